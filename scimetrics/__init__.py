"""Scientometric tables, text statistics and co-author networks as Spark jobs."""
