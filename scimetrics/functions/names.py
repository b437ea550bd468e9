"""Column and label names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snake_case(name: str) -> str:
    """``P(gf)`` -> ``p_gf``, ``H.index_auth`` -> ``h_index_auth``, ``PaperID`` -> ``paper_id``."""
    words = name.replace("%", " percent ").replace("#", " number ")
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", words)
    words = re.sub(r"([A-Z])([A-Z][a-z])", r"\1 \2", words)
    return "_".join(re.findall(r"[a-z0-9]+", words.lower())) or "x"


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column to unique snake case; repeated names get ``_2``, ``_3``…"""
    seen: dict[str, int] = {}
    renamed = []
    for column in df.columns:
        name = column if column.startswith("_") else snake_case(column)
        seen[name] = seen.get(name, 0) + 1
        renamed.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*renamed)


def safe_label(label: Column) -> Column:
    """A file-safe form of a label column."""
    joined = F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_")
    return F.regexp_replace(joined, "^_+|_+$", "")


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """The columns from ``first`` to ``last`` in table order, both included."""
    return df.columns[df.columns.index(first) : df.columns.index(last) + 1]
