"""The job that writes every dataset, over the smallest data folder."""

from pathlib import Path

import pytest

from scimetrics.operators.graph import structure
from scimetrics.plans.publish import write_datasets
from scimetrics.sources.testdata import NOUN_SUFFIXES, STEM, STEM_LABEL, Inputs
from scimetrics.registry import DATASETS, rounded

FOLDER = "/root/testdata/sf0.001"
NETWORK = {
    "net_edges": "networks/edges",
    "net_summary": "networks/summary",
    "net_strength": "networks/vertices",
    "net_clustering": "networks/vertices",
}


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
def test_written_tables_equal_the_queries(spark, tmp_path, monkeypatch):
    # the other metrics of the vertex table have tests of their own
    monkeypatch.setattr("scimetrics.plans.network.vertex_metrics", structure.clustering)
    d, out = Inputs(spark, FOLDER), str(tmp_path / "out")
    write_datasets(
        spark, out, d._flat(with_text=True), d.countries, d.main_affiliation_tsv, d.gender_tsv, d.main_field_tsv,
        d.top_of_sub, STEM, STEM_LABEL, NOUN_SUFFIXES,
    )
    for name in (
        "papers_fields papers_abstracts venue_counts papers_gender collab_authors field_edges field_nouns top_cooccurrence "
        "net_edges net_summary net_strength net_clustering"
    ).split():
        want = DATASETS[name](d)
        columns = [c for c in want.columns if c != "_seq"]
        want, got = want.select(columns), spark.read.parquet(f"{out}/{NETWORK.get(name, name)}").select(columns)
        if name in NETWORK:
            got = rounded(got, *[c for c, kind in got.dtypes if kind == "double"])
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), name
    assert (tmp_path / "out" / "papers_abstracts" / "year=1990").exists()
    files = sorted((tmp_path / "out" / "papers_gender").glob("*.parquet"))
    keys = [(r.paper_id, r.name_gender) for f in files for r in spark.read.parquet(str(f)).collect()]
    assert keys == sorted(keys)
