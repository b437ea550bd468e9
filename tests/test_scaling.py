"""What a job reads and holds: written once, bounded state."""

from pathlib import Path

import pytest

from scimetrics import registry
from scimetrics.operators.graph import centrality, krylov, paths
from scimetrics.operators.graph.network import build_network
from scimetrics.session import materialize
from scimetrics.sources.testdata import Inputs

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


def flat_frames(df):
    """How often the plan builds the flat frame anew."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")


def test_krylov_state_holds_two_vectors(spark, monkeypatch):
    monkeypatch.setattr(krylov, "BLOCK", 8)
    monkeypatch.setattr(krylov, "STRIPE", 4)
    held, step = [], krylov._step

    def watched(state, edges):
        size = "octet_length(last) + octet_length(before)"
        held.append(state.selectExpr(f"max({size}) AS held").first()["held"])
        return step(state, edges)

    monkeypatch.setattr(krylov, "_step", watched)
    chain = [("f", "q", k, k + 1) for k in range(24)]
    network = build_network(spark.createDataFrame(chain, "field string, quin string, from long, to long"))
    centrality.eigenvector(network).collect()
    assert len(held) > 5
    assert max(held) <= 2 * 8 * 8


def test_search_shuffles_two_columns_of_bits(spark, monkeypatch):
    made = []

    def watched(df, label):
        made.append((label, df.columns))
        return materialize(df, label)

    monkeypatch.setattr(paths, "materialize", watched)
    wheel = [("f", "q", k, (k + 1) % 150) for k in range(150)] + [("f", "q", 0, 0)]
    network = build_network(spark.createDataFrame(wheel, "field string, quin string, from long, to long"))
    for words in (1, 3):
        got = {r["id"]: r.asDict() for r in paths.reach(network, words=words).collect()}
        assert set(got) == set(range(150))
        expected = {"reached": 149, "distance": 2 * 74 * 75 // 2 + 75, "eccentricity": 75, "within_1": 3, "within_2": 5}
        assert all({k: r[k] for k in expected} == expected for r in got.values())
    assert not any("distance" in columns for _, columns in made)
    made.clear()
    paths.reach(network, max_hops=2).collect()
    assert [label for label, _ in made] == ["positions", "reach-1"]


@tables
def test_edges_build_the_flat_frame_once_more(spark):
    # the years and the rows of the papers are written; the fields are read from the frame
    assert flat_frames(registry._edges(Inputs(spark, FOLDER))) == 1


@tables
def test_noun_steps_read_written_tables(spark):
    inputs = Inputs(spark, FOLDER)
    assert flat_frames(inputs.field_nouns) == 3
    assert flat_frames(registry._top_cooccurrence(inputs)) == 0
    assert flat_frames(registry.DATASETS["top_nouns"](inputs)) == 0


@tables
def test_narrow_tables_carry_no_other_columns(spark):
    plans = {
        "papers_summary": ("official_page", "hit_1pct"),
        "collab_institutions": ("doi", "original_venue"),
        "field_grid": ("doi", "hit_1pct"),
        "field_nouns": ("doi", "hit_1pct"),
    }
    for name, unused in plans.items():
        plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert not [column for column in unused if f"{column}#" in plan], name


SHARED = {
    "net_edges_full": lambda d: registry._edges(d, "full"),
    "papers_summary": registry._papers_summary,
    "papers_gender": registry._papers_gender,
    "papers_auth_fields": registry._papers_auth_fields,
    "collab_authors": registry.DATASETS["collab_authors"],
    "collab_institutions": registry.DATASETS["collab_institutions"],
    "field_nouns": lambda d: d.field_nouns,
}


@tables
@pytest.mark.parametrize("name", SHARED)
def test_tables_are_joined_once(spark, name):
    made = []

    class Watched(Inputs):
        def _joined(self, *located):
            made.append(1)
            return super()._joined(*located)

    d = Watched(spark, FOLDER)
    SHARED[name](d)
    # authors and affiliations with their names are read beside the written rows
    assert len(made) == (2 if name == "papers_gender" else 1)


@tables
def test_written_rows_keep_the_order(spark):
    d = Inputs(spark, FOLDER)
    struct = d.raw.selectExpr("_seq as s", "struct(paper_id, author_id, affiliation_id, field_id) as r").collect()
    number = d.core_raw.selectExpr("_seq as s", "struct(paper_id, author_id, affiliation_id, field_id) as r").collect()
    assert len({r["s"] for r in number}) == len(number)
    assert [r["r"] for r in sorted(number)] == [r["r"] for r in sorted(struct)]
