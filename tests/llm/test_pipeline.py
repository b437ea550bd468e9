import corpus_pipeline
from scimetrics.llm import queries
from __spark_entry__ import queries as registered

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    toxic = {
        r.doc_id for r in queries.op2_toxicity(spark, FOLDER).where("not kept").collect()
    }
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, before, FOLDER), name)
        assert after.columns == docs.columns
        kept, had = {r.doc_id for r in after.select("doc_id").collect()}, {r.doc_id for r in before.select("doc_id").collect()}
        assert kept <= had
        if name == "toxicity":
            assert had - kept == toxic
        if name == "secrets":
            assert kept == had
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER)
    assert last.count() == before.count()


def test_all_are_registered():
    names = set(registered())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
