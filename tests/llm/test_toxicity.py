import numpy as np

from scimetrics.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").orderBy("doc_id")
    chain = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    held = labels.where("doc_id % 3 = 0").select("doc_id", labels.toxic.alias("truth"))
    rows = toxicity.score(docs, chain).join(held, "doc_id").select("truth", "toxicity.toxic").collect()
    wrong = sum(bool(r.truth) != r.toxic for r in rows)
    assert len(rows) > 1000 and wrong <= 0.03 * len(rows)


def test_later_models_see_earlier_probabilities():
    rng = np.random.default_rng(0)
    x = (rng.random((400, 20)) < 0.3).astype(np.float32)
    y0 = x[:, 0]
    # the second category follows the first one through a feature of its own that is weak
    y = np.stack([y0, y0], axis=1).astype(float)
    models = toxicity.fit_chain(x, y, np.arange(400) % 5)
    assert len(models[0].chain) == 0 and models[1].chain[0] > 0.5


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, "idiot words here", "en", 0), (2, None, None, 0), (None, "x", "en", 0), (1, "idiot words here", "en", 0)],
        "doc_id long, text string, lang string, toxicity int",
    )
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, none)
    assert toxicity.score(docs, chain).count() == 4
    one = spark.createDataFrame([(1, None, 1), (None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, one)).select("toxicity.*").collect()
    assert len(rows) == 4 and all(0 <= p <= 1 for r in rows for p in tuple(r)[:4])
    assert toxicity.score(docs.limit(0), chain).collect() == []


def test_whole_texts_are_read(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    chain = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    long = "the of and " * 100_000
    p = chain.probabilities([long, long + "idiot moron scum stupid loser"])
    assert p[0, -1] < 0.5 < p[1, -1]
