"""Reading and writing round trips."""

from pyspark.sql import functions as F

from scimetrics.plans import base_tables
from scimetrics.sources import readers, writers
from tests.test_verbs import rows


def test_tsv_columns_and_missing(spark, tmp_path):
    path = tmp_path / "gender.tsv"
    path.write_text("other\tAuthorID\tP(gf)\nx\t1\t0.9\ny\tbad\tNA\n")
    tsv = readers.read_tsv(spark, str(path), readers.GENDER_SCHEMA)
    assert rows(base_tables.author_gender(tsv)) == [(1, 0.9, "female"), (None, None, "indeterminate")]
    path.write_text("AuthorID\tfield_predominant_all\ttype_predominant_all\n1\t7\tSub\n")
    tsv = readers.read_tsv(spark, str(path), readers.MAIN_FIELD_SCHEMA)
    assert rows(base_tables.author_main_field(tsv)) == [(1, 7, "Sub")]
    path.write_text("AuthorID\tAffiliationID\n1\t7\n")
    tsv = readers.read_tsv(spark, str(path), readers.MAIN_AFFILIATION_SCHEMA)
    assert rows(base_tables.author_main_aff(tsv)) == [(1, 7)]


def test_raw_order_comes_from_the_file(spark, tmp_path):
    path = str(tmp_path / "raw")
    df = spark.createDataFrame([("1", "b"), ("1", "a"), ("x", "c")], "PaperID string, `H.index_auth` string")
    df.coalesce(1).write.parquet(path)
    raw = readers.read_raw(spark, path)
    assert raw.columns == ["paper_id", "h_index_auth", "_seq"]
    from scimetrics.operators.dedupe import keep_first

    assert rows(keep_first(raw, ["paper_id"])) == [(1, "b"), (None, "c")]


def test_noun_folder_skips_bad_rows(spark, tmp_path):
    (tmp_path / "1.csv").write_text("paper_id,lemma,n\n1,cell,2\n1,broken\n")
    (tmp_path / "2.csv").write_text("paper_id,lemma,n\n2,water,1\n")
    found = readers.read_nouns(spark, str(tmp_path))
    assert (1, "cell", 2) in rows(found) and (2, "water", 1) in rows(found)
    assert "broken" not in [r.lemma for r in found.collect()]


def test_rejected_rows_are_counted(spark, tmp_path):
    (tmp_path / "1.csv").write_text("paper_id,lemma,n\n1,cell,2\n1,broken\nx,cell,3\n")
    (tmp_path / "2.csv").write_text("paper_id,lemma,n\n2,water,1\n")
    (found,) = readers.rejected_nouns(spark, str(tmp_path)).collect()
    assert found.rejected == 2 and found.file.endswith("1.csv")
    assert rows(readers.read_nouns(spark, str(tmp_path))) == [(1, "cell", 2), (2, "water", 1)]


def test_skipped_files_are_listed(spark, tmp_path):
    (tmp_path / "1.csv").write_text("paper_id,lemma,n\n1,cell,2\n")
    (tmp_path / "2.csv.gz").write_bytes(b"no gzip data")
    (tmp_path / "3.csv").write_text("")
    (found,) = readers.skipped_files(spark, str(tmp_path)).collect()
    assert found.file.endswith("2.csv.gz") and found.length == 12
    assert rows(readers.read_nouns(spark, str(tmp_path))) == [(1, "cell", 2)]


def files_in_order(spark, folder):
    return [[tuple(r) for r in spark.read.parquet(str(f)).collect()] for f in sorted(folder.glob("*.parquet"))]


def test_ordered_files_are_one_sorted_table(spark, tmp_path):
    df = spark.range(4000).selectExpr("if(id % 3 = 0, 7, id % 50) AS a", "hash(id) AS b", "id")
    shuffled = df.repartition(5)
    with_one_file_per_range = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in with_one_file_per_range}
    for key, value in with_one_file_per_range.items():
        spark.conf.set(key, value)
    try:
        writers.write_ordered(shuffled, str(tmp_path / "t"), [F.desc("a")])
        writers.write_cells(
            shuffled.selectExpr("'f' AS field", "if(a = 7, 'hot', 'rest') AS quin", "b", "id"),
            str(tmp_path / "c"),
            sort=[F.desc("b")],
        )
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    files = files_in_order(spark, tmp_path / "t")
    together = [r for f in files for r in f]
    assert len(together) == 4000
    assert together == sorted(together, key=lambda r: (-r[0], r[1], r[2]))
    assert sum(any(r[0] == 7 for r in f) for f in files) > 1
    for cell in ("hot", "rest"):
        parts = files_in_order(spark, tmp_path / "c" / "field=f" / f"quin={cell}")
        values = [r[0] for f in parts for r in f]
        assert len(parts) > 1 and values == sorted(values, reverse=True)


def test_equal_file_names_keep_their_order(spark, tmp_path):
    df = spark.createDataFrame([(1, a) for a in range(4)], "PaperID long, AuthorID long")
    for name, part in (("a", df.where("AuthorID < 2")), ("b", df.where("AuthorID >= 2"))):
        part.coalesce(1).write.parquet(str(tmp_path / "made" / name))
        folder = tmp_path / "raw" / f"part={name}"
        folder.mkdir(parents=True)
        written = next((tmp_path / "made" / name).glob("part-*.parquet"))
        (folder / "data.parquet").write_bytes(written.read_bytes())
    raw = readers.read_raw(spark, str(tmp_path / "raw"))
    assert raw.select("_seq").distinct().count() == 4


def test_tsv_keeps_its_row_order(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("A\tB\n" + "".join(f"{i % 3}\t{9 - i}\n" for i in range(9)))
    df = readers.read_tsv(spark, str(tmp_path / "f.tsv"), "A long, B long")
    assert [r.B for r in df.orderBy("_seq").collect()] == list(range(9, 0, -1))


def test_file_names_become_labels(spark, tmp_path):
    spark.range(1).coalesce(1).write.parquet(str(tmp_path / "made"))
    part = next((tmp_path / "made").glob("part-*.parquet"))
    folder = tmp_path / "fields"
    folder.mkdir()
    (folder / "art_nouns.parquet").write_bytes(part.read_bytes())
    assert rows(readers.read_labelled(spark, str(folder), "_nouns", "field")) == [(0, "art")]


def test_partitioned_and_resumed_cells(spark, tmp_path):
    path = str(tmp_path / "cells")
    cells = spark.createDataFrame([("A", "q1", 1), ("B", "q1", 2)], "field string, quin string, v int")
    grid = cells.select("field", "quin")
    assert writers.missing_cells(grid, path).count() == 2
    writers.write_cells(cells.where("field = 'A'"), path)
    assert rows(writers.missing_cells(grid, path)) == [("B", "q1")]
    writers.write_cells(cells.where("field = 'B'"), path)
    assert spark.read.parquet(path).count() == 2
    writers.write_cells(cells.where("field = 'B'").withColumn("v", F.lit(9)), path)
    assert rows(spark.read.parquet(path).select("field", "v")) == [("A", 1), ("B", 9)]


def test_year_partitions(spark, tmp_path):
    path = str(tmp_path / "abstracts")
    df = spark.createDataFrame([(1, 1990), (2, 1991)], "paper_id long, year int")
    writers.write_partitioned(df, path, ["year"])
    assert rows(spark.read.parquet(path).where("year = 1991")) == [(2, 1991)]
    writers.write_table(df, str(tmp_path / "plain"))
    assert spark.read.parquet(str(tmp_path / "plain")).count() == 2


def test_stopwords(spark):
    table = readers.stopword_table(spark)
    words = [r.stopword for r in table.collect()]
    assert words.count("data") == 2 and "n°" in words


def test_tables_by_name(spark):
    readers.name_tables({"papers_of_test": spark.range(2)})
    assert spark.table("papers_of_test").count() == 2
