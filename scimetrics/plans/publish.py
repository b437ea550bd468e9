"""The job that writes every dataset, each base table once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scimetrics.operators.dedupe import ORDER
from scimetrics.plans import base_tables, collaboration, cooccurrence, disciplines, network, nouns, papers, people
from scimetrics.sources.writers import write_cells, write_ordered, write_partitioned, write_table


class Folder:
    """Tables of an output folder: written once, then read back by what needs them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, name: str, df: DataFrame) -> DataFrame:
        write_table(df, f"{self.path}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def write_datasets(
    spark: SparkSession,
    folder: str,
    raw: DataFrame,
    countries: DataFrame,
    main_affiliation: DataFrame,
    gender: DataFrame,
    main_field: DataFrame,
    top_of_sub: DataFrame,
    stem: str,
    stem_label: str,
    suffixes: tuple[str, ...] = (),
) -> None:
    """Write base tables, summaries, pairs, flows, nouns and networks below ``folder``.

    ``raw`` is the flat frame with row order, the others are the side tables as
    they are read. A later table reads earlier ones from the folder, never the
    flat frame. Tables that the order of rows matters for keep ``_seq``.
    Sorted output is in total order over its files, read by name.
    """
    out = Folder(spark, folder)
    authors = out.save("authors", base_tables.authors(raw))
    affiliations = out.save("affiliations", base_tables.affiliations(raw, countries))
    main_aff = out.save("author_main_aff", base_tables.author_main_aff(main_affiliation))
    genders = out.save("author_gender", base_tables.author_gender(gender))
    ordered = ORDER in main_field.columns
    main_fields = out.save("author_main_field", base_tables.author_main_field(main_field, ordered))
    paper = out.save("papers", base_tables.papers(raw))
    paa = out.save("papers_auth_aff", base_tables.papers_auth_aff(raw, keep_order=True))
    fields = out.save("papers_fields", base_tables.papers_fields(raw, keep_order=True))
    write_table(base_tables.papers_titles(raw), f"{out.path}/papers_titles")
    write_partitioned(base_tables.papers_abstracts(raw), f"{out.path}/papers_abstracts", ["year"])
    abstracts = out.read("papers_abstracts")

    extra = people.authors_extra(authors, main_fields.drop(ORDER), fields, genders, main_aff, affiliations)
    extra = out.save("authors_extra", extra)
    summary = out.save("papers_summary", papers.papers_summary(paper, paa, fields, affiliations))
    write_table(papers.venue_counts(summary), f"{out.path}/venue_counts")
    write_ordered(people.papers_gender(paa, extra), f"{out.path}/papers_gender", ["paper_id", "name_gender"])
    write_table(people.gender_totals(out.read("papers_gender")), f"{out.path}/gender_totals")

    pairs = out.save("collab_authors", collaboration.collab_authors(paa, paper))
    write_table(collaboration.collab_institutions(paa, paper), f"{out.path}/collab_institutions")

    author_fields = disciplines.author_fields(main_fields, fields, top_of_sub)
    collab_fields = out.save("collab_author_fields", disciplines.collab_author_fields(paa, author_fields))
    write_table(disciplines.multidiscipline_index(collab_fields), f"{out.path}/multidiscipline_index")
    flows = out.save("papers_auth_fields", disciplines.papers_auth_fields(paper, fields, collab_fields))
    write_cells(disciplines.field_edges(flows), f"{out.path}/field_edges", sort=[F.desc("weight")])

    rules = {"suffixes": suffixes} if suffixes else {}
    counted = out.save("abstract_nouns", nouns.abstract_nouns(abstracts, **rules))
    by_field = nouns.field_nouns(counted, fields, paper)
    write_partitioned(by_field, f"{out.path}/field_nouns", ["file_field"])
    by_field = out.read("field_nouns")
    write_cells(nouns.top_nouns(by_field), f"{out.path}/top_nouns", sort=[F.desc("n")])
    together = cooccurrence.top_cooccurrence(by_field, stem, stem_label)
    together = out.save("top_cooccurrence", together)
    write_cells(cooccurrence.cooccurrence_edges(together), f"{out.path}/cooccurrence_edges")
    write_cells(cooccurrence.cooccurrence_nodes(together), f"{out.path}/cooccurrence_nodes")

    network.publish_networks(network.network_edges(summary, fields, pairs), f"{out.path}/networks")
