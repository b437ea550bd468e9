"""The driver's tables read as bibliographic inputs.

paper = order, author = part, affiliation = supplier, country = nation, sub
field = brand, top field = brand number mod 5, abstract = document of that key.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scimetrics.plans import base_tables, disciplines, nouns
from scimetrics.session import WorkTables, materialize
from scimetrics.sources.readers import as_raw

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
        "l_extendedprice double, l_shipdate timestamp_ntz"
    ),
    "documents": "doc_id long, text string",
}

#: Columns of the joined tables that keys, years, fields, countries and abstracts come from.
CORE = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_extendedprice l_shipdate p_brand n_nationkey "
    "o_custkey o_totalprice o_orderdate o_orderpriority"
).split()

#: What the rows of the joined tables are ordered by; the two rows that each becomes follow by their kind.
SEQUENCE = "l_orderkey l_linenumber l_partkey l_suppkey l_shipdate l_extendedprice".split()

NOUN_SUFFIXES = ("ion", "er", "ing", "nd", "th")
STEM, STEM_LABEL = "thin", "thin"


class Inputs:
    """Raw frame and side inputs over one data folder, with the base tables on top."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        """The flat frame without abstracts, which only their own table needs."""
        return self._flat(with_text=False)

    @cached_property
    def core(self) -> DataFrame:
        """The joined tables in the columns of CORE, written once for all tables that are built from them alone.

        They are written in their order, so that a number made of file and row says it in place of six columns.
        Lineitems that have met parts and suppliers are written before they meet the orders, which frees their shuffles.
        """
        with WorkTables(self.spark) as work:
            located = work.keep(self._located().select(*[c for c in CORE if not c.startswith("o_")]), "located")
            ordered = self._joined(located).select(*CORE).repartitionByRange(*SEQUENCE).sortWithinPartitions(*SEQUENCE)
            written = materialize(ordered.withColumn("place", F.monotonically_increasing_id()), "joined")
        # equal by the join, which a plan over the written rows does not know
        return written.withColumn("o_orderkey", F.col("l_orderkey"))

    @cached_property
    def core_raw(self) -> DataFrame:
        """The flat frame without names and other figures of authors and affiliations."""
        return self._flat(with_text=False, joined=self.core)

    def _located(self) -> DataFrame:
        return (
            self.table("lineitem")
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        )

    def _joined(self, located: DataFrame | None = None) -> DataFrame:
        """Orders come last: their key is the paper's, so what follows finds its rows in place."""
        located = self._located() if located is None else located
        return located.join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))

    def _flat(self, with_text: bool, joined: DataFrame | None = None) -> DataFrame:
        """The flat frame, of ``core`` without what describes authors and affiliations."""
        brand = F.substr("p_brand", F.lit(7)).cast("int")
        sub = F.col("kind") == "Sub"
        if joined is None:
            order = F.struct(*SEQUENCE, "kind")
        else:
            order = F.col("place") * 2 + F.when(sub, 0).otherwise(1)
        no_affiliation = F.col("l_linenumber") == 7
        per_mille = F.col("o_orderkey") % 100

        def known(value):
            return F.when(~no_affiliation, value)

        country = (
            F.when(F.col("n_nationkey") == 0, "TW")
            .when(F.col("n_nationkey") == 1, None)
            .otherwise(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")))
        )
        described = joined is None
        joined = self._joined() if described else joined
        describing = [
            F.col("p_name").alias("Author_Name"),
            F.col("p_size").alias("H.index_auth"),
            (F.col("p_size") * 2).alias("Productivity_auth"),
            F.col("p_retailprice").alias("Average_C10_auth"),
            F.log1p("p_retailprice").alias("Average_LogC10_auth"),
            known(F.col("s_name")).alias("Affiliation_Name"),
            F.concat(F.lit("grid."), F.col("s_suppkey").cast("string")).alias("GridID"),
            F.concat(F.lit("http://"), F.col("s_name")).alias("Official_Page"),
            (F.col("s_suppkey") % 90).cast("double").alias("Latitude_aff"),
            (F.col("s_suppkey") % 180).cast("double").alias("Longitude_aff"),
            F.floor("s_acctbal").cast("int").alias("Productivity_aff"),
            (F.col("s_acctbal") / 10).alias("Average_C10_aff"),
            F.log1p(F.abs("s_acctbal")).alias("Average_LogC10_aff"),
            known(F.col("n_name")).alias("name"),
        ]
        text = []
        if with_text:
            written = F.col("doc_id") == F.col("o_orderkey")
            joined = joined.join(self.table("documents"), written, "left")
            text = [F.when(F.col("o_orderkey") % 97 == 0, "").otherwise(F.col("text")).alias("ab")]
        joined = joined.withColumn("kind", F.explode(F.lit(["Sub", "Top"])))
        return as_raw(
            joined.select(
                F.col("l_orderkey").alias("PaperID"),
                F.col("l_partkey").alias("AuthorID"),
                known(F.col("l_suppkey")).alias("AffiliationID"),
                F.col("l_linenumber").alias("AuthorSequenceNumber"),
                *(describing if described else []),
                known(country).alias("ISO3166Code"),
                F.concat(F.lit("10.0/"), F.col("o_orderkey").cast("string")).alias("DOI"),
                (1988 + F.col("o_orderkey") % 36).cast("int").alias("Year"),
                F.col("o_orderdate").cast("date").alias("Date"),
                (F.col("o_custkey") % 50).alias("JournalID"),
                F.col("o_orderpriority").alias("OriginalVenue"),
                (F.col("o_orderkey") % 60).cast("int").alias("ReferenceCount"),
                F.floor(F.col("o_totalprice") / 1000).cast("int").alias("CitationCount"),
                F.concat(F.lit("Paper "), F.col("o_orderkey").cast("string")).alias("PaperTitle"),
                F.when(sub, 100 + brand).otherwise(1000 + brand % 5).alias("FieldID"),
                F.when(sub, F.col("p_brand"))
                .otherwise(F.concat(F.lit("Top_"), (brand % 5).cast("string")))
                .alias("Field_Name"),
                F.col("kind").alias("Field_Type"),
                (per_mille < 1).cast("int").alias("Hit_1pct"),
                (per_mille < 5).cast("int").alias("Hit_5pct"),
                (per_mille < 10).cast("int").alias("Hit_10pct"),
                (F.col("o_totalprice") / 1000).alias("C_f"),
                *text,
                order.alias("_seq"),
            )
        )

    @cached_property
    def countries(self) -> DataFrame:
        """Codes N2…N24; Taiwan is left to the override and nation 1 has no code."""
        nation, region = self.table("nation"), self.table("region")
        return (
            nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
            .where(F.col("n_nationkey") > 1)
            .select(
                F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("iso2c"),
                F.col("r_name").alias("subregion_un"),
                F.col("r_name").alias("region"),
            )
        )

    @cached_property
    def main_affiliation_tsv(self) -> DataFrame:
        suppliers = self.table("supplier").agg(F.count("*").alias("n")).scalar()
        return self.table("part").select(
            F.col("p_partkey").alias("AuthorID"),
            (F.col("p_partkey") % suppliers).alias("AffiliationID"),
        )

    @cached_property
    def gender_tsv(self) -> DataFrame:
        share = (F.col("p_size") % 41) / 40.0
        return self.table("part").select(
            F.col("p_partkey").alias("AuthorID"),
            F.when(F.col("p_size") != 13, share).alias("P(gf)"),
        )

    @cached_property
    def main_field_tsv(self) -> DataFrame:
        """Every tenth author has no main field, to exercise unmatched joins."""
        return (
            self.table("part")
            .where(F.col("p_partkey") % 10 != 0)
            .select(
                F.col("p_partkey").alias("AuthorID"),
                (100 + F.substr("p_brand", F.lit(7)).cast("int")).alias("field_predominant_all"),
                F.lit("Sub").alias("type_predominant_all"),
            )
        )

    @cached_property
    def top_of_sub(self) -> DataFrame:
        """Top field per brand; brand 3 has a second one that must lose."""
        number = F.substr("p_brand", F.lit(7)).cast("int")
        top = F.concat(F.lit("Top_"), (number % 5).cast("string"))
        second = F.struct(F.lit("Top_9").alias("topfield_name"), F.lit(2).alias("ordinal"))
        first = F.struct(top.alias("topfield_name"), F.lit(1).alias("ordinal"))
        rows = F.when(number == 3, F.array(first, second)).otherwise(F.array(first))
        brands = self.table("part").select("p_brand").distinct()
        return brands.select(F.col("p_brand").alias("subfield_name"), F.inline(rows))

    @cached_property
    def authors(self) -> DataFrame:
        return base_tables.authors(self.raw)

    @cached_property
    def affiliations(self) -> DataFrame:
        return base_tables.affiliations(self.raw, self.countries)

    @cached_property
    def author_main_aff(self) -> DataFrame:
        return base_tables.author_main_aff(self.main_affiliation_tsv)

    @cached_property
    def author_gender(self) -> DataFrame:
        return base_tables.author_gender(self.gender_tsv)

    @cached_property
    def author_main_field(self) -> DataFrame:
        return base_tables.author_main_field(self.main_field_tsv)

    @cached_property
    def papers(self) -> DataFrame:
        return base_tables.papers(self.core_raw)

    @cached_property
    def paper_years(self) -> DataFrame:
        """``papers`` for those who need the year alone."""
        return base_tables.papers(self.core_raw, ("paper_id", "year"))

    @cached_property
    def papers_auth_aff(self) -> DataFrame:
        """Written, as the datasets of pairs and counts read it several times."""
        return materialize(base_tables.papers_auth_aff(self.core_raw, keep_order=True), "paper-rows")

    @cached_property
    def papers_fields(self) -> DataFrame:
        return base_tables.papers_fields(self.core_raw, keep_order=True)

    @cached_property
    def field_names(self) -> DataFrame:
        """``papers_fields`` for those who need names and types alone."""
        columns = ("paper_id", "field_id", "field_name", "field_type")
        return base_tables.papers_fields(self.core_raw, keep_order=True, columns=columns)

    @cached_property
    def affiliation_countries(self) -> DataFrame:
        """``affiliations`` for those who need the country alone."""
        return base_tables.affiliations(self.core_raw, self.countries, ("affiliation_id", "iso3166_code"))

    @cached_property
    def abstracts(self) -> DataFrame:
        return base_tables.papers_abstracts(self._flat(with_text=True, joined=self.core))

    @cached_property
    def collab_author_fields(self) -> DataFrame:
        fields = disciplines.author_fields(
            self.author_main_field, self.field_names, self.top_of_sub
        )
        return disciplines.collab_author_fields(self.papers_auth_aff, fields)

    @cached_property
    def nouns(self) -> DataFrame:
        return nouns.abstract_nouns(self.abstracts, suffixes=NOUN_SUFFIXES)

    @cached_property
    def field_nouns(self) -> DataFrame:
        return nouns.field_nouns(self.nouns, self.field_names, self.paper_years)
