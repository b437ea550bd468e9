"""Statements for the base tables, summaries, pairs, fields and nouns."""

from oracles.common import QUIN_BREAKS, QUIN_FIRST, QUIN_RANGE, STOP, statement

_PAPER = "doi, year, CAST(date AS VARCHAR) AS date, journal_id, original_venue, reference_count, citation_count"

TABLES = {
    "authors": statement("SELECT * FROM t_authors"),
    "affiliations_regions": statement("SELECT * FROM t_affiliations"),
    "author_main_aff": statement("SELECT * FROM t_main_aff"),
    "author_gender": statement("SELECT * FROM t_gender"),
    "author_main_field": statement("SELECT * FROM t_main_field"),
    "papers": statement(f"SELECT paper_id, {_PAPER} FROM t_papers"),
    "papers_auth_aff": statement(
        "SELECT paper_id, author_id, affiliation_id, author_sequence_number FROM t_paa"
    ),
    "papers_titles": statement(
        "SELECT paper_id, paper_title, year FROM raw QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY seq)=1"
    ),
    "papers_fields": statement("SELECT * EXCLUDE (seq) FROM t_fields"),
    "papers_abstracts": statement("SELECT paper_id, paper_abstract, year FROM t_abstracts"),
    "authors_extra": statement("SELECT * FROM t_extra"),
    "papers_summary": statement(
        f"SELECT paper_id, {_PAPER}, author_count, affiliation_count, top_field_count, sub_field_count,"
        " countries_count, is_int_collab FROM t_summary"
    ),
    "venue_counts": statement("SELECT original_venue, count(*) AS n FROM t_papers GROUP BY 1"),
    "papers_gender": statement("SELECT * FROM t_papers_gender"),
    "gender_totals": statement(
        "SELECT name_gender, CAST(sum(n) AS BIGINT) AS author_gender FROM t_papers_gender GROUP BY 1"
    ),
    "collab_authors": statement("SELECT * FROM t_collab"),
    "collab_authors_canonical": statement(
        """
SELECT a.paper_id, least(a.author_id, b.author_id) AS author_1, greatest(a.author_id, b.author_id) AS author_2, p.year
FROM (SELECT DISTINCT paper_id, author_id FROM t_paa) a
JOIN (SELECT DISTINCT paper_id, author_id FROM t_paa) b ON a.paper_id=b.paper_id AND a.author_id < b.author_id
JOIN t_papers p ON p.paper_id=a.paper_id"""
    ),
    "collab_institutions": statement(
        """
SELECT a.paper_id, a.affiliation_id AS institution_1, b.affiliation_id AS institution_2, p.year
FROM t_inst a JOIN t_inst b ON a.paper_id=b.paper_id AND a.seq < b.seq JOIN t_papers p ON p.paper_id=a.paper_id"""
    ),
    "multidiscipline_index": statement(
        """
SELECT paper_id, round(0.0 - sum((n/total) * ln(n/total)), 9) + 0.0 AS multidisciplinarity_messure
FROM (SELECT paper_id, author_subfield, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY paper_id)::DOUBLE AS total
      FROM t_collab_fields GROUP BY 1,2) GROUP BY 1"""
    ),
    "papers_auth_fields": statement("SELECT * FROM t_paper_auth_fields"),
    "field_edges": statement(
        """
SELECT paper_field AS field, quin, paper_field AS "from", author_field AS "to", count(*) AS weight
FROM t_paper_auth_fields WHERE author_field IS NOT NULL AND quin IS NOT NULL GROUP BY 1,2,4"""
    ),
    "field_grid": statement(
        """
SELECT field, quin FROM (SELECT DISTINCT paper_field AS field FROM t_paper_auth_fields)
CROSS JOIN (SELECT unnest(['1990-1994','1995-1999','2000-2004','2005-2009','2010-2014','2015-2019','2020-2021']) AS quin)"""
    ),
    "lang_detect": statement("SELECT paper_id, year, lang FROM t_lang"),
    "abstract_nouns": statement("SELECT * FROM t_nouns"),
    "field_nouns": statement("SELECT * FROM t_field_nouns"),
    "field_nouns_strict": statement("SELECT * FROM t_field_nouns WHERE file_field = field_name"),
    "top_nouns": statement(
        f"""
SELECT file_field AS field, quin, lemma, n, round(n / total, 9) AS rel_freq FROM (
  SELECT *, sum(n) OVER (PARTITION BY file_field, quin)::DOUBLE AS total,
    rank() OVER (PARTITION BY file_field, quin ORDER BY n DESC) AS r
  FROM (SELECT file_field, {QUIN_RANGE} AS quin, field_name, lemma, CAST(sum(n) AS BIGINT) AS n FROM t_field_nouns
        WHERE year BETWEEN 1990 AND 2021 AND length(lemma) > 2 AND lemma NOT IN ({STOP}) GROUP BY 1,2,3,4))
WHERE r <= 100"""
    ),
    "top_cooccurrence": statement("SELECT * FROM t_top_co"),
    "cooccurrence_edges": statement(
        """
SELECT top_field AS field, quin, lemma_1 AS "from", lemma_2 AS "to", freq AS value,
 concat('Frequency: ', CAST(freq AS VARCHAR)) AS title FROM t_top_co"""
    ),
    "cooccurrence_nodes": statement(
        """
SELECT top_field AS field, quin, lemma AS id, lemma AS label, CAST(sum(freq) AS BIGINT) AS value,
 round(ln(1 + sum(freq)), 9) AS value_log
FROM (SELECT top_field, quin, lemma_1 AS lemma, freq FROM t_top_co UNION ALL SELECT top_field, quin, lemma_2, freq FROM t_top_co)
GROUP BY 1,2,3"""
    ),
    "quin_bins": statement(
        f"""
SELECT year, {QUIN_BREAKS} AS by_breaks, {QUIN_RANGE} AS by_label, {QUIN_FIRST} AS by_first_year, count(*) AS papers
FROM t_papers GROUP BY year"""
    ),
    "uncount": statement(
        "SELECT paper_id, lemma FROM (SELECT paper_id, lemma, unnest(range(n)) AS i FROM t_nouns)"
    ),
    "complete_grid": statement(
        """
SELECT k.paper_id, k.field_type, coalesce(c.n, 0) AS n FROM
 (SELECT * FROM (SELECT DISTINCT paper_id FROM t_fields) CROSS JOIN (SELECT DISTINCT field_type FROM t_fields)) k
LEFT JOIN (SELECT paper_id, field_type, count(*) AS n FROM t_fields GROUP BY 1,2) c
  ON c.paper_id=k.paper_id AND c.field_type=k.field_type"""
    ),
}
