"""Named subqueries shared by the statements."""

import re

from scimetrics.functions.wordlists import STOPWORDS

STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(STOPWORDS)))
QUIN_BREAKS = """CASE WHEN year BETWEEN 1990 AND 1994 THEN '1990-1994' WHEN year BETWEEN 1995 AND 1999 THEN '1995-1999'
 WHEN year BETWEEN 2000 AND 2004 THEN '2000-2004' WHEN year BETWEEN 2005 AND 2009 THEN '2005-2009'
 WHEN year BETWEEN 2010 AND 2014 THEN '2010-2014' WHEN year BETWEEN 2015 AND 2019 THEN '2015-2019'
 WHEN year BETWEEN 2020 AND 2022 THEN '2020-2021' END"""
QUIN_RANGE = QUIN_BREAKS.replace("2020 AND 2022", "2020 AND 2021")
QUIN_FIRST = """CASE year WHEN 1990 THEN '1990-1994' WHEN 1995 THEN '1995-1999' WHEN 2000 THEN '2000-2004'
 WHEN 2005 THEN '2005-2009' WHEN 2010 THEN '2010-2014' WHEN 2015 THEN '2015-2019' WHEN 2020 THEN '2020-2021' END"""


# the statement's own copy of the profiles
PROFILES = {
    "en": "the of and to in is that it on for was with as by",
    "fr": "le la les de des et un une en que qui dans du elle",
    "de": "der die und das den von zu ein eine ist mit nicht",
    "es": "el la los de que y en un una por con las del",
    "pt": "o os de que e em um uma por com do da dos das não para",
    "nl": "de het een en van in is dat op te met voor zijn niet",
    "it": "il lo la gli le di che e un una per con del della non è",
}


def _score(code: str) -> str:
    """Different function words of a language, 0 if they are too small a share of all words."""
    listed = ", ".join(f"'{w}'" for w in PROFILES[code].split())
    share = f"len(list_filter(w, lambda x: x IN ({listed}))) >= len(w) * 0.08::DOUBLE"
    return f"CASE WHEN {share} THEN len(list_intersect(list_distinct(w), [{listed}])) ELSE 0 END"


CTES = {
    "raw": """
SELECT CAST(l.l_orderkey AS BIGINT) AS paper_id, CAST(l.l_partkey AS BIGINT) AS author_id,
 CASE WHEN l.l_linenumber=7 THEN NULL ELSE CAST(l.l_suppkey AS BIGINT) END AS affiliation_id,
 CAST(l.l_linenumber AS INT) AS author_sequence_number,
 p.p_name AS author_name, CAST(p.p_size AS INT) AS h_index_auth, p.p_retailprice AS average_c10_auth,
 CAST(p.p_size*2 AS INT) AS productivity_auth, ln(1+p.p_retailprice) AS average_log_c10_auth,
 CASE WHEN l.l_linenumber=7 THEN NULL ELSE s.s_name END AS affiliation_name,
 CASE WHEN l.l_linenumber=7 THEN NULL WHEN n.n_nationkey=0 THEN 'TW' WHEN n.n_nationkey=1 THEN NULL
      ELSE concat('N', CAST(n.n_nationkey AS VARCHAR)) END AS country_iso,
 CASE WHEN l.l_linenumber=7 THEN NULL ELSE n.n_name END AS country_name,
 concat('10.0/', CAST(o.o_orderkey AS VARCHAR)) AS doi, CAST(1988 + o.o_orderkey % 36 AS INT) AS year,
 CAST(o.o_orderdate AS DATE) AS date, o.o_custkey % 50 AS journal_id, o.o_orderpriority AS original_venue,
 CAST(o.o_orderkey % 60 AS INT) AS reference_count, CAST(floor(o.o_totalprice/1000) AS INT) AS citation_count,
 f.k AS field_type,
 CASE WHEN f.k='Sub' THEN 100 + CAST(substr(p.p_brand,7) AS INT) ELSE 1000 + CAST(substr(p.p_brand,7) AS INT) % 5 END AS field_id,
 CASE WHEN f.k='Sub' THEN p.p_brand ELSE concat('Top_', CAST(CAST(substr(p.p_brand,7) AS INT) % 5 AS VARCHAR)) END AS field_name,
 concat('grid.', CAST(s.s_suppkey AS VARCHAR)) AS grid_id, concat('http://', s.s_name) AS official_page,
 CAST(s.s_suppkey % 90 AS DOUBLE) AS latitude_aff, CAST(s.s_suppkey % 180 AS DOUBLE) AS longitude_aff,
 CAST(floor(s.s_acctbal) AS INT) AS productivity_aff, s.s_acctbal/10 AS average_c10_aff,
 ln(1+abs(s.s_acctbal)) AS average_log_c10_aff,
 concat('Paper ', CAST(o.o_orderkey AS VARCHAR)) AS paper_title,
 CASE WHEN o.o_orderkey % 100 < 1 THEN 1 ELSE 0 END AS hit_1pct, CASE WHEN o.o_orderkey % 100 < 5 THEN 1 ELSE 0 END AS hit_5pct,
 CASE WHEN o.o_orderkey % 100 < 10 THEN 1 ELSE 0 END AS hit_10pct, o.o_totalprice/1000 AS c_f,
 row_number() OVER (ORDER BY l.l_orderkey,l.l_linenumber,l.l_partkey,l.l_suppkey,l.l_shipdate,l.l_extendedprice,f.k) AS seq
FROM lineitem l JOIN orders o ON o.o_orderkey=l.l_orderkey JOIN part p ON p.p_partkey=l.l_partkey
JOIN supplier s ON s.s_suppkey=l.l_suppkey JOIN nation n ON n.n_nationkey=s.s_nationkey
CROSS JOIN (SELECT 'Sub' AS k UNION ALL SELECT 'Top' AS k) f""",
    "t_countries": """
SELECT concat('N', CAST(n_nationkey AS VARCHAR)) AS iso2c, r_name AS subregion_un, r_name AS region
FROM nation JOIN region ON r_regionkey=n_regionkey WHERE n_nationkey > 1""",
    "t_authors": """
SELECT author_id, author_name, h_index_auth, productivity_auth, average_c10_auth,
 round(average_log_c10_auth, 9) AS average_log_c10_auth
FROM raw QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY seq)=1""",
    "t_affiliations": """
SELECT affiliation_id, affiliation_name, grid_id, official_page, country_iso, latitude_aff, longitude_aff,
 productivity_aff, average_c10_aff, round(average_log_c10_aff, 9) AS average_log_c10_aff, country_name,
 CASE WHEN country_iso='TW' THEN 'Eastern Asia' ELSE c.subregion_un END AS subregion_un,
 CASE WHEN country_iso='TW' THEN 'Eastern Asia' ELSE c.region END AS region
FROM (SELECT * FROM raw WHERE affiliation_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY affiliation_id ORDER BY seq)=1) a
LEFT JOIN t_countries c ON c.iso2c=a.country_iso""",
    "t_main_aff": """
SELECT p_partkey AS author_id, p_partkey % (SELECT count(*) FROM supplier) AS main_affiliation_id FROM part""",
    "t_gender": """
SELECT author_id, p_gf, CASE WHEN p_gf >= 0.75 THEN 'female' WHEN p_gf <= 0.25 THEN 'male' ELSE 'indeterminate' END AS name_gender
FROM (SELECT p_partkey AS author_id, CASE WHEN p_size=13 THEN NULL ELSE (p_size % 41)/40.0::DOUBLE END AS p_gf FROM part)""",
    "t_main_field": """
SELECT p_partkey AS author_id, CAST(100 + CAST(substr(p_brand,7) AS INT) AS BIGINT) AS author_main_field, 'Sub' AS field_type
FROM part WHERE p_partkey % 10 <> 0""",
    "t_papers": """
SELECT paper_id, doi, year, date, journal_id, original_venue, reference_count, citation_count
FROM raw QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY seq)=1""",
    "t_paa": """
SELECT paper_id, author_id, affiliation_id, author_sequence_number, seq
FROM raw QUALIFY row_number() OVER (PARTITION BY paper_id, author_id, affiliation_id ORDER BY seq)=1""",
    "t_fields": """
SELECT paper_id, CAST(field_id AS BIGINT) AS field_id, field_name, field_type, hit_1pct, hit_5pct, hit_10pct, c_f, seq
FROM raw QUALIFY row_number() OVER (PARTITION BY paper_id, field_id ORDER BY seq)=1""",
    "t_abstracts": """
SELECT paper_id, d.text AS paper_abstract, year FROM t_papers JOIN documents d ON d.doc_id=paper_id
WHERE paper_id % 97 <> 0 AND d.text IS NOT NULL AND d.text <> ''""",
    "t_extra": """
SELECT a.*, mf.author_main_field, fn.field_name, g.p_gf, g.name_gender, ma.main_affiliation_id,
 af.affiliation_name, af.country_name, af.subregion_un, af.region
FROM t_authors a LEFT JOIN t_main_field mf ON mf.author_id IS NOT DISTINCT FROM a.author_id
LEFT JOIN (SELECT DISTINCT field_id, field_name FROM t_fields) fn ON fn.field_id IS NOT DISTINCT FROM mf.author_main_field
LEFT JOIN t_gender g ON g.author_id IS NOT DISTINCT FROM a.author_id
LEFT JOIN t_main_aff ma ON ma.author_id IS NOT DISTINCT FROM a.author_id
LEFT JOIN t_affiliations af ON af.affiliation_id IS NOT DISTINCT FROM ma.main_affiliation_id""",
    "t_summary": """
SELECT p.*, pa.author_count, pa.affiliation_count, ft.top_field_count, fs.sub_field_count, pa.countries_count,
 pa.countries_count > 1 AS is_int_collab
FROM t_papers p
LEFT JOIN (SELECT paper_id,
   count(DISTINCT x.author_id) + max(CASE WHEN x.author_id IS NULL THEN 1 ELSE 0 END) AS author_count,
   count(DISTINCT x.affiliation_id) + max(CASE WHEN x.affiliation_id IS NULL THEN 1 ELSE 0 END) AS affiliation_count,
   count(DISTINCT a.country_iso) + max(CASE WHEN a.country_iso IS NULL THEN 1 ELSE 0 END) AS countries_count
   FROM t_paa x LEFT JOIN t_affiliations a ON a.affiliation_id = x.affiliation_id GROUP BY paper_id) pa ON pa.paper_id=p.paper_id
LEFT JOIN (SELECT paper_id, count(DISTINCT field_name) AS top_field_count FROM t_fields WHERE field_type='Top' GROUP BY 1) ft ON ft.paper_id=p.paper_id
LEFT JOIN (SELECT paper_id, count(DISTINCT field_name) AS sub_field_count FROM t_fields WHERE field_type='Sub' GROUP BY 1) fs ON fs.paper_id=p.paper_id""",
    "t_auth_gender": """
SELECT d.*, e.name_gender FROM (SELECT DISTINCT paper_id, author_id, author_sequence_number FROM t_paa) d
LEFT JOIN t_extra e ON e.author_id = d.author_id""",
    "t_papers_gender": """
SELECT k.paper_id, k.name_gender, coalesce(c.n, 0) AS n, t.n_authors, t.n_authors > 1 AS is_collab, f.gender_first_auth
FROM (SELECT * FROM (SELECT DISTINCT paper_id FROM t_auth_gender WHERE name_gender IS NOT NULL)
      CROSS JOIN (SELECT DISTINCT name_gender FROM t_auth_gender WHERE name_gender IS NOT NULL)) k
LEFT JOIN (SELECT paper_id, name_gender, count(*) AS n FROM t_auth_gender GROUP BY 1,2) c
  ON c.paper_id=k.paper_id AND c.name_gender=k.name_gender
LEFT JOIN (SELECT paper_id, author_sequence_number AS n_authors FROM t_auth_gender
  QUALIFY rank() OVER (PARTITION BY paper_id ORDER BY author_sequence_number DESC NULLS LAST)=1) t ON t.paper_id=k.paper_id
LEFT JOIN (SELECT paper_id, name_gender AS gender_first_auth FROM t_auth_gender WHERE author_sequence_number=1) f ON f.paper_id=k.paper_id""",
    "t_collab_papers": """
SELECT paper_id FROM (SELECT DISTINCT paper_id, author_id FROM t_paa) GROUP BY paper_id HAVING count(*) > 1""",
    "t_collab": """
SELECT a.paper_id, a.author_id AS author_1, b.author_id AS author_2, p.year
FROM t_paa a JOIN t_paa b ON a.paper_id=b.paper_id AND a.seq < b.seq
LEFT JOIN t_papers p ON p.paper_id=a.paper_id
WHERE a.paper_id IN (SELECT paper_id FROM t_collab_papers)""",
    "t_inst": """
SELECT paper_id, affiliation_id, min(seq) AS seq FROM t_paa WHERE affiliation_id IS NOT NULL GROUP BY 1,2""",
    "t_top_of_sub": """
SELECT DISTINCT p_brand AS subfield_name, concat('Top_', CAST(CAST(substr(p_brand,7) AS INT) % 5 AS VARCHAR)) AS topfield_name, 1 AS ordinal FROM part
UNION ALL SELECT DISTINCT p_brand, 'Top_9', 2 FROM part WHERE p_brand='Brand#3'""",
    "t_author_fields": """
SELECT m.author_id, m.author_main_field AS author_subfield, t.topfield_name FROM t_main_field m
LEFT JOIN (SELECT DISTINCT field_id, field_name FROM t_fields WHERE field_type='Sub') s ON s.field_id=m.author_main_field
LEFT JOIN t_top_of_sub t ON t.subfield_name=s.field_name
QUALIFY row_number() OVER (PARTITION BY m.author_id ORDER BY t.ordinal)=1""",
    "t_collab_fields": """
SELECT d.paper_id, d.author_id, f.author_subfield, f.topfield_name
FROM (SELECT DISTINCT paper_id, author_id FROM t_paa WHERE paper_id IN (SELECT paper_id FROM t_collab_papers)) d
LEFT JOIN t_author_fields f ON f.author_id=d.author_id""",
    "t_paper_auth_fields": f"""
SELECT p.paper_id, p.year, {QUIN_BREAKS} AS quin, x.paper_field, x.author_id, x.author_field FROM t_papers p
JOIN (SELECT f.paper_id, f.field_name AS paper_field, c.author_id, c.topfield_name AS author_field
      FROM t_fields f LEFT JOIN t_collab_fields c ON c.paper_id=f.paper_id
      WHERE f.field_type='Top' AND f.paper_id IN (SELECT paper_id FROM t_collab_papers)
      QUALIFY row_number() OVER (PARTITION BY f.paper_id, c.author_id ORDER BY f.seq)=1) x ON x.paper_id=p.paper_id
WHERE x.paper_field IS NOT NULL""",
    "t_lang": f"""
SELECT paper_id, year, paper_abstract, CASE greatest(en,fr,de,es,pt,nl,it) WHEN 0 THEN NULL WHEN en THEN 'en' WHEN fr THEN 'fr'
  WHEN de THEN 'de' WHEN es THEN 'es' WHEN pt THEN 'pt' WHEN nl THEN 'nl' ELSE 'it' END AS lang
FROM (SELECT *, {", ".join(f"{_score(k)} AS {k}" for k in PROFILES)}
      FROM (SELECT *, regexp_extract_all(lower(paper_abstract), '\\p{{L}}+') AS w FROM t_abstracts))""",
    "t_lemmas": """
SELECT paper_id, CASE WHEN regexp_matches(f, '[^aeiou]ies$') AND length(f) > 4 THEN regexp_replace(f, 'ies$', 'y')
  WHEN regexp_matches(f, '(ss|us|is)$') THEN f WHEN regexp_matches(f, '(s|x|z|ch|sh)es$') THEN regexp_replace(f, 'es$', '')
  WHEN f LIKE '%s' AND length(f) > 3 THEN regexp_replace(f, 's$', '') ELSE f END AS lemma
FROM (SELECT paper_id, unnest(regexp_extract_all(lower(paper_abstract), '\\p{L}+')) AS f FROM t_lang WHERE lang='en')""",
    "t_nouns": """
SELECT paper_id, lemma, count(*) AS n FROM t_lemmas WHERE regexp_matches(lemma, '(ion|er|ing|nd|th)$') GROUP BY 1,2""",
    "t_field_nouns": """
SELECT f.field_name AS file_field, n.paper_id, n.lemma, n.n, t.field_id, t.field_name, p.year
FROM t_nouns n JOIN t_fields f ON f.paper_id=n.paper_id AND f.field_type='Top'
JOIN t_fields t ON t.paper_id=n.paper_id AND t.field_type='Top' LEFT JOIN t_papers p ON p.paper_id=n.paper_id""",
    "t_top_co": f"""
SELECT quin, 'thin' AS lemma_1, lemma_2, freq, file_field AS top_field FROM (
  SELECT a.file_field, a.quin, b.lemma AS lemma_2, CAST(sum(a.n * b.n) AS BIGINT) AS freq
  FROM t_co_rows a JOIN t_co_rows b ON a.file_field=b.file_field AND a.paper_id=b.paper_id AND a.lemma <> b.lemma
  WHERE a.lemma LIKE 'thin%' GROUP BY 1,2,3)
QUALIFY rank() OVER (PARTITION BY file_field, quin ORDER BY freq DESC) <= 30""",
    "t_co_rows": f"""
SELECT file_field, paper_id, lower(lemma) AS lemma, {QUIN_BREAKS} AS quin, n FROM t_field_nouns
WHERE year BETWEEN 1990 AND 2021 AND lower(lemma) NOT IN ({STOP}) AND lemma NOT LIKE '.%'""",
    "t_cells": f"""
SELECT DISTINCT s.paper_id, f.field_name AS field, {QUIN_FIRST} AS quin, s.author_count
FROM t_summary s JOIN t_fields f ON f.paper_id=s.paper_id AND f.field_type='Top'
WHERE s.year IN (1990,1995,2000,2005,2010,2015,2020)""",
    "t_edges": """
SELECT k.field, k.quin, c.author_1, c.author_2, sum(2.0::DOUBLE/(k.author_count*(k.author_count-1))) AS fractional_weight, count(*) AS pair_count
FROM t_cells k JOIN t_collab c ON c.paper_id=k.paper_id GROUP BY 1,2,3,4""",
    "t_cells_full": f"""
SELECT DISTINCT s.paper_id, f.field_name AS field, {QUIN_RANGE} AS quin, s.author_count
FROM t_summary s JOIN t_fields f ON f.paper_id=s.paper_id AND f.field_type='Top' WHERE s.year BETWEEN 1990 AND 2021""",
    "t_ends": """
SELECT field, quin, author_1 AS id, author_2 AS other, fractional_weight, pair_count FROM t_edges
UNION ALL SELECT field, quin, author_2, author_1, fractional_weight, pair_count FROM t_edges""",
    "t_vertices": """
SELECT field, quin, id, count(*) OVER (PARTITION BY field, quin) AS n,
 row_number() OVER (PARTITION BY field, quin ORDER BY id) - 1 AS pos FROM (SELECT DISTINCT field, quin, id FROM t_ends)""",
    "t_simple": """
SELECT DISTINCT field, quin, id, other FROM t_ends WHERE id <> other""",
    "t_flow": """
SELECT field, quin, id, other, count(*) AS m FROM t_ends GROUP BY 1,2,3,4""",
}


def statement(select: str, recursive: str = "") -> str:
    """``select`` preceded by the subqueries it needs; ``recursive`` CTEs come last."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:raw|t_\w+)\b", text):
            if name in CTES and name not in needed:
                visit(CTES[name])
                needed.append(name)

    visit(recursive + " " + select)
    kept = "MATERIALIZED " if recursive else ""
    parts = [f"{name} AS {kept}({CTES[name]})" for name in needed] + ([recursive] if recursive else [])
    keyword = "WITH RECURSIVE" if recursive else "WITH"
    return f"{keyword} {', '.join(parts)}\n{select}" if parts else select
