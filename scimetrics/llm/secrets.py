"""Secret scan through a trigram inverted index, in DataFrame operations only.

Every rule's regular expression gives a Boolean query over trigrams that each
match must contain. One pass writes the postings of the trigrams that occur in
any query; the postings of a clause are intersected per document, and only the
documents that a query leaves are searched with the expression. Rules without
a mandatory trigram search every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scimetrics.llm.tables import checked
from scimetrics.session import materialize

MOST_STRINGS, MOST_CHARACTERS = 64, 6


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters.

    ``pattern`` must mean the same in Java and Python and may not match nothing.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule(
        "assign",
        "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    # the runs of [0-9a-f]+ with 24 or more characters
    Rule("hex", "[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


def _characters(items: list) -> set[str] | None:
    """Lower-cased members of a character class, None if it is negated or large."""
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < MOST_CHARACTERS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST_CHARACTERS else None


def _strings(kind, value) -> set[str] | None:
    """All lower-cased strings a node matches, None if they are many."""
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        return _characters(value)
    if kind is op.AT:
        return {""}
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        return None if None in parts else set().union(*parts)
    if kind is op.MAX_REPEAT and value[1] <= 3:
        once = _sequence(value[2])
        if once is None:
            return None
        many = {"".join(p) for n in range(value[0], value[1] + 1) for p in product(once, repeat=n)}
        return many if len(many) <= MOST_STRINGS else None
    return None


def _sequence(nodes) -> set[str] | None:
    found = {""}
    for kind, value in nodes:
        own = _strings(kind, value)
        if own is None or len(found) * len(own) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in own}
    return found


def _segments(nodes) -> list[set[str]]:
    """Sets of strings of which every match contains one each."""
    done, open_ = [], {""}
    for kind, value in nodes:
        own = _strings(kind, value)
        if own is not None and len(open_) * len(own) <= MOST_STRINGS:
            open_ = {a + b for a in open_ for b in own}
            continue
        done.append(open_)
        open_ = {""} if own is None else own
        if kind is op.SUBPATTERN:
            done += _segments(value[3])
        elif kind is op.MAX_REPEAT and value[0] > 0:
            done += _segments(value[2])
    return [*done, open_]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams: every match has, lower-cased, all of one of them.

    An empty list means that no trigram is mandatory. Of the parts of the
    expression that give a query, the most selective one is taken.
    """
    best: list[frozenset[str]] = []
    for strings in _segments(_parser.parse(pattern)):
        clauses = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        least = [c for c in clauses if not any(other < c for other in clauses)]
        if all(least) and min(map(len, least)) > min(map(len, best), default=0):
            best = sorted(least, key=sorted)
    return best


def postings(df: DataFrame, id_col: str, text_col: str, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id) of the given trigrams in the lower-cased texts."""
    low = df.select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("low"))
    present = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams]))
    return low.select(F.explode(present).alias("trigram"), "doc_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): documents in the postings of all trigrams of some clause."""
    rows = [
        (rule.kind, n, trigram, len(clause))
        for rule in rules
        for n, clause in enumerate(trigram_query(rule.pattern))
        for trigram in sorted(clause)
    ]
    schema = "rule string, clause int, trigram string, needed int"
    clauses = index.sparkSession.createDataFrame(rows, schema)
    met = (
        index.join(F.broadcast(clauses), "trigram")
        .groupBy("doc_id", "rule", "clause", "needed")
        .agg(F.count("*").alias("n"))
        .where("n >= needed")
    )
    return met.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rule: Rule) -> Column:
    """Sorted (start, end) of a rule's matches, in code points.

    The matches and the text between them have the same order, so running sums
    of their lengths are the offsets.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    steps = F.zip_with(
        whole,
        F.zip_with(F.split(text, rule.pattern, -1), part, lambda gap, p: F.struct(gap.alias("gap"), p.alias("part"))),
        lambda w, x: F.struct(F.length(x["gap"]).alias("gap"), F.length(w).alias("size"), F.length(x["part"]).alias("part")),
    )
    # the text after the last match has no match of its own
    steps = F.filter(steps, lambda s: s["size"].isNotNull())
    empty = F.array().cast("array<struct<start:int,end:int,part:int>>")

    def step(state: Column, s: Column) -> Column:
        start = state["at"] + s["gap"]
        end = start + s["size"]
        own = F.struct(start.alias("start"), end.alias("end"), s["part"].alias("part"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(own)).alias("found"))

    begin = F.struct(F.lit(0).alias("at"), empty.alias("found"))
    found = F.aggregate(steps, begin, step, lambda state: state["found"])
    return F.filter(found, lambda s: s["part"] >= rule.least)


def _named(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")
        ),
    )


def find_secrets(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """The ``carry`` columns as ``row``, doc_id, and ``found``: array of (start, rank, kind, end).

    One row per input row; spans are in code points, the end is exclusive, and
    they are ordered by start, then by the order of the rules. A null text is
    empty. Rows without doc_id are in no posting and are searched with every
    rule. Rows that repeat a doc_id share its candidates and are searched each
    by itself. Other columns are ignored; an empty table gives an empty result.
    """
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    trigrams = sorted({t for clauses in queries.values() for c in clauses for t in c})
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(text_col, F.lit("")).alias("text"),
        F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in carry]).alias("row"),
    )
    index = materialize(postings(rows.where("doc_id is not null"), "doc_id", "text", trigrams), "postings")
    wanted = materialize(candidates(index, rules), "candidates")
    rows = rows.join(checked(wanted, 64), "doc_id", "left")
    found = []
    for rank, rule in enumerate(rules):
        text = F.col("text")
        open_ = text.rlike(rule.pattern)
        if queries[rule.kind]:
            open_ = (F.col("doc_id").isNull() | F.array_contains("rules", rule.kind)) & open_
        none = F.array().cast("array<struct<start:int,end:int,part:int>>")
        spans = F.when(open_, _spans(text, rule)).otherwise(none)
        found.append(_named(spans, rank, rule.kind))
    return rows.select("doc_id", "text", "row", F.array_sort(F.concat(*found)).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of ``find_secrets``'s rows."""
    spans = F.col("found")
    kinds = [rule.kind for rule in BASE_RULES]
    counts = [_count(spans, k).alias(f"n_{k}") for k in kinds]
    base = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans")
    )


def redacted(found: DataFrame, mask: str = "[secret]") -> Column:
    """The text of ``find_secrets``'s rows with every found span, or run of overlapping spans, masked."""
    text = F.col("text")

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        fresh = s["start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size("found") == 0, text).otherwise(F.aggregate("found", begin, step, rest))
