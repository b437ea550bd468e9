"""Text expressions: language and lemma rules on whole texts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scimetrics.functions.wordlists import FUNCTION_WORDS


def words(text: Column) -> Column:
    """All letter runs of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


#: A language needs at least this share of function words among all words.
LEAST_SHARE = 0.08


def _occurrences(found: Column, profile: Sequence[str]) -> Column:
    return F.size(F.filter(found, lambda w: w.isin(list(profile))))


def language(found: Column, profiles: dict[str, list[str]] | None = None) -> Column:
    """Language whose function words cover the ``found`` words of a text best.

    The score is how many different words of the profile occur; the earlier
    profile wins a tie. A text in which less than LEAST_SHARE of all words are
    function words of the best language has none.
    """
    profiles = profiles or FUNCTION_WORDS
    scored = []
    for position, (code, profile) in enumerate(profiles.items()):
        score = F.size(F.array_intersect(found, F.lit(list(profile))))
        enough = _occurrences(found, profile) >= F.size(found) * LEAST_SHARE
        entry = F.struct(
            score.alias("score"), F.lit(-position).alias("preference"), F.lit(code).alias("code")
        )
        scored.append(F.when((score > 0) & enough, entry))
    # the largest entry has the best score, then the earliest profile
    return F.array_max(F.array(*scored))["code"]


def singular(form: Column) -> Column:
    """Dictionary form of a regular English plural."""
    return (
        F.when(form.rlike("[^aeiou]ies$") & (F.length(form) > 4), F.regexp_replace(form, "ies$", "y"))
        .when(form.rlike("(ss|us|is)$"), form)
        .when(form.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(form, "es$", ""))
        .when(form.rlike("s$") & (F.length(form) > 3), F.regexp_replace(form, "s$", ""))
        .otherwise(form)
    )


def ends_with_any(word: Column, suffixes: Sequence[str]) -> Column:
    return word.rlike(f"({'|'.join(map(re.escape, suffixes))})$")
