"""Column expressions shared by several datasets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENDERS = ("female", "male", "indeterminate")


def n_distinct(column: Column) -> Column:
    """Distinct values in a group, where a missing value counts as one more."""
    return F.count_distinct(column) + F.max(column.isNull().cast("long"))


def gender_of(p_female: Column) -> Column:
    """Gender label from the probability of a female name; missing is indeterminate."""
    return (
        F.when(p_female >= 0.75, GENDERS[0]).when(p_female <= 0.25, GENDERS[1]).otherwise(GENDERS[2])
    )


def gender_order(gender: Column) -> Column:
    """Position of a label for sorting, NULL outside the labels."""
    return F.nullif(F.array_position(F.lit(list(GENDERS)), gender), F.lit(0).cast("long"))


def as_gender(gender: Column) -> Column:
    """The label itself, NULL when it is not one of the three."""
    return F.when(gender.isin(*GENDERS), gender)


def pair_share(authors: Column) -> Column:
    """Weight of one of the k(k-1)/2 author pairs of a paper; NULL for k < 2."""
    return F.try_divide(F.lit(2.0), authors * (authors - 1))


def shannon(n: Column) -> Column:
    """Natural-log entropy of a group whose rows carry class counts ``n``.

    ln N - (sum n ln n) / N equals -sum p ln p and needs no second pass for N.
    """
    total = F.sum(n)
    return F.log(total) - F.sum(n * F.log(n)) / total
