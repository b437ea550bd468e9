"""Five-year periods. Labels and breaks are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = (
    "1990-1994",
    "1995-1999",
    "2000-2004",
    "2005-2009",
    "2010-2014",
    "2015-2019",
    "2020-2021",
)


def bounds(label: str) -> tuple[int, int]:
    first, last = label.split("-")
    return int(first), int(last)


def _case(year: Column, ranges: list[tuple[str, int, int]]) -> Column:
    expr = None
    for label, low, high in ranges:
        hit = year.between(low, high)
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return expr


def period_by_breaks(year: Column) -> Column:
    """Half-open bins whose last one is closed, so 2022 falls in ``2020-2021``."""
    ranges = [(label, *bounds(label)) for label in PERIODS]
    label, low, high = ranges[-1]
    return _case(year, ranges[:-1] + [(label, low, high + 1)])


def period_by_label(year: Column) -> Column:
    """The period whose label spans the year; 2022 has none."""
    return _case(year, [(label, *bounds(label)) for label in PERIODS])


def period_by_first_year(year: Column) -> Column:
    """The period that starts in this very year; other years have none."""
    return _case(year, [(label, bounds(label)[0], bounds(label)[0]) for label in PERIODS])


PERIOD_MODES = {
    "breaks": period_by_breaks,
    "full": period_by_label,
    "first_year": period_by_first_year,
}
