"""The twelve aggregators of a series' samples, as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other spellings (fixed values).
ALIASES = {"avg": "average", "current": "last", "rangeOf": "range", "total": "sum"}
NAMES = ("average", "count", "diff", "first", "last", "max", "median", "min", "multiply", "range", "stddev", "sum")


def canonical(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in NAMES:
        raise ValueError(f"no aggregator {name!r}")
    return name


def aggregate(name: str, v: Column, order: Column) -> Column:
    """Nulls are skipped; all null gives null, but count gives 0. ``first``, ``last``
    and ``diff`` (first less the others) go by ``order``. What has no value, as the sum of
    both infinities, is null, never NaN."""
    present = F.when(v.isNotNull(), order)
    first = F.min_by(v, present)
    found = {
        "average": lambda: F.avg(v),
        "count": lambda: F.count(v).cast("double"),
        "diff": lambda: 2 * first - F.sum(v),
        "first": lambda: first,
        "last": lambda: F.max_by(v, present),
        "max": lambda: F.max(v),
        "median": lambda: F.median(v),
        "min": lambda: F.min(v),
        "multiply": lambda: F.product(v),
        "range": lambda: F.max(v) - F.min(v),
        "stddev": lambda: F.stddev_pop(v),
        "sum": lambda: F.sum(v),
    }[canonical(name)]()
    return F.when(~F.isnan(found), found)
