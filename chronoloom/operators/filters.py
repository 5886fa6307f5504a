"""Filters and rankings of whole series by an aggregate of their samples.

One partial and one final aggregate by series; what qualifies is a set of heads, and
samples follow by a semi-join. Look-back slots count, if an outer function asked for
them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.aggregators import aggregate, canonical
from chronoloom.operators.leaf import as_expr
from chronoloom.operators.series import Expr, Request, SeriesSet, Store

#: Spellings of the comparisons (fixed values).
OPERATORS = {"eq": "=", "=": "=", "ne": "!=", "!=": "!=", "<>": "!=", "gt": ">", ">": ">", "ge": ">=", ">=": ">=", "lt": "<", "<": "<", "le": "<=", "<=": "<="}


def judged(s: SeriesSet, agg: str) -> DataFrame:
    """Heads with ``_a``, the aggregate of each series."""
    by = s.samples.groupBy("skey").agg(aggregate(agg, F.col("v"), F.col("t")).alias("_a"))
    a = F.coalesce("_a", F.lit(0.0)) if canonical(agg) == "count" else F.col("_a")
    return s.heads.join(by, "skey", "left").withColumn("_a", a)


def filterSeries(q: str | Expr, aggFunc: str, operator: str, num: float) -> Expr:
    """Series whose aggregate compares so; a missing aggregate only differs."""
    arg, op, n = as_expr(q), OPERATORS[operator], F.lit(float(num))

    def build(store: Store, req: Request) -> SeriesSet:
        s, a = arg.build(store, req), F.col("_a")
        test = {"=": a == n, "!=": a.isNull() | (a != n), ">": a > n, ">=": a >= n, "<": a < n, "<=": a <= n}[op]
        return s.only(judged(s, aggFunc).where(test).drop("_a"))

    return Expr(build, arg.target, arg.method)


def _ranked(q: str | Expr, n: float, agg: str, largest: bool) -> Expr:
    arg = as_expr(q)

    def build(store: Store, req: Request) -> SeriesSet:
        s = arg.build(store, req)
        by = [F.col("_a").desc() if largest else F.col("_a").asc(), "arg", "sid", "skey"]
        best = judged(s, agg).where("_a is not null").orderBy(*by).limit(max(int(n), 0))
        # Ascending by the aggregate, then in series order: at most n rows.
        order = W.orderBy("_a", "arg", "sid", "skey")
        return s.only(best.withColumn("arg", F.row_number().over(order) - 1).drop("_a"))

    return Expr(build, arg.target, arg.method)


def averageAbove(q: str | Expr, n: float) -> Expr:
    return filterSeries(q, "average", ">", n)


def averageBelow(q: str | Expr, n: float) -> Expr:
    return filterSeries(q, "average", "<", n)


def currentAbove(q: str | Expr, n: float) -> Expr:
    return filterSeries(q, "last", ">", n)


def currentBelow(q: str | Expr, n: float) -> Expr:
    return filterSeries(q, "last", "<", n)


def maximumAbove(q: str | Expr, n: float) -> Expr:
    return filterSeries(q, "max", ">", n)


def maximumBelow(q: str | Expr, n: float) -> Expr:
    return filterSeries(q, "max", "<", n)


def minimumAbove(q: str | Expr, n: float) -> Expr:
    return filterSeries(q, "min", ">", n)


def minimumBelow(q: str | Expr, n: float) -> Expr:
    return filterSeries(q, "min", "<", n)


def highest(q: str | Expr, n: float = 1, aggFunc: str = "average") -> Expr:
    """The ``n`` series with the largest aggregate; earlier series win ties."""
    return _ranked(q, n, aggFunc, True)


def highestAverage(q: str | Expr, n: float) -> Expr:
    return _ranked(q, n, "average", True)


def highestCurrent(q: str | Expr, n: float) -> Expr:
    return _ranked(q, n, "last", True)


def highestMax(q: str | Expr, n: float) -> Expr:
    return _ranked(q, n, "max", True)


def lowest(q: str | Expr, n: float = 1, aggFunc: str = "average") -> Expr:
    return _ranked(q, n, aggFunc, False)


def lowestAverage(q: str | Expr, n: float) -> Expr:
    return _ranked(q, n, "average", False)


def lowestCurrent(q: str | Expr, n: float) -> Expr:
    return _ranked(q, n, "last", False)
