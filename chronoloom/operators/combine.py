"""Functions that make one series of many: a grouped aggregate by slot time.

Only series with the step of the first one (in series order) take part; the result
covers the union of their ranges. Spark sums within tasks first, so what is
shuffled are slots, not samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.aggregators import aggregate, canonical
from chronoloom.operators.leaf import as_expr, group, union
from chronoloom.operators.series import LONGEST_NAME, Expr, Request, SeriesSet, Store, finite


def _name(function: str, target: str) -> str:
    full = f"{function}({target})"
    return full if len(full) <= LONGEST_NAME else full[: LONGEST_NAME - 4] + "..."


def _alike(s: SeriesSet) -> SeriesSet:
    """The series with the first one's step: a semi-join with one row."""
    step = s.heads.agg(F.min_by("step", F.struct("arg", "sid", "skey")).alias("step"))
    return SeriesSet(s.heads.join(step, "step", "left_semi"), s.samples.join(step, "step", "left_semi"))


def _head(heads: DataFrame, name: str, target: str) -> DataFrame:
    one = heads.groupBy("step").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return one.select(F.lit("0").alias("skey"), F.lit(0).alias("arg"), F.lit(0).cast("long").alias("sid"), "step", "lo", "hi", F.lit(target).alias("target"), F.lit(name).alias("name"))


def _combine(function: str, queries: tuple[str | Expr, ...], value: Callable[[], Column], ordered: bool = False) -> Expr:
    args = [as_expr(q) for q in queries]
    target, method = args[-1].target, args[-1].method

    def build(store: Store, req: Request) -> SeriesSet:
        s = _alike(union(args, store, req))
        rows = s.samples
        if ordered:
            rows = rows.join(s.heads.select("skey", "arg", F.struct("arg", "sid", "skey").alias("place")), "skey")
        slots = rows.groupBy("step", "t").agg(value().alias("v"))
        return SeriesSet(_head(s.heads, _name(function, target), target), slots.where("v is not null").select(F.lit("0").alias("skey"), "step", "t", "v"))

    return Expr(build, target, method)


def _by(function: str, agg: str, ordered: bool = False):
    order = lambda: F.col("place") if ordered else F.col("t")
    return lambda *queries: _combine(function, queries, lambda: aggregate(agg, F.col("v"), order()), ordered)


averageSeries = avg = _by("averageSeries", "average")
firstSeries = _by("firstSeries", "first", ordered=True)
lastSeries = _by("lastSeries", "last", ordered=True)
maxSeries = _by("maxSeries", "max")
medianSeries = _by("medianSeries", "median")
minSeries = _by("minSeries", "min")
multiplySeries = _by("multiplySeries", "multiply")
rangeSeries = _by("rangeSeries", "range")
stddevSeries = _by("stddevSeries", "stddev")
sumSeries = sum = _by("sumSeries", "sum")


def countSeries(*queries: str | Expr) -> Expr:
    """The number of series in every slot, whether they have values or not; no
    series give zeros, one a second."""
    args = [as_expr(q) for q in queries]
    target, method = args[-1].target, args[-1].method
    name = _name("countSeries", target)

    def build(store: Store, req: Request) -> SeriesSet:
        s = _alike(union(args, store, req))
        counted = s.heads.groupBy("step").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"))
        # One row at most; where there is none, a row of its own stands in.
        one = F.lit(1).cast("long")
        filled = counted.agg(F.coalesce(F.first("step"), one).alias("step"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.coalesce(F.first("n"), F.lit(0)).alias("n"))
        filled = filled.withColumns({"lo": F.coalesce("lo", req.lo(F.col("step"))), "hi": F.coalesce("hi", req.hi(F.col("step")))})
        heads = filled.select(F.lit("0").alias("skey"), F.lit(0).alias("arg"), F.lit(0).cast("long").alias("sid"), "step", "lo", "hi", F.lit(target).alias("target"), F.lit(name).alias("name"))
        slots = filled.where("lo < hi").select(F.lit("0").alias("skey"), "step", F.explode(F.sequence("lo", F.col("hi") - F.col("step"), "step")).alias("t"), F.col("n").cast("double").alias("v"))
        return SeriesSet(heads, slots, True)

    return Expr(build, target, method)


def diffSeries(*queries: str | Expr) -> Expr:
    """The first argument less the sum of the others. All series of the first one
    are added up and must all be there; of the others what is there counts."""
    args = [as_expr(q) for q in queries]
    target, method = args[-1].target, args[-1].method

    def build(store: Store, req: Request) -> SeriesSet:
        s = _alike(union(args, store, req))
        rows = s.samples.join(s.heads.select("skey", "arg"), "skey")
        mine = F.col("arg") == 0
        slots = rows.groupBy("step", "t").agg(F.sum(F.when(mine, F.col("v"))).alias("a"), F.count(F.when(mine, F.col("v"))).alias("n"), F.coalesce(F.sum(F.when(~mine, F.col("v"))), F.lit(0.0)).alias("b"))
        whole = s.heads.groupBy("step").agg(F.count(F.when(mine, F.col("skey"))).alias("all"))
        v = finite(F.col("a") - F.col("b"))
        found = slots.join(whole, "step").where("n = all and n > 0").select(F.lit("0").alias("skey"), "step", "t", v.alias("v"))
        return SeriesSet(_head(s.heads, _name("diffSeries", target), target), found)

    return Expr(build, target, method)


def aggregate_series(q: str | Expr, aggFunc: str) -> Expr:
    """``aggregate``: the combining function of that name."""
    made = {
        "average": averageSeries,
        "count": countSeries,
        "diff": diffSeries,
        "first": firstSeries,
        "last": lastSeries,
        "max": maxSeries,
        "median": medianSeries,
        "min": minSeries,
        "multiply": multiplySeries,
        "range": rangeSeries,
        "stddev": stddevSeries,
        "sum": sumSeries,
    }
    return made[canonical(aggFunc)](q)


__all__ = ["aggregate_series", "averageSeries", "avg", "countSeries", "diffSeries", "firstSeries", "group", "lastSeries", "maxSeries", "medianSeries", "minSeries", "multiplySeries", "rangeSeries", "stddevSeries", "sum", "sumSeries"]
