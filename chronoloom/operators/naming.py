"""Names, presentation, and how a result is consolidated."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from chronoloom.functions.aggregators import aggregate, canonical
from chronoloom.functions.times import align
from chronoloom.operators.leaf import as_expr
from chronoloom.operators.series import Expr, Request, SeriesSet, Store


def alias(q: str | Expr, name: str) -> Expr:
    """Every series gets the name."""
    arg = as_expr(q)
    return replace(arg, build=lambda store, req: arg.build(store, req).renamed(F.lit(name)))


def aliasSub(q: str | Expr, search: str, replacement: str) -> Expr:
    """Kept for its place in queries: names stay."""
    return as_expr(q)


def legendValue(q: str | Expr, *types: str) -> Expr:
    return as_expr(q)


def color(q: str | Expr, color: str) -> Expr:
    return as_expr(q)


def lineWidth(q: str | Expr, width: float) -> Expr:
    return as_expr(q)


def consolidateBy(q: str | Expr, aggFunc: str) -> Expr:
    """Which aggregator makes one point of many, if the result has too many."""
    return replace(as_expr(q), method=canonical(aggFunc))


def consolidate(s: SeriesSet, req: Request, points: int, method: str) -> SeriesSet:
    """At most about ``points`` slots per series: slots are merged by whole numbers
    of steps, aligned like slots are. Runs on the window alone, once, outermost."""
    least = (req.last - req.first) / points
    merged = F.ceil(F.lit(least) / F.col("step")).cast("long")
    step = F.when(F.col("step") >= F.lit(least), F.col("step")).otherwise(F.col("step") * merged)
    heads = s.heads.withColumn("_step", step)
    heads = heads.withColumns({"lo": align(F.col("lo"), F.col("_step")), "hi": align(F.col("hi") - 1, F.col("_step")) + F.col("_step")})
    rows = s.samples.withColumn("_step", step).withColumn("_t", align(F.col("t"), F.col("_step")))
    points_ = rows.groupBy("skey", "_step", "_t").agg(aggregate(method, F.col("v"), F.col("t")).alias("v"))
    return SeriesSet(heads.drop("step").withColumnRenamed("_step", "step"), points_.select("skey", F.col("_step").alias("step"), F.col("_t").alias("t"), "v"), s.full)
