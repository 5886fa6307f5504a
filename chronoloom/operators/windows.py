"""Functions of a series' neighbouring slots. All run on dense series and keep the
partitioning by series, so a chain of them shuffles once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.times import align, duration
from chronoloom.operators.leaf import as_expr
from chronoloom.operators.series import Expr, Request, SeriesSet, Store, by_series, dense, derived, finite

#: Windows of more slots than this are added up by blocks.
SHORT_WINDOW = 64


def _over(function: str, q: str | Expr, value: Column, slots: int) -> Expr:
    arg = as_expr(q)

    def build(store: Store, req: Request) -> SeriesSet:
        s = dense(arg.build(store, req.before(slots)))
        return s.values(finite(value)).renamed(derived(function))

    return Expr(build, arg.target, arg.method)


def derivative(q: str | Expr) -> Expr:
    """Difference to the slot before; missing if either is."""
    return _over("derivative", q, F.col("v") - F.lag("v").over(by_series()), 1)


def nonNegativeDerivative(q: str | Expr, maxValue: float | None = None) -> Expr:
    """Rises only; with a ``maxValue`` a fall is a counter that wrapped there, and
    values above it are missing."""
    v, before = F.col("v"), F.lag("v").over(by_series())
    value = F.when(v >= before, v - before)
    if maxValue is not None:
        most = F.lit(float(maxValue))
        value = F.when(v <= most, F.when(v >= before, v - before).otherwise(v + (most - before + 1)))
    return _over("nonNegativeDerivative", q, value, 1)


def keepLastValue(q: str | Expr, limit: int = 0) -> Expr:
    """Fills a run of missing slots with the value before it, unless the whole run
    is longer than ``limit`` (0: no limit). Leading runs stay."""
    arg = as_expr(q)

    def build(store: Store, req: Request) -> SeriesSet:
        s = dense(arg.build(store, req.before(1)))
        run = F.count("v").over(by_series().rowsBetween(W.unboundedPreceding, W.currentRow))
        by_run = W.partitionBy("skey", "_run")
        gap, kept = F.sum(F.col("v").isNull().cast("long")).over(by_run), F.max("v").over(by_run)
        fits = F.lit(True) if limit <= 0 else F.col("_gap") <= limit
        rows = s.samples.withColumn("_run", run).withColumns({"_gap": gap, "_kept": kept})
        filled = rows.withColumn("v", F.when(F.col("v").isNotNull(), F.col("v")).when((F.col("_run") > 0) & fits, F.col("_kept")))
        return replace(s, samples=filled.drop("_run", "_gap", "_kept")).renamed(derived("keepLastValue"))

    return Expr(build, arg.target, arg.method)


def movingAverage(q: str | Expr, window: int | str, xFilesFactor: float | None = None) -> Expr:
    """Sum of the values in the last slots over the number of slots; missing if all
    are. ``window`` counts slots, or is a duration of which the slots are one more
    than it holds whole. ``xFilesFactor`` has no effect.

    Short windows are frames. A frame is added up anew for each slot, so for long ones
    slots are parted into blocks as long as the window: a window is the end of one block and
    the start of the next, two running sums that nothing is subtracted from.
    """
    arg = as_expr(q)
    text = str(window).strip()
    slots = int(float(text)) if text.replace(".", "", 1).isdigit() else None
    seconds = duration(text) if slots is None else 0

    def build(store: Store, req: Request) -> SeriesSet:
        s = dense(arg.build(store, req.before(max(slots - 1, 0)) if slots is not None else req.before(seconds=seconds)))
        s = s.renamed(derived("movingAverage"))
        if slots == 0:
            return s.values(F.lit(None).cast("double"))
        size = F.lit(slots).cast("long") if slots is not None else F.floor(F.lit(seconds) / F.col("step")).cast("long") + 1
        if slots is not None and slots <= SHORT_WINDOW:
            return s.values(finite(F.sum("v").over(by_series().rowsBetween(1 - slots, 0)) / size))
        block = W.partitionBy("skey", "_block")
        upto, since = block.orderBy("t"), block.orderBy(F.desc("t"))
        rows = s.samples.withColumns({"_size": size, "_block": F.floor(F.col("t") / (F.col("step") * size))})
        rows = rows.withColumn("_upto", F.sum("v").over(upto.rowsBetween(W.unboundedPreceding, 0)))
        rows = rows.withColumn("_since", F.sum("v").over(since.rowsBetween(W.unboundedPreceding, 0)))
        if slots is not None:
            start = F.lag(F.struct("_since", "_block"), slots - 1).over(by_series())
        else:
            # The first slot of the window: steps differ, and none is longer than the store's longest.
            near = by_series().rangeBetween(-seconds, min(0, store.longest_step - 1 - seconds))
            start = F.first(F.struct("_since", "_block")).over(near)
            first = F.min("t").over(W.partitionBy("skey"))
            start = F.when(F.col("t") - (F.col("_size") - 1) * F.col("step") >= first, start)
        rows = rows.withColumn("_start", start)
        # At a block's end the window is the block; before the first whole window there is no block before.
        earlier = F.when(F.col("_start._block") < F.col("_block"), F.col("_start._since"))
        both = F.when(F.col("_upto").isNull(), earlier).when(earlier.isNull(), F.col("_upto")).otherwise(F.col("_upto") + earlier)
        part = F.when(F.col("_start").isNotNull(), both).otherwise(F.sum("v").over(by_series().rowsBetween(W.unboundedPreceding, 0)))
        return replace(s, samples=rows.withColumn("v", finite(part / F.col("_size"))).drop("_size", "_block", "_upto", "_since", "_start"))

    return Expr(build, arg.target, arg.method)


def timeShift(q: str | Expr, shift: str) -> Expr:
    """What the series were ``shift`` before (after, with a plus sign)."""
    arg = as_expr(q)
    seconds = duration(shift) if shift.strip()[:1] in "+-" else -duration(shift)

    def build(store: Store, req: Request) -> SeriesSet:
        s = arg.build(store, req.shifted(seconds))
        back = lambda c: align(F.col(c) - F.lit(seconds), F.col("step"))
        heads = s.heads.withColumns({"lo": back("lo"), "hi": back("hi")})
        return replace(s, heads=heads, samples=s.samples.withColumn("t", back("t"))).renamed(derived("timeShift"))

    return Expr(build, arg.target, arg.method)
