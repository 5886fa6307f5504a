"""Series sets and the request that they answer.

A series set is two frames: ``heads`` has a row per series, ``samples`` a row per
slot that has a value. Names and targets live in the heads alone, so samples
shuffle as narrow rows, and what renames or orders series costs as much as the
catalog, not as the data.

    heads    skey, arg, sid, step, lo, hi, target, name
    samples  skey, step, t, v

``lo`` and ``hi`` (exclusive) are the slots that a series covers; missing slots are
nulls by absence until :func:`dense` fills them in, and a set that is ``full`` has them all. Series order is (arg, sid, skey).

An expression is a function of the request: what wants samples before the window
asks its argument for a wider request. Python composes these functions; Catalyst
sees one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.times import align

#: Names longer than this are cut (fixed value).
LONGEST_NAME = 1000


def by_series():
    """A series' slots in order."""
    return W.partitionBy("skey").orderBy("t")


@dataclass(frozen=True)
class Request:
    """Seconds from ``first`` to ``last``, both included; ``pretime`` seconds and
    ``pre`` slots of each series before."""

    first: int
    last: int
    pre: int = 0
    pretime: int = 0

    def before(self, slots: int = 0, seconds: int = 0) -> Request:
        return replace(self, pre=self.pre + slots, pretime=self.pretime + seconds)

    def shifted(self, seconds: int) -> Request:
        return replace(self, first=self.first + seconds, last=self.last + seconds)

    def lo(self, step: Column) -> Column:
        return align(F.lit(self.first - self.pretime) - F.lit(self.pre) * step, step)

    def start(self, step: Column) -> Column:
        return align(F.lit(self.first), step)

    def hi(self, step: Column) -> Column:
        return align(F.lit(self.last) + step, step)


@dataclass(frozen=True)
class SeriesSet:
    heads: DataFrame
    samples: DataFrame
    full: bool = False

    def values(self, v: Column) -> SeriesSet:
        return replace(self, samples=self.samples.withColumn("v", v))

    def renamed(self, name: Column) -> SeriesSet:
        return replace(self, heads=self.heads.withColumn("name", name))

    def only(self, heads: DataFrame) -> SeriesSet:
        """The series of ``heads``; its samples by a semi-join that Catalyst may broadcast."""
        return replace(self, heads=heads, samples=self.samples.join(heads.select("skey"), "skey", "left_semi"))


@dataclass(frozen=True)
class Expr:
    """``build`` gives the series for a request; ``target`` is the text of the last
    path below, ``method`` how to consolidate the result."""

    build: Callable[[Store, Request], SeriesSet]
    target: str
    method: str = "average"


@dataclass(frozen=True)
class Store:
    """``catalog`` has (id, name, n_segs, step, retention, last_t), ``samples``
    (id, t, v) and maybe ``day``, by which files are parted; ``retention`` and
    ``last_t`` may be null (unlimited, unknown). No series has a longer step than
    ``longest_step``, which bounds the scan for slots before a window."""

    catalog: DataFrame
    samples: DataFrame
    longest_step: int = 604_800


def derived(function: str) -> Column:
    """``function(name)``, cut if too long."""
    full = F.concat(F.lit(f"{function}("), F.col("name"), F.lit(")"))
    return F.when(F.length(full) > LONGEST_NAME, F.concat(F.substring(full, 1, LONGEST_NAME - 4), F.lit("..."))).otherwise(full)


def finite(v: Column) -> Column:
    """A missing value is null, never NaN."""
    return F.when(F.isnan(v), F.lit(None)).otherwise(v)


def dense(s: SeriesSet) -> SeriesSet:
    """All slots of each series, null where missing; one shuffle by series.

    A series' rows each reach up to the next one, with a row for its first slot
    added; no join with a grid is needed, and windows by series can follow without
    another shuffle.
    """
    if s.full:
        return s
    first = s.heads.where("lo < hi").select("skey", "step", F.col("lo").alias("t"), F.lit(None).cast("double").alias("v"), F.col("hi").alias("hi"))
    rows = s.samples.select("skey", "step", "t", "v", F.lit(None).cast("long").alias("hi")).unionByName(first)
    order = W.partitionBy("skey").orderBy("t", F.col("hi").isNull())
    upto = F.coalesce(F.lead("t").over(order), F.max("hi").over(W.partitionBy("skey")))
    spans = rows.withColumn("upto", upto).where("t < upto")
    slots = spans.select("skey", "step", F.col("t").alias("at"), "v", F.explode(F.sequence("t", F.col("upto") - F.col("step"), "step")).alias("t"))
    return replace(s, samples=slots.select("skey", "step", "t", F.when(F.col("t") == F.col("at"), F.col("v")).alias("v")), full=True)


def within(s: SeriesSet, req: Request) -> SeriesSet:
    """Without the slots before the window."""
    start = req.start(F.col("step"))
    heads = s.heads.withColumn("lo", F.greatest("lo", start))
    return replace(s, heads=heads, samples=s.samples.where(F.col("t") >= start))
