"""The catalog of series: names, branches, rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.globs import matches

#: Longest stored name, and what a new series gets without a rule (fixed values).
LONGEST_STORED = 127
DEFAULT = {"type": "float32", "retention": 7 * 86400, "step": 60}
TYPES = ("float32", "float64", "int8", "int16", "int32")


@dataclass(frozen=True)
class Rule:
    """How series whose names the expression finds are stored; retention 0 ignores them."""

    pattern: str
    retention: int = DEFAULT["retention"]
    step: int = DEFAULT["step"]
    type: str = DEFAULT["type"]


def n_segs(name: Column) -> Column:
    return F.size(F.split(name, r"\."))


def with_ids(rows: DataFrame) -> DataFrame:
    """Rows with a ``name`` each; those whose ``id`` is null get a hash of the name, so any
    task, and a replayed batch, gives the same. Where names would share an id, all but
    the one that has it already, or else the first in order, get another hash."""
    hashed = rows.withColumn("_id", F.coalesce("id", F.xxhash64("name")))
    twin = F.row_number().over(W.partitionBy("_id").orderBy(F.col("id").isNull(), "name")) > 1
    return hashed.withColumn("_twin", twin).withColumn("id", F.when(F.col("id").isNull() & F.col("_twin"), F.xxhash64("name", F.lit("again"))).otherwise(F.col("_id"))).drop("_id", "_twin")


def find(catalog: DataFrame, pattern: str) -> DataFrame:
    """``(id, name)`` of the series that fit."""
    return catalog.where(matches(pattern, F.col("name"), F.col("n_segs"))).select("id", "name")


def branches(catalog: DataFrame) -> DataFrame:
    """``(name, n_segs)`` of all proper prefixes of names."""
    segs = F.split("name", r"\.")
    deep = catalog.where(F.col("n_segs") > 1)
    prefix = deep.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("n_segs") - 1), lambda k: F.array_join(F.slice(segs, F.lit(1), k), "."))).alias("name"))
    return prefix.distinct().withColumn("n_segs", n_segs(F.col("name")))


def find_branches(catalog: DataFrame, pattern: str) -> DataFrame:
    """The branches that fit. Without ``**`` they all have the pattern's depth, so each
    name has one prefix to look at."""
    if "**" not in pattern:
        depth = pattern.count(".") + 1
        cut = catalog.where(F.col("n_segs") > depth).select(F.substring_index("name", ".", depth).alias("name"), F.lit(depth).alias("n_segs"))
        return cut.where(matches(pattern, F.col("name"), F.col("n_segs"))).select("name").distinct()
    return branches(catalog).where(matches(pattern, F.col("name"), F.col("n_segs"))).select("name")


def browse(catalog: DataFrame, pattern: str) -> DataFrame:
    """``(path, text, expandable)``: branches that fit, then series; ``text`` is the last segment."""
    found = find_branches(catalog, pattern).select(F.col("name").alias("path"), F.lit(True).alias("expandable"))
    leaves = find(catalog, pattern).select(F.col("name").alias("path"), F.lit(False).alias("expandable"))
    return found.unionByName(leaves).select("path", F.substring_index("path", ".", -1).alias("text"), "expandable")


def browse_paths(catalog: DataFrame, pattern: str) -> DataFrame:
    """The same as ``(path, is_leaf)``."""
    return browse(catalog, pattern).select("path", (~F.col("expandable")).alias("is_leaf"))


def index(catalog: DataFrame) -> DataFrame:
    """All names in order."""
    return catalog.select("name").orderBy("name")


def sanitize(name: Column) -> Column:
    """A name of any text: what isn't a letter, digit, ``_``, ``.`` or ``-`` becomes ``_``."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_.\-]", "_")


def settings(name: Column, rules: list[Rule]) -> Column:
    """``struct(type, retention, step)`` of the first rule whose expression finds
    something in the name, the defaults without any; null if it is to be ignored. Rules with an unknown
    type are skipped."""
    kind = "struct<type:string,retention:bigint,step:bigint>"
    pack = lambda t, r, s: F.struct(F.lit(t).alias("type"), F.lit(r).cast("long").alias("retention"), F.lit(s).cast("long").alias("step")).cast(kind)
    out = None
    for r in rules:
        if r.type in TYPES:
            value = pack(r.type, r.retention, r.step) if r.retention > 0 else F.lit(None).cast(kind)
            fits = name.rlike(r.pattern)
            out = F.when(fits, value) if out is None else out.when(fits, value)
    default = pack(DEFAULT["type"], DEFAULT["retention"], DEFAULT["step"])
    return default if out is None else out.otherwise(default)


def quantize(v: Column, type: Column) -> Column:
    """What storing as ``type`` makes of a value: floats narrow, integers clamp and
    lose their fraction; missing stays missing. Column ``type`` holds the names."""
    real = F.when(F.isnan(v), F.lit(None)).otherwise(v)
    clamp = lambda most: F.signum(real) * F.floor(F.least(F.abs(real), F.lit(float(most))))
    out = F.when(type == "float64", real).when(type == "float32", real.cast("float").cast("double"))
    for name, most in (("int8", 127), ("int16", 32767), ("int32", 2147483647)):
        out = out.when(type == name, clamp(most) + F.lit(0.0))
    return out


def expire(catalog: DataFrame, now: int) -> DataFrame:
    """The series that stay: those heard of within twice their retention."""
    return catalog.where(F.col("last_t").isNull() | (F.lit(now) < F.col("last_t") + 2 * F.col("retention")) | (F.col("retention") <= 0))


def summary(catalog: DataFrame, samples: DataFrame) -> DataFrame:
    """Numbers of series and samples, by type."""
    n = samples.groupBy("id").agg(F.count("*").alias("n"))
    return catalog.join(n, "id", "left").groupBy("type").agg(F.count("*").alias("series"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples"))
