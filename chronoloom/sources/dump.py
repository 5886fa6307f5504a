"""Dumps of whole series, generated series, and a look at their time stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators.series import Store
from chronoloom.sources.catalog import find, n_segs, with_ids

VERSION = "2018.1"
RECORD = "name string, type string, creation long, retention long, interval long, first long, samples array<double>"
#: Names of the digits, for generated series (fixed values).
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def dump(store: Store, pattern: str = "**") -> DataFrame:
    """A record per series: settings, first slot and all samples from there on, null
    for gaps. An array holds one series' samples within its retention."""
    some = store.catalog.join(find(store.catalog, pattern).select("id"), "id", "left_semi")
    # Each sample comes with the nulls up to the next one; of a slot that is there twice the largest value counts.
    ahead = F.lead("t").over(W.partitionBy("id").orderBy("t", "v"))
    rows = store.samples.where("v is not null").join(some.select("id", "step"), "id").withColumn("next", ahead).where("next is null or next > t")
    gap = F.coalesce((F.col("next") - F.col("t")) / F.col("step") - 1, F.lit(0)).cast("int")
    piece = F.concat(F.array("v"), F.array_repeat(F.lit(None).cast("double"), gap))
    by = rows.groupBy("id").agg(F.min("t").alias("first"), F.sort_array(F.collect_list(F.struct("t", piece.alias("p")))).alias("pieces"))
    filled = by.select("id", "first", F.flatten(F.transform("pieces", lambda x: x["p"])).alias("samples"))
    return some.join(filled, "id", "left").select("name", "type", "creation", "retention", F.col("step").alias("interval"), "first", F.coalesce("samples", F.array().cast("array<double>")).alias("samples"))


def write_dump(records: DataFrame, path: str) -> None:
    """JSON lines, one record each, with the version in every line."""
    records.withColumn("version", F.lit(VERSION)).write.mode("overwrite").json(path)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def load(records: DataFrame, into: Store | None = None) -> Store:
    """The store that the records describe; ``into`` gets them added, and of a name
    that it has already the new record counts."""
    numbered = with_ids(records.withColumn("id", F.lit(None).cast("long")))
    catalog = numbered.select("id", "name", n_segs(F.col("name")).alias("n_segs"), "type", "retention", F.col("interval").alias("step"), "creation", (F.col("first") + (F.size("samples") - 1) * F.col("interval")).alias("last_t"))
    samples = numbered.select("id", "first", "interval", F.posexplode("samples").alias("k", "v")).where("v is not null").select("id", (F.col("first") + F.col("k") * F.col("interval")).alias("t"), "v")
    if into is None:
        return Store(catalog, samples)
    known = into.catalog.join(catalog.select("name"), "name", "left_semi").select("id")
    rest = Store(into.catalog.join(known, "id", "left_anti"), into.samples.join(known, "id", "left_anti"))
    # Ids that the rest of the store has stay with it.
    new = catalog.select("name", F.col("id").alias("_was"))
    both = with_ids(rest.catalog.unionByName(catalog.withColumn("id", F.lit(None).cast("long")).select(*rest.catalog.columns)))
    moved = both.join(new, "name").select("id", "_was")
    return Store(both, rest.samples.select("id", "t", "v").unionByName(samples.withColumnRenamed("id", "_was").join(moved, "_was").select("id", "t", "v")))


def generate(spark: SparkSession, prefix: str = "test.", metrics: int = 100, samples: int = 10, interval: int = 60, start: int = 0, low: float = 0.0, high: float = 10.0, seed: int = 0) -> DataFrame:
    """``(name, t, v)``: series that walk at random, named by their number's digits
    in words. Steps come from a hash, so any task makes the same ones."""
    rows = spark.range(metrics).select(F.col("id").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k"))
    words = F.array_join(F.transform(F.split(F.col("m").cast("string"), ""), lambda d: F.element_at(F.array(*map(F.lit, DIGITS)), d.cast("int") + 1)), ".")
    unit = F.pmod(F.xxhash64("m", "k", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    moved = rows.withColumn("d", F.lit(low) + unit * F.lit(high - low))
    walk = F.sum("d").over(W.partitionBy("m").orderBy("k"))
    return moved.select(F.concat(F.lit(prefix), words).alias("name"), (F.lit(start) + F.col("k") * interval).alias("t"), walk.alias("v"))


def analyze(samples: DataFrame, key: str = "id") -> DataFrame:
    """``(bits, n)``: how many second differences of a series' times have so many
    bits, negative for falls, 0 for none."""
    w = W.partitionBy(key).orderBy("t")
    delta = samples.select(key, "t", (F.col("t") - F.lag("t").over(w)).alias("d"))
    second = delta.select((F.col("d") - F.lag("d").over(w)).alias("dd")).where("dd is not null")
    size = F.floor(F.log2(F.abs("dd").cast("double"))) + 1
    bits = F.when(F.col("dd") == 0, F.lit(0)).otherwise(F.signum("dd").cast("long") * size)
    return second.groupBy(bits.cast("long").alias("bits")).agg(F.count("*").alias("n"))
