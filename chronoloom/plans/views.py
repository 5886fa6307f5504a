"""Series stores that Spark derives from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.times import align
from chronoloom.operators.series import Store
from chronoloom.sources.catalog import n_segs, sanitize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000)


def _store(rows: DataFrame, step: int) -> Store:
    """A store of ``(name, t, v)`` by slot; ids count the names in order, which is
    work on the catalog alone."""
    rows = rows.groupBy("name", "t").agg(F.sum("v").alias("v"))
    names = rows.select("name").distinct().withColumn("id", F.row_number().over(W.orderBy("name")).cast("long"))
    null = F.lit(None).cast("long")
    catalog = names.select("id", "name", n_segs(F.col("name")).alias("n_segs"), F.lit("float64").alias("type"), null.alias("retention"), F.lit(step).cast("long").alias("step"), F.lit(0).cast("long").alias("creation"), null.alias("last_t"))
    return Store(catalog, rows.join(names, "name").select("id", "t", "v"), step)


def events(spark: SparkSession, sf_dir: str, step: int = 3600) -> Store:
    """``ev.<event_type>.s<user_id % 4>``: cents per slot."""
    name = F.concat(F.lit("ev."), "event_type", F.lit(".s"), (F.col("user_id") % 4).cast("string"))
    e = table(spark, sf_dir, "events").select(name.alias("name"), align(seconds(F.col("ts")), step).alias("t"), F.round(F.col("value") * 100).alias("v"))
    return _store(e, step)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as writes ``(name, v, t, seq)`` to series ``ev.<event_type>.u<user_id>``."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("ev."), "event_type", F.lit(".u"), F.col("user_id").cast("string")).alias("name"), F.round(F.col("value") * 100).alias("v"), seconds(F.col("ts")).alias("t"), F.col("event_id").alias("seq"))


def lineitem(spark: SparkSession, sf_dir: str) -> Store:
    """``li.<l_returnflag>.<l_linestatus>``: quantity per day."""
    name = F.concat_ws(".", F.lit("li"), "l_returnflag", "l_linestatus")
    return _store(table(spark, sf_dir, "lineitem").select(name.alias("name"), align(seconds(F.col("l_shipdate")), 86400).alias("t"), F.col("l_quantity").alias("v")), 86400)


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of names ``part.<brand>.<type words>.p<key>``."""
    name = F.concat_ws(".", F.lit("part"), sanitize(F.col("p_brand")), F.regexp_replace(sanitize(F.lower("p_type")), "_", "."), F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name")).withColumn("n_segs", n_segs(F.col("name")))
