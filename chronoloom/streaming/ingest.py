"""Taking samples in: last write per slot wins, retention goes by sample time.

A batch is a bounded frame ``(name, v, t)`` with an order of arrival; a stream hands
its micro-batches to the same function. New names get a catalog row by the rules,
times are floored to their series' slots, values are stored as their type has them,
and slots older than the newest one less the retention go. All of it is a union
and one aggregate by slot, so replaying a batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.times import align
from chronoloom.operators.series import Store
from chronoloom.sources.catalog import LONGEST_STORED, Rule, n_segs, quantize, settings, with_ids
from chronoloom.sources.store import commit, committed, day, day_folders, open_store, read_days


def register(catalog: DataFrame, names: DataFrame, rules: list[Rule], now: int) -> DataFrame:
    """The catalog with rows for the new ones of ``names`` (one column ``name``).

    An id is a hash of its name (:func:`with_ids`).
    """
    made = names.distinct().withColumn("s", settings(F.col("name"), rules)).where("s is not null")
    null = F.lit(None).cast("long")
    rows = made.select(
        null.alias("id"), "name", n_segs(F.col("name")).alias("n_segs"), F.col("s.type").alias("type"), F.col("s.retention").alias("retention"),
        F.col("s.step").alias("step"), F.lit(now).cast("long").alias("creation"), null.alias("last_t"),
    )
    # Of a name that is there already the new row is the later one.
    nth = F.row_number().over(W.partitionBy("name").orderBy(F.col("id").isNull()))
    return with_ids(catalog.unionByName(rows).withColumn("_nth", nth).where("_nth = 1").drop("_nth")).select(*catalog.columns)


def slots(batch: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(id, t, v, seq)``: a batch ``(name, v, t, seq)`` by slot; names without a
    catalog row (ignored ones) and missing values or times go."""
    known = catalog.select("id", "name", "type", "step")
    met = batch.where("t is not null").withColumn("name", F.substring("name", 1, LONGEST_STORED)).join(known, "name")
    return met.select("id", align(F.col("t"), F.col("step")).alias("t"), quantize(F.col("v"), F.col("type")).alias("v"), "seq").where("v is not null")


def newest(catalog: DataFrame, fresh: DataFrame) -> DataFrame:
    """The catalog with each series' newest slot."""
    last = fresh.groupBy("id").agg(F.max("t").alias("_t"))
    return catalog.join(last, "id", "left").withColumn("last_t", F.greatest("last_t", "_t")).drop("_t")


def merge(store: Store, batch: DataFrame, rules: list[Rule] = (), now: int = 0) -> Store:
    """The store after a batch ``(name, v, t, seq)``.

    Of several writes to a slot the one with the highest ``seq`` wins, and any of
    them wins over what was stored. Late samples within retention are taken; older
    ones go, as does what a jump ahead leaves behind.
    """
    names = batch.select(F.substring("name", 1, LONGEST_STORED).alias("name")).where("name is not null")
    catalog = register(store.catalog, names, list(rules), now)
    fresh = slots(batch, catalog)
    catalog = newest(catalog, fresh)
    old = store.samples.select("id", "t", "v", F.lit(None).cast("long").alias("seq"))
    # A struct orders nulls first, so stored values lose against any write.
    one = old.unionByName(fresh.select("id", "t", "v", F.col("seq").cast("long").alias("seq"))).groupBy("id", "t").agg(F.max_by("v", F.struct("seq", "v")).alias("v"))
    return Store(catalog, retained(one, catalog))


def retained(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """Samples newer than their series' newest slot less its retention."""
    oldest = catalog.select("id", F.when(F.col("retention") > 0, F.col("last_t") - F.col("retention")).alias("_oldest"))
    return samples.join(oldest, "id").where(F.col("_oldest").isNull() | (F.col("t") > F.col("_oldest"))).drop("_oldest")


def counts(store: Store, batch: DataFrame, rules: list[Rule] = (), now: int = 0) -> DataFrame:
    """What a batch does, ``(added, changed, same, old)``: slots that are new, get
    another value, get the value they have, or lie before the retention."""
    catalog = register(store.catalog, batch.select("name"), list(rules), now)
    fresh = slots(batch, catalog)
    catalog = newest(catalog, fresh)
    last = fresh.groupBy("id", "t").agg(F.max_by("v", F.struct("seq", "v")).alias("v"))
    oldest = catalog.select("id", F.when(F.col("retention") > 0, F.col("last_t") - F.col("retention")).alias("_oldest"))
    met = last.join(oldest, "id").join(store.samples.select("id", "t", F.col("v").alias("was")), ["id", "t"], "left")
    old = F.coalesce(F.col("t") <= F.col("_oldest"), F.lit(False))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return met.agg(n(~old & F.col("was").isNull()).alias("added"), n(~old & (F.col("was") != F.col("v"))).alias("changed"), n(~old & (F.col("was") == F.col("v"))).alias("same"), n(old).alias("old"))


def write_batch(spark: SparkSession, path: str, batch: DataFrame, rules: list[Rule], now: int) -> None:
    """Merges a batch into a store on disk. The batch is written first, so that all
    that is derived from it sees the same rows. Only the days that it touches are read
    and written again, as a new version that the catalog's commits; days that
    no series' retention reaches any more go."""
    version = committed(spark, path)
    batch.write.mode("overwrite").parquet(f"{path}/_batch")
    batch = spark.read.schema(batch.schema).parquet(f"{path}/_batch")
    store = open_store(spark, path)
    names = batch.select(F.substring("name", 1, LONGEST_STORED).alias("name")).where("name is not null")
    catalog = register(store.catalog, names, rules, now)
    fresh = slots(batch, catalog).withColumn("day", day(F.col("t")))
    catalog = newest(catalog, fresh)
    days = {r.day for r in fresh.select("day").distinct().collect()}  # a folder each, in any case
    folders = day_folders(spark, path, version)
    touched = read_days(spark, path, [f for d, f in folders.items() if d in days]).select("day", "id", "t", "v", F.lit(None).cast("long").alias("seq"))
    one = touched.unionByName(fresh.select("day", "id", "t", "v", F.col("seq").cast("long").alias("seq"))).groupBy("day", "id", "t").agg(F.max_by("v", F.struct("seq", "v")).alias("v"))
    oldest = catalog.agg(F.min(F.when(F.col("retention") > 0, F.coalesce(F.col("last_t") - F.col("retention"), F.lit(-(1 << 62)))).otherwise(F.lit(-(1 << 62)))).alias("t")).first()["t"]
    gone = {d for d in folders if oldest is not None and (d + 1) * 86400 <= oldest}
    commit(spark, path, catalog, retained(one, catalog), days, gone)


def stream_into(lines: DataFrame, path: str, checkpoint: str, rules: list[Rule] = (), now: int = 0):
    """A streaming query that merges a parsed stream's lines into a store on disk.

    The order of arrival is the micro-batch, then the place in it; a batch that is
    replayed after a failure writes the same slots again.
    """

    def each(batch: DataFrame, number: int) -> None:
        ordered = batch.where("not malformed").select("name", "v", "t", (F.lit(number) * (1 << 40) + F.monotonically_increasing_id() % (1 << 40)).alias("seq"))
        write_batch(batch.sparkSession, path, ordered, list(rules), now)

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
