"""Series on disk: Parquet of samples by day, and of the catalog, in versions.

    catalog/version=N          id, name, n_segs, type, retention, step, creation, last_t
    samples/day=D/version=N    id, t, v

Files are immutable. A change writes new versions of the days it touches and then of
the catalog, whose ``_SUCCESS`` file is what commits them: readers take the newest
committed version and of each day the newest one up to that. A writer that dies
in between leaves the store as it was. One writer at a time. Within a file samples are
sorted by id and time, so a scan for few series or a short range skips row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.series import Store
from chronoloom.sources.catalog import expire

CATALOG = "id long, name string, n_segs int, type string, retention long, step long, creation long, last_t long"
SAMPLES = "id long, t long, v double, day long"


def _files(spark: SparkSession, path: str):
    """(file system, path) in Hadoop's terms, so any store that Spark reads will do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str, key: str, marked: bool = False) -> list[int]:
    """The numbers N of the folders ``key=N``; with ``marked`` of those whose write ended well."""
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return []
    folders = [x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()]
    found = [int(n.removeprefix(f"{key}=")) for n in folders if n.startswith(f"{key}=") and n.removeprefix(f"{key}=").lstrip("-").isdigit()]
    return sorted(n for n in found if not marked or fs.exists(_files(spark, f"{path}/{key}={n}/_SUCCESS")[1]))


def committed(spark: SparkSession, path: str) -> int:
    """The newest version of the store; 0 if there is none."""
    return max(_numbers(spark, f"{path}/catalog", "version", marked=True), default=0)


def day_folders(spark: SparkSession, path: str, version: int) -> dict[int, str]:
    """The folder of each day's samples in that version: as many as there are days."""
    out = {}
    for day in _numbers(spark, f"{path}/samples", "day"):
        at = f"{path}/samples/day={day}"
        known = [n for n in _numbers(spark, at, "version") if n <= version]
        if known:
            out[day] = f"{at}/version={known[-1]}"
    return out


def read_days(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], SAMPLES)
    return spark.read.schema(SAMPLES).option("basePath", f"{path}/samples").parquet(*folders).drop("version")


def open_store(spark: SparkSession, path: str) -> Store:
    version = committed(spark, path)
    if not version:
        return Store(spark.createDataFrame([], CATALOG), spark.createDataFrame([], SAMPLES), 1)
    catalog = spark.read.schema(CATALOG).parquet(f"{path}/catalog/version={version}")
    longest = catalog.agg(F.coalesce(F.max("step"), F.lit(1))).first()[0]
    return Store(catalog, read_days(spark, path, list(day_folders(spark, path, version).values())), longest)


def day(t):
    return F.floor(t / 86400)


def commit(spark: SparkSession, path: str, catalog: DataFrame, samples: DataFrame, days: set[int], gone: set[int] = frozenset()) -> None:
    """Writes ``samples`` (all there are of ``days``) and ``catalog`` as the next
    version, then takes away what it replaces, ``days`` without samples, and the days
    ``gone``."""
    was = committed(spark, path)
    now = was + 1
    by_day = samples.select("id", "t", "v", F.col("day").cast("long").alias("day"), F.lit(now).alias("version"))
    for at in (f"{path}/catalog/version={now}", *(f"{path}/samples/day={d}/version={now}" for d in _numbers(spark, f"{path}/samples", "day"))):
        fs, old = _files(spark, at)  # what a writer left that died
        fs.delete(old, True)
    by_day.repartition("day", F.pmod("id", F.lit(8))).sortWithinPartitions("day", "id", "t").write.mode("append").partitionBy("day", "version").parquet(f"{path}/samples")
    catalog.write.mode("overwrite").parquet(f"{path}/catalog/version={now}")
    for n in _numbers(spark, f"{path}/catalog", "version"):
        if n < was:  # the last one stays for readers that opened it
            fs, old = _files(spark, f"{path}/catalog/version={n}")
            fs.delete(old, True)
    for d in _numbers(spark, f"{path}/samples", "day"):
        known = _numbers(spark, f"{path}/samples/day={d}", "version")
        for n in known:
            if d in gone or (d in days and now not in known) or n < max((k for k in known if k <= was), default=0):
                fs, old = _files(spark, f"{path}/samples/day={d}/version={n}")
                fs.delete(old, True)


def write_store(store: Store, path: str) -> None:
    """Writes both tables anew."""
    spark = store.catalog.sparkSession
    samples = store.samples.withColumn("day", day(F.col("t")))
    kept = {r.day for r in samples.select("day").distinct().collect()}
    commit(spark, path, store.catalog, samples, kept, set(_numbers(spark, f"{path}/samples", "day")) - kept)


def compact(spark: SparkSession, path: str, now: int) -> None:
    """What retention asks for, on disk: series not heard of within twice their retention
    go, and samples older than their series' newest slot less its retention. For a
    regular job: ingestion itself touches only the days of its batch."""
    store = open_store(spark, path)
    catalog = expire(store.catalog, now)
    oldest = catalog.select("id", F.when(F.col("retention") > 0, F.col("last_t") - F.col("retention")).alias("_oldest"))
    kept = store.samples.join(oldest, "id").where(F.col("_oldest").isNull() | (F.col("t") > F.col("_oldest"))).drop("_oldest")
    write_store(Store(catalog, kept.select("id", "t", "v")), path)


def erase(store: Store, ids: DataFrame) -> Store:
    """Without the series of ``ids`` (one column ``id``)."""
    return Store(store.catalog.join(ids, "id", "left_anti"), store.samples.join(ids, "id", "left_anti"))


def reconfigure(store: Store, changes: DataFrame) -> Store:
    """With new settings ``(id, type, retention, step)``; series whose settings differ
    lose their samples."""
    new = changes.select("id", F.col("type").alias("_type"), F.col("retention").alias("_retention"), F.col("step").alias("_step"))
    both = store.catalog.join(new, "id", "left")
    differs = F.col("_type").isNotNull() & ~((F.col("type") == F.col("_type")) & (F.col("retention") == F.col("_retention")) & (F.col("step") == F.col("_step")))
    changed = both.where(differs).select("id")
    keep = [c for c in store.catalog.columns if c not in ("type", "retention", "step", "last_t")]
    catalog = both.select(*keep, *(F.coalesce(f"_{c}", c).alias(c) for c in ("type", "retention", "step")), F.when(~differs, F.col("last_t")).alias("last_t"))
    return Store(catalog.select(*store.catalog.columns), store.samples.join(changed, "id", "left_anti"))
