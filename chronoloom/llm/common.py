"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and all
    of Spark runs in one process (as in unit tests) a temporary folder is made and
    remembered; on a cluster it would lose data, so there the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.chronoloom.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        path = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        spark.conf.set("spark.chronoloom.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (cuts lineage,
    survives the loss of executors)."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that are broadcast at most (two longs each, about 100 bytes in a hash table).
FEW = 250_000


def few(keys: DataFrame) -> bool:
    """Whether ``keys`` (narrow, and written already) may be broadcast; counts no further than that."""
    return keys.limit(FEW + 1).count() <= FEW


#: Rows and bytes of an Arrow batch of texts at most: a batch is held several times over, in the JVM and in Python.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20


@lru_cache(maxsize=1)
def _allocator():
    """The C library's, if it can give free memory back."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with batches that fit texts of any length: Spark reads their
    size from the session when a query runs, so larger settings are lowered there, and
    smaller ones of the user's stay. When a task is done, its worker, which Spark may
    use again, gives free memory back."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _allocator():
                trim(0)

    return df.mapInArrow(whole, schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id's decimal text leaves ``fold`` modulo
    ``folds``. A null id counts as empty text, so it is never held out unless
    ``fold`` is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold
