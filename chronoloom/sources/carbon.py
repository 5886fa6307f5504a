"""The plaintext feed: ``name value time`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line: dotted name, decimal number without a plus sign, seconds or -1 (fixed pattern).
LINE = r"^([A-Za-z0-9!\"#$%&'+\-:;<=>?@\\^_`~]+(?:\.[A-Za-z0-9!\"#$%&'+\-:;<=>?@\\^_`~]+)*) (-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:e[+-]?[0-9]+)?) (-1|[0-9]+)\r?$"


def parse_lines(lines: DataFrame, now: int | None = None) -> DataFrame:
    """``(line, name, v, t, malformed)`` from a frame with ``value``; time -1 is
    ``now`` (the query's time by default). Malformed lines keep only their text."""
    line = F.regexp_replace("value", r"[\r\n]+$", "")
    ok = F.coalesce(line.rlike(LINE), F.lit(False))
    part = lambda k: F.when(ok, F.regexp_extract(line, LINE, k))
    at = F.unix_timestamp() if now is None else F.lit(now)
    t = part(3).cast("long")
    return lines.select(line.alias("line"), part(1).alias("name"), part(2).cast("double").alias("v"), F.when(t == -1, at.cast("long")).otherwise(t).alias("t"), (~ok).alias("malformed"))


def read_lines(spark: SparkSession, path: str, now: int | None = None) -> DataFrame:
    return parse_lines(spark.read.text(path), now)


def stream_lines(spark: SparkSession, path: str, now: int | None = None, **options) -> DataFrame:
    """The same from a folder to which files are added."""
    return parse_lines(spark.readStream.options(**options).text(path), now)


def stream_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """The same from a socket (for development: a socket can't be replayed)."""
    return parse_lines(spark.readStream.format("socket").option("host", host).option("port", port).load())


def format_lines(samples: DataFrame) -> DataFrame:
    """``value`` lines from ``(name, v, t)``; whole numbers are written without a fraction."""
    v = F.col("v")
    number = F.when((v == F.floor(v)) & (F.abs(v) < 1e15), F.floor(v).cast("string")).otherwise(F.regexp_replace(F.lower(v.cast("string")), r"\.0e", "e"))
    return samples.where("v is not null").select(F.concat_ws(" ", "name", number, F.col("t").cast("string")).alias("value"))


def write_lines(samples: DataFrame, path: str) -> None:
    format_lines(samples).write.mode("overwrite").text(path)


def record(stream: DataFrame, path: str, checkpoint: str):
    """A streaming query that writes a parsed stream's lines to text files."""
    return stream.where("not malformed").select(F.col("line").alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
