"""The engine's own measurements as writes to series."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from chronoloom.sources.catalog import sanitize

FIELDS = ("numInputRows", "inputRowsPerSecond", "processedRowsPerSecond", "batchDuration")


class ProgressListener(StreamingQueryListener):
    """Keeps the measurements of streaming queries until they are taken: a few numbers for each micro-batch."""

    def __init__(self, prefix: str = "self."):
        self.prefix, self.rows = prefix, []

    def onQueryProgress(self, event) -> None:
        p, now = event.progress, int(time.time())
        for field in FIELDS:
            value = getattr(p, field, None)
            if value is not None:
                self.rows.append((f"{self.prefix}{p.name or p.id}.{field}", float(value), now, p.batchId))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def take(self, spark: SparkSession) -> DataFrame:
        """``(name, v, t, seq)`` of what was kept since the last call."""
        rows, self.rows = self.rows, []
        df = spark.createDataFrame(rows, "name string, v double, t long, seq long")
        return df.withColumn("name", sanitize(F.col("name")))
