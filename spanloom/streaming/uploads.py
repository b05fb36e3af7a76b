"""Counters that are sent on: what has not been acknowledged yet, behind a list of what may leave, with retry and back-off.

Increments, and what was acknowledged, are folders of Parquet under one shared path, a part for each batch or delivery. A part is
overwritten if its batch comes again, so a stream that is restarted counts nothing twice; totals and pending deltas are sums over these
parts, worked out by Spark. The driver keeps no counters, only when it last tried and how often it failed since.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def delta(totals: DataFrame, sent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n: what totals (keys, n) have beyond what was sent; counters that have not grown have no row."""
    both = totals.select(*keys, F.col("n").cast("long").alias("n")).unionByName(sent.select(*keys, (-F.col("n").cast("long")).alias("n")))
    return both.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")


def envelope(rows: DataFrame, allowed: Mapping[str, Sequence[str] | None], counter: str = "counter", cohort: str = "cohort") -> DataFrame:
    """Rows that may leave: known counters, and of these the cohorts that are listed (None: all). Other columns than counter, cohort and n do not leave."""
    good = F.lit(False)
    for name, cohorts in allowed.items():
        good = good | ((F.col(counter) == name) & (F.lit(True) if cohorts is None else F.col(cohort).isin(*cohorts)))
    return rows.where(F.coalesce(good, F.lit(False))).select(counter, cohort, "n")


def backoff(failures: int, least: float, most: float) -> float:
    """Seconds from one attempt to the next: doubled for each failure in a row, up to eight times and to ``most``."""
    return min(least * 2.0 ** min(failures, 8), most)


@dataclass
class Uploader:
    """For ``writeStream.foreachBatch``: adds a batch of increments (counter, cohort, n) and sends what is pending when it is time.

    ``send(rows, key)`` delivers rows; it gets the same key until it has succeeded, so that a receiver can tell a delivery that comes again.
    """

    path: str
    send: Callable[[DataFrame, str], None]
    allowed: Mapping[str, Sequence[str] | None]
    least: float = 3600.0
    most: float = 86_400.0
    clock: Callable[[], float] = time.time
    failures: int = 0
    last: float | None = None
    outcome: str = field(default="", compare=False)

    KEYS = ("counter", "cohort")
    SCHEMA = "counter string, cohort string, n long"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*self.KEYS).agg(F.sum("n").cast("long").alias("n")).write.mode("overwrite").parquet(f"{self.path}/increments/part={batch_id}")
        self.flush(batch.sparkSession)

    def _stored(self, spark: SparkSession, what: str) -> DataFrame:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], f"{self.SCHEMA}, part long")
        return spark.read.schema(f"{self.SCHEMA}, part long").parquet(f"{self.path}/{what}")

    def pending(self, spark: SparkSession) -> DataFrame:
        sums = lambda what: self._stored(spark, what).groupBy(*self.KEYS).agg(F.sum("n").alias("n"))
        return envelope(delta(sums("increments"), sums("acknowledged"), self.KEYS), self.allowed)

    def flush(self, spark: SparkSession) -> str:
        """Send what is pending: sent, failed, nothing pending or too soon."""
        now = self.clock()
        if self.last is not None and now - self.last < backoff(self.failures, self.least, self.most):
            self.outcome = "too soon"
            return self.outcome
        delivery = (self._stored(spark, "acknowledged").agg(F.max("part")).first()[0] or 0) + 1
        rows = self.pending(spark)
        if not rows.limit(1).count():
            self.outcome = "nothing pending"
            return self.outcome
        rows.write.mode("overwrite").parquet(f"{self.path}/deliveries/{delivery}")
        rows = spark.read.schema(self.SCHEMA).parquet(f"{self.path}/deliveries/{delivery}")
        self.last = now
        try:
            self.send(rows, str(delivery))
        except Exception:  # noqa: BLE001 - whatever the receiver raises, the rows stay pending
            self.failures += 1
            self.outcome = "failed"
            return self.outcome
        rows.write.mode("overwrite").parquet(f"{self.path}/acknowledged/part={delivery}")
        self.failures = 0
        self.outcome = "sent"
        return self.outcome
