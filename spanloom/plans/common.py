"""What the query modules share: tables, events as scored rows and as spans in whole seconds, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One row an event: a score u of 0 to 1, a whole number k of 0 to 99, its kind and its time in microseconds.
EVENT_SQL = "ev AS (SELECT event_id, user_id, event_type AS kind, value AS v, least(value, 100) / 100 AS u, CAST(json_extract(props, '$.k') AS BIGINT) AS k, props, epoch_us(ts) AS tm FROM events)"
#: Events as spans of whole seconds; ``ord`` counts a user's events from 1.
SPAN_SQL = EVENT_SQL + ", sp AS (SELECT *, tm // 1000000 AS s, tm // 1000000 + CAST(floor(v * 60) AS BIGINT) AS e, row_number() OVER (PARTITION BY user_id ORDER BY tm, event_id) AS ord FROM ev)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", "user_id", F.col("event_type").alias("kind"), F.col("value").alias("v"), (F.least(F.col("value"), F.lit(100.0)) / 100).alias("u"), F.get_json_object("props", "$.k").cast("long").alias("k"), "props", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


def second_spans(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Events with start, end (whole seconds) and ord."""
    start = F.floor(F.col("at") / 1_000_000)
    order = Window.partitionBy("user_id").orderBy("at", "event_id")
    rows = events(spark, sf_dir).withColumns({"start": start, "end": start + F.floor(F.col("v") * 60), "ord": F.row_number().over(order).cast("long")})
    return rows.where(F.col("kind").isin(*kinds)) if kinds else rows


def rounded(name: str, places: int) -> Column:
    """A column rounded as DuckDB rounds it, scaled first: 0.145 is a hair less and gives 0.14, where ``F.round`` goes by the decimal digits and gives 0.15."""
    return F.round(F.col(name) * 10**places) / 10**places


def pick(index: Column, values: tuple[str, ...]) -> Column:
    """The value that an index, modulo their number, stands for."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def pick_sql(index: str, values: tuple[str, ...]) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST(({index}) % {len(values)} AS INTEGER) + 1)"
