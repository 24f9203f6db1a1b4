"""Point-set views of the driver's tables. Coordinates are integers over powers of two, so sums and
products are exact and results do not depend on the order of addition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud_emb(spark: SparkSession, sf_dir: str, first: int = 0) -> DataFrame:
    d = [(F.floor(F.col("embedding")[first + k] * 1024) / F.lit(64.0)).alias(c) for k, c in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("frame_id"), F.col("vec_id").alias("point_id"), *d)


def cloud_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("long").alias("frame_id"),
        (F.col("l_orderkey") * 1000 + F.row_number().over(w)).alias("point_id"),
        F.col("l_quantity").cast("double").alias("x"),
        (F.floor("l_extendedprice") / F.lit(1024.0)).alias("y"),
        (F.floor(F.col("l_discount") * 100) / F.lit(8.0)).alias("z"),
        (F.floor(F.col("l_tax") * 100) / F.lit(4.0)).alias("intensity"),
    )


def seconds(c: str = "ts") -> F.Column:
    """Seconds since the start of 2024, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', {c}) / 1e6D")


def scan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.when(F.col("event_type").isNull(), 0).otherwise(F.length("event_type"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), F.col("event_id").alias("point_id"), seconds().alias("ts"),
        (F.floor(F.col("value") * 16) / F.lit(16.0)).alias("x"), F.col("user_id").cast("double").alias("y"), order.cast("double").alias("z"),
    )


def imu_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.floor("value")
    part = lambda n, m: (F.pmod(v + n, F.lit(m)) / F.lit(float(m)) - 0.5)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), F.col("event_id").alias("arrival"), seconds().alias("ts"),
        part(0, 8).alias("gx"), part(1, 16).alias("gy"), part(2, 32).alias("gz"), part(3, 8).alias("ax"), part(4, 16).alias("ay"), (part(5, 32) + 9.75).alias("az"),
    )


def ring_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point at unit range, so that squared ranges are exact."""
    day = F.floor(seconds() / 86400)
    return table(spark, sf_dir, "events").select(
        day.cast("long").alias("frame_id"), F.col("event_id").alias("point_id"), F.col("user_id").alias("ring"), F.floor("value").cast("double").alias("ambient"),
        (F.floor(F.col("value") * 4) / F.lit(4.0)).alias("intensity"), F.lit(2.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"),
    )


# The same in SQL: common table expressions that a query's oracle starts with.
SQL = {
    "emb": "emb AS (SELECT CAST(label AS BIGINT) AS frame_id, vec_id AS point_id, floor(embedding[1]*1024)/64e0 AS x, floor(embedding[2]*1024)/64e0 AS y, floor(embedding[3]*1024)/64e0 AS z FROM embeddings)",
    "emb2": "emb2 AS (SELECT CAST(label AS BIGINT) AS frame_id, vec_id AS point_id, floor(embedding[4]*1024)/64e0 AS x, floor(embedding[5]*1024)/64e0 AS y, floor(embedding[6]*1024)/64e0 AS z FROM embeddings)",
    "li": "li AS (SELECT CAST(l_linenumber AS BIGINT) AS frame_id, l_orderkey*1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS point_id, CAST(l_quantity AS DOUBLE) AS x, floor(l_extendedprice)/1024e0 AS y, floor(l_discount*100)/8e0 AS z, floor(l_tax*100)/4e0 AS intensity FROM lineitem)",
    "scan": "scan AS (SELECT user_id AS stream_id, event_id AS point_id, epoch_us(ts - TIMESTAMP '2024-01-01')/1e6 AS ts, floor(value*16)/16e0 AS x, CAST(user_id AS DOUBLE) AS y, CAST(coalesce(length(event_type), 0) AS DOUBLE) AS z FROM events)",
    "imu": "imu AS (SELECT user_id AS stream_id, event_id AS arrival, epoch_us(ts - TIMESTAMP '2024-01-01')/1e6 AS ts, (CAST(floor(value) AS BIGINT) % 8)/8e0 - 0.5e0 AS gx, ((CAST(floor(value) AS BIGINT)+1) % 16)/16e0 - 0.5e0 AS gy, ((CAST(floor(value) AS BIGINT)+2) % 32)/32e0 - 0.5e0 AS gz, ((CAST(floor(value) AS BIGINT)+3) % 8)/8e0 - 0.5e0 AS ax, ((CAST(floor(value) AS BIGINT)+4) % 16)/16e0 - 0.5e0 AS ay, ((CAST(floor(value) AS BIGINT)+5) % 32)/32e0 - 0.5e0 + 9.75e0 AS az FROM events)",
    "ring": "ring AS (SELECT CAST(floor(epoch_us(ts - TIMESTAMP '2024-01-01')/1e6/86400) AS BIGINT) AS frame_id, event_id AS point_id, user_id AS ring, CAST(floor(value) AS DOUBLE) AS ambient, floor(value*4)/4e0 AS intensity, 2e0 AS x, 0e0 AS y, 0e0 AS z FROM events)",
}


def with_views(names: str, rest: str) -> str:
    head = "WITH " + ", ".join(SQL[n] for n in names.split())
    return head + (", " + rest.strip()[1:] if rest.strip().startswith(",") else " " + rest)
