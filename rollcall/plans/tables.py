"""The driver's tables in the roles that the operators need; see each query for which proxy it takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as boxes of an image: integer geometry and a unique position."""
    line = table(spark, sf_dir, "lineitem")
    pos = F.concat_ws("-", *(F.lpad(F.col(c).cast("string"), 10, "0") for c in ("l_linenumber", "l_partkey", "l_suppkey")), F.lpad(F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), 12, "0"))
    return line.select(
        F.col("l_orderkey").alias("image"), pos.alias("pos"), (F.col("l_partkey") % 100).alias("x0"), (F.col("l_suppkey") % 100).alias("y0"),
        (F.col("l_partkey") % 100 + F.col("l_quantity").cast("long")).alias("x1"), (F.col("l_suppkey") % 100 + 5 * F.col("l_linenumber") + 20).alias("y1"),
        F.round("l_discount", 2).alias("score"), F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("line"),
    )


BOXES_SQL = """boxes AS (SELECT l_orderkey AS image,
  concat_ws('-', lpad(l_linenumber::VARCHAR, 10, '0'), lpad(l_partkey::VARCHAR, 10, '0'), lpad(l_suppkey::VARCHAR, 10, '0'), lpad(round(l_extendedprice * 100)::BIGINT::VARCHAR, 12, '0')) AS pos,
  l_partkey % 100 AS x0, l_suppkey % 100 AS y0, l_partkey % 100 + l_quantity::BIGINT AS x1, l_suppkey % 100 + 5 * l_linenumber + 20 AS y1,
  round(l_discount, 2) AS score, l_returnflag AS label, l_linenumber AS line FROM lineitem)"""


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as exemplars: label is the character, one movie."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("m").alias("movie"), F.col("vec_id"), F.col("label").cast("string").alias("character"), F.col("embedding").alias("feature"), F.col("label").cast("long").alias("pos"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of `value` minutes, in seconds since 2024: user is the clip, event type the speaker."""
    e = table(spark, sf_dir, "events")
    start = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(1704067200)
    return e.select(F.col("user_id").alias("clip"), F.col("event_id").alias("seg_pos"), start.alias("start"), (start + F.floor(F.col("value") * 60)).alias("end"), F.col("event_type").alias("label"), "value")


SEGMENTS_SQL = """segments AS (SELECT user_id AS clip, event_id AS seg_pos, epoch(date_trunc('second', ts))::BIGINT - 1704067200 AS start,
  epoch(date_trunc('second', ts))::BIGINT - 1704067200 + floor(value * 60)::BIGINT AS fin, event_type AS label, value FROM events)"""
