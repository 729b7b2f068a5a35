"""Observations, posts and dimensions over the given tables: the mapping every query starts from."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLATFORMS = {"click": "reddit", "view": "hackernews", "purchase": "youtube", "signup": "bluesky"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the log of signal observations; all times are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return as_observations(table(spark, sf_dir, "events"))


def as_observations(e: DataFrame) -> DataFrame:
    """The mapping itself, for a table or a stream of events."""
    platform = F.lit("other")
    for kind, name in PLATFORMS.items():
        platform = F.when(F.col("event_type") == kind, name).otherwise(platform)
    return e.select(
        F.col("event_id").alias("seq"), platform.alias("platform"), F.col("user_id").cast("string").alias("source_id"),
        F.concat(platform, F.lit(":"), F.col("user_id").cast("string")).alias("id"), (F.col("user_id") % 25).cast("int").alias("community_id"),
        F.concat(F.lit("author"), (F.col("user_id") % 40).cast("string")).alias("author"), F.concat(F.lit("post "), F.col("user_id").cast("string")).alias("title"),
        F.col("ts").cast("timestamp").alias("captured_at"), F.floor("value").cast("long").alias("raw_score"),
        F.get_json_object("props", "$.k").cast("long").alias("comment_count"), (((F.col("event_id") * 37) % 201 - 100) / F.lit(100.0)).alias("sentiment_compound"),
        F.array(F.concat(F.lit("topic"), (F.col("event_id") % 5).cast("string")), F.concat(F.lit("topic"), (F.col("event_id") % 3 + 5).cast("string"))).alias("topics"),
    )


def as_of(spark: SparkSession, sf_dir: str):
    """The last time in the log, as a literal: what windows of time end at; null of an empty log."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return F.lit(table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]).cast("timestamp")


def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("community_id"), F.col("n_name").alias("community"))


def subreddit_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (60 * (1 + F.col("n_regionkey"))).cast("long").alias("interval_seconds"), (F.col("n_regionkey") != 4).alias("is_active"))


#: The same mapping in DuckDB SQL, as common table expressions.
OBS = """
obs AS (SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'reddit' WHEN 'view' THEN 'hackernews' WHEN 'purchase' THEN 'youtube' WHEN 'signup' THEN 'bluesky' ELSE 'other' END AS platform,
  user_id::VARCHAR AS source_id, CASE event_type WHEN 'click' THEN 'reddit' WHEN 'view' THEN 'hackernews' WHEN 'purchase' THEN 'youtube' WHEN 'signup' THEN 'bluesky' ELSE 'other' END || ':' || user_id AS id,
  (user_id % 25)::INTEGER AS community_id, 'author' || (user_id % 40) AS author, 'post ' || user_id AS title, ts AS captured_at, floor(value)::BIGINT AS raw_score,
  json_extract(props, '$.k')::BIGINT AS comment_count, ((event_id * 37) % 201 - 100) / 100.0::DOUBLE AS sentiment_compound, ['topic' || (event_id % 5), 'topic' || (event_id % 3 + 5)] AS topics FROM events),
now AS (SELECT max(captured_at) AS t FROM obs)"""


@cache
def sql(body: str, *more: str) -> str:
    """A statement over the mapping: ``WITH obs, now, more... body``."""
    return "WITH " + ",\n".join([OBS.strip(), *more]) + "\n" + body
