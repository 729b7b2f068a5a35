"""Polling, archive, dead letters, rates, latencies and data tests."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.config import POLL_SECONDS
from weirflow.functions.scoring import poll_priority, seconds_between
from weirflow.operators.state import kept


def with_priority(posts: DataFrame, now: Column, created: str = "created_utc") -> DataFrame:
    return posts.withColumn("poll_priority", poll_priority(seconds_between(now, F.col(created)) / 60.0))


def refresh_due(posts: DataFrame, now: Column, intervals: dict[str, int] | None = None) -> DataFrame:
    """Posts never polled, or last polled at least their tier's interval ago; inactive ones never."""
    wait = F.create_map(*[F.lit(x) for pair in (intervals or POLL_SECONDS).items() for x in pair])[F.col("poll_priority")]
    return posts.where(wait.isNotNull() & (F.col("last_polled_at").isNull() | (seconds_between(now, F.col("last_polled_at")) >= wait)))


def unexpired(posts: DataFrame, now: Column, hours: float = 24, created: str = "created_utc") -> DataFrame:
    return posts.where(F.col(created) >= now - F.make_dt_interval(secs=F.lit(hours * 3600.0)))


def active_config(config: DataFrame, defaults: list[tuple[str, int]]) -> DataFrame:
    """Active rows, or the defaults where there are none."""
    active = config.where("is_active").select("name", "interval_seconds")
    spare = config.sparkSession.createDataFrame(defaults, "name string, interval_seconds long") if defaults else active.limit(0)
    return active if not active.isEmpty() else spare


def enriched_since(signals: DataFrame, watermark: Column, most: int = 5000) -> DataFrame:
    """Signals with topics updated since the watermark, oldest first."""
    return signals.where((F.col("last_updated_at") >= watermark) & (F.size("topics") > 0)).orderBy("last_updated_at", "id").limit(most)


def archive_days(history: DataFrame, now: Column, done: DataFrame | None = None, *, retention: int = 90, lookahead: int = 5, at: str = "captured_at") -> DataFrame:
    """Days old enough to be archived and not archived yet, oldest first."""
    days = history.where(F.col(at) < F.date_trunc("day", now - F.make_dt_interval(F.lit(retention - lookahead)))).groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("rows"))
    return (days if done is None else days.join(done, "day", "left_anti")).orderBy("day")


def archive_rows(history: DataFrame, posts: DataFrame, nlp: DataFrame) -> DataFrame:
    """History joined to posts and features in the archive's fixed types, with zero-padded partition columns."""
    rows = history.join(posts.select("post_id", "title", "author", "subreddit_id", "created_utc", "score_velocity", "comment_velocity", "trending_score", "is_trending", "poll_priority"), "post_id").join(nlp.select("post_id", "sentiment_score", "sentiment_label", "keywords_raw"), "post_id", "left")
    day = lambda form: F.date_format("captured_at", form)
    return rows.select(
        F.col("captured_at").alias("time"), "post_id", "title", "author", F.col("subreddit_id").cast("int").alias("subreddit_id"), F.col("score").cast("int").alias("score"), F.col("num_comments").cast("int").alias("num_comments"),
        F.col("upvote_ratio").cast("float").alias("upvote_ratio"), F.col("score_velocity").cast("float").alias("score_velocity"), F.col("comment_velocity").cast("float").alias("comment_velocity"),
        F.col("trending_score").cast("float").alias("trending_score"), "is_trending", F.col("sentiment_score").cast("float").alias("sentiment_score"), "sentiment_label", "poll_priority", "created_utc",
        day("yyyy").alias("year"), day("MM").alias("month"), day("dd").alias("day"),
    )


def write_archive(rows: DataFrame, path: str, rows_a_file: int = 5_000_000) -> None:
    """Snappy Parquet by year, month and day, sorted by time; a day written again replaces itself, a large one has several files."""
    parts = ["year", "month", "day"]
    writer = rows.repartition(*parts).sortWithinPartitions(*parts, "time").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("compression", "snappy").option("maxRecordsPerFile", rows_a_file).partitionBy(*parts).parquet(path)


def replay(envelopes: DataFrame, schemas: dict[str, str], topics: list[str] | None = None) -> dict[str, DataFrame]:
    """Payloads of unresolved envelopes, parsed again for the topic they came from; empty ones are left."""
    open_ = envelopes.where(F.length(F.coalesce("payload", F.lit(""))) > 0)
    open_ = open_.where(F.col("replayed_at").isNull()) if "replayed_at" in envelopes.columns else open_
    return {t: open_.where(F.col("source_topic") == t).select(F.from_json("payload", s).alias("raw")).where("raw IS NOT NULL").select("raw.*") for t, s in schemas.items() if topics is None or t in topics}


def dead_letter_counts(envelopes: DataFrame) -> DataFrame:
    return envelopes.groupBy("source_topic", "error").agg(F.count("*").alias("events"))


def latency_summary(rows: DataFrame, value: str, by: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Count, sum and nearest-rank percentiles, exact. Equal values are counted first. The distinct ones are dealt by ranges of
    (metric, value); the counts of the ranges (a row a metric and range) tell which range holds each rank, and only these few
    ranges are counted through, so no task holds a metric, however many distinct values it has. Nulls count as rows, not as
    values; a metric without values has null percentiles."""
    values = rows.groupBy(F.col(by).alias("of"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranged = kept(values.where("v IS NOT NULL").repartitionByRange("of", "v").withColumn("range", F.spark_partition_id()))
    ranges = ranged.groupBy("of", "range").agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("s"))
    w = Window.partitionBy("of")
    ranges = ranges.withColumns({"upto": F.sum("n").over(w.orderBy("range")), "total": F.sum("n").over(w)})
    rank = lambda p: F.least(F.floor(F.col("total") * p / 100), F.col("total") - 1) + 1
    wanted = ranges.withColumns({f"r{p}": rank(p) - (F.col("upto") - F.col("n")) for p in percents})
    holds = lambda p: F.col(f"r{p}").between(1, F.col("n"))
    held = wanted.where(reduce(or_, map(holds, percents))).select(F.col("of").alias("_of"), F.col("range").alias("_range"), *[F.when(holds(p), F.col(f"r{p}")).alias(f"r{p}") for p in percents])
    inside = ranged.join(held, F.col("of").eqNullSafe(F.col("_of")) & (F.col("range") == F.col("_range")))
    inside = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("of", "range").orderBy("v")))
    found = inside.groupBy(F.col("of").alias("_of")).agg(*[F.min(F.when(F.col("upto") >= F.col(f"r{p}"), F.col("v"))).alias(f"p{p}") for p in percents])
    whole = values.groupBy("of").agg(F.sum("n").alias("count"), F.sum(F.col("v") * F.col("n")).alias("sum"))
    return whole.join(found, F.col("of").eqNullSafe(F.col("_of")), "left").select(F.col("of").alias(by), "count", "sum", *[f"p{p}" for p in percents])


def message_rate(rows: DataFrame, by: str, at: str = "captured_at") -> DataFrame:
    """Messages a second, by minute."""
    minute = F.window(at, "1 minute")["start"]
    return rows.groupBy(minute.alias("minute"), by).agg(F.count("*").alias("messages")).withColumn("per_second", F.round(F.col("messages") / 60, 6))


def quality_report(rows: DataFrame, rules: dict[str, Column], unique: dict[str, str] | None = None) -> DataFrame:
    """Violations of each rule: rows that meet its predicate, and, for ``unique`` (rule: key), values of the key that occur more
    than once. One pass over the rows, whatever the number of rules: they are summed by key first, then over all keys; each
    further key is a pass of its own."""
    unique = dict(unique or {})
    parts, first = [], True
    for rule, key in unique.items() or [(None, None)]:
        told = {name: F.coalesce(F.count_if(bad), F.lit(0)) for name, bad in rules.items()} if first else {}
        counts = rows.groupBy(*([key] if key else [])).agg(F.count("*").alias("_rows"), *[c.alias(f"_{n}") for n, c in told.items()])
        sums = [F.coalesce(F.sum(f"_{n}"), F.lit(0)).alias(n) for n in told] + ([F.count_if(F.col("_rows") > 1).alias(rule)] if rule else [])
        names = [*told, *([rule] if rule else [])]
        parts.append(counts.agg(*sums).select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("violations")) for n in names]))))
        first = False
    return reduce(DataFrame.unionByName, parts)


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def unrelated(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table lacks."""
    return rows.join(others.select(key).distinct(), key, "left_anti")
