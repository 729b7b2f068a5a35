"""Topic intelligence: buckets, cross-platform events, platform sentiment, divergence, pulse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.scoring import momentum_label, rounded
from weirflow.functions.topk import least_k


def exploded(rows: DataFrame, most: int = 8) -> DataFrame:
    """A row for each of the first topics of a signal, trimmed, in lower case, two characters or more."""
    return rows.withColumn("topic", F.explode(F.slice("topics", 1, most))).withColumn("topic", F.lower(F.trim("topic"))).where(F.length("topic") >= 2)


def topic_buckets(rows: DataFrame, minutes: int = 15, at: str = "captured_at") -> DataFrame:
    """Per topic, platform and bucket: count, mergeable sentiment (sum and number of non-zero ones), peak trending, score."""
    bucket = F.window(at, f"{minutes} minutes")["start"]
    felt = F.when(F.col("sentiment_compound") != 0, F.col("sentiment_compound"))
    return exploded(rows).groupBy("topic", "platform", bucket.alias("bucket")).agg(
        F.count("*").alias("signal_count"), F.sum(felt).alias("sentiment_sum"), F.count(felt).alias("sentiment_n"),
        F.greatest(F.coalesce(F.max("trending_score"), F.lit(0.0)), F.lit(0.0)).alias("max_trending"), F.sum("raw_score").alias("total_score"),
    ).withColumn("avg_sentiment", F.col("sentiment_sum") / F.nullif(F.col("sentiment_n"), F.lit(0)))


def merge_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets of two batches as one."""
    parts = ["topic", "platform", "bucket"]
    both = a.unionByName(b).groupBy(*parts).agg(F.sum("signal_count").alias("signal_count"), F.sum("sentiment_sum").alias("sentiment_sum"), F.sum("sentiment_n").alias("sentiment_n"), F.max("max_trending").alias("max_trending"), F.sum("total_score").alias("total_score"))
    return both.withColumn("avg_sentiment", F.col("sentiment_sum") / F.nullif(F.col("sentiment_n"), F.lit(0)))


def mean_of_two(old: Column, new: Column) -> Column:
    """The older rule for one stored and one new average: their mean where both are known."""
    return F.when(old.isNotNull() & new.isNotNull(), (old + new) / 2).otherwise(F.coalesce(new, old))


def since(rows: DataFrame, now: Column, hours: float, at: str = "bucket") -> DataFrame:
    return rows.where(F.col(at) > now - F.make_dt_interval(secs=F.lit(hours * 3600)))


def topic_totals(buckets: DataFrame) -> DataFrame:
    """Per topic: platforms, signals, mean of bucket averages, peak trending, first and last bucket."""
    return buckets.groupBy("topic").agg(
        F.array_sort(F.collect_set("platform")).alias("platforms"), F.count_distinct("platform").alias("platform_count"), F.sum("signal_count").alias("total_signals"),
        rounded(F.avg("avg_sentiment"), 3).alias("avg_sentiment"), F.max("max_trending").alias("peak_trending"), F.min("bucket").alias("first_seen"), F.max("bucket").alias("last_seen"),
    )


def cross_platform_topics(buckets: DataFrame, now: Column, hours: float = 2, platforms: int = 2, signals: int = 3, top: int = 100) -> DataFrame:
    rows = topic_totals(since(buckets, now, hours)).where((F.col("platform_count") >= platforms) & (F.col("total_signals") >= signals))
    return rows.orderBy(F.desc("platform_count"), F.desc("total_signals"), "topic").limit(top)


def trending_topics_view(buckets: DataFrame, now: Column, hours: float = 24, signals: int = 3) -> DataFrame:
    return topic_totals(since(buckets, now, hours)).where(F.col("total_signals") >= signals)


def leaderboard(buckets: DataFrame, now: Column, hours: float = 2) -> DataFrame:
    rows = since(buckets, now, hours).groupBy("topic", "platform")
    return rows.agg(F.sum("signal_count").alias("signal_count"), rounded(F.avg("avg_sentiment"), 3).alias("avg_sentiment"), F.max("max_trending").alias("peak_trending"), F.min("bucket").alias("first_seen"), F.max("bucket").alias("last_seen"))


def cross_platform_detail(buckets: DataFrame, now: Column, hours: float = 2, platforms: int = 2, signals: int = 3) -> DataFrame:
    """Every topic's platforms by first bucket, its origin, the minutes it took to spread, and sentiment by platform."""
    per = since(buckets, now, hours).groupBy("topic", "platform").agg(F.min("bucket").alias("first_seen"), F.sum("signal_count").alias("signals"), rounded(F.avg("avg_sentiment"), 3).alias("sentiment"))
    by_time = F.array_sort(F.collect_list(F.struct("first_seen", "platform", "signals", "sentiment")))
    rows = per.groupBy("topic").agg(by_time.alias("platforms"), F.sum("signals").alias("total_signals"), F.max("signals").alias("peak_signal_count"))
    rows = rows.where((F.size("platforms") >= platforms) & (F.col("total_signals") >= signals))
    first, last = F.get("platforms", F.lit(0)), F.element_at("platforms", -1)
    return rows.select(
        "topic", "platforms", first["platform"].alias("origin_platform"), first["first_seen"].alias("origin_first_seen"), "total_signals", "peak_signal_count",
        ((F.unix_seconds(last["first_seen"]) - F.unix_seconds(first["first_seen"])) / 60).cast("int").alias("spread_minutes"),
        F.map_from_entries(F.transform("platforms", lambda p: F.struct(p["platform"], p["sentiment"]))).alias("sentiment_by_platform"),
    )


def platform_sentiment(rows: DataFrame, now: Column, minutes: float = 60, least: int = 3) -> DataFrame:
    """Per topic and platform over the last minutes: mean sentiment, count, earliest time, and the three ids with the top scores;
    one aggregation, whose partial states hold three ids each."""
    recent = rows.where((F.col("captured_at") >= now - F.make_dt_interval(secs=F.lit(minutes * 60.0))) & F.col("sentiment_compound").isNotNull())
    best = least_k(F.struct(F.col("raw_score").isNull().alias("unknown"), (-F.col("raw_score")).alias("minus"), "seq", "id"), 3)
    stats = exploded(recent).groupBy("topic", "platform").agg(
        rounded(F.avg("sentiment_compound"), 4).alias("avg_sentiment"), F.count("*").alias("signal_count"), F.min("captured_at").alias("earliest"), best.alias("best")
    )
    return stats.where(F.col("signal_count") >= least).withColumn("best", F.transform("best", lambda x: x["id"])).withColumnRenamed("best", "sample_ids")


def divergence_events(sentiment: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs of platforms of a topic whose sentiments differ, with the topic's origin and its lag to the second platform: all from
    one array a topic, of an element a platform."""
    sides = F.array_sort(F.collect_list(F.struct("earliest", "platform", F.col("avg_sentiment").alias("sentiment"), F.col("sample_ids").alias("ids"))))
    of_topic = sentiment.groupBy("topic").agg(sides.alias("o")).where(F.size("o") >= 2)
    lag = ((F.unix_seconds(F.get("o", F.lit(1))["earliest"]) - F.unix_seconds(F.get("o", F.lit(0))["earliest"])) / 60).cast("int")

    def pair(a: Column, b: Column) -> Column:
        return F.struct(
            a["platform"].alias("platform_a"), b["platform"].alias("platform_b"), a["sentiment"].alias("sentiment_a"), b["sentiment"].alias("sentiment_b"),
            F.round(F.abs(a["sentiment"] - b["sentiment"]), 4).alias("divergence_score"), F.slice(F.concat(a["ids"], b["ids"]), 1, 6).alias("sample_signal_ids"),
        )

    pairs = F.flatten(F.transform("o", lambda a: F.transform(F.filter("o", lambda b: a["platform"] < b["platform"]), lambda b: pair(a, b))))
    rows = of_topic.select("topic", F.get("o", F.lit(0))["platform"].alias("origin_platform"), lag.alias("origin_lag_minutes"), F.inline(pairs))
    return rows.where(F.col("divergence_score") >= least).select("topic", "platform_a", "platform_b", "sentiment_a", "sentiment_b", "divergence_score", "origin_platform", "origin_lag_minutes", "sample_signal_ids")


def resolve(events: DataFrame, now: Column, hours: float = 2) -> DataFrame:
    """Events older than the hours count as resolved."""
    return events.withColumn("is_resolved", F.col("is_resolved") | (F.col("detected_at") < now - F.make_dt_interval(secs=F.lit(hours * 3600.0))))


def trending_topics(rows: DataFrame, now: Column, hours: float = 24, limit: int = 20, platform: str | None = None) -> DataFrame:
    """Topics by count x platforms x velocity, with two sample signals each, from one aggregation."""
    recent = rows.where(F.col("captured_at") >= now - F.make_dt_interval(secs=F.lit(hours * 3600.0)))
    recent = recent.where(F.col("platform") == platform) if platform else recent
    spread = recent.withColumn("topic", F.explode("topics"))
    stats = spread.groupBy("topic").agg(
        F.count("*").alias("signal_count"), F.size(F.collect_set("platform")).cast("long").alias("platform_count"), F.coalesce(F.avg("sentiment_compound"), F.lit(0.0)).alias("s"),
        F.coalesce(F.avg("score_velocity"), F.lit(0.0)).alias("v"), F.transform(least_k(F.struct("captured_at", "seq", "id"), 2), lambda x: x["id"]).alias("samples"),
    ).where("signal_count >= 2")
    score = F.round(F.col("signal_count") * F.col("platform_count") * F.greatest(F.col("v") + 1, F.lit(0.1)), 2)
    ranked = stats.select("topic", "signal_count", "platform_count", F.round("s", 4).alias("avg_sentiment"), F.round("v", 4).alias("avg_velocity"), score.alias("trend_score"), (F.col("platform_count") > 1).alias("cross_platform"), "samples")
    return ranked.orderBy(F.desc("trend_score"), "topic").limit(min(limit, 50))


def pulse(rows: DataFrame, now: Column, hours: float = 24, alert: float = 0.3) -> DataFrame:
    """Every topic's state over the window: per-platform sentiment and top signal, overall sentiment, divergence, momentum."""
    start, half = now - F.make_dt_interval(secs=F.lit(hours * 3600.0)), now - F.make_dt_interval(secs=F.lit(hours * 1800.0))
    recent = rows.where((F.col("captured_at") >= start) & F.col("sentiment_compound").isNotNull()).withColumn("topic", F.explode("topics"))
    per = recent.groupBy("topic", "platform").agg(
        rounded(F.avg("sentiment_compound"), 4).alias("sentiment"), F.count("*").alias("n"), F.count_if(F.col("captured_at") >= half).alias("late"),
        F.avg("score_velocity").alias("velocity"), F.max_by("id", F.struct("raw_score", -F.col("seq"))).alias("top_signal"),
    )
    per = per.withColumn("momentum", momentum_label(F.coalesce("velocity", F.lit(0.0))))
    one = per.groupBy("topic").agg(
        F.sum("n").alias("signal_count"), F.sum("late").alias("late"), rounded(F.avg("sentiment"), 4).alias("overall_sentiment"), F.count("*").alias("platforms"),
        rounded(F.max("sentiment") - F.min("sentiment"), 4).alias("divergence"), F.array_sort(F.collect_list(F.struct("platform", "sentiment", "n", "momentum", "top_signal"))).alias("detail"),
        F.max_by("platform", F.struct("sentiment", "platform")).alias("pos"), F.min_by("platform", F.struct("sentiment", "platform")).alias("neg"),
    )
    older = F.col("signal_count") - F.col("late")
    text = F.when(F.col("platforms") < 2, "Only one platform has data").when(F.col("divergence") >= alert, F.concat("pos", F.lit(" significantly more positive than "), "neg")).otherwise("Platforms broadly agree")
    momentum = F.when(F.col("late") > older * 1.5, "rising").when(F.col("late") < older * 0.5, "falling").otherwise("stable")
    return one.select("topic", "signal_count", "overall_sentiment", "divergence", (F.col("divergence") >= alert).alias("alert"), text.alias("interpretation"), momentum.alias("overall_momentum"), "detail")
