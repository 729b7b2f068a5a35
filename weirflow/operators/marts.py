"""The warehouse layer: staging, dimensions and facts, each a function of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.scoring import age_bucket, seconds_between, sentiment_bucket, sentiment_label, signal_tier

#: Offsets in hours from first sight with the band, in hours, in which a snapshot counts.
BANDS = {"1h": (1.0, 0.75, 1.5), "3h": (3.0, 2.5, 3.5), "6h": (6.0, 5.5, 6.5)}


def stg_posts(posts: DataFrame, now: Column) -> DataFrame:
    hours = lambda a, b: seconds_between(a, b) / 3600.0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return posts.where("is_active").select(
        F.col("id").alias("post_id"), "title", "author", "subreddit_id", "created_utc", F.col("current_score").alias("score"), F.col("current_comments").alias("num_comments"),
        zero("current_ratio").alias("upvote_ratio"), zero("score_velocity").alias("score_velocity"), zero("comment_velocity").alias("comment_velocity"),
        (zero("velocity")).alias("combined_velocity"), zero("trending_score").alias("trending_score"), F.coalesce("is_trending", F.lit(False)).alias("is_trending"),
        "poll_priority", "first_seen_at", "last_polled_at", hours(now, F.col("created_utc")).alias("age_hours"), hours(F.coalesce("last_polled_at", now), F.col("first_seen_at")).alias("hours_polled"),
    )


def stg_metrics_history(history: DataFrame) -> DataFrame:
    kept = history.where("captured_at IS NOT NULL AND score IS NOT NULL")
    return kept.select(
        F.col("captured_at").alias("recorded_at"), F.date_trunc("hour", "captured_at").alias("recorded_hour"), F.to_date("captured_at").alias("recorded_date"), "post_id",
        "score", F.coalesce("num_comments", F.lit(0)).alias("num_comments"), F.coalesce("upvote_ratio", F.lit(0.0)).alias("upvote_ratio"),
    )


def stg_nlp_features(nlp: DataFrame) -> DataFrame:
    score = F.coalesce("sentiment_score", F.lit(0.0))
    return nlp.where("post_id IS NOT NULL").select(
        "post_id", score.alias("sentiment_score"), sentiment_label(score).alias("sentiment_label"), F.coalesce(F.to_json("keywords"), F.lit("[]")).alias("keywords_raw"),
        F.coalesce(F.array_size("keywords"), F.lit(0)).alias("keyword_count"), F.col("topic_cluster").cast("string").alias("topic_cluster"),
    )


def dim_posts(posts: DataFrame, nlp: DataFrame) -> DataFrame:
    """Staged posts with their features (defaults where there are none), engagement, momentum and age."""
    joined = posts.join(nlp, "post_id", "left").fillna({"sentiment_score": 0.0, "sentiment_label": "neutral", "keywords_raw": "[]", "keyword_count": 0, "topic_cluster": "unknown"})
    return joined.withColumns({
        "engagement_score": F.col("score") + 2 * F.col("num_comments"),
        "momentum_score": F.when(F.col("age_hours") > 0, F.col("score_velocity") * F.log1p("age_hours")).otherwise(F.lit(0.0)),
        "age_bucket": age_bucket(F.col("age_hours")),
    })


def dim_subreddits(posts: DataFrame, nlp: DataFrame, subreddits: DataFrame, config: DataFrame) -> DataFrame:
    """One row a subreddit: volume, engagement, sentiment, polling and tier. Posts meet their features once; both kinds of
    statistic come from that one aggregation."""
    known = F.col("sentiment_label").isNotNull()
    label = lambda x: F.count_if(F.col("sentiment_label") == x)
    stats = posts.join(nlp.select("post_id", "sentiment_score", "sentiment_label"), "post_id", "left").groupBy("subreddit_id").agg(
        F.count("*").alias("total_posts"), F.count_if("is_trending").alias("trending_posts"), F.avg("score").alias("avg_score"), F.max("score").alias("peak_score"),
        F.avg("num_comments").alias("avg_comments"), F.avg("score_velocity").alias("avg_score_velocity"), F.max("score_velocity").alias("peak_score_velocity"),
        F.max("last_polled_at").alias("last_activity_at"), F.min("first_seen_at").alias("first_post_seen_at"), F.avg("sentiment_score").alias("avg_sentiment_score"),
        F.mode("sentiment_label", True).alias("dominant_sentiment"), F.count_if(known).alias("_known"),
        label("positive").alias("positive_posts"), label("negative").alias("negative_posts"), label("neutral").alias("neutral_posts"),
    )
    stats = stats.withColumn("trending_rate_pct", F.round(F.col("trending_posts") / F.col("total_posts") * 100, 2))
    stats = stats.withColumns({c: F.when(F.col("_known") > 0, F.col(c)) for c in ("positive_posts", "negative_posts", "neutral_posts")}).drop("_known")
    named = stats.join(subreddits.select(F.col("id").alias("subreddit_id"), F.col("name").alias("subreddit_name")), "subreddit_id", "left")
    polled = config.select(F.col("name").alias("subreddit_name"), F.col("is_active").alias("is_actively_polled"), F.col("interval_seconds").alias("poll_interval_seconds"))
    return named.join(polled, "subreddit_name", "left").withColumn("signal_tier", signal_tier(F.col("trending_rate_pct"), F.col("avg_score_velocity")))


def fct_hourly_engagement(history: DataFrame, posts: DataFrame, nlp: DataFrame, since_hour: Column | None = None) -> DataFrame:
    """Per hour and subreddit. First summed by post, then by subreddit: exact distinct posts without an expand, and a busy
    subreddit is spread over its posts. ``since_hour`` recomputes whole hours from there."""
    rows = history if since_hour is None else history.where(F.col("recorded_hour") >= since_hour)
    dims = posts.select("post_id", "subreddit_id", "score_velocity", "comment_velocity", "is_trending", "trending_score").join(nlp.select("post_id", "sentiment_score", "sentiment_label"), "post_id", "left")
    per = rows.groupBy("post_id", "recorded_hour", "recorded_date").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.max("score").alias("top"), F.sum("num_comments").alias("c"), F.sum("upvote_ratio").alias("u")).join(dims, "post_id")
    n = F.col("n")
    mean = lambda c: F.sum(F.col(c) * n) / F.sum(F.when(F.col(c).isNotNull(), n))
    some = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")
    out = per.groupBy("recorded_hour", "recorded_date", "subreddit_id").agg(
        F.count("*").alias("unique_posts_observed"), F.sum("n").alias("total_snapshots"), some(F.col("is_trending")).alias("trending_snapshots"),
        (F.sum("s") / F.sum("n")).alias("avg_score"), F.max("top").alias("max_score"), (F.sum("c") / F.sum("n")).alias("avg_comments"), (F.sum("u") / F.sum("n")).alias("avg_upvote_ratio"),
        mean("score_velocity").alias("avg_score_velocity"), F.max("score_velocity").alias("peak_score_velocity"), mean("comment_velocity").alias("avg_comment_velocity"),
        mean("trending_score").alias("avg_trending_score"), mean("sentiment_score").alias("avg_sentiment_score"),
        *[some(F.col("sentiment_label") == x).alias(f"{x}_post_count") for x in ("positive", "negative", "neutral")],
    )
    return out.withColumns({"trending_rate_pct": F.round(F.col("trending_snapshots") / F.col("total_snapshots") * 100, 2), "hour_of_day": F.hour("recorded_hour"), "day_of_week": F.dayofweek("recorded_hour") - 1})


def post_partials(history: DataFrame) -> DataFrame:
    """Mergeable statistics of a post's snapshots."""
    return history.groupBy("post_id").agg(
        F.count("*").alias("total_snapshots"), F.max("score").alias("peak_score_ever"), F.max("num_comments").alias("peak_comments_ever"), F.sum("score").alias("score_sum"),
        F.sum("upvote_ratio").alias("ratio_sum"), F.min("recorded_at").alias("first_snapshot_at"), F.max("recorded_at").alias("last_snapshot_at"),
    )


def merge_partials(old: DataFrame, new: DataFrame) -> DataFrame:
    """The incremental form: lifetime statistics of two disjoint sets of snapshots."""
    return old.unionByName(new).groupBy("post_id").agg(
        F.sum("total_snapshots").alias("total_snapshots"), F.max("peak_score_ever").alias("peak_score_ever"), F.max("peak_comments_ever").alias("peak_comments_ever"), F.sum("score_sum").alias("score_sum"),
        F.sum("ratio_sum").alias("ratio_sum"), F.min("first_snapshot_at").alias("first_snapshot_at"), F.max("last_snapshot_at").alias("last_snapshot_at"),
    )


def fct_post_lifecycle(posts: DataFrame, partials: DataFrame) -> DataFrame:
    rows = posts.join(partials, "post_id", "left")
    n = F.nullif(F.col("total_snapshots"), F.lit(0))
    return rows.withColumns({
        "avg_score_lifetime": F.col("score_sum") / n, "avg_upvote_ratio": F.col("ratio_sum") / n,
        "score_growth": F.when(F.col("total_snapshots") > 1, F.col("peak_score_ever") - F.col("score")).otherwise(F.lit(0)),
        "sentiment_bucket": sentiment_bucket(F.col("sentiment_score")),
    }).withColumnsRenamed({"score": "current_score", "num_comments": "current_comments", "sentiment_score": "initial_sentiment_score", "sentiment_label": "initial_sentiment_label"})


def nearest_snapshots(history: DataFrame, posts: DataFrame, bands: dict[str, tuple[float, float, float]] = BANDS) -> DataFrame:
    """Per post the snapshot nearest to each offset inside its band (ends included), all offsets in one join and one
    aggregation; ties go to the earlier snapshot."""
    joined = history.join(posts.select("post_id", "first_seen_at"), "post_id")
    age = seconds_between(F.col("recorded_at"), F.col("first_seen_at")) / 3600.0
    joined = joined.withColumn("_age", age).where(F.col("_age").between(min(b[1] for b in bands.values()), max(b[2] for b in bands.values())))
    picks = []
    for name, (centre, low, high) in bands.items():
        key = F.when(F.col("_age").between(low, high), F.struct(F.abs(F.col("_age") - centre).alias("off"), "recorded_at", F.col("score").alias("score"), F.col("num_comments").alias("comments")))
        picks += [F.min(key).alias(f"_{name}")]
    found = joined.groupBy("post_id").agg(*picks)
    return found.select("post_id", *[F.col(f"_{n}.score").alias(f"score_at_{n}") for n in bands], *[F.col(f"_{n}.comments").alias(f"comments_at_{n}") for n in bands])


def fct_sentiment_vs_velocity(lifecycle: DataFrame, history: DataFrame, bands: dict[str, tuple[float, float, float]] = BANDS, least_age_hours: float = 1.0) -> DataFrame:
    a, b, c = bands
    near = nearest_snapshots(history, lifecycle, bands)
    rows = lifecycle.where(F.col("age_hours") >= least_age_hours).join(near, "post_id", "left")
    at = lambda n: F.col(f"score_at_{n}")
    return rows.select(
        "post_id", "subreddit_id", "first_seen_at", "age_hours", "is_trending", "initial_sentiment_score", "initial_sentiment_label", "sentiment_bucket",
        *[f"score_at_{n}" for n in bands], *[f"comments_at_{n}" for n in bands], "current_score", F.col("score_velocity").alias("current_velocity"),
        (at(b) - at(a)).alias(f"score_growth_{a}_to_{b}"), (at(c) - at(b)).alias(f"score_growth_{b}_to_{c}"), *[at(n).isNotNull().alias(f"has_{n}_snapshot") for n in bands],
    )


def hourly_rollup(history: DataFrame, key: str, averages: tuple[str, ...], at: str = "captured_at") -> DataFrame:
    """Per hour and key: mean and peak score, further means, and the count."""
    hour = F.window(at, "1 hour")["start"]
    return history.groupBy(hour.alias("hour"), key).agg(F.avg("raw_score").alias("avg_score"), F.max("raw_score").alias("max_score"), *[F.avg(c).alias(f"avg_{c}") for c in averages], F.count("*").alias("snapshots"))


def activity_snapshot(posts: DataFrame, now: Column) -> DataFrame:
    return posts.groupBy("subreddit_id").agg(F.count("*").alias("post_count"), F.avg("score").alias("avg_score"), F.avg("num_comments").alias("avg_comments")).withColumn("captured_at", now)
