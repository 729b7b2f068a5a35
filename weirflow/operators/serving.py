"""What the interface asks for: feeds, statistics, timelines, keyword counts and dashboard rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.scoring import rounded, seconds_between, sentiment_label
from weirflow.functions.topk import least_k

#: Words of titles that are no dashboard keywords.
TITLE_STOP = (
    "that", "this", "with", "from", "have", "they", "will", "been", "were", "your", "what", "when", "about", "just", "than", "then", "there", "their", "which",
    "would", "could", "should", "after", "before", "these", "those", "some", "more", "into", "over", "also", "here", "like", "very", "even", "much", "such", "only",
    "dont", "cant", "wont", "isnt", "arent", "wasnt", "hasnt", "didnt", "doesnt",
)

SORTS = {"score": "raw_score", "comments": "comment_count", "momentum": "momentum", "velocity": "score_velocity", "trending": "trending_score", "sentiment": "sentiment_compound", "newest": "first_seen_at"}


def hours(n: float) -> Column:
    return F.make_dt_interval(secs=F.lit(n * 3600.0))


def with_feed_columns(rows: DataFrame, now: Column, at: str = "captured_at") -> DataFrame:
    """engagement, age_minutes and momentum."""
    age = seconds_between(now, F.col(at)) / 60.0
    return rows.withColumns({"engagement": F.col("raw_score") + 2 * F.col("comment_count"), "age_minutes": age}).withColumn("momentum", F.col("engagement") / (F.col("age_minutes") + 1))


def feed(rows: DataFrame, *, platforms: list[str] | None = None, community: str | None = None, topics: list[str] | None = None, text: str | None = None, trending_only: bool = False, least_score: float | None = None, start: Column | None = None, end: Column | None = None, at: str = "captured_at") -> DataFrame:
    """Any mix of the feed's filters; each is a predicate that the scan can take."""
    out = rows.where(F.col(at).isNotNull())
    if platforms:
        out = out.where(F.col("platform").isin(platforms))
    if community:
        out = out.where(F.lower("community") == community.lower())
    if topics:
        out = out.where(F.arrays_overlap("topics", F.array(*map(F.lit, topics))))
    if text:
        held = F.lit(text.lower())
        out = out.where(F.contains(F.lower("title"), held) | (F.contains(F.lower("body"), held) if "body" in rows.columns else F.lit(False)))
    if trending_only:
        out = out.where("is_trending")
    if least_score is not None:
        out = out.where(F.col("normalised_score") >= least_score)
    if start is not None:
        out = out.where(F.col(at) >= start)
    return out if end is None else out.where(F.col(at) <= end)


def sorted_feed(rows: DataFrame, by: str = "newest", size: int = 50, tie: str = "id") -> DataFrame:
    return rows.orderBy(F.col(SORTS[by]).desc_nulls_last(), tie).limit(min(size, 200))


def searched(rows: DataFrame, text: str, columns: tuple[str, ...] = ("title", "community", "author")) -> DataFrame:
    """Rows one of whose columns holds the text in any case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.col(c)), F.lit(text.lower()))
    return rows.where(found)


def with_communities(rows: DataFrame, communities: DataFrame) -> DataFrame:
    return rows.join(communities, "community_id", "left")


def stats_overview(rows: DataFrame, first_day: str, last_day: str, platform: str | None = None, at: str = "captured_at") -> DataFrame:
    kept = between_days(rows, first_day, last_day, at)
    kept = kept.where(F.col("platform") == platform) if platform else kept
    return kept.agg(F.count("*").alias("total_signals"), F.round(F.avg("raw_score"), 2).alias("avg_score"), rounded(F.avg("sentiment_compound"), 4).alias("avg_sentiment"))


def between_days(rows: DataFrame, first_day: str, last_day: str, at: str = "captured_at") -> DataFrame:
    """Days, both included, as a range of times."""
    return rows.where((F.col(at) >= F.lit(first_day).cast("date")) & (F.col(at) < F.date_add(F.lit(last_day).cast("date"), 1)))


def top_signals(rows: DataFrame) -> DataFrame:
    """The most scored and the most discussed signal; ties to the earlier."""
    row = lambda c, kind: rows.agg(F.max_by(F.struct("id", F.col(c).alias("value")), F.struct(F.col(c), -F.col("seq"))).alias("x")).select(F.lit(kind).alias("kind"), "x.*")
    return row("raw_score", "most_scored").unionByName(row("comment_count", "most_discussed"))


def top_authors(rows: DataFrame, n: int = 20) -> DataFrame:
    return rows.groupBy("author", "platform").agg(F.count("*").alias("signals"), F.sum("raw_score").alias("total_score")).orderBy(F.desc("total_score"), "author", "platform").limit(n)


def by_platform(rows: DataFrame) -> DataFrame:
    return rows.groupBy("platform").agg(F.count("*").alias("signals"), rounded(F.avg("sentiment_compound"), 4).alias("avg_sentiment")).orderBy(F.desc("signals"))


def timeline(history: DataFrame, signals: DataFrame, now: Column, last_hours: float = 24) -> DataFrame:
    """Per hour and platform of the last hours: distinct signals, mean score and sentiment. Summed by signal first."""
    recent = history.where(F.col("captured_at") >= now - hours(last_hours))
    per = recent.groupBy(F.date_trunc("hour", "captured_at").alias("hour"), "id").agg(F.count("*").alias("n"), F.sum("raw_score").alias("s"), F.sum("sentiment_compound").alias("f"), F.count("sentiment_compound").alias("fn"))
    rows = per.join(signals.select("id", "platform"), "id").groupBy("hour", "platform")
    out = rows.agg(F.count("*").alias("signals"), F.round(F.sum("s") / F.sum("n"), 2).alias("avg_score"), rounded(F.sum("f") / F.sum("fn"), 4).alias("avg_sentiment"))
    return out.withColumn("label", F.date_format("hour", "HH:mm"))


def keyword_counts(rows: DataFrame, words: Column, least_length: int = 3, n: int = 50) -> DataFrame:
    spread = rows.select(F.explode(words).alias("word")).where(F.length("word") >= least_length)
    return spread.groupBy("word").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "word").limit(n)


def dash_subreddits(rows: DataFrame, n: int = 12) -> DataFrame:
    label = sentiment_label(F.col("sentiment_compound"))
    out = rows.groupBy("community").agg(F.count("*").alias("posts"), F.sum("raw_score").alias("score"), F.sum("comment_count").alias("comments"), *[F.count_if(label == x).alias(x) for x in ("positive", "negative", "neutral")])
    return out.orderBy(F.desc("score"), "community").limit(n)


def dash_sentiment(rows: DataFrame) -> DataFrame:
    label = sentiment_label(F.col("sentiment_compound"))
    return rows.agg(*[F.count_if(label == x).alias(x) for x in ("positive", "negative", "neutral")], rounded(F.avg("sentiment_compound"), 4).alias("mean_sentiment"))


def dash_kpis(rows: DataFrame) -> DataFrame:
    positive = F.count_if(sentiment_label(F.col("sentiment_compound")) == "positive")
    return rows.agg(F.count("*").alias("posts"), F.count_if("is_trending").alias("trending"), F.max("raw_score").alias("top_score"), F.round(F.max("score_velocity"), 6).alias("fastest_velocity"), F.count_distinct("author").alias("authors"), F.round(positive / F.count("*") * 100, 2).alias("positive_pct"))


def dash_timeline(rows: DataFrame, at: Column) -> DataFrame:
    return rows.groupBy(F.date_trunc("hour", at).alias("hour")).agg(F.count("*").alias("posts"), F.sum("raw_score").alias("score"))


def dash_keywords(rows: DataFrame, keywords: Column, title: Column, n: int = 25, weights: Column | None = None) -> DataFrame:
    """Stored keywords over two characters, else words of the title: over four, no stop word, no number, the first eight.
    ``weights``: a map of keywords to what each counts (1 where that is 0 or null), which comes before ``keywords``."""
    stop = F.array(*map(F.lit, TITLE_STOP))
    of_title = F.slice(F.filter(F.split(F.lower(title), "\\W+"), lambda w: (F.length(w) > 4) & ~F.array_contains(stop, w) & ~w.rlike("^[0-9]+$")), 1, 8)
    stored = F.filter(keywords, lambda w: F.length(w) > 2)
    plain = F.when(F.coalesce(F.array_size(keywords), F.lit(0)) > 0, stored).otherwise(of_title)
    counted = F.transform(plain, lambda w: F.struct(w.alias("word"), F.lit(1).cast("long").alias("n")))
    if weights is not None:
        weighed = F.transform(F.map_entries(weights), lambda e: F.struct(e["key"].alias("word"), F.coalesce(F.nullif(e["value"].cast("long"), F.lit(0).cast("long")), F.lit(1).cast("long")).alias("n")))
        counted = F.when(weights.isNotNull(), F.filter(weighed, lambda e: F.length(e["word"]) > 2)).otherwise(counted)
    spread = rows.select(F.inline(counted))
    return spread.groupBy("word").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "word").limit(n)


def dash_top(rows: DataFrame) -> DataFrame:
    """The dashboard's lists: twenty by score, ten by velocity, the fastest, five by momentum; ties by id, unknown values last.
    All come from one aggregation that keeps the best of each list only."""
    lists = {"score": ("raw_score", 20), "velocity": ("score_velocity", 10), "fastest": ("score_velocity", 1), "momentum": ("momentum", 5)}
    best = rows.agg(*[least_k(F.struct(F.col(c).isNull().alias("unknown"), (-F.col(c).cast("double")).alias("minus"), "id"), n).alias(name) for name, (c, n) in lists.items()])
    entry = lambda name: lambda x: F.struct(F.lit(name).alias("list"), x["id"].alias("id"), F.round(-x["minus"], 6).alias("value"))
    entries = F.flatten(F.array(*[F.transform(name, entry(name)) for name in lists]))
    return best.select(F.inline(entries))


def divergence_filter(events: DataFrame, now: Column, *, last_hours: float = 24, topic: str | None = None, pair: tuple[str, str] | None = None, resolved: bool = False) -> DataFrame:
    """Events of the last hours: of a topic, of a pair in either order, and unless asked otherwise unresolved ones."""
    out = events.where(F.col("detected_at") >= now - hours(last_hours))
    out = out.where(F.col("topic") == topic.lower().strip()) if topic else out
    if pair:
        out = out.where((F.least("platform_a", "platform_b") == min(pair)) & (F.greatest("platform_a", "platform_b") == max(pair)))
    return out if resolved else out.where(~F.col("is_resolved"))


def compare_summary(events: DataFrame, top: int = 100) -> DataFrame:
    """Total, mean and peak divergence of the top events, and the topic with most of them; of no events a total of 0."""
    best = events.orderBy(F.desc("divergence_score"), "topic", "platform_a", "platform_b").limit(top)
    per = best.groupBy("topic").agg(F.count("*").alias("n"), F.sum("divergence_score").alias("s"), F.max("divergence_score").alias("m"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total_events"), F.round(F.sum("s") / F.sum("n"), 4).alias("avg_divergence"), F.max("m").alias("max_divergence"), F.min_by("topic", F.struct(-F.col("n"), "topic")).alias("hottest_topic"))
