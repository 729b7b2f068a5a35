"""The tables the catalogue's queries share, built from the given ones, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators import base, marts, state, topics, windows
from weirflow.sources import fixtures
from weirflow.sources.fixtures import as_of, observations


def text(at: str | Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return windows.enriched(observations(spark, d))


def current(spark: SparkSession, d: str) -> DataFrame:
    """Current state of every signal."""
    return state.fold(state.only_when_moved(enriched(spark, d)))


#: Bases of this process: (application, place, files) -> base.
_bases: dict[tuple, base.Base] = {}


def files_of(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: what tells whether it changed."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = system.getFileStatus(place)
    found = system.listStatus(place) if status.isDirectory() else [status]
    return tuple(sorted((str(s.getPath()), s.getLen(), s.getModificationTime()) for s in found))


def marts_base(spark: SparkSession, d: str) -> base.Base:
    """The base of the marts: built from the log once a session, and read by every mart after that, until the log's files change."""
    key = (spark.sparkContext.applicationId, d, files_of(spark, f"{d}/events.parquet"))
    if key not in _bases:
        o = observations(spark, d)
        _bases[key] = base.extended(base.new_base(o.count()), o)
    return _bases[key]


def based(spark: SparkSession, d: str) -> DataFrame:
    """Current state of every signal, from the base."""
    return marts_base(spark, d).state(spark)


def posts(spark: SparkSession, d: str) -> DataFrame:
    return posts_of(based(spark, d))


def posts_of(c: DataFrame) -> DataFrame:
    """Posts of the older layer, from the current state (velocities 0 where never stored)."""
    n = F.col("source_id").cast("long")
    return c.select(
        "id", F.col("community_id").alias("subreddit_id"), "title", "author", F.col("first_seen_at").alias("created_utc"), "first_seen_at", F.col("last_updated_at").alias("last_polled_at"),
        F.col("raw_score").alias("current_score"), F.col("comment_count").alias("current_comments"), ((n % 100) / F.lit(100.0)).alias("current_ratio"), (n % 10 != 0).alias("is_active"),
        F.element_at(F.array(F.lit("aggressive"), F.lit("normal"), F.lit("slow"), F.lit("inactive")), (n % 4 + 1).cast("int")).alias("poll_priority"),
        "score_velocity", "comment_velocity", (F.col("score_velocity") + F.col("comment_velocity")).alias("velocity"), "trending_score", (F.col("trending_score") >= 0.3).alias("is_trending"),
    )


def nlp(spark: SparkSession, d: str) -> DataFrame:
    return nlp_of(based(spark, d))


def nlp_of(c: DataFrame) -> DataFrame:
    n = F.col("source_id").cast("long")
    return c.where(n % 4 != 0).select(F.col("id").alias("post_id"), F.col("sentiment_compound").alias("sentiment_score"), F.col("topics").alias("keywords"), (n % 7).cast("int").alias("topic_cluster"))


def post_history(spark: SparkSession, d: str) -> DataFrame:
    return marts_base(spark, d).log(spark).select(F.col("id").alias("post_id"), "captured_at", F.col("raw_score").alias("score"), F.col("comment_count").alias("num_comments"), ((F.col("seq") % 100) / F.lit(100.0)).alias("upvote_ratio"))


def stg_posts(spark: SparkSession, d: str) -> DataFrame:
    return marts.stg_posts(posts(spark, d), as_of(spark, d))


def stg_nlp(spark: SparkSession, d: str) -> DataFrame:
    return marts.stg_nlp_features(nlp(spark, d))


def stg_history(spark: SparkSession, d: str) -> DataFrame:
    return marts.stg_metrics_history(post_history(spark, d))


def staged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Staged posts and features, of the base's state."""
    return stg_posts(spark, d), stg_nlp(spark, d)


def dim_posts(spark: SparkSession, d: str) -> DataFrame:
    return marts.dim_posts(*staged(spark, d))


def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return marts.fct_post_lifecycle(dim_posts(spark, d), marts.post_partials(stg_history(spark, d)))


def buckets(spark: SparkSession, d: str) -> DataFrame:
    return topics.topic_buckets(enriched(spark, d))


def communities(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.communities(spark, d)


# SQL twins: one common table expression a table, to be listed after ``obs`` and ``now``.

VEL = """vel AS (SELECT * EXCLUDE (pt, ps, pc),
  CASE WHEN pt IS NULL OR (epoch_us(captured_at) - epoch_us(pt)) / 1e6 > 90000 THEN 0.0 ELSE (raw_score - ps) / greatest((epoch_us(captured_at) - epoch_us(pt)) / 1e6, 1.0) END AS score_velocity,
  CASE WHEN pt IS NULL OR (epoch_us(captured_at) - epoch_us(pt)) / 1e6 > 90000 THEN 0.0 ELSE (comment_count - pc) / greatest((epoch_us(captured_at) - epoch_us(pt)) / 1e6, 1.0) END AS comment_velocity
  FROM (SELECT *, lag(captured_at) OVER w AS pt, lag(raw_score) OVER w AS ps, lag(comment_count) OVER w AS pc FROM obs WINDOW w AS (PARTITION BY id ORDER BY captured_at, seq)))"""
NORM = """norm AS (SELECT * EXCLUDE (a, n), CASE WHEN raw_score > 0 THEN round(least(raw_score / (2 * greatest(CASE WHEN n >= 10 THEN a ELSE CASE platform WHEN 'reddit' THEN 150.0 WHEN 'hackernews' THEN 50.0 WHEN 'bluesky' THEN 10.0 WHEN 'youtube' THEN 20.0 ELSE 100.0 END END, 1.0)), 1.0), 4) ELSE 0.0 END::DOUBLE AS normalised_score
  FROM (SELECT *, avg(raw_score) OVER w AS a, count(*) OVER w AS n FROM vel WINDOW w AS (PARTITION BY platform, raw_score > 0 ORDER BY captured_at, seq ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING)))"""
ENR = """enr AS (SELECT *, trending_score >= 0.3 AS is_trending FROM (SELECT *, round(least(CASE platform
  WHEN 'hackernews' THEN CASE WHEN normalised_score > 0.6 THEN 0.5 WHEN normalised_score > 0.3 THEN 0.3 ELSE 0 END + CASE WHEN abs(sentiment_compound) > 0.3 THEN 0.2 ELSE 0 END + CASE WHEN comment_count > 20 THEN 0.3 WHEN comment_count > 5 THEN 0.2 ELSE 0 END
  WHEN 'youtube' THEN CASE WHEN normalised_score > 0.6 THEN 0.5 WHEN normalised_score > 0.3 THEN 0.3 ELSE 0 END + CASE WHEN abs(sentiment_compound) > 0.3 THEN 0.2 ELSE 0 END + CASE WHEN comment_count > 50 THEN 0.3 WHEN comment_count > 5 THEN 0.2 ELSE 0 END
  WHEN 'bluesky' THEN CASE WHEN abs(sentiment_compound) > 0.6 THEN 0.6 WHEN abs(sentiment_compound) > 0.3 THEN 0.4 WHEN abs(sentiment_compound) > 0.1 THEN 0.2 ELSE 0 END + CASE WHEN sentiment_compound > 0.2 THEN 0.1 ELSE 0 END
  ELSE CASE WHEN score_velocity > 50 THEN 0.4 WHEN score_velocity > 5 THEN 0.2 ELSE 0 END + CASE WHEN abs(sentiment_compound) > 0.3 THEN 0.2 ELSE 0 END + CASE WHEN comment_count > 10 THEN 0.2 ELSE 0 END + CASE WHEN normalised_score > 0.6 THEN 0.2 ELSE 0 END END, 1.0)::DOUBLE, 4) AS trending_score FROM norm))"""
CUR = """moved AS (SELECT *, (epoch_us(captured_at)::HUGEINT * 1000000 + seq) AS k, score_velocity <> 0 OR comment_velocity <> 0 AS m FROM enr),
cur AS (SELECT id, arg_min(platform, k) AS platform, arg_min(source_id, k) AS source_id, arg_min(title, k) AS title, arg_min(author, k) AS author, arg_min(community_id, k) AS community_id, arg_min(normalised_score, k) AS normalised_score,
  arg_max(raw_score, k) AS raw_score, arg_max(comment_count, k) AS comment_count, arg_max(topics, k) AS topics, arg_max(CASE WHEN m THEN score_velocity END, CASE WHEN m THEN k END) AS score_velocity, arg_max(CASE WHEN m THEN comment_velocity END, CASE WHEN m THEN k END) AS comment_velocity,
  arg_max(CASE WHEN m THEN trending_score END, CASE WHEN m THEN k END) AS trending_score, arg_max(sentiment_compound, k) AS sentiment_compound, min(captured_at) AS first_seen_at, max(captured_at) AS last_updated_at FROM moved GROUP BY id)"""
POSTS = """posts AS (SELECT id, community_id AS subreddit_id, title, author, first_seen_at AS created_utc, first_seen_at, last_updated_at AS last_polled_at, raw_score AS current_score, comment_count AS current_comments,
  (source_id::BIGINT % 100) / 100.0::DOUBLE AS current_ratio, source_id::BIGINT % 10 <> 0 AS is_active, ['aggressive', 'normal', 'slow', 'inactive'][source_id::BIGINT % 4 + 1] AS poll_priority, score_velocity, comment_velocity, score_velocity + comment_velocity AS velocity, trending_score, trending_score >= 0.3 AS is_trending FROM cur)"""
STG_POSTS = """sp AS (SELECT id AS post_id, title, author, subreddit_id, created_utc, current_score AS score, current_comments AS num_comments, coalesce(current_ratio, 0.0) AS upvote_ratio, coalesce(score_velocity, 0.0) AS score_velocity, coalesce(comment_velocity, 0.0) AS comment_velocity,
  coalesce(velocity, 0.0) AS combined_velocity, coalesce(trending_score, 0.0) AS trending_score, coalesce(is_trending, false) AS is_trending, poll_priority, first_seen_at, last_polled_at, (epoch_us(t) - epoch_us(created_utc)) / 1e6 / 3600.0 AS age_hours,
  (epoch_us(coalesce(last_polled_at, t)) - epoch_us(first_seen_at)) / 1e6 / 3600.0 AS hours_polled FROM posts, now WHERE is_active)"""
STG_NLP = """sn AS (SELECT id AS post_id, coalesce(sentiment_compound, 0.0) AS sentiment_score, CASE WHEN sentiment_compound >= 0.05 THEN 'positive' WHEN sentiment_compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
  to_json(topics)::VARCHAR AS keywords_raw, len(topics)::INTEGER AS keyword_count, (source_id::BIGINT % 7)::VARCHAR AS topic_cluster FROM cur WHERE source_id::BIGINT % 4 <> 0)"""
STG_HISTORY = """sh AS (SELECT id AS post_id, captured_at AS recorded_at, date_trunc('hour', captured_at) AS recorded_hour, captured_at::DATE AS recorded_date, raw_score AS score, comment_count AS num_comments, (seq % 100) / 100.0::DOUBLE AS upvote_ratio FROM obs WHERE raw_score IS NOT NULL)"""
DIM_POSTS = """dp AS (SELECT sp.*, coalesce(sentiment_score, 0.0) AS sentiment_score, coalesce(sentiment_label, 'neutral') AS sentiment_label, coalesce(keywords_raw, '[]') AS keywords_raw, coalesce(keyword_count, 0) AS keyword_count, coalesce(topic_cluster, 'unknown') AS topic_cluster,
  score + 2 * num_comments AS engagement_score, CASE WHEN age_hours > 0 THEN score_velocity * ln(1 + age_hours) ELSE 0.0 END AS momentum_score,
  CASE WHEN age_hours < 1 THEN 'under_1h' WHEN age_hours < 6 THEN '1h_to_6h' WHEN age_hours < 12 THEN '6h_to_12h' WHEN age_hours < 24 THEN '12h_to_24h' ELSE 'over_24h' END AS age_bucket FROM sp LEFT JOIN sn USING (post_id))"""
LIFECYCLE = """lc AS (SELECT dp.* EXCLUDE (score, num_comments, sentiment_score, sentiment_label, upvote_ratio), score AS current_score, num_comments AS current_comments, sentiment_score AS initial_sentiment_score, sentiment_label AS initial_sentiment_label, h.* EXCLUDE (post_id),
  CASE WHEN total_snapshots > 1 THEN peak_score_ever - score ELSE 0 END AS score_growth,
  CASE WHEN sentiment_score >= 0.5 THEN 'strongly_positive' WHEN sentiment_score >= 0.05 THEN 'mildly_positive' WHEN sentiment_score <= -0.5 THEN 'strongly_negative' WHEN sentiment_score <= -0.05 THEN 'mildly_negative' ELSE 'neutral' END AS sentiment_bucket
  FROM dp LEFT JOIN (SELECT post_id, count(*) AS total_snapshots, max(score) AS peak_score_ever, max(num_comments) AS peak_comments_ever, avg(score) AS avg_score_lifetime, avg(upvote_ratio) AS avg_upvote_ratio, min(recorded_at) AS first_snapshot_at, max(recorded_at) AS last_snapshot_at FROM sh GROUP BY 1) h USING (post_id))"""
SPREAD = """ex AS (SELECT * EXCLUDE (topics), unnest(topics) AS topic FROM enr)"""
BUCKETS = """bk AS (SELECT topic, platform, time_bucket(INTERVAL 15 MINUTE, captured_at) AS bucket, count(*) AS signal_count, avg(CASE WHEN sentiment_compound <> 0 THEN sentiment_compound END) AS avg_sentiment, greatest(coalesce(max(trending_score), 0.0), 0.0) AS max_trending, sum(raw_score)::BIGINT AS total_score FROM ex GROUP BY ALL)"""
ENRICHED = (VEL, NORM, ENR)
CURRENT = (*ENRICHED, CUR)
STAGED = (*CURRENT, POSTS, STG_POSTS, STG_NLP, STG_HISTORY)
BUCKETED = (*ENRICHED, SPREAD, BUCKETS)
