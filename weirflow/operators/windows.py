"""Per-key sequential logic: velocity, rolling baselines, caps, deltas; token buckets are in ``throttle``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.config import DEFAULTS, Thresholds
from weirflow.functions.scoring import fallback_baseline, normalised_score, seconds_between, trending_score
from weirflow.operators.throttle import token_bucket


def with_velocity(obs: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """score_velocity and comment_velocity per second since the id's previous observation; 0 on first sight or after the TTL."""
    w = Window.partitionBy("id").orderBy("captured_at", "seq")
    gap = seconds_between(F.col("captured_at"), F.col("_at"))
    fresh = F.col("_at").isNull() | (gap > t.ttl_seconds)
    per = lambda now, before: F.when(fresh, F.lit(0.0)).otherwise((F.col(now) - F.col(before)) / F.greatest(gap, F.lit(1.0)))
    return (
        obs.withColumns({"_at": F.lag("captured_at").over(w), "_score": F.lag("raw_score").over(w), "_comments": F.lag("comment_count").over(w)})
        .withColumns({"score_velocity": per("raw_score", "_score"), "comment_velocity": per("comment_count", "_comments")})
        .drop("_at", "_score", "_comments")
    )


def _baseline(rows: DataFrame, w, t: Thresholds) -> DataFrame:
    enough = F.count("raw_score").over(w) >= t.least_samples
    return rows.withColumn("baseline", F.when(enough, F.avg("raw_score").over(w)).otherwise(fallback_baseline(F.col("platform"), t)))


def with_normalised(obs: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """normalised_score against the mean of the platform's last ``window_rows`` positive scores: the plain window, a task a platform."""
    w = Window.partitionBy("platform", F.col("raw_score") > 0).orderBy("captured_at", "seq").rowsBetween(-t.window_rows, -1)
    return _baseline(obs, w, t).withColumn("normalised_score", normalised_score(F.col("raw_score"), F.col("baseline"))).drop("baseline")


def with_normalised_blocked(obs: DataFrame, t: Thresholds = DEFAULTS, *, block: int = 8192, slice_seconds: int = 3600, first: str | None = None) -> DataFrame:
    """The same in blocks, for platforms of any size. Positive rows get their ordinal from counts of time slices; each block
    of ordinals also gets the rows that its first windows reach back to, so that a (platform, block) is a task's own work.
    ``first``: a column of integers by which rows stand before they stand by time."""
    block = max(block, t.window_rows)
    rows = obs.withColumn("_slice", F.struct(F.col(first) if first else F.lit(0).alias("_first"), F.floor(F.unix_seconds("captured_at") / slice_seconds).alias("_s")))
    positive = rows.where("raw_score > 0")
    slices = positive.groupBy("platform", "_slice").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("platform").orderBy("_slice")) - F.col("_n")
    slices = slices.select(F.col("platform").alias("_p"), F.col("_slice").alias("_s"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("platform", "_slice").orderBy("captured_at", "seq"))
    numbered = positive.withColumn("_in", inside).join(slices, F.col("platform").eqNullSafe(F.col("_p")) & F.col("_slice").eqNullSafe(F.col("_s"))).withColumn("_at", F.col("_before") + F.col("_in") - 1)
    own = F.floor(F.col("_at") / block)
    blocks = F.when(F.col("_at") % block >= block - t.window_rows, F.array(own, own + 1)).otherwise(F.array(own))
    copied = numbered.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    # a frame's sum is the difference of two running sums, so a row costs the same whatever ``window_rows`` is
    w = Window.partitionBy("platform", "_block").orderBy("_at")
    summed = copied.withColumn("_sum", F.coalesce(F.sum("raw_score").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    summed = summed.withColumn("_sum", F.col("_sum") - F.coalesce(F.lag("_sum", t.window_rows).over(w), F.lit(0))).where(F.col("_block") == F.col("_own"))
    n = F.least(F.col("_at"), F.lit(t.window_rows))
    baseline = F.when(n >= t.least_samples, F.col("_sum") / n).otherwise(fallback_baseline(F.col("platform"), t))
    scored = summed.withColumn("normalised_score", normalised_score(F.col("raw_score"), baseline))
    flat = rows.where("raw_score <= 0 OR raw_score IS NULL").withColumn("normalised_score", F.lit(0.0))
    return scored.select(*obs.columns, "normalised_score").unionByName(flat.select(*obs.columns, "normalised_score"))


def scored(rows: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Trending score and flag, from velocity and normalised score."""
    score = trending_score(F.col("platform"), F.col("score_velocity"), F.col("sentiment_compound"), F.col("comment_count"), F.col("normalised_score"), t)
    return rows.withColumn("trending_score", score).withColumn("is_trending", F.col("trending_score") >= t.cutoff)


def enriched(obs: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Velocity, normalised score, trending score and flag of every observation."""
    return scored(with_normalised_blocked(with_velocity(obs, t), t), t)


def minute_cap(rows: DataFrame, cap: int = 200, at: str = "captured_at", order: str = "seq") -> DataFrame:
    """At most ``cap`` rows a minute, the first by time."""
    minute = F.date_trunc("minute", at)
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(minute).orderBy(at, order))).where(F.col("_rank") <= cap).drop("_rank")


def score_delta(obs: DataFrame) -> DataFrame:
    """The change of score since the id's previous poll."""
    w = Window.partitionBy("id").orderBy("captured_at", "seq")
    return obs.withColumn("score_delta", F.col("raw_score") - F.lag("raw_score").over(w))


def keyset_page(rows: DataFrame, before: Column, size: int = 50) -> DataFrame:
    """The newest rows older than the cursor, at most 200."""
    return rows.where(F.col("captured_at") < before).orderBy(F.desc("captured_at"), "seq").limit(min(size, 200))


__all__ = ["enriched", "keyset_page", "minute_cap", "score_delta", "token_bucket", "with_normalised", "with_normalised_blocked", "with_velocity"]
