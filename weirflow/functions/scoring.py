"""Scores, labels and tiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirflow.config import DEFAULTS, Thresholds


def rounded(value: Column, digits: int) -> Column:
    """Rounded past the noise that the order of a sum leaves, so that ties fall alike in every run."""
    return F.round(F.round(value, 10), digits)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def steps(value: Column, *bounds: tuple[float, float]) -> Column:
    """The first gain whose bound the value is over, else 0."""
    out = F.lit(0.0)
    for bound, gain in reversed(bounds):
        out = F.when(value > bound, gain).otherwise(out)
    return out


def trending_score(platform: Column, velocity: Column, sentiment: Column, comments: Column, normalised: Column, t: Thresholds = DEFAULTS) -> Column:
    """0 to 1, by the rule of the platform; unknown and null ones follow Reddit's."""
    norm, felt = F.coalesce(normalised, F.lit(0.0)), F.abs(F.coalesce(sentiment, F.lit(0.0)))
    feeling = F.when(felt > t.sentiment, 0.2).otherwise(0.0)
    general = steps(velocity, (t.velocity_high, 0.4), (t.velocity_low, 0.2)) + feeling + F.when(comments > t.comments, 0.2).otherwise(0.0) + F.when(norm > 0.6, 0.2).otherwise(0.0)
    weighed = steps(norm, (0.6, 0.5), (0.3, 0.3)) + feeling
    bluesky = steps(felt, (0.6, 0.6), (0.3, 0.4), (0.1, 0.2)) + F.when(sentiment > 0.2, 0.1).otherwise(0.0)
    score = F.when(platform == "hackernews", weighed + steps(comments, (20, 0.3), (5, 0.2))).when(platform == "youtube", weighed + steps(comments, (50, 0.3), (5, 0.2))).when(platform == "bluesky", bluesky).otherwise(general)
    return F.round(F.least(score, F.lit(1.0)), 4)


def fallback_baseline(platform: Column, t: Thresholds = DEFAULTS) -> Column:
    out = F.lit(t.other_fallback)
    for name, value in t.fallback.items():
        out = F.when(platform == name, value).otherwise(out)
    return out


def normalised_score(score: Column, baseline: Column) -> Column:
    """Half at the baseline, 1 at twice it, 0 for scores that aren't positive."""
    return F.when(score > 0, F.round(F.least(score / (2 * F.greatest(baseline, F.lit(1.0))), F.lit(1.0)), 4)).otherwise(F.lit(0.0))


def sentiment_label(score: Column) -> Column:
    return F.when(score >= 0.05, "positive").when(score <= -0.05, "negative").otherwise("neutral")


def sentiment_bucket(score: Column) -> Column:
    return F.when(score >= 0.5, "strongly_positive").when(score >= 0.05, "mildly_positive").when(score <= -0.5, "strongly_negative").when(score <= -0.05, "mildly_negative").otherwise("neutral")


def momentum_label(velocity: Column) -> Column:
    return F.when(velocity > 2, "rising").when(velocity < -1, "falling").otherwise("stable")


def poll_priority(age_minutes: Column) -> Column:
    return F.when(age_minutes < 5, "aggressive").when(age_minutes < 60, "normal").when(age_minutes < 1440, "slow").otherwise("inactive")


def age_bucket(hours: Column) -> Column:
    return F.when(hours < 1, "under_1h").when(hours < 6, "1h_to_6h").when(hours < 12, "6h_to_12h").when(hours < 24, "12h_to_24h").otherwise("over_24h")


def signal_tier(rate_pct: Column, velocity: Column) -> Column:
    return F.when((rate_pct >= 20) & (velocity >= 10), "high_signal").when((rate_pct >= 10) | (velocity >= 5), "medium_signal").otherwise("low_signal")
