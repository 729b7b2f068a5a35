"""Raw platform records: parsing, filters, and one select a platform into the signal shape."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.config import BLUESKY_TERMS
from weirflow.schemas import RAW, SIGNAL

TITLE, BODY = 512, 2048


def parse(lines: DataFrame, platform: str, value: str = "value") -> DataFrame:
    """JSON text to the platform's record ``raw``; malformed text is kept in its field ``_malformed``."""
    return lines.withColumn("raw", F.from_json(value, RAW[platform] + ", _malformed string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}))


def epoch_of_iso(text: Column) -> Column:
    """Seconds since the epoch of an ISO-8601 text; 0 where it can't be read."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(text)) / F.lit(1e6), F.lit(0.0))


def signal(platform: str, source_id: Column, title: Column, body: Column, url: Column, author: Column, community: Column, published: Column, score: Column, comments: Column, extra: Column) -> list[Column]:
    or_zero = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    or_empty = lambda c: F.coalesce(c, F.lit(""))
    return [
        F.concat(F.lit(f"{platform}:"), source_id).alias("id"), F.lit(platform).alias("platform"), source_id.alias("source_id"),
        F.substring(or_empty(title), 1, TITLE).alias("title"), F.substring(or_empty(body), 1, BODY).alias("body"), url.alias("url"),
        F.coalesce(author, F.lit("deleted")).alias("author"), community.alias("community"), published.cast("double").alias("published_at"),
        or_zero(score).alias("raw_score"), or_zero(comments).alias("comment_count"), extra.alias("extra"), F.lit(1).alias("schema_version"),
    ]


def normalise_reddit(rows: DataFrame) -> DataFrame:
    r = F.col
    return rows.select(*signal("reddit", r("id"), r("title"), r("selftext"), F.concat(F.lit("https://reddit.com/r/"), r("subreddit"), F.lit("/comments/"), r("id")), r("author"), F.concat(F.lit("r/"), r("subreddit")), r("created_utc"), r("score"), r("num_comments"), F.create_map(F.lit("upvote_ratio"), r("upvote_ratio").cast("string"), F.lit("poll_priority"), r("poll_priority"))))


def normalise_hackernews(rows: DataFrame) -> DataFrame:
    r = F.col
    url = F.coalesce(F.nullif(r("url"), F.lit("")), F.concat(F.lit("https://news.ycombinator.com/item?id="), r("objectID")))
    return rows.select(*signal("hackernews", r("objectID"), r("title"), r("story_text"), url, r("author"), F.lit("hackernews"), r("created_at_i"), r("points"), r("num_comments"), F.create_map(F.lit("hn_id"), r("objectID"), F.lit("tags"), F.to_json("_tags"))))


def normalise_bluesky(rows: DataFrame) -> DataFrame:
    r = F.col
    post = F.element_at(F.split("uri", "/"), -1)
    handle = F.coalesce("author_handle", "author")
    url = F.concat(F.lit("https://bsky.app/profile/"), handle, F.lit("/post/"), post)
    return rows.select(*signal("bluesky", F.coalesce("cid", post), F.lit(""), r("record.text"), url, handle, F.coalesce("feed", F.lit("bluesky")), epoch_of_iso(r("record.createdAt")), r("likeCount"), r("replyCount"), F.create_map(F.lit("repost_count"), r("repostCount").cast("string"), F.lit("cid"), r("cid"), F.lit("langs"), F.to_json("record.langs"))))


def normalise_youtube(rows: DataFrame) -> DataFrame:
    r = F.col
    own = "snippet.topLevelComment.snippet."
    url = F.concat(F.lit("https://youtube.com/watch?v="), r("snippet.videoId"), F.lit("&lc="), r("id"))
    return rows.select(*signal("youtube", r("id"), r("video_title"), r(own + "textOriginal"), url, r(own + "authorDisplayName"), F.coalesce("channel_title", "snippet.videoId"), epoch_of_iso(r(own + "publishedAt")), r(own + "likeCount"), r("snippet.totalReplyCount"), F.create_map(F.lit("video_id"), r("snippet.videoId"), F.lit("channel_id"), r("channel_id"))))


NORMALISERS = {"reddit": normalise_reddit, "hackernews": normalise_hackernews, "bluesky": normalise_bluesky, "youtube": normalise_youtube}


def normalise(records: dict[str, DataFrame]) -> DataFrame:
    """Records of each platform as one table of signals; rows without an id are dropped (they go to the dead letters)."""
    parts = [NORMALISERS[p](rows) for p, rows in records.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("id").isNotNull())


def hackernews_wanted(kinds: tuple[str, ...] = ("story", "ask_hn", "show_hn")) -> Column:
    """Stories, Ask and Show posts that are neither dead nor deleted."""
    live = ~F.coalesce("dead", F.lit(False)) & ~F.coalesce("deleted", F.lit(False))
    return (F.length(F.coalesce("objectID", F.lit(""))) > 0) & F.arrays_overlap("_tags", F.array(*map(F.lit, kinds))) & live


def bluesky_wanted(text: Column, langs: Column, terms: tuple[str, ...] = BLUESKY_TERMS, least: int = 40, lang: str = "en") -> Column:
    """Posts long enough, in the language or with none told, that hold one of the terms in any case."""
    spoken = langs.isNull() | (F.size(langs) == 0) | F.array_contains(langs, lang)
    held = F.lit(False)
    for term in terms:
        held = held | F.contains(F.lower(text), F.lit(term.lower()))
    return (F.length(F.coalesce(text, F.lit(""))) >= least) & spoken & held


def split_valid(lines: DataFrame, platform: str, source_topic: str, failed_at: Column, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, dead letters): a line that is no record of the platform, or has no id, goes into an envelope."""
    parsed = parse(lines, platform, value)
    key = {"hackernews": F.col("raw.objectID"), "bluesky": F.coalesce("raw.cid", "raw.uri")}.get(platform, F.col("raw.id"))
    malformed = F.col("raw").isNull() | F.col("raw._malformed").isNotNull()
    bad = malformed | key.isNull()
    dead = parsed.where(bad).select(F.lit(source_topic).alias("source_topic"), F.when(malformed, "malformed").otherwise("no id").alias("error"), failed_at.alias("failed_at"), F.lit(1).alias("attempt"), F.col(value).alias("payload"))
    return parsed.where(~bad).select("raw.*").drop("_malformed"), dead


def stored(signals: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Unified signals in the types they are stored in: times on the wire are seconds since the epoch, stored ones are timestamps;
    what no step has filled yet is null."""
    times = {"published_at": F.timestamp_seconds("published_at"), "ingested_at": ingested_at if ingested_at is not None else F.lit(None)}
    given = signals.withColumns({c: v for c, v in times.items() if c == "published_at" or c not in signals.columns})
    fields = [f.strip().split(" ", 1) for f in re.split(r",(?![^<]*>)", SIGNAL)]
    return given.select(*[(F.col(n) if n in given.columns else F.lit(None)).cast(kind).alias(n) for n, kind in fields])
