"""Registered queries over the library's operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import lexicon, runs, scoring, text as words
from weirflow.operators import base, marts, numbering, ops, serving, state, throttle, topics, windows
from weirflow.plans import frames as f
from weirflow.schemas import RAW, REDDIT
from weirflow.sources import raw
from weirflow.sources.fixtures import as_observations, as_of, communities, observations, sql, subreddit_config, table
from weirflow.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

DAY = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def at(column: str) -> str:
    return DAY.format(column)


def query(statement: str | None = None, *parts: str):
    def register(of: Query) -> Query:
        QUERIES[of.__name__] = of
        if statement:
            ORACLE[of.__name__] = sql(statement, *parts)
        return of

    return register


# Sources, filters, projections.


@query(f"SELECT seq, platform, id, community_id, {at('captured_at')} AS captured_at, raw_score, comment_count, sentiment_compound, list_aggregate(topics, 'string_agg', ',') AS topics FROM obs")
def observations_log(spark, d):
    return observations(spark, d).select("seq", "platform", "id", "community_id", f.text("captured_at").alias("captured_at"), "raw_score", "comment_count", "sentiment_compound", F.array_join("topics", ",").alias("topics"))


def raw_lines(spark, d, platform, *others):
    """The log's rows as the platform's own JSON, beside ``others`` of their columns."""
    o = observations(spark, d).where(F.col("platform") == platform)
    epoch = F.unix_seconds("captured_at")
    iso = F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    of = {
        "reddit": F.struct(F.col("seq").cast("string").alias("id"), "title", F.lit("").alias("selftext"), F.concat(F.lit("c"), F.col("community_id")).alias("subreddit"), "author", epoch.cast("double").alias("created_utc"), F.col("raw_score").alias("score"), F.col("comment_count").alias("num_comments")),
        "hackernews": F.struct(F.col("seq").cast("string").alias("objectID"), "title", "author", epoch.alias("created_at_i"), F.col("raw_score").alias("points"), F.col("comment_count").alias("num_comments"), F.array(F.when(F.col("seq") % 3 == 0, "comment").otherwise("story")).alias("_tags"), (F.col("seq") % 7 == 0).alias("dead")),
        "bluesky": F.struct(F.concat(F.lit("at://did/post/"), F.col("seq")).alias("uri"), "author", F.struct(F.col("title").alias("text"), iso.alias("createdAt"), F.array(F.lit("en")).alias("langs")).alias("record"), F.col("raw_score").alias("likeCount"), F.col("comment_count").alias("replyCount")),
        "youtube": F.struct(F.col("seq").cast("string").alias("id"), F.struct(F.lit("v1").alias("videoId"), F.col("comment_count").alias("totalReplyCount"), F.struct(F.struct(F.col("title").alias("textOriginal"), F.col("author").alias("authorDisplayName"), iso.alias("publishedAt"), F.col("raw_score").alias("likeCount")).alias("snippet")).alias("topLevelComment")).alias("snippet"), F.lit("video").alias("video_title")),
    }[platform]
    return o.select(F.to_json(of).alias("value"), *others)


def records(spark, d):
    return {p: raw.parse(raw_lines(spark, d, p), p).select("raw.*") for p in raw.NORMALISERS}


@query("""SELECT platform || ':' || seq AS id, platform, CASE platform WHEN 'bluesky' THEN '' WHEN 'youtube' THEN 'video' ELSE title END AS title, CASE WHEN platform IN ('bluesky', 'youtube') THEN title ELSE '' END AS body,
  CASE platform WHEN 'reddit' THEN 'https://reddit.com/r/c' || community_id || '/comments/' || seq WHEN 'hackernews' THEN 'https://news.ycombinator.com/item?id=' || seq WHEN 'bluesky' THEN 'https://bsky.app/profile/' || author || '/post/' || seq ELSE 'https://youtube.com/watch?v=v1&lc=' || seq END AS url,
  author, CASE platform WHEN 'reddit' THEN 'r/c' || community_id WHEN 'youtube' THEN 'v1' ELSE platform END AS community, floor(epoch(captured_at))::DOUBLE AS published_at, raw_score, comment_count FROM obs WHERE platform <> 'other'""")
def normalise_union(spark, d):
    return raw.normalise(records(spark, d)).select("id", "platform", "title", "body", "url", "author", "community", "published_at", "raw_score", "comment_count")


@query(f"SELECT platform || ':' || seq AS id, platform, {at("date_trunc('second', captured_at)")} AS published_at, raw_score, 1 AS schema_version FROM obs WHERE platform <> 'other'")
def signals_stored(spark, d):
    """Unified signals in their stored types."""
    rows = raw.stored(raw.normalise(records(spark, d)), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return rows.select("id", "platform", f.text("published_at").alias("published_at"), "raw_score", "schema_version")


@query("SELECT seq::VARCHAR AS id, raw_score AS points FROM obs WHERE platform = 'hackernews' AND seq % 3 <> 0 AND seq % 7 <> 0")
def hn_filter(spark, d):
    return records(spark, d)["hackernews"].where(raw.hackernews_wanted()).select(F.col("objectID").alias("id"), "points")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND length(text) >= 40 AND (contains(lower(text), 'the ') OR contains(lower(text), ' que '))")
def bluesky_filter(spark, d):
    docs = table(spark, d, "documents")
    langs = F.when(F.col("lang") == "fr", F.array().cast("array<string>")).otherwise(F.array("lang"))
    return docs.where(raw.bluesky_wanted(F.col("text"), langs, ("The ", " que "))).select("doc_id")


@query("SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY date_trunc('minute', captured_at) ORDER BY captured_at, seq) AS r FROM obs) WHERE r <= 1")
def minute_cap(spark, d):
    return windows.minute_cap(observations(spark, d), 1).select("seq")


AGE = "(epoch_us(t) - epoch_us(created_utc)) / 6e7"


@query(f"SELECT id, CASE WHEN {AGE} < 5 THEN 'aggressive' WHEN {AGE} < 60 THEN 'normal' WHEN {AGE} < 1440 THEN 'slow' ELSE 'inactive' END AS poll_priority FROM posts, now", *f.CURRENT, f.POSTS)
def priority_tiers(spark, d):
    return ops.with_priority(f.posts(spark, d), as_of(spark, d)).select("id", "poll_priority")


@query("SELECT id FROM posts, now WHERE poll_priority <> 'inactive' AND (last_polled_at IS NULL OR (epoch_us(t) - epoch_us(last_polled_at)) / 1e6 >= CASE poll_priority WHEN 'aggressive' THEN 300 WHEN 'normal' THEN 1800 ELSE 7200 END)", *f.CURRENT, f.POSTS)
def refresh_due(spark, d):
    return ops.refresh_due(f.posts(spark, d), as_of(spark, d)).select("id")


@query("SELECT id FROM posts, now WHERE created_utc >= t - INTERVAL 480 HOUR", *f.CURRENT, f.POSTS)
def expire_old(spark, d):
    return ops.unexpired(f.posts(spark, d), as_of(spark, d), 480).select("id")


@query("SELECT n_name AS name, 60 * (1 + n_regionkey)::BIGINT AS interval_seconds FROM nation WHERE n_regionkey <> 4")
def config_active(spark, d):
    return ops.active_config(subreddit_config(spark, d), [])


# Velocity, baseline, trending.


@query("SELECT seq, id, round(score_velocity, 6) AS score_velocity, round(comment_velocity, 6) AS comment_velocity FROM vel", f.VEL)
def velocity(spark, d):
    return windows.with_velocity(observations(spark, d)).select("seq", "id", F.round("score_velocity", 6).alias("score_velocity"), F.round("comment_velocity", 6).alias("comment_velocity"))


@query("SELECT seq, platform, normalised_score FROM norm", f.VEL, f.NORM)
def normalised_score(spark, d):
    return windows.with_normalised_blocked(observations(spark, d)).select("seq", "platform", "normalised_score")


@query("SELECT seq, platform, normalised_score FROM norm", f.VEL, f.NORM)
def normalised_score_blocked(spark, d):
    return windows.with_normalised_blocked(observations(spark, d), block=1000).select("seq", "platform", "normalised_score")


@query("SELECT seq, platform, trending_score, is_trending FROM enr", *f.ENRICHED)
def trending_score(spark, d):
    return f.enriched(spark, d).select("seq", "platform", "trending_score", "is_trending")


@query("SELECT seq, raw_score - lag(raw_score) OVER (PARTITION BY id ORDER BY captured_at, seq) AS score_delta FROM obs")
def score_delta(spark, d):
    return windows.score_delta(observations(spark, d)).select("seq", "score_delta")


#: Tokens a second; a bucket holds one of them at these rates. Levels in the twin are parts of a token, as in the library.
RATES = {"reddit": 0.0005, "hackernews": 0.001, "youtube": -1.0}
WALK = f"""walk AS (WITH RECURSIVE line AS (SELECT seq, platform, epoch_us(captured_at) AS at, row_number() OVER (PARTITION BY platform ORDER BY captured_at, seq) AS n, CASE platform {" ".join(f"WHEN '{p}' THEN {throttle.refill_of(r, 3.0)[0]}" for p, r in RATES.items() if r >= 0)} END AS gain FROM obs WHERE platform IN ('reddit', 'hackernews')),
  step AS (SELECT *, 0::BIGINT AS level, true AS through FROM line WHERE n = 1 UNION ALL
    SELECT l.seq, l.platform, l.at, l.n, l.gain, CASE WHEN s.level + l.gain * (l.at - s.at) >= {throttle.TOKEN} THEN least(s.level + l.gain * (l.at - s.at), {throttle.TOKEN}) - {throttle.TOKEN} ELSE s.level + l.gain * (l.at - s.at) END, s.level + l.gain * (l.at - s.at) >= {throttle.TOKEN} FROM step s JOIN line l ON l.platform = s.platform AND l.n = s.n + 1)
  SELECT seq, platform FROM step WHERE through)"""
BUCKET = "SELECT seq, platform FROM walk UNION ALL SELECT seq, platform FROM obs WHERE platform NOT IN ('reddit', 'hackernews')"


@query(BUCKET, WALK)
def token_bucket(spark, d):
    return windows.token_bucket(observations(spark, d), RATES).select("seq", "platform")


# State and history.

CUR_COLUMNS = "id, platform, community_id, title, author, normalised_score, raw_score, comment_count, round(score_velocity, 6) AS score_velocity, trending_score, sentiment_compound"


@query(f"SELECT {CUR_COLUMNS}, list_aggregate(topics, 'string_agg', ',') AS topics, {at('first_seen_at')} AS first_seen_at, {at('last_updated_at')} AS last_updated_at FROM cur", *f.CURRENT)
def signals_current(spark, d):
    c = f.current(spark, d)
    return c.select("id", "platform", "community_id", "title", "author", "normalised_score", "raw_score", "comment_count", F.round("score_velocity", 6).alias("score_velocity"), "trending_score", "sentiment_compound", F.array_join("topics", ",").alias("topics"), f.text("first_seen_at").alias("first_seen_at"), f.text("last_updated_at").alias("last_updated_at"))


STATE = "SELECT id, platform, normalised_score, raw_score, comment_count, round(score_velocity, 6) AS score_velocity, trending_score, sentiment_compound FROM cur"


@query(STATE, *f.CURRENT)
def marts_base(spark, d):
    """The state that the marts stand on, built here or by the first mart."""
    return f.based(spark, d).select("id", "platform", "normalised_score", "raw_score", "comment_count", F.round("score_velocity", 6).alias("score_velocity"), "trending_score", "sentiment_compound")


@query(STATE, *f.CURRENT)
def signals_incremental(spark, d):
    """The state after the log came in three spans of days, each extending what the spans before left."""
    o = observations(spark, d)
    first, last = o.agg(F.min(F.to_date("captured_at")), F.max(F.to_date("captured_at"))).first()
    grown = base.new_base(o.count())
    for third in (1, 2, 3):
        grown = base.extended(grown, o.where(F.to_date("captured_at") <= F.date_add(F.lit(first), (last - first).days * third // 3)))
    return grown.state(spark).select("id", "platform", "normalised_score", "raw_score", "comment_count", F.round("score_velocity", 6).alias("score_velocity"), "trending_score", "sentiment_compound")


@query("SELECT id, seq, raw_score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY captured_at DESC, seq DESC) AS r FROM obs) WHERE r = 1")
def posts_current(spark, d):
    return state.latest_per_key(observations(spark, d), "id", "captured_at", "seq").select("id", "seq", "raw_score")


@query("SELECT id, CASE WHEN source_id::BIGINT % 4 <> 0 THEN 0.5 ELSE sentiment_compound END::DOUBLE AS sentiment_compound FROM cur", *f.CURRENT)
def nlp_update(spark, d):
    c = state.kept(f.current(spark, d))
    new = f.nlp_of(c).select(F.col("post_id").alias("id"), F.lit(0.5).alias("sentiment_compound"))
    return state.set_features(c.select("id", "sentiment_compound"), new, ("sentiment_compound",))


@query("SELECT id, seq, raw_score, round(score_velocity, 6) AS score_velocity, trending_score FROM enr WHERE score_velocity <> 0 OR comment_velocity <> 0", *f.ENRICHED)
def metrics_history(spark, d):
    return state.metrics_history(f.enriched(spark, d)).select("id", "seq", "raw_score", F.round("score_velocity", 6).alias("score_velocity"), "trending_score")


@query("SELECT seq FROM obs, now WHERE captured_at >= t - INTERVAL 10 DAY")
def retention(spark, d):
    return state.retained(observations(spark, d), as_of(spark, d), 10).select("seq")


@query("""SELECT row_number() OVER (ORDER BY old DESC, CASE WHEN old THEN platform END, CASE WHEN old THEN name END, platform, name)::INTEGER AS id, platform, name FROM (SELECT DISTINCT platform, n_name AS name, n_regionkey = 0 AS old FROM obs JOIN nation ON community_id = n_nationkey)""")
def communities_dim(spark, d):
    named = observations(spark, d).join(communities(spark, d), "community_id").select("platform", F.col("community").alias("name"))
    region0 = table(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_name").alias("name"))
    empty = spark.createDataFrame([], "id int, platform string, name string")
    old = numbering.with_surrogates(named.join(region0, "name").select("platform", "name"), empty)
    return numbering.with_surrogates(named, old)


# Feed.


@query("SELECT id, raw_score, n_name AS community FROM cur LEFT JOIN nation ON community_id = n_nationkey", *f.CURRENT)
def signals_with_community(spark, d):
    return serving.with_communities(f.current(spark, d), communities(spark, d)).select("id", "raw_score", "community")


@query("""SELECT seq, raw_score + 2 * comment_count AS engagement, round((epoch_us(t) - epoch_us(captured_at)) / 6e7, 4) AS age_minutes, round((raw_score + 2 * comment_count) / ((epoch_us(t) - epoch_us(captured_at)) / 6e7 + 1), 6) AS momentum
  FROM enr, now WHERE platform IN ('reddit', 'youtube') AND list_has_any(topics, ['topic1', 'topic6']) AND contains(title, '1') AND normalised_score >= 0.2 AND captured_at >= t - INTERVAL 15 DAY""", *f.ENRICHED)
def signal_feed(spark, d):
    now = as_of(spark, d)
    rows = serving.feed(f.enriched(spark, d), platforms=["reddit", "youtube"], topics=["topic1", "topic6"], text="1", least_score=0.2, start=now - serving.hours(360), end=now)
    return serving.with_feed_columns(rows, now).select("seq", "engagement", F.round("age_minutes", 4).alias("age_minutes"), F.round("momentum", 6).alias("momentum"))


@query("SELECT id, raw_score FROM cur ORDER BY raw_score DESC NULLS LAST, id LIMIT 50", *f.CURRENT)
def feed_sorted(spark, d):
    return serving.sorted_feed(f.current(spark, d), "score").select("id", "raw_score")


@query("SELECT seq FROM obs, now WHERE captured_at < t - INTERVAL 1 DAY ORDER BY captured_at DESC, seq LIMIT 200")
def keyset_page(spark, d):
    return windows.keyset_page(observations(spark, d), as_of(spark, d) - serving.hours(24), 500).select("seq")


@query("SELECT id FROM cur JOIN nation ON community_id = n_nationkey WHERE contains(lower(title), '12') OR contains(lower(n_name), '12') OR contains(lower(author), '12')", *f.CURRENT)
def feed_search(spark, d):
    return serving.searched(named_current(spark, d), "12").select("id")


# Text.

STOPS = "[" + ", ".join(f"'{w}'" for w in words.STOP_WORDS) + "]"


@query(rf"SELECT doc_id, array_to_string(list_distinct_in_order[1:10], ',') AS keywords FROM (SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_in_order FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: length(x) > 3 AND regexp_full_match(x, '\p{{L}}+') AND NOT list_contains({STOPS}, x)) AS w FROM documents))")
def keywords(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(words.keywords(F.col("text")), ",").alias("keywords"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: length(x) > 3)[1:10], ',') AS keywords FROM documents")
def legacy_keywords(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(words.legacy_keywords(F.col("text")), ",").alias("keywords"))


TERMS = ("the", "and", "of the", "was", "idiot", "que")


@query(r"""SELECT doc_id, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i)[1:8], ',') AS topics FROM (SELECT doc_id, list_filter(list_transform(w, lambda x, i: CASE WHEN x = 'of' AND w[i + 1] = 'the' THEN 'of the' WHEN list_contains(['the', 'and', 'was', 'idiot', 'que'], x) THEN x END), lambda x: x IS NOT NULL) AS u
  FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS w FROM documents))""")
def seed_topics(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(words.seed_topics(F.col("text"), TERMS), ",").alias("topics"))


#: Words of the given tables' prose with a valence, next to the small English lexicon.
VALENCES = {**words.LEXICON, "with": 1.3, "this": 2.2, "was": -1.7, "und": 0.9, "les": -0.6}


@query(words.sentiment_sql(VALENCES))
def sentiment(spark, d):
    score = words.sentiment(words.title_else_body(F.lit(""), F.col("text")), VALENCES)
    return table(spark, d, "documents").select("doc_id", score.alias("sentiment_compound")).withColumn("sentiment_label", scoring.sentiment_label(F.col("sentiment_compound")))


# Terms of a table. The tables are made of the documents' own words and pairs of words, so they grow with these.

RUNS = rf"""tok AS MATERIALIZED (SELECT *, len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) BETWEEN 1 AND len(w) - 1 AS mixed FROM (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''), lambda x: trim(x, '{words.PUNCTUATION}')) AS w, text FROM documents)),
word AS (SELECT DISTINCT lower(unnest(w)) AS term FROM tok),
pair AS (SELECT DISTINCT lower(w[i] || ' ' || w[i + 1]) AS term FROM tok, LATERAL (SELECT unnest(range(1, len(w))) AS i) WHERE doc_id % 10 = 0)"""
KIND = "CASE WHEN length(term) % 11 = 2 THEN 'booster' WHEN length(term) % 11 = 3 AND ascii(term) % 3 = 0 THEN 'negation' WHEN length(term) = 4 AND ascii(term) % 13 = 0 THEN 'contrast' WHEN ascii(term) % 4 = 1 THEN 'valence' END"
VALUE = "CASE WHEN length(term) % 11 = 2 THEN 0.293 ELSE ((length(term) * 7 + ascii(term)) % 9 - 4) * 0.5 + 0.25 END"
HITS = """runs AS (SELECT doc_id, i - 1 AS pos, n, lower(array_to_string(w[i:i + n - 1], ' ')) AS term, len(list_filter(w[i:i + n - 1], lambda x: NOT (upper(x) = x AND lower(x) <> x))) = 0 AS capital, mixed
  FROM tok, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i), (VALUES (1), (2)) v(n) WHERE i + n - 1 <= len(w)),
longest AS (SELECT * FROM runs JOIN terms USING (term) QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY n DESC) = 1),
hit AS (SELECT * FROM longest QUALIFY coalesce(max(pos + n - 1) OVER (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), -1) < pos)"""
LOUD = "(CASE WHEN capital AND mixed THEN 0.733::DOUBLE ELSE 0.0::DOUBLE END)"
RULED = f"""ruled AS (SELECT *, min(CASE WHEN kind = 'contrast' THEN pos END) OVER (PARTITION BY doc_id) AS turn_at, coalesce(max((kind = 'negation')::INT) OVER (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) > 0 AS turned,
  {" + ".join(f"coalesce(max(CASE WHEN kind = 'booster' THEN value + {LOUD} * sign(value) END) OVER (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN {d} PRECEDING AND {d} PRECEDING), 0.0::DOUBLE) * {fade}::DOUBLE" for d, fade in enumerate(lexicon.FADE, 1))} AS boost FROM hit),
summed AS (SELECT doc_id, sum(round((value + ({LOUD} + boost) * sign(value)) * CASE WHEN turned THEN -0.74::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN pos < turn_at THEN 0.5::DOUBLE WHEN pos > turn_at THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END, 9)::DECIMAL(20, 9))::DOUBLE AS s FROM ruled WHERE kind = 'valence' GROUP BY doc_id),
marked AS (SELECT doc_id, coalesce(s, 0.0) AS s, length(coalesce(text, '')) - length(replace(coalesce(text, ''), '!', '')) AS x, length(coalesce(text, '')) - length(replace(coalesce(text, ''), '?', '')) AS q FROM tok LEFT JOIN summed USING (doc_id)),
raised AS (SELECT doc_id, s + sign(s) * (least(x, 4) * 0.292::DOUBLE + CASE WHEN q > 3 THEN 0.96::DOUBLE WHEN q > 1 THEN q * 0.18::DOUBLE ELSE 0.0::DOUBLE END) AS s FROM marked)"""


def run_terms(spark, d):
    """The documents' words, and pairs of words of a tenth of them, in lower case."""
    docs = table(spark, d, "documents")
    few = docs.select("doc_id", F.transform(lexicon.words_of(F.col("text")), F.lower).alias("w"))
    pairs = few.where("doc_id % 10 = 0").select(F.explode(F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))).alias("term"))
    return runs.forms(docs, F.col("text"), words.PUNCTUATION), pairs.distinct()


@query("SELECT doc_id, round(s / sqrt(s * s + 15), 4) AS sentiment_compound FROM raised", RUNS, f"terms AS (SELECT * FROM (SELECT term, {KIND} AS kind, ({VALUE})::DOUBLE AS value FROM (FROM word UNION ALL (FROM pair WHERE length(term) % 5 = 0))) WHERE kind IS NOT NULL)", HITS, RULED)
def sentiment_lexicon(spark, d):
    """Sentiment by a lexicon of thousands of words and phrases, with boosters, negations, contrasts, capitals and marks."""
    word, pair = run_terms(spark, d)
    terms = word.unionByName(pair.where(F.length("term") % 5 == 0)).withColumns({"kind": F.expr(KIND), "value": F.expr(VALUE).cast("double")}).where("kind IS NOT NULL")
    return lexicon.sentiment_by_table(table(spark, d, "documents"), "text", terms, ["doc_id"], longest=2)


NOISE = "[" + ", ".join(f"'{w}'" for w in words.NOISE_TOPICS) + "]"


@query(f"""SELECT doc_id, coalesce(array_to_string(list(name ORDER BY pos)[1:8], ','), '') AS topics FROM documents LEFT JOIN (SELECT doc_id, name, min(pos) AS pos FROM hit WHERE length(name) >= 2 AND NOT regexp_full_match(name, '[0-9]+') AND NOT list_contains({NOISE}, name) GROUP BY doc_id, name) USING (doc_id) GROUP BY doc_id""",
       RUNS, "terms AS (SELECT term, term AS name FROM word WHERE length(term) % 3 = 0 UNION ALL SELECT term, term FROM pair WHERE ascii(term) % 2 = 0)", HITS)
def entity_topics(spark, d):
    """Topics by a table of names of one and two words: the longest match, less noise."""
    word, pair = run_terms(spark, d)
    names = word.where(F.length("term") % 3 == 0).unionByName(pair.where(F.ascii("term") % 2 == 0)).withColumn("name", F.col("term"))
    return lexicon.topics_by_table(table(spark, d, "documents"), "text", names, ["doc_id"], longest=2).withColumn("topics", F.array_join("topics", ","))


# Topic intelligence.


@query(f"SELECT topic, platform, {at('bucket')} AS bucket, signal_count, round(avg_sentiment, 4) AS avg_sentiment, max_trending, total_score FROM bk", *f.BUCKETED)
def topic_buckets(spark, d):
    return f.buckets(spark, d).select("topic", "platform", f.text("bucket").alias("bucket"), "signal_count", F.round("avg_sentiment", 4).alias("avg_sentiment"), "max_trending", "total_score")


@query(f"SELECT topic, platform, {at('bucket')} AS bucket, signal_count, round(avg_sentiment, 4) AS avg_sentiment, max_trending, total_score FROM bk", *f.BUCKETED)
def topic_bucket_merge(spark, d):
    rows = f.enriched(spark, d)
    both = topics.merge_buckets(topics.topic_buckets(rows.where("seq % 2 = 0")), topics.topic_buckets(rows.where("seq % 2 = 1")))
    return both.select("topic", "platform", f.text("bucket").alias("bucket"), "signal_count", F.round("avg_sentiment", 4).alias("avg_sentiment"), "max_trending", "total_score")


TOTALS = f"SELECT topic, array_to_string(list_sort(list(DISTINCT platform)), ',') AS platforms, count(DISTINCT platform) AS platform_count, sum(signal_count)::BIGINT AS total_signals, round(round(avg(avg_sentiment), 10), 3) AS avg_sentiment, max(max_trending) AS peak_trending, {at('min(bucket)')} AS first_seen, {at('max(bucket)')} AS last_seen FROM bk, now"


def flat_totals(rows):
    return rows.select("topic", F.array_join("platforms", ",").alias("platforms"), "platform_count", "total_signals", "avg_sentiment", "peak_trending", f.text("first_seen").alias("first_seen"), f.text("last_seen").alias("last_seen"))


@query(TOTALS + " WHERE bucket > t - INTERVAL 24 HOUR GROUP BY topic HAVING count(DISTINCT platform) >= 2 AND sum(signal_count) >= 3 ORDER BY platform_count DESC, total_signals DESC, topic LIMIT 100", *f.BUCKETED)
def cross_platform_events(spark, d):
    return flat_totals(topics.cross_platform_topics(f.buckets(spark, d), as_of(spark, d), 24))


@query(TOTALS + " WHERE bucket > t - INTERVAL 24 HOUR GROUP BY topic HAVING sum(signal_count) >= 3", *f.BUCKETED)
def trending_topics_24h(spark, d):
    return flat_totals(topics.trending_topics_view(f.buckets(spark, d), as_of(spark, d)))


@query(f"SELECT topic, platform, sum(signal_count)::BIGINT AS signal_count, round(round(avg(avg_sentiment), 10), 3) AS avg_sentiment, max(max_trending) AS peak_trending, {at('min(bucket)')} AS first_seen, {at('max(bucket)')} AS last_seen FROM bk, now WHERE bucket > t - INTERVAL 2 HOUR GROUP BY topic, platform", *f.BUCKETED)
def topic_leaderboard_2h(spark, d):
    return topics.leaderboard(f.buckets(spark, d), as_of(spark, d)).withColumns({c: f.text(c) for c in ("first_seen", "last_seen")})


@query(f"""SELECT topic, arg_min(platform, (fs, platform)) AS origin_platform, {at('min(fs)')} AS origin_first_seen, sum(n)::BIGINT AS total_signals, max(n) AS peak_signal_count, ((epoch(max(fs)) - epoch(min(fs))) // 60)::INTEGER AS spread_minutes, string_agg(platform, ',' ORDER BY fs, platform) AS platforms
  FROM (SELECT topic, platform, min(bucket) AS fs, sum(signal_count)::BIGINT AS n FROM bk, now WHERE bucket > t - INTERVAL 24 HOUR GROUP BY ALL) GROUP BY topic HAVING count(*) >= 2 AND sum(n) >= 3""", *f.BUCKETED)
def cross_platform_detail(spark, d):
    rows = topics.cross_platform_detail(f.buckets(spark, d), as_of(spark, d), 24)
    return rows.select("topic", "origin_platform", f.text("origin_first_seen").alias("origin_first_seen"), "total_signals", "peak_signal_count", "spread_minutes", F.array_join(F.transform("platforms", lambda p: p["platform"]), ",").alias("platforms"))


PLATFORM_SENTIMENT = """ps AS (SELECT topic, platform, round(round(avg(sentiment_compound), 10), 4) AS avg_sentiment, count(*) AS signal_count, min(captured_at) AS earliest, list(id ORDER BY raw_score DESC NULLS LAST, seq)[1:3] AS ids FROM ex, now WHERE captured_at >= t - INTERVAL 24 HOUR GROUP BY topic, platform HAVING count(*) >= 3)"""


@query(f"SELECT topic, platform, avg_sentiment, signal_count, {at('earliest')} AS earliest, array_to_string(ids, ',') AS ids FROM ps", *f.ENRICHED, f.SPREAD, PLATFORM_SENTIMENT)
def platform_sentiment(spark, d):
    rows = topics.platform_sentiment(f.enriched(spark, d), as_of(spark, d), 1440)
    return rows.select("topic", "platform", "avg_sentiment", "signal_count", f.text("earliest").alias("earliest"), F.array_join("sample_ids", ",").alias("ids"))


EVENTS = """ev AS (SELECT a.topic, a.platform AS platform_a, b.platform AS platform_b, a.avg_sentiment AS sentiment_a, b.avg_sentiment AS sentiment_b, round(abs(a.avg_sentiment - b.avg_sentiment), 4) AS divergence_score, list_concat(a.ids, b.ids)[1:6] AS ids FROM ps a JOIN ps b ON a.topic = b.topic AND a.platform < b.platform WHERE round(abs(a.avg_sentiment - b.avg_sentiment), 4) >= 0.1),
org AS (SELECT topic, list(platform ORDER BY earliest, platform)[1] AS origin_platform, ((epoch(list(earliest ORDER BY earliest, platform)[2]::TIMESTAMP)::BIGINT - epoch(list(earliest ORDER BY earliest, platform)[1]::TIMESTAMP)::BIGINT) // 60)::INTEGER AS origin_lag_minutes FROM ps GROUP BY topic HAVING count(*) >= 2)"""


def divergence(spark, d):
    return topics.divergence_events(topics.platform_sentiment(f.enriched(spark, d), as_of(spark, d), 1440), 0.1)


@query("SELECT topic, platform_a, platform_b, sentiment_a, sentiment_b, divergence_score, origin_platform, origin_lag_minutes, array_to_string(ids, ',') AS ids FROM ev JOIN org USING (topic)", *f.ENRICHED, f.SPREAD, PLATFORM_SENTIMENT, EVENTS)
def divergence_events(spark, d):
    return divergence(spark, d).select("topic", "platform_a", "platform_b", "sentiment_a", "sentiment_b", "divergence_score", "origin_platform", "origin_lag_minutes", F.array_join("sample_signal_ids", ",").alias("ids"))


def dated_events(spark, d):
    """Events detected over the last hours, some resolved before."""
    rows = divergence(spark, d).withColumn("h", (F.length("topic") + F.length("platform_a")) % 5)
    return rows.withColumns({"detected_at": as_of(spark, d) - F.make_dt_interval(hours=F.col("h")), "is_resolved": F.col("platform_b") == "youtube"})


@query("SELECT topic, platform_a, platform_b, platform_b = 'youtube' OR (length(topic) + length(platform_a)) % 5 > 2 AS is_resolved FROM ev", *f.ENRICHED, f.SPREAD, PLATFORM_SENTIMENT, EVENTS)
def resolve_divergence(spark, d):
    return topics.resolve(dated_events(spark, d), as_of(spark, d)).select("topic", "platform_a", "platform_b", "is_resolved")


@query("SELECT topic, platform_a, platform_b, divergence_score FROM ev WHERE platform_a = 'hackernews' AND platform_b = 'reddit' AND (length(topic) + length(platform_a)) % 5 <= 3", *f.ENRICHED, f.SPREAD, PLATFORM_SENTIMENT, EVENTS)
def divergence_filter(spark, d):
    return serving.divergence_filter(dated_events(spark, d), as_of(spark, d), last_hours=3, pair=("reddit", "hackernews")).select("topic", "platform_a", "platform_b", "divergence_score")


@query("SELECT count(*) AS total_events, round(avg(divergence_score), 4) AS avg_divergence, max(divergence_score) AS max_divergence, (SELECT topic FROM ev GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 1) AS hottest_topic FROM ev", *f.ENRICHED, f.SPREAD, PLATFORM_SENTIMENT, EVENTS)
def compare(spark, d):
    return serving.compare_summary(divergence(spark, d))


@query("""SELECT topic, signal_count, platform_count, avg_sentiment, avg_velocity, trend_score, platform_count > 1 AS cross_platform, samples FROM (SELECT topic, count(*) AS signal_count, count(DISTINCT platform) AS platform_count, round(round(avg(sentiment_compound), 10), 4) AS avg_sentiment, round(avg(score_velocity), 4) AS avg_velocity,
  round(count(*) * count(DISTINCT platform) * greatest(avg(score_velocity) + 1, 0.1), 2) AS trend_score, array_to_string(list(id ORDER BY captured_at, seq)[1:2], ',') AS samples FROM ex, now WHERE captured_at >= t - INTERVAL 24 HOUR GROUP BY topic HAVING count(*) >= 2) ORDER BY trend_score DESC, topic LIMIT 20""", *f.ENRICHED, f.SPREAD)
def trending_topics(spark, d):
    return topics.trending_topics(f.enriched(spark, d), as_of(spark, d)).withColumn("samples", F.array_join("samples", ","))


@query("""SELECT topic, sum(n)::BIGINT AS signal_count, round(round(avg(s), 10), 4) AS overall_sentiment, round(round(max(s) - min(s), 10), 4) AS divergence, round(round(max(s) - min(s), 10), 4) >= 0.3 AS alert, CASE WHEN sum(late) > (sum(n) - sum(late)) * 1.5 THEN 'rising' WHEN sum(late) < (sum(n) - sum(late)) * 0.5 THEN 'falling' ELSE 'stable' END AS overall_momentum,
  string_agg(platform || '=' || n || ' ' || CASE WHEN v > 2 THEN 'rising' WHEN v < -1 THEN 'falling' ELSE 'stable' END || ' ' || top, ';' ORDER BY platform) AS detail
  FROM (SELECT topic, platform, round(round(avg(sentiment_compound), 10), 4) AS s, count(*) AS n, count(*) FILTER (WHERE captured_at >= t - INTERVAL 12 HOUR) AS late, avg(score_velocity) AS v, list(id ORDER BY raw_score DESC, seq)[1] AS top FROM ex, now WHERE captured_at >= t - INTERVAL 24 HOUR GROUP BY ALL) GROUP BY topic""", *f.ENRICHED, f.SPREAD)
def pulse(spark, d):
    rows = topics.pulse(f.enriched(spark, d), as_of(spark, d))
    flat = F.array_join(F.transform("detail", lambda p: F.concat(p["platform"], F.lit("="), p["n"].cast("string"), F.lit(" "), p["momentum"], F.lit(" "), p["top_signal"])), ";")
    return rows.select("topic", "signal_count", "overall_sentiment", "divergence", "alert", "overall_momentum", flat.alias("detail"))


# Statistics.

DAYS = "captured_at::DATE BETWEEN (SELECT (t - INTERVAL 7 DAY)::DATE FROM now) AND (SELECT t::DATE FROM now)"


def last_week(spark, d):
    end = observations(spark, d).agg(F.max("captured_at").cast("date").alias("b"), F.date_sub(F.max("captured_at").cast("date"), 7).alias("a")).first()
    return str(end["a"]), str(end["b"])


@query(f"SELECT count(*) AS total_signals, round(avg(raw_score), 2) AS avg_score, round(round(avg(sentiment_compound), 10), 4) AS avg_sentiment FROM obs WHERE {DAYS}")
def stats_overview(spark, d):
    return serving.stats_overview(observations(spark, d), *last_week(spark, d))


@query(f"SELECT author, platform, count(*) AS signals, sum(raw_score)::BIGINT AS total_score FROM obs WHERE {DAYS} GROUP BY ALL ORDER BY total_score DESC, author, platform LIMIT 20")
def top_authors(spark, d):
    return serving.top_authors(serving.between_days(observations(spark, d), *last_week(spark, d)))


@query(f"SELECT platform, count(*) AS signals, round(round(avg(sentiment_compound), 10), 4) AS avg_sentiment FROM obs WHERE {DAYS} GROUP BY ALL")
def by_platform(spark, d):
    return serving.by_platform(serving.between_days(observations(spark, d), *last_week(spark, d)))


@query("(SELECT 'most_scored' AS kind, id, raw_score AS value FROM obs ORDER BY raw_score DESC, seq LIMIT 1) UNION ALL (SELECT 'most_discussed', id, comment_count FROM obs ORDER BY comment_count DESC, seq LIMIT 1)")
def top_signals(spark, d):
    return serving.top_signals(observations(spark, d))


@query(f"SELECT {at('hour')} AS hour, strftime(hour, '%H:%M') AS label, platform, count(DISTINCT id) AS signals, round(avg(raw_score), 2) AS avg_score, round(round(avg(sentiment_compound), 10), 4) AS avg_sentiment FROM (SELECT *, date_trunc('hour', captured_at) AS hour FROM obs, now WHERE captured_at >= t - INTERVAL 168 HOUR) GROUP BY hour, platform")
def timeline(spark, d):
    rows = serving.timeline(observations(spark, d), f.current(spark, d), as_of(spark, d), 168)
    return rows.withColumn("hour", f.text("hour"))


@query("SELECT word, count(*) AS count FROM (SELECT unnest(topics) AS word FROM obs) WHERE length(word) > 2 GROUP BY word ORDER BY count DESC, word LIMIT 50")
def keyword_frequency(spark, d):
    return serving.keyword_counts(observations(spark, d), F.col("topics"))


# Warehouse.


@query("SELECT post_id, title, author, subreddit_id, score, num_comments, upvote_ratio, round(score_velocity, 6) AS score_velocity, round(combined_velocity, 6) AS combined_velocity, trending_score, is_trending, poll_priority, round(age_hours, 4) AS age_hours, round(hours_polled, 4) AS hours_polled FROM sp", *f.CURRENT, f.POSTS, f.STG_POSTS)
def stg_posts(spark, d):
    rounded = {"score_velocity": F.round("score_velocity", 6), "combined_velocity": F.round("combined_velocity", 6), "age_hours": F.round("age_hours", 4), "hours_polled": F.round("hours_polled", 4)}
    return f.stg_posts(spark, d).withColumns(rounded).select("post_id", "title", "author", "subreddit_id", "score", "num_comments", "upvote_ratio", "score_velocity", "combined_velocity", "trending_score", "is_trending", "poll_priority", "age_hours", "hours_polled")


@query(f"SELECT post_id, {at('recorded_at')} AS recorded_at, {at('recorded_hour')} AS recorded_hour, recorded_date::VARCHAR AS recorded_date, score, num_comments, upvote_ratio FROM sh", f.STG_HISTORY)
def stg_metrics_history(spark, d):
    return f.stg_history(spark, d).withColumns({"recorded_at": f.text("recorded_at"), "recorded_hour": f.text("recorded_hour"), "recorded_date": F.col("recorded_date").cast("string")})


@query("SELECT * FROM sn", *f.CURRENT, f.STG_NLP)
def stg_nlp_features(spark, d):
    return f.stg_nlp(spark, d)


@query("SELECT post_id, sentiment_score, sentiment_label, keywords_raw, keyword_count, topic_cluster, engagement_score, round(momentum_score, 6) AS momentum_score, age_bucket FROM dp", *f.STAGED, f.DIM_POSTS)
def dim_posts(spark, d):
    return f.dim_posts(spark, d).select("post_id", "sentiment_score", "sentiment_label", "keywords_raw", "keyword_count", "topic_cluster", "engagement_score", F.round("momentum_score", 6).alias("momentum_score"), "age_bucket")


@query(f"""SELECT subreddit_id, n_name AS subreddit_name, n_regionkey <> 4 AS is_actively_polled, 60 * (1 + n_regionkey)::BIGINT AS poll_interval_seconds, total_posts, trending_posts, rate AS trending_rate_pct, round(avg_score, 4) AS avg_score, peak_score, round(vel, 4) AS avg_score_velocity, {at('last_at')} AS last_activity_at, avg_sentiment_score, dominant_sentiment, positive_posts, negative_posts, neutral_posts,
  CASE WHEN rate >= 20 AND vel >= 10 THEN 'high_signal' WHEN rate >= 10 OR vel >= 5 THEN 'medium_signal' ELSE 'low_signal' END AS signal_tier
  FROM (SELECT subreddit_id, count(*) AS total_posts, count(*) FILTER (WHERE is_trending) AS trending_posts, round(count(*) FILTER (WHERE is_trending) / count(*) * 100, 2) AS rate, avg(score) AS avg_score, max(score) AS peak_score, avg(score_velocity) AS vel, max(last_polled_at) AS last_at FROM sp GROUP BY 1) a
  LEFT JOIN (SELECT subreddit_id, round(avg(sentiment_score), 4) AS avg_sentiment_score, count(*) FILTER (WHERE sentiment_label = 'positive') AS positive_posts, count(*) FILTER (WHERE sentiment_label = 'negative') AS negative_posts, count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral_posts FROM sp JOIN sn USING (post_id) GROUP BY 1) b USING (subreddit_id)
  LEFT JOIN (SELECT subreddit_id, sentiment_label AS dominant_sentiment FROM (SELECT subreddit_id, sentiment_label, row_number() OVER (PARTITION BY subreddit_id ORDER BY count(*) DESC, sentiment_label) AS r FROM sp JOIN sn USING (post_id) GROUP BY subreddit_id, sentiment_label) WHERE r = 1) m USING (subreddit_id)
  LEFT JOIN nation ON n_nationkey = subreddit_id""", *f.STAGED)
def dim_subreddits(spark, d):
    names = communities(spark, d).select(F.col("community_id").alias("id"), F.col("community").alias("name"))
    rows = marts.dim_subreddits(*f.staged(spark, d), names, subreddit_config(spark, d))
    return rows.select("subreddit_id", "subreddit_name", "is_actively_polled", "poll_interval_seconds", "total_posts", "trending_posts", "trending_rate_pct", F.round("avg_score", 4).alias("avg_score"), "peak_score", F.round("avg_score_velocity", 4).alias("avg_score_velocity"), f.text("last_activity_at").alias("last_activity_at"), F.round("avg_sentiment_score", 4).alias("avg_sentiment_score"), "dominant_sentiment", "positive_posts", "negative_posts", "neutral_posts", "signal_tier")


HOURLY = f"""SELECT {at('recorded_hour')} AS recorded_hour, subreddit_id, count(DISTINCT post_id) AS unique_posts_observed, count(*) AS total_snapshots, count(*) FILTER (WHERE is_trending) AS trending_snapshots, round(avg(score), 4) AS avg_score, max(score) AS max_score, round(avg(num_comments), 4) AS avg_comments, round(avg(upvote_ratio), 4) AS avg_upvote_ratio,
  round(avg(score_velocity), 6) AS avg_score_velocity, round(avg(sentiment_score), 4) AS avg_sentiment_score, count(*) FILTER (WHERE sentiment_label = 'positive') AS positive_post_count, count(*) FILTER (WHERE sentiment_label = 'negative') AS negative_post_count, count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral_post_count, round(count(*) FILTER (WHERE is_trending) / count(*) * 100, 2) AS trending_rate_pct,
  hour(recorded_hour)::INTEGER AS hour_of_day, dayofweek(recorded_hour)::INTEGER AS day_of_week FROM (SELECT sh.* EXCLUDE (upvote_ratio), sh.upvote_ratio, subreddit_id, score_velocity, is_trending, sentiment_score, sentiment_label FROM (SELECT post_id, recorded_hour, score, num_comments, upvote_ratio FROM sh) sh JOIN (SELECT post_id, subreddit_id, score_velocity, is_trending FROM sp) USING (post_id) LEFT JOIN sn USING (post_id))"""


def flat_hourly(rows):
    exact = ["subreddit_id", "unique_posts_observed", "total_snapshots", "trending_snapshots", "max_score", "positive_post_count", "negative_post_count", "neutral_post_count", "trending_rate_pct", "hour_of_day", "day_of_week"]
    return rows.select(f.text("recorded_hour").alias("recorded_hour"), *exact, *[F.round(c, 6 if c.endswith("velocity") else 4).alias(c) for c in ("avg_score", "avg_comments", "avg_upvote_ratio", "avg_score_velocity", "avg_sentiment_score")])


@query(HOURLY + " GROUP BY recorded_hour, subreddit_id", *f.STAGED)
def fct_hourly_engagement(spark, d):
    return flat_hourly(marts.fct_hourly_engagement(f.stg_history(spark, d), *f.staged(spark, d)))


@query(HOURLY + " GROUP BY recorded_hour, subreddit_id", *f.STAGED)
def fct_hourly_incremental(spark, d):
    """The table as of a day ago, then its recent hours computed again and merged."""
    start = F.date_trunc("hour", as_of(spark, d) - serving.hours(24))
    history, (posts, nlp) = f.stg_history(spark, d), f.staged(spark, d)
    old = marts.fct_hourly_engagement(history.where(F.col("recorded_at") < start + serving.hours(2)), posts, nlp)
    return flat_hourly(state.merge_rows(old, marts.fct_hourly_engagement(history, posts, nlp, start), ["recorded_hour", "subreddit_id"]))


LIFE = "SELECT post_id, current_score, total_snapshots, peak_score_ever, peak_comments_ever, round(avg_score_lifetime, 4) AS avg_score_lifetime, round(avg_upvote_ratio, 8) AS avg_upvote_ratio, score_growth, sentiment_bucket, initial_sentiment_label, age_bucket FROM lc"


def flat_life(rows):
    return rows.select("post_id", "current_score", "total_snapshots", "peak_score_ever", "peak_comments_ever", F.round("avg_score_lifetime", 4).alias("avg_score_lifetime"), F.round("avg_upvote_ratio", 8).alias("avg_upvote_ratio"), "score_growth", "sentiment_bucket", "initial_sentiment_label", "age_bucket")


@query(LIFE, *f.STAGED, f.DIM_POSTS, f.LIFECYCLE)
def fct_post_lifecycle(spark, d):
    return flat_life(f.lifecycle(spark, d))


@query(LIFE, *f.STAGED, f.DIM_POSTS, f.LIFECYCLE)
def fct_post_lifecycle_incremental(spark, d):
    history, cut = f.stg_history(spark, d), as_of(spark, d) - serving.hours(48)
    old, new = (marts.post_partials(history.where(c)) for c in (F.col("recorded_at") < cut, F.col("recorded_at") >= cut))
    return flat_life(marts.fct_post_lifecycle(f.dim_posts(spark, d), marts.merge_partials(old, new)))


WIDE = {"1h": (24.0, 18.0, 36.0), "3h": (72.0, 60.0, 84.0), "6h": (144.0, 132.0, 156.0)}
NEAR = ",\n".join(f"n{n} AS (SELECT post_id, arg_min(score, (abs(a - {c}), recorded_at)) AS score_at_{n}, arg_min(num_comments, (abs(a - {c}), recorded_at)) AS comments_at_{n} FROM (SELECT sh.*, (epoch_us(recorded_at) - epoch_us(first_seen_at)) / 1e6 / 3600.0 AS a FROM sh JOIN lc USING (post_id)) WHERE a BETWEEN {low} AND {high} GROUP BY 1)" for n, (c, low, high) in WIDE.items())


@query("""SELECT post_id, score_at_1h, score_at_3h, score_at_6h, comments_at_1h, comments_at_3h, comments_at_6h, score_at_3h - score_at_1h AS score_growth_1h_to_3h, score_at_6h - score_at_3h AS score_growth_3h_to_6h, score_at_1h IS NOT NULL AS has_1h_snapshot, score_at_3h IS NOT NULL AS has_3h_snapshot, score_at_6h IS NOT NULL AS has_6h_snapshot, current_score, round(score_velocity, 6) AS current_velocity, sentiment_bucket
  FROM lc LEFT JOIN n1h USING (post_id) LEFT JOIN n3h USING (post_id) LEFT JOIN n6h USING (post_id) WHERE age_hours >= 1""", *f.STAGED, f.DIM_POSTS, f.LIFECYCLE, NEAR)
def fct_sentiment_vs_velocity(spark, d):
    rows = marts.fct_sentiment_vs_velocity(f.lifecycle(spark, d), f.stg_history(spark, d), WIDE)
    return rows.withColumn("current_velocity", F.round("current_velocity", 6)).drop("subreddit_id", "first_seen_at", "age_hours", "is_trending", "initial_sentiment_score", "initial_sentiment_label")


ROLLUP = f"SELECT {at('hour')} AS hour, id, round(avg(raw_score), 4) AS avg_score, max(raw_score) AS max_score, round(avg(comment_count), 4) AS avg_comment_count"


@query(ROLLUP + ", count(*) AS snapshots FROM (SELECT *, date_trunc('hour', captured_at) AS hour FROM obs) GROUP BY hour, id")
def hourly_posts(spark, d):
    rows = marts.hourly_rollup(observations(spark, d), "id", ("comment_count",))
    return rows.withColumns({"hour": f.text("hour"), "avg_score": F.round("avg_score", 4), "avg_comment_count": F.round("avg_comment_count", 4)})


@query(ROLLUP + ", round(avg(score_velocity), 6) AS avg_score_velocity, round(round(avg(sentiment_compound), 10), 4) AS avg_sentiment_compound, count(*) AS snapshots FROM (SELECT *, date_trunc('hour', captured_at) AS hour FROM vel) GROUP BY hour, id", f.VEL)
def hourly_signals(spark, d):
    rows = marts.hourly_rollup(windows.with_velocity(observations(spark, d)), "id", ("comment_count", "score_velocity", "sentiment_compound"))
    return rows.withColumns({"hour": f.text("hour"), **{c: F.round(c, 6 if c.endswith("velocity") else 4) for c in rows.columns if c.startswith("avg_")}})


@query("SELECT subreddit_id, count(*) AS post_count, round(avg(score), 4) AS avg_score, round(avg(num_comments), 4) AS avg_comments FROM sp GROUP BY 1", *f.STAGED)
def activity_snapshot(spark, d):
    rows = marts.activity_snapshot(f.stg_posts(spark, d), as_of(spark, d))
    return rows.select("subreddit_id", "post_count", F.round("avg_score", 4).alias("avg_score"), F.round("avg_comments", 4).alias("avg_comments"))


# Dashboard.

LABELS = "count(*) FILTER (WHERE sentiment_compound >= 0.05) AS positive, count(*) FILTER (WHERE sentiment_compound <= -0.05) AS negative, count(*) FILTER (WHERE sentiment_compound > -0.05 AND sentiment_compound < 0.05) AS neutral"


def named_current(spark, d):
    return serving.with_communities(f.current(spark, d), communities(spark, d))


@query(f"SELECT n_name AS community, count(*) AS posts, sum(raw_score)::BIGINT AS score, sum(comment_count)::BIGINT AS comments, {LABELS} FROM cur LEFT JOIN nation ON community_id = n_nationkey GROUP BY 1 ORDER BY score DESC, community LIMIT 12", *f.CURRENT)
def dash_subreddits(spark, d):
    return serving.dash_subreddits(named_current(spark, d))


@query(f"SELECT {LABELS}, round(round(avg(sentiment_compound), 10), 4) AS mean_sentiment FROM cur", *f.CURRENT)
def dash_sentiment(spark, d):
    return serving.dash_sentiment(f.current(spark, d))


@query("SELECT count(*) AS posts, count(*) FILTER (WHERE is_trending) AS trending, max(raw_score) AS top_score, round(max(score_velocity), 6) AS fastest_velocity, count(DISTINCT author) AS authors, round(count(*) FILTER (WHERE sentiment_compound >= 0.05) / count(*) * 100, 2) AS positive_pct FROM enr", *f.ENRICHED)
def dash_kpis(spark, d):
    return serving.dash_kpis(f.enriched(spark, d))


@query(f"SELECT {at('hour')} AS hour, posts, score FROM (SELECT date_trunc('hour', first_seen_at) AS hour, count(*) AS posts, sum(raw_score)::BIGINT AS score FROM cur GROUP BY 1)", *f.CURRENT)
def dash_timeline(spark, d):
    return serving.dash_timeline(f.current(spark, d), F.col("first_seen_at")).withColumn("hour", f.text("hour"))


DASH_STOPS = "[" + ", ".join(f"'{w}'" for w in serving.TITLE_STOP) + "]"


@query(rf"SELECT word, count(*) AS count FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\W+'), lambda x: length(x) > 4 AND NOT list_contains({DASH_STOPS}, x) AND NOT regexp_full_match(x, '[0-9]+'))[1:8]) AS word FROM documents) GROUP BY word ORDER BY count DESC, word LIMIT 25")
def dash_keywords(spark, d):
    return serving.dash_keywords(table(spark, d, "documents"), F.array().cast("array<string>"), F.col("text"))


@query("""(SELECT 'score' AS list, id, raw_score::DOUBLE AS value FROM m ORDER BY raw_score DESC NULLS LAST, id LIMIT 20) UNION ALL (SELECT 'velocity', id, round(score_velocity, 6) FROM m ORDER BY score_velocity DESC NULLS LAST, id LIMIT 10) UNION ALL (SELECT 'fastest', id, round(score_velocity, 6) FROM m ORDER BY score_velocity DESC NULLS LAST, id LIMIT 1) UNION ALL (SELECT 'momentum', id, round(momentum, 6) FROM m ORDER BY momentum DESC NULLS LAST, id LIMIT 5)""", *f.CURRENT, "m AS (SELECT *, (raw_score + 2 * comment_count) / ((epoch_us(t) - epoch_us(first_seen_at)) / 6e7 + 1) AS momentum FROM cur, now)")
def dash_top(spark, d):
    return serving.dash_top(serving.with_feed_columns(f.current(spark, d), as_of(spark, d), "first_seen_at"))


@query(r"""SELECT word, sum(n)::BIGINT AS count FROM (SELECT unnest(topics) AS word, 1 AS n FROM obs WHERE seq % 3 = 0 UNION ALL SELECT topics[1], CASE WHEN comment_count = 0 THEN 1 ELSE comment_count END FROM obs WHERE seq % 3 = 1
  UNION ALL SELECT w, 1 FROM (SELECT unnest(list_filter(regexp_split_to_array(author || ' ' || platform, '\W+'), lambda x: length(x) > 4 AND NOT regexp_full_match(x, '[0-9]+'))[1:8]) AS w FROM obs WHERE seq % 3 = 2)) GROUP BY word ORDER BY count DESC, word LIMIT 25""")
def dash_keywords_stored(spark, d):
    """Arrays on a third of the rows, weighted keywords on another, none on the rest."""
    o, turn = observations(spark, d), F.col("seq") % 3
    weights = F.when(turn == 1, F.map_from_arrays(F.array(F.get("topics", 0)), F.array("comment_count")))
    return serving.dash_keywords(o, F.when(turn == 0, F.col("topics")), F.concat_ws(" ", "author", "platform"), weights=weights)


@query(f"SELECT id, {at('last_updated_at')} AS last_updated_at FROM cur, now WHERE last_updated_at >= t - INTERVAL 5 DAY AND len(topics) > 0 ORDER BY cur.last_updated_at, id LIMIT 5000", *f.CURRENT)
def enriched_since(spark, d):
    rows = ops.enriched_since(f.current(spark, d), as_of(spark, d) - serving.hours(120))
    return rows.select("id", f.text("last_updated_at").alias("last_updated_at"))


# Operations.


@query("""SELECT event_type AS topic, count(*) AS count, sum(v)::BIGINT AS sum, list_sort(list(v))[least((count(*) * 50) // 100, count(*) - 1) + 1] AS p50, list_sort(list(v))[least((count(*) * 95) // 100, count(*) - 1) + 1] AS p95, list_sort(list(v))[least((count(*) * 99) // 100, count(*) - 1) + 1] AS p99 FROM (SELECT event_type, floor(value)::BIGINT AS v FROM events) GROUP BY 1""")
def latency_summary(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("topic"), F.floor("value").cast("long").alias("v"))
    return ops.latency_summary(rows, "v", "topic")


@query(f"SELECT {at('minute')} AS minute, platform, count(*) AS messages, round(count(*) / 60, 6) AS per_second FROM (SELECT date_trunc('minute', captured_at) AS minute, platform FROM obs) GROUP BY ALL")
def message_rate(spark, d):
    return ops.message_rate(observations(spark, d), "platform").withColumn("minute", f.text("minute"))


def spoiled_lines(spark, d):
    """Reddit's lines, some cut short and some without an id."""
    lines = raw_lines(spark, d, "reddit").withColumn("n", F.regexp_extract("value", '"id":"(\\d+)"', 1).cast("long"))
    bad = F.when(F.col("n") % 11 == 0, F.expr("left(value, 12)")).when(F.col("n") % 13 == 0, F.regexp_replace("value", '"id":"\\d+",', "")).otherwise(F.col("value"))
    return lines.select(bad.alias("value"))


@query("SELECT CASE WHEN seq % 11 = 0 THEN 'malformed' WHEN seq % 13 = 0 THEN 'no id' ELSE 'valid' END AS kind, count(*) AS rows FROM obs WHERE platform = 'reddit' GROUP BY 1")
def deadletter_split(spark, d):
    good, dead = raw.split_valid(spoiled_lines(spark, d), "reddit", "reddit.posts.raw", as_of(spark, d))
    return dead.select(F.col("error").alias("kind")).unionByName(good.select(F.lit("valid").alias("kind"))).groupBy("kind").agg(F.count("*").alias("rows"))


def envelopes(spark, d):
    """Every Reddit line in an envelope; some replayed before, some empty."""
    lines = raw_lines(spark, d, "reddit").withColumn("n", F.regexp_extract("value", '"id":"(\\d+)"', 1).cast("long"))
    return lines.select(F.lit("reddit.posts.raw").alias("source_topic"), F.lit("timeout").alias("error"), F.when(F.col("n") % 5 == 0, as_of(spark, d)).alias("replayed_at"), F.when(F.col("n") % 7 == 0, "").otherwise(F.col("value")).alias("payload"))


@query("SELECT seq::VARCHAR AS id, raw_score AS score FROM obs WHERE platform = 'reddit' AND seq % 5 <> 0 AND seq % 7 <> 0")
def deadletter_replay(spark, d):
    return ops.replay(envelopes(spark, d), {"reddit.posts.raw": REDDIT})["reddit.posts.raw"].select("id", "score")


@query("SELECT 'reddit.posts.raw' AS source_topic, CASE WHEN seq % 11 = 0 THEN 'malformed' ELSE 'no id' END AS error, count(*) AS events FROM obs WHERE platform = 'reddit' AND (seq % 11 = 0 OR seq % 13 = 0) GROUP BY 2")
def dlq_counts(spark, d):
    return ops.dead_letter_counts(raw.split_valid(spoiled_lines(spark, d), "reddit", "reddit.posts.raw", as_of(spark, d))[1])


@query("SELECT captured_at::DATE::VARCHAR AS day, count(*) AS rows FROM obs, now WHERE captured_at < date_trunc('day', t - INTERVAL 10 DAY) AND day(captured_at) % 2 = 1 GROUP BY 1 ORDER BY 1")
def archive_days(spark, d):
    o = observations(spark, d)
    done = o.select(F.to_date("captured_at").alias("day")).where(F.dayofmonth("day") % 2 == 0).distinct()
    return ops.archive_days(o, as_of(spark, d), done, retention=15, lookahead=5).withColumn("day", F.col("day").cast("string"))


@query(f"SELECT post_id, {at('captured_at')} AS time, h.score::INTEGER AS score, h.num_comments::INTEGER AS num_comments, is_trending, sentiment_label, strftime(captured_at, '%Y') AS year, strftime(captured_at, '%m') AS month, strftime(captured_at, '%d') AS day FROM (SELECT id AS post_id, captured_at, raw_score AS score, comment_count AS num_comments FROM obs) h JOIN (SELECT post_id, is_trending FROM sp) USING (post_id) LEFT JOIN sn USING (post_id)", *f.STAGED)
def archive_rows(spark, d):
    rows = ops.archive_rows(f.post_history(spark, d), *f.staged(spark, d))
    return rows.select("post_id", f.text("time").alias("time"), "score", "num_comments", "is_trending", "sentiment_label", "year", "month", "day")


@query("""SELECT 'trending_bounds' AS rule, count(*) FILTER (WHERE trending_score < 0 OR trending_score > 1) AS violations FROM enr UNION ALL SELECT 'velocity_floor', count(*) FILTER (WHERE score_velocity < -0.001) FROM enr UNION ALL SELECT 'platform_known', count(*) FILTER (WHERE platform = 'other') FROM enr UNION ALL SELECT 'score_not_null', count(*) FILTER (WHERE raw_score IS NULL) FROM enr UNION ALL SELECT 'id_repeats', count(*) FROM (SELECT id FROM enr GROUP BY id HAVING count(*) > 1)""", *f.ENRICHED)
def quality_report(spark, d):
    rows = f.enriched(spark, d)
    return ops.quality_report(rows, {
        "trending_bounds": ~F.col("trending_score").between(0, 1), "velocity_floor": F.col("score_velocity") < -0.001,
        "platform_known": ~F.col("platform").isin("reddit", "hackernews", "youtube", "bluesky"), "score_not_null": F.col("raw_score").isNull(),
    }, {"id_repeats": "id"})


# Streams: the same results through Structured Streaming.


def event_stream(spark, d):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    place = f"{d}/events.parque[t]"  # as a pattern: a file source takes a plain path for a folder
    return as_observations(jobs.read_files(spark, place, table(spark, d, "events").schema))


@query(f"SELECT topic, platform, {at('bucket')} AS bucket, signal_count, round(avg_sentiment, 4) AS avg_sentiment, total_score FROM bk", *f.BUCKETED)
def stream_topic_buckets(spark, d):
    rows = jobs.drain(jobs.topic_windows(event_stream(spark, d), "60 days"), ["topic", "platform", "bucket"])
    return rows.select("topic", "platform", f.text("bucket").alias("bucket"), "signal_count", F.round(F.col("sentiment_sum") / F.nullif(F.col("sentiment_n"), F.lit(0)), 4).alias("avg_sentiment"), "total_score")


@query("SELECT seq, id, round(score_velocity, 6) AS score_velocity, round(comment_velocity, 6) AS comment_velocity FROM vel", f.VEL)
def stream_velocity(spark, d):
    rows = jobs.drain(jobs.velocities(event_stream(spark, d), "60 days"), ["seq"], "append")
    return rows.withColumns({c: F.round(c, 6) for c in ("score_velocity", "comment_velocity")})


@query(f"SELECT topic, {at('start')} AS start, count(*) AS signals, count(DISTINCT platform) AS platforms FROM (SELECT topic, platform, time_bucket(INTERVAL 15 MINUTE, captured_at) - k * INTERVAL 15 MINUTE AS start FROM ex, range(8) r(k)) GROUP BY ALL", *f.ENRICHED, f.SPREAD)
def stream_sliding_topics(spark, d):
    rows = jobs.drain(jobs.sliding_topics(event_stream(spark, d), "60 days").select("topic", "w.start", "signals", "platforms"), ["topic", "start"])
    return rows.select("topic", f.text("start").alias("start"), "signals", "platforms")


def in_files(spark, rows, arrival, parts=3):
    """A stream of ``rows`` in files that come one after the other, by ``arrival``: ``parts`` batches."""
    place = f"{jobs.scratch(spark)}/in"
    first, last = rows.agg(F.min(arrival), F.max(arrival)).first()
    part = F.least(F.floor((F.unix_micros(arrival) - F.unix_micros(F.lit(first))) * parts / (F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)) + 1)), F.lit(parts - 1))
    for k in range(parts):
        rows.where(part == k).coalesce(1).write.mode("append").parquet(place)
    return jobs.read_files(spark, place, rows.schema, files_a_batch=1)


@query(BUCKET, WALK)
def stream_token_bucket(spark, d):
    o = observations(spark, d).select("seq", "platform", "captured_at")
    return jobs.drain(jobs.throttled(in_files(spark, o, "captured_at"), RATES), ["seq"], "append").select("seq", "platform")


@query("SELECT seq, platform, normalised_score FROM norm", f.VEL, f.NORM)
def stream_normalised(spark, d):
    o = observations(spark, d).select("seq", "platform", "captured_at", "raw_score")
    return jobs.drain(jobs.normalised(in_files(spark, o, "captured_at")), ["seq"], "append")


@query(f"SELECT topic, platform, {at('bucket')} AS bucket, signal_count, round(avg_sentiment, 4) AS avg_sentiment, total_score FROM bk", *f.BUCKETED)
def stream_late_backfill(spark, d):
    """A tenth of the rows come three days late, past a watermark of an hour: buckets close without them, and are filled later."""
    o = observations(spark, d).withColumn("trending_score", F.lit(0.0))
    arrival = F.when(F.col("seq") % 10 == 0, F.col("captured_at") + F.expr("INTERVAL 3 DAYS")).otherwise(F.col("captured_at"))
    place = jobs.scratch(spark)
    jobs.carry(jobs.buckets_with_late(in_files(spark, o.withColumn("arrived_at", arrival), "arrived_at", 4), 3600), place)
    closed = jobs.visible(spark, place, "closed").drop("batch")
    whole = closed.unionByName(jobs.last_state(spark, place, "open"))  # at the end of the stream all buckets close
    state.merge_partitions(whole.withColumn("bucket_date", F.to_date("bucket")), f"{place}/buckets", "bucket_date")
    jobs.backfilled(spark, f"{place}/buckets", jobs.visible(spark, place, "late"))
    rows = spark.read.parquet(f"{place}/buckets")
    return rows.select("topic", "platform", f.text("bucket").alias("bucket"), "signal_count", F.round("avg_sentiment", 4).alias("avg_sentiment"), "total_score")


@query("""SELECT sink, topic, count(*) AS messages, min(seq)::BIGINT AS first, max(seq)::BIGINT AS last FROM (SELECT 'raw' AS sink, platform || '.raw' AS topic, seq FROM obs WHERE platform <> 'other' UNION ALL SELECT 'unified', 'signals.normalised', seq FROM obs WHERE platform <> 'other'
  UNION ALL SELECT 'push', 'live', seq FROM obs WHERE platform <> 'other' AND raw_score >= 400) GROUP BY ALL""")
def stream_published(spark, d):
    """Every message to its platform's raw channel and to the unified one, high scores to the live one."""
    lines = reduce(DataFrame.unionByName, [raw_lines(spark, d, p, "captured_at").withColumn("platform", F.lit(p)) for p in raw.NORMALISERS])
    place = jobs.scratch(spark)

    def unify(batch):
        told = {p: raw.parse(batch.where(F.col("platform") == p), p).select("raw.*") for p in raw.NORMALISERS}
        return raw.normalise(told).withColumn("is_trending", F.col("raw_score") >= 400)

    jobs.carry(jobs.published(in_files(spark, lines, "captured_at").select("platform", "value"), unify), place)
    number = lambda c: F.element_at(F.split(c, "[:/]"), -1).cast("long")
    told = F.coalesce(F.get_json_object("value", "$.id"), F.get_json_object("value", "$.objectID"), F.get_json_object("value", "$.uri"))
    sinks = [jobs.visible(spark, place, "raw").select(F.lit("raw").alias("sink"), "topic", number(told).alias("seq")), jobs.visible(spark, place, "unified").select(F.lit("unified").alias("sink"), "topic", number(F.col("id")).alias("seq")), jobs.visible(spark, place, "push").select(F.lit("push").alias("sink"), F.lit("live").alias("topic"), number(F.get_json_object("value", "$.id")).alias("seq"))]
    return reduce(DataFrame.unionByName, sinks).groupBy("sink", "topic").agg(F.count("*").alias("messages"), F.min("seq").alias("first"), F.max("seq").alias("last"))


@query("SELECT platform, count(*) AS messages, sum(raw_score)::BIGINT AS score FROM obs WHERE platform IN ('reddit', 'hackernews', 'youtube') GROUP BY platform")
def stream_records(spark, d):
    """Messages of three topics from the wire, each parsed by its topic's schema."""
    wire = reduce(DataFrame.unionByName, [raw_lines(spark, d, p, "captured_at").withColumn("topic", F.lit(f"{p}.raw")) for p in raw.NORMALISERS])
    told = jobs.records_of(in_files(spark, wire, "captured_at"), {f"{p}.raw": RAW[p] for p in ("reddit", "hackernews", "youtube")})
    score = F.coalesce("reddit_raw.score", "hackernews_raw.points", "youtube_raw.snippet.topLevelComment.snippet.likeCount")
    rows = jobs.drain(told.select(F.element_at(F.split("topic", "[.]"), 1).alias("platform"), score.alias("score")), [], "append")
    return rows.groupBy("platform").agg(F.count("*").alias("messages"), F.sum("score").alias("score"))


@query("SELECT list, count(*) AS messages, min(seq)::BIGINT AS first, max(seq)::BIGINT AS last FROM (SELECT CASE platform WHEN 'reddit' THEN 'raw' WHEN 'youtube' THEN 'refresh' ELSE 'signals' END AS list, seq FROM obs WHERE platform <> 'other') GROUP BY list")
def stream_routed(spark, d):
    """Messages of three topics, dealt into their work lists; other topics are left."""
    topic = F.element_at(F.create_map(*[F.lit(x) for pair in (("reddit", "posts.raw"), ("youtube", "posts.refresh"), ("hackernews", "signals"), ("bluesky", "signals"), ("other", "elsewhere")) for x in pair]), F.col("platform"))
    lists = jobs.drain(jobs.routed(event_stream(spark, d).withColumn("topic", topic), {"posts.raw": "raw", "posts.refresh": "refresh", "signals": "signals"}), ["seq"], "append")
    return lists.groupBy("list").agg(F.count("*").alias("messages"), F.min("seq").alias("first"), F.max("seq").alias("last"))


@query("SELECT DISTINCT id FROM obs")
def stream_dedup(spark, d):
    return jobs.drain(jobs.without_repeats(event_stream(spark, d), ["id"], "60 days"), ["id"], "append").select("id")


@query(f"SELECT {at('hour')} AS hour, id, round(avg(raw_score), 4) AS avg_score, max(raw_score) AS max_score, count(*) AS snapshots FROM (SELECT *, date_trunc('hour', captured_at) AS hour FROM obs) GROUP BY hour, id")
def stream_hourly(spark, d):
    rows = jobs.drain(jobs.hourly(event_stream(spark, d), "id", "60 days"), ["id", "hour"])
    return rows.select(f.text("hour").alias("hour"), "id", F.round("avg_score", 4).alias("avg_score"), "max_score", "snapshots")
