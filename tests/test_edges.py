"""Golden rows and edges: worked examples, bounds that are strict or not, order of repeats, independence of batches."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from weirflow.functions import scoring, text
from weirflow.operators import marts, ops, serving, state, topics, windows
from weirflow.plans import catalogue
from weirflow.sources import raw
from weirflow.streaming import jobs

T0 = datetime(2024, 1, 1)
SCHEMA = "seq long, id string, platform string, captured_at timestamp, raw_score long, comment_count long, sentiment_compound double, topics array<string>"


def log(spark, *rows):
    """(seconds, id, platform, score, comments, sentiment, topics)"""
    return spark.createDataFrame([(i, r[1], r[2], T0 + timedelta(seconds=r[0]), *r[3:]) for i, r in enumerate(rows)], SCHEMA)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("gap", "want"), [(300, 3.85), (0, 1155.0), (25 * 3600, 1155 / 90000), (25 * 3600 + 1, 0.0)])
def test_velocity(spark, gap, want):
    rows = windows.with_velocity(log(spark, (0, "a", "reddit", 45, 0, 0.0, []), (gap, "a", "reddit", 1200, 0, 0.0, []))).orderBy("seq").collect()
    assert rows[0].score_velocity == 0 and abs(rows[1].score_velocity - want) < 1e-9


def test_normalised_score(spark):
    score = lambda s, b: value(spark, scoring.normalised_score(F.lit(s), F.lit(b)))
    assert [score(50, 50.0), score(100, 50.0), score(0, 50.0), score(-3, 50.0), score(1, 0.1)] == [0.5, 1.0, 0.0, 0.0, 0.5]


def test_baseline_needs_ten_samples_and_blocks_change_nothing(spark):
    rows = log(spark, *[(i, f"i{i}", "bluesky", (i * 7) % 23 - 2, 0, 0.0, []) for i in range(400)])
    a = {r.seq: r.normalised_score for r in windows.with_normalised(rows).collect()}
    t = windows.DEFAULTS
    small = type(t)(window_rows=30)
    b = {r.seq: r.normalised_score for r in windows.with_normalised(rows, small).collect()}
    c = {r.seq: r.normalised_score for r in windows.with_normalised_blocked(rows, small, block=64, slice_seconds=17).collect()}
    assert b == c and a.keys() == b.keys()
    positive = [(i * 7) % 23 - 2 for i in range(400) if (i * 7) % 23 - 2 > 0]
    first = [i for i in range(400) if (i * 7) % 23 - 2 > 0]
    assert a[first[9]] == round(min(positive[9] / 20, 1), 4)  # nine samples: the fallback of 10
    assert a[first[10]] == round(min(positive[10] / (2 * sum(positive[:10]) / 10), 1), 4)


@pytest.mark.parametrize(
    ("platform", "velocity", "sentiment", "comments", "norm", "want"),
    [("reddit", 3.85, 0.34, 11, 0.7, 0.6), ("reddit", 50.0, 0.3, 10, 0.6, 0.2), ("reddit", 50.1, -0.31, 11, 0.61, 1.0), (None, 5.0, None, 0, None, 0.0), ("hackernews", 0.0, 0.0, 21, 0.61, 0.8), ("youtube", 0.0, 0.4, 6, 0.31, 0.7), ("bluesky", 0.0, 0.61, 0, 0.0, 0.7), ("bluesky", 0.0, -0.61, 0, 0.0, 0.6)],
)
def test_trending_score(spark, platform, velocity, sentiment, comments, norm, want):
    d = lambda x: F.lit(x).cast("double")
    assert value(spark, scoring.trending_score(F.lit(platform).cast("string"), d(velocity), d(sentiment), F.lit(comments), d(norm))) == want


def test_fold_first_last_and_batches(spark):
    rows = log(spark, (0, "a", "reddit", 1, 1, 0.5, ["x"]), (10, "a", "reddit", 9, 2, None, []), (10, "a", "reddit", 3, 3, None, ["y"])).withColumns({"normalised_score": F.col("seq") / 10.0, "score_velocity": F.when(F.col("seq") == 1, 0.8)})
    fold = lambda df: state.fold(df, ("normalised_score",), ("raw_score", "topics"), ("sentiment_compound", "score_velocity")).first()
    whole = fold(rows)
    assert (whole.normalised_score, whole.raw_score, whole.topics, whole.sentiment_compound, whole.score_velocity) == (0.0, 3, ["y"], 0.5, 0.8)
    assert fold(rows.repartition(3)) == whole and fold(rows.orderBy(F.desc("seq"))) == whole


def test_buckets_leave_out_zero_sentiment_and_merge(spark):
    rows = log(spark, (0, "a", "reddit", 1, 0, 0.0, [" AI ", "x"]), (60, "b", "reddit", 2, 0, 0.5, ["ai"]), (899, "c", "reddit", 3, 0, 0.1, ["ai"]), (900, "d", "reddit", 4, 0, None, ["ai"])).withColumn("trending_score", F.lit(-1.0))
    got = {r.bucket: r for r in topics.topic_buckets(rows).collect()}
    assert set(r.topic for r in got.values()) == {"ai"} and [got[T0].signal_count, round(got[T0].avg_sentiment, 9), got[T0].max_trending] == [3, 0.3, 0.0]
    assert got[T0 + timedelta(minutes=15)].avg_sentiment is None
    parts = [topics.topic_buckets(rows.where(c)) for c in ("seq % 2 = 0", "seq % 2 = 1")]
    merged = {r.bucket: (r.signal_count, r.total_score, r.sentiment_n) for r in topics.merge_buckets(*parts).collect()}
    assert merged == {k: (r.signal_count, r.total_score, r.sentiment_n) for k, r in got.items()}
    assert [value(spark, topics.mean_of_two(F.lit(a).cast("double"), F.lit(b).cast("double"))) for a, b in ((0.2, 0.4), (None, 0.4), (0.2, None))] == [pytest.approx(0.3), 0.4, 0.2]


def test_divergence_at_the_bound(spark):
    rows = [(s, f"{p}{i}", p, i, 0, v, ["ai"]) for p, v, s in (("reddit", 0.3, 0), ("hackernews", 0.0, 120), ("youtube", 0.01, 300)) for i in range(4)]
    now = F.lit(T0 + timedelta(minutes=30))
    events = topics.divergence_events(topics.platform_sentiment(log(spark, *rows), now)).collect()
    assert [(e.platform_a, e.platform_b, e.divergence_score, e.origin_platform, e.origin_lag_minutes) for e in events] == [("hackernews", "reddit", 0.3, "reddit", 2)]
    assert events[0].sample_signal_ids == ["hackernews3", "hackernews2", "hackernews1", "reddit3", "reddit2", "reddit1"]


def test_nearest_snapshot_bands_hold_their_ends(spark):
    posts = spark.createDataFrame([(f"p{i}", T0) for i in range(5)], "post_id string, first_seen_at timestamp")
    minutes = [("p0", 45, 1), ("p1", 90, 2), ("p2", 44, 3), ("p3", 91, 4), ("p4", 50, 5), ("p4", 70, 6)]
    history = spark.createDataFrame([(p, T0 + timedelta(minutes=m), s, 0) for p, m, s in minutes], "post_id string, recorded_at timestamp, score long, num_comments long")
    got = {r.post_id: r.score_at_1h for r in marts.nearest_snapshots(history, posts).collect()}
    assert {k: v for k, v in got.items() if v is not None} == {"p0": 1, "p1": 2, "p4": 5}


def test_keywords_and_topics(spark):
    row = spark.createDataFrame([("Kafka kafka released 3.7 with DBT and the new Mistral AI, zig", ["New", " dbt ", "x", "2024", "dbt", "us"])], "t string, topics array<string>")
    got = row.select(text.keywords(F.col("t")).alias("k"), text.legacy_keywords(F.col("t")).alias("l"), text.seed_topics(F.col("t")).alias("s"), text.clean_topics(F.col("topics")).alias("c")).first()
    assert got.k == ["kafka", "released", "mistral"] and got.l == ["kafka", "kafka", "released", "with", "mistral"]
    assert got.s == ["kafka", "dbt", "mistral ai", "zig"] and got.c == ["dbt"]
    assert [value(spark, F.size(text.parsed_topics(F.lit(s)))) for s in ('["a","b"]', "no json", None)] == [2, 0, 0]


def test_sentiment_boosts_and_negates(spark):
    rows = spark.createDataFrame([("good",), ("very good",), ("not good",), ("",), (None,)], "t string").select(text.sentiment(F.col("t")).alias("s")).collect()
    good, very, no, empty, null = (r.s for r in rows)
    assert very > good > 0 > no and empty == null == 0
    assert value(spark, text.sentiment(F.lit("x"), scorer=lambda t: 0.25)) == 0.25


def test_normalisers(spark):
    lines = spark.createDataFrame([('{"uri":"at://d/post/9","author":"h","record":{"text":"t","createdAt":"2024-01-01T00:00:00Z"}}',), ('{"cid":"c","record":{"createdAt":"bad"}}',)], "value string")
    a, b = raw.normalise_bluesky(raw.parse(lines, "bluesky").select("raw.*")).collect()
    assert (a.id, a.published_at, a.url, a.title) == ("bluesky:9", 1704067200.0, "https://bsky.app/profile/h/post/9", "") and (b.id, b.published_at, b.author) == ("bluesky:c", 0.0, "deleted")


def test_polling_rules(spark):
    now = F.lit(T0)
    age = spark.createDataFrame([(T0 - timedelta(minutes=m),) for m in (4, 5, 59, 60, 1439, 1440)], "created_utc timestamp")
    assert [r.poll_priority for r in ops.with_priority(age, now).collect()] == ["aggressive", "normal", "normal", "slow", "slow", "inactive"]
    posts = spark.createDataFrame([("a", "aggressive", T0 - timedelta(seconds=300)), ("b", "aggressive", T0 - timedelta(seconds=299)), ("c", "slow", None), ("d", "inactive", None)], "id string, poll_priority string, last_polled_at timestamp")
    assert {r.id for r in ops.refresh_due(posts, now).collect()} == {"a", "c"}
    config = spark.createDataFrame([("x", 60, False)], "name string, interval_seconds long, is_active boolean")
    assert ops.active_config(config, [("spark", 300)]).first().name == "spark"


def test_token_bucket_caps_and_lets_free_platforms_through(spark):
    rows = log(spark, *[(i, f"a{i}", p, 1, 0, 0.0, []) for p in ("reddit", "youtube") for i in range(30)])
    kept = windows.token_bucket(rows, {"reddit": 0.5, "youtube": -1.0}, burst_seconds=4).groupBy("platform").count().collect()
    assert {r.platform: r["count"] for r in kept} == {"reddit": 16, "youtube": 30}


def test_archive_writes_padded_days_and_replaces_them(spark, tmp_path):
    rows = spark.createDataFrame([(T0, "p", "2024", "01", "01"), (T0 + timedelta(days=8), "p", "2024", "01", "09")], "time timestamp, post_id string, year string, month string, day string")
    for _ in range(2):
        ops.write_archive(rows, str(tmp_path / "a"))
    assert (tmp_path / "a/year=2024/month=01/day=09").is_dir() and spark.read.parquet(str(tmp_path / "a")).count() == 2


def test_history_partitions_and_merges(spark, tmp_path):
    rows = log(spark, (0, "a", "reddit", 1, 1, 0.0, []), (90_000, "a", "reddit", 2, 1, 0.0, []))
    state.write_history(rows, str(tmp_path / "h"))
    state.write_history(rows, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 4
    state.merge_partitions(rows.where("seq = 1").withColumn("captured_date", F.to_date("captured_at")), str(tmp_path / "h"), "captured_date")
    assert spark.read.parquet(str(tmp_path / "h")).count() == 3


def test_feed_filters_and_latency_ranks(spark):
    rows = log(spark, (0, "a", "reddit", 5, 1, 0.0, ["x"]), (60, "b", "youtube", 7, 2, 0.0, ["y"])).withColumns({"title": F.col("id"), "community": F.lit("R/Data"), "is_trending": F.col("seq") == 1})
    assert [r.id for r in serving.feed(rows, community="r/data", trending_only=True, topics=["y", "z"]).collect()] == ["b"]
    assert [r.id for r in serving.sorted_feed(rows, "score").collect()] == ["b", "a"]
    ranks = ops.latency_summary(spark.range(1, 101).select(F.lit("m").alias("k"), F.col("id").alias("v")), "v", "k").first()
    assert (ranks.p50, ranks.p95, ranks.p99, ranks["count"], ranks["sum"]) == (51, 96, 100, 100, 5050)


def test_history_tells_rows_of_one_second_apart(spark):
    rows = log(spark, (0, "a", "reddit", 1, 0, 0.0, []), (5, "a", "reddit", 7, 0, 0.0, []), (5, "a", "reddit", 9, 0, 0.0, []), (9, "a", "reddit", 9, 0, 0.0, []))
    moved = state.metrics_history(windows.enriched(rows)).collect()
    assert sorted((r.seq, r.raw_score) for r in moved) == [(1, 7), (2, 9)]


def test_percentiles_of_distinct_doubles_and_odd_metrics(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    values = [(k, (i * 7919 % n) / 7 - 20) for k, n in (("a", 1000), ("b", 1), (None, 37)) for i in range(n)] + [("a", None), ("c", None)]
    got = {r.k: (r["count"], r.p50, r.p95, r.p99) for r in ops.latency_summary(spark.createDataFrame(values, "k string, v double"), "v", "k").collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in ("a", "b", None, "c"):
        held = sorted(v for a, v in values if a == k and v is not None)
        want = tuple(held[min(len(held) * p // 100, len(held) - 1)] if held else None for p in (50, 95, 99))
        assert got[k] == (len([1 for a, _ in values if a == k]), *want)


def test_quality_report_counts_rows_and_keys_in_one_pass(spark):
    rows = log(spark, (0, "a", "reddit", 1, 0, 0.0, []), (0, "a", "x", -1, 0, 0.0, []), (0, "b", None, 5, 0, 0.0, []))
    report = ops.quality_report(rows, {"score": F.col("raw_score") < 0, "platform": F.col("platform") == "x"}, {"ids": "id", "platforms": "platform"})
    assert {r.rule: r.violations for r in report.collect()} == {"score": 1, "platform": 1, "ids": 1, "platforms": 0}
    assert {r.rule: r.violations for r in ops.quality_report(rows.limit(0), {"score": F.col("raw_score") < 0}, {"ids": "id"}).collect()} == {"score": 0, "ids": 0}


def test_dashboard_lists_keep_ties_and_unknown_values_in_order(spark):
    rows = log(spark, *[(0, f"i{i:02d}", "reddit", 5, 0, 0.0, []) for i in range(30)]).withColumns({"score_velocity": F.when(F.col("seq") < 3, F.col("seq") * 1.0), "momentum": F.lit(None).cast("double")})
    got = [(r.list, r.id, r.value) for r in serving.dash_top(rows).collect()]
    assert [g[1] for g in got if g[0] == "score"] == [f"i{i:02d}" for i in range(20)]
    assert [g[1:] for g in got if g[0] == "velocity"][:4] == [("i02", 2.0), ("i01", 1.0), ("i00", 0.0), ("i03", None)] and [g[1] for g in got if g[0] == "fastest"] == ["i02"]


def test_stream_of_many_batches_equals_batch(spark, tmp_path):
    rows = log(spark, *[(i * 1000 % 7919, f"i{i % 5}", "reddit", i, i, 0.1, [f"t{i % 3}"]) for i in range(60)])
    for k in range(3):
        rows.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: jobs.read_files(spark, str(tmp_path / "in"), rows.schema, files_a_batch=1)
    got = {(r.topic, r.bucket): r.signal_count for r in jobs.drain(jobs.topic_windows(stream(), "2 days"), ["topic", "platform", "bucket"]).collect()}
    assert got == {(r.topic, r.bucket): r.signal_count for r in topics.topic_buckets(rows.withColumn("trending_score", F.lit(0.0))).collect()}
    assert {r.id for r in jobs.drain(jobs.without_repeats(stream(), ["id"], "2 days"), ["id"], "append").collect()} == {f"i{i}" for i in range(5)}


def test_two_sinks(spark):
    seen = []
    batch = spark.createDataFrame([("a", "t", "x", 0.5, 1, 1, 0.0, True), ("b", "t", "x", 0.1, 1, 1, 0.0, False)], "id string, title string, author string, trending_score double, raw_score long, comment_count long, score_velocity double, is_trending boolean")
    jobs.two_sinks(lambda df, n: seen.append(df.count()), lambda df, n: seen.append(df.first().value))(batch, 0)
    assert seen[0] == 2 and '"id":"a"' in seen[1]


def test_entry_imports_and_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def twin_of_compare(spark, tmp_path, events):
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = catalogue.compare(spark, str(tmp_path))
    return [tuple(got.select(*got.columns).first())], con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLE['compare']})").fetchall()


@pytest.mark.parametrize("kept", ["event_type = 'click'", "false"])
def test_compare_of_no_events_has_a_total_of_0(spark, sf_small, tmp_path, kept):
    got, want = twin_of_compare(spark, tmp_path, spark.read.parquet(f"{sf_small}/events.parquet").where(kept))
    assert got == want == [(0, None, None, None)]
