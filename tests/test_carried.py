"""Token buckets by composed functions, and streams that carry tables: faults, late rows, repeats."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirflow.operators import throttle, topics
from weirflow.streaming import jobs

T0 = datetime(2024, 1, 1)
T = throttle.TOKEN


@pytest.mark.parametrize("size", [T, 2 * T + 5, 7 * T])
def test_functions_of_rows_compose(size):
    draw = random.Random(size)
    for _ in range(60):
        gains = [min(size, draw.choice([0, T // 3, T // 2 + 7, T, size])) for _ in range(draw.randint(1, 40))]
        cut = draw.randint(0, len(gains))
        halves = []
        for part in (gains[:cut], gains[cut:]):
            pieces = throttle.IDENTITY
            for g in part:
                pieces = throttle.after_row(pieces, g, size)
            halves.append(pieces)
        whole = throttle.composed(*halves, size)
        assert len(whole) <= 3 * (size // T + 2)
        for level in [0, size, *(draw.randint(0, size) for _ in range(20))]:
            want = level
            for g in gains:
                want = throttle.taken(min(size, want + g))
            assert throttle.applied(whole, level) == want


def busy(spark, n, seed=1):
    draw = random.Random(seed)
    times = [0]
    while len(times) < n:
        times.append(times[-1] + draw.choice([0, 0, 1, 1, 2, 90]))
    rows = [(i, ("reddit", "reddit", "youtube", None)[i % 4], T0 + timedelta(seconds=t)) for i, t in enumerate(times)] + [(n, "reddit", None), (n + 1, "reddit", None)]
    return spark.createDataFrame(rows, "seq long, platform string, captured_at timestamp")


def walk(rows, rate, burst):
    per, size = throttle.refill_of(rate, burst)
    level, last, out = size, None, set()
    for r in sorted(rows, key=lambda r: (r.captured_at is None, r.captured_at, r.seq)):
        gap = (r.captured_at - last) // timedelta(microseconds=1) if last and r.captured_at else 0
        filled = min(size, level + per * gap)
        level, last = throttle.taken(filled), r.captured_at or last
        if filled >= T:
            out.add(r.seq)
    return out


@pytest.mark.parametrize(("block", "fan"), [(4096, 1024), (16, 3)])
def test_blocks_decide_as_a_plain_walk(spark, block, fan):
    rows = busy(spark, 700)
    got = {r.seq for r in throttle.token_bucket(rows, {"reddit": 0.4, "bluesky": 1.0, "youtube": -1}, burst_seconds=12, block=block, fan=fan).collect()}
    held = [r for r in rows.collect() if r.platform == "reddit"]
    assert got == walk(held, 0.4, 12) | {r.seq for r in rows.collect() if r.platform != "reddit"}
    assert throttle.token_bucket(rows.limit(0), {"reddit": 0.4}).count() == 0 and throttle.token_bucket(rows, {}).count() == 702


def test_a_fault_between_sinks_shows_nothing_and_loses_nothing(spark, tmp_path):
    place, faulty = str(tmp_path / "p"), []

    @F.udf("long")
    def checked(x):
        raise OSError("the second sink is down")

    def step(rows, state):
        total = rows.agg(F.sum("id").alias("n"))
        total = total.unionByName(state["sum"]).agg(F.sum("n").alias("n")) if state else total
        return {"raw": rows, "unified": rows.select(checked("id").alias("id") if faulty else "id")}, {"sum": total}

    run = jobs.batches(jobs.Carried(None, step), place)
    run(spark.range(0, 5), 0)
    faulty.append(True)
    with pytest.raises(Exception, match="second sink"):
        run(spark.range(5, 9), 1)
    seen = lambda sink: sorted(r.id for r in jobs.visible(spark, place, sink).collect())
    assert seen("raw") == seen("unified") == list(range(5)) and spark.read.parquet(f"{place}/raw").count() == 9
    faulty.clear()
    run(spark.range(5, 9), 1)
    run(spark.range(5, 9), 1)  # once more: replaces itself
    assert seen("raw") == seen("unified") == list(range(9)) and jobs.last_state(spark, place, "sum").first().n == sum(range(9))


def test_late_rows_reach_their_own_buckets(spark, tmp_path):
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    rows = [(0, 0, 0.5), (0, 1, 0.0), (1, 300, 0.1), (2, 2, 0.25), (2, 310, None), (3, 14, -0.5), (3, 900, 0.2), (3, None, 0.9)]
    table = spark.createDataFrame([(i, b, "reddit", None if m is None else at(m), 1, 0.0, s, ["ai", " AI "]) for i, (b, m, s) in enumerate(rows)], "seq long, b long, platform string, captured_at timestamp, raw_score long, trending_score double, sentiment_compound double, topics array<string>")
    place = str(tmp_path / "p")
    run = jobs.batches(jobs.buckets_with_late(table, 3600), place)
    for b in range(4):
        run(table.where(F.col("b") == b), b)
    late = jobs.visible(spark, place, "late")
    assert sorted(r.seq for r in late.collect()) == [3, 5, 7]
    whole = jobs.visible(spark, place, "closed").drop("batch").unionByName(jobs.last_state(spark, place, "open"))
    jobs.merge_partitions(whole.withColumn("bucket_date", F.to_date("bucket")), f"{place}/t", "bucket_date")
    jobs.backfilled(spark, f"{place}/t", late)
    columns = ["topic", "platform", "bucket", "signal_count", "sentiment_sum", "sentiment_n", "total_score"]
    plain = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert plain(spark.read.parquet(f"{place}/t")) == plain(topics.topic_buckets(table.where("captured_at IS NOT NULL")))


def test_a_timed_stream_goes_on_where_it_stopped(spark, tmp_path):
    lines = lambda a, b: spark.range(a, b).select(F.lit("a.raw").alias("topic"), F.to_json(F.struct(F.col("id").alias("n"))).alias("value"))
    bad = spark.createDataFrame([("a.raw", "no json"), ("other", "{}"), ("a.raw", None)], "topic string, value string")
    lines(0, 5).unionByName(bad).coalesce(1).write.parquet(str(tmp_path / "in"))
    told = jobs.records_of(jobs.read_files(spark, str(tmp_path / "in"), bad.schema), {"a.raw": "n long"})
    work, place = jobs.Carried(told, lambda rows, state: ({"out": rows.select("a_raw.n")}, {})), str(tmp_path / "p")
    for first in (5, 8):
        query = jobs.run_every(work, place, 0.2)
        query.processAllAvailable()
        query.stop()
        lines(first, first + 3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = jobs.run_every(work, place)
    query.processAllAvailable()
    query.stop()
    got = [r.n for r in jobs.visible(spark, place, "out").collect()]
    assert sorted(n for n in got if n is not None) == list(range(11)) and got.count(None) == 2
