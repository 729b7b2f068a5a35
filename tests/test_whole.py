"""Whole groups: nothing is held in one frame."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from weirflow.operators import windows
from weirflow.plans import catalogue
from weirflow.streaming import jobs

T0 = datetime(2024, 1, 1)


def log(spark, n):
    rows = [(i, f"i{i}", ("reddit", "bluesky", None)[i % 3], T0 + timedelta(seconds=i // 2), (i * 7) % 23 - 2) for i in range(n)]
    return spark.createDataFrame(rows, "seq long, id string, platform string, captured_at timestamp, raw_score long")


def test_token_bucket_holds_no_group_and_goes_on_between_batches(spark):
    rows = log(spark, 900)
    got = {}
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        kept = windows.token_bucket(rows, {"reddit": 0.1, "youtube": -1.0}, burst_seconds=30)
        got[size] = sorted(r.seq for r in kept.collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, tokens, last = [], 3.0, None
    for r in sorted(rows.where("platform = 'reddit'").collect(), key=lambda r: (r.captured_at, r.seq)):
        tokens = min(3.0, tokens + 0.1 * ((r.captured_at - last).total_seconds() if last else 0))
        last = r.captured_at
        want += [r.seq] if tokens >= 1 else []
        tokens -= tokens >= 1
    assert got["7"] == got["10000"] == sorted(want + [i for i in range(900) if i % 3])
    plan = kept._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_registered_baseline_is_the_blocked_one(spark, sf_small, monkeypatch):
    monkeypatch.setattr(windows, "with_normalised", None)
    assert catalogue.normalised_score(spark, sf_small).count() > 0


def test_blocks_keep_rows_without_a_platform(spark):
    rows, small = log(spark, 300), type(windows.DEFAULTS)(window_rows=30)
    blocked = windows.with_normalised_blocked(rows, small, block=64, slice_seconds=17)
    assert {r.seq: r.normalised_score for r in blocked.collect()} == {r.seq: r.normalised_score for r in windows.with_normalised(rows, small).collect()}


def test_streamed_baseline_keeps_state_between_batches(spark, tmp_path):
    rows, small = log(spark, 300).where("platform IS NOT NULL"), type(windows.DEFAULTS)(window_rows=30)
    for at in range(0, 300, 100):
        rows.where(F.col("seq").between(at, at + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), rows.schema, files_a_batch=1)
    got = {r.seq: r.normalised_score for r in jobs.drain(jobs.normalised(stream, t=small), ["seq"], "append").collect()}
    assert got == {r.seq: r.normalised_score for r in windows.with_normalised(rows, small).collect()}


def test_streamed_bucket_equals_the_batch_one_and_keeps_state(spark, tmp_path):
    rows = log(spark, 600).where("platform IS NOT NULL")
    want = sorted(r.seq for r in windows.token_bucket(rows, {"reddit": 0.1, "youtube": -1.0}, burst_seconds=30).collect())
    for at in range(0, 600, 200):
        rows.where(F.col("seq").between(at, at + 199)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), rows.schema, files_a_batch=1)
    got = jobs.drain(jobs.throttled(stream, {"reddit": 0.1, "youtube": -1.0}, burst_seconds=30), ["seq"], "append")
    assert sorted(r.seq for r in got.collect()) == want
