"""What a job leaves behind: checkpoints of its steps and what its streams needed are gone, results stay."""

import os
import threading
from glob import glob

import pytest
from pyspark.sql import functions as F

from weirflow.operators.state import kept, passing, settled
from weirflow.streaming import jobs


def folder(rows):
    return rows._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")


def test_settled_rows_outlive_the_steps_behind_them(spark):
    steps = []

    def make():
        steps.append(kept(spark.range(10).withColumn("x", F.rand(1))))
        steps.append(settled(spark, lambda: kept(steps[0].where("id > 3"))))
        return steps[1].groupBy().agg(F.count("*").alias("n"))

    out = settled(spark, make)
    assert os.path.exists(folder(out)) and not any(os.path.exists(folder(s)) for s in steps)
    assert out.collect()[0].n == 6
    assert settled(spark, lambda: spark.range(0)).count() == 0


def test_a_fault_and_other_threads(spark):
    other, mine = [], []
    with pytest.raises(RuntimeError), passing(spark):
        mine.append(kept(spark.range(5)))
        thread = threading.Thread(target=lambda: other.append(kept(spark.range(7))))
        thread.start()
        thread.join()
        raise RuntimeError
    assert not os.path.exists(folder(mine[0])) and other[0].count() == 7
    outside = kept(spark.range(3))
    with passing(spark):
        pass
    assert outside.count() == 3


def test_streams_leave_their_rows_alone(spark, tmp_path, monkeypatch):
    for n in range(4):
        spark.range(n, n + 1).selectExpr("id AS seq", "'reddit' AS platform", "timestamp_seconds(id) AS captured_at", "id + 1 AS raw_score").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: jobs.read_files(spark, str(tmp_path / "in"), "seq long, platform string, captured_at timestamp, raw_score long", files_a_batch=1)
    place, context = str(tmp_path / "out"), spark.sparkContext
    monkeypatch.setattr(jobs, "scratch", lambda _: place)
    before = set(glob(f"{context.getCheckpointDir().removeprefix('file:')}/rdd-*")) if context.getCheckpointDir() else set()
    rows = jobs.drain(jobs.normalised(stream()), ["seq"], "append")
    assert sorted(r.seq for r in rows.collect()) == [0, 1, 2, 3]
    assert sorted(os.listdir(place)) == ["manifest", "out"]
    assert set(glob(f"{context.getCheckpointDir().removeprefix('file:')}/rdd-*")) == before
    place = str(tmp_path / "plain")
    rows = jobs.drain(stream(), ["seq"], "append")
    assert rows.count() == 4 and os.listdir(place) == ["out"]
