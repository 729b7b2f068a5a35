"""Numbers and running sums of keys that lie in many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from weirflow.operators.numbering import numbered, running, with_surrogates


def test_a_hot_key_is_numbered_in_many_tasks(spark):
    draw = random.Random(3)
    rows = [("hot" if i % 3 else draw.choice(["a", None, "b"]), draw.randrange(10**6), i) for i in range(3000)]
    table = spark.createDataFrame(rows, "k string, at long, id long").repartition(6)
    got = numbered(table, ["k"], ["at", "id"], "n")
    want = {}
    for k in ("hot", "a", "b", None):
        want |= {r[2]: n for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]), 1)}
    assert {r.id: r.n for r in got.collect()} == want and got.columns == ["k", "at", "id", "n"]
    assert table.where("k = 'x'").transform(numbered, ["k"], ["at"]).count() == 0


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_new_names_with_one_head_lie_in_many_ranges(uncoalesced):
    spark = uncoalesced
    names = spark.range(2000).select(F.lit("reddit").alias("platform"), F.concat(F.lit("r/c"), "id").alias("name")).unionByName(spark.createDataFrame([("reddit", None), (None, "x")], "platform string, name string"))
    old = with_surrogates(names.where("name < 'r/c15'"), spark.createDataFrame([], "id int, platform string, name string"))
    first = {(r.platform, r.name): r.id for r in old.collect()}
    assert list(first.values()) and sorted(first.values()) == list(range(1, len(first) + 1)) and sorted(first, key=first.get) == sorted(first, key=lambda x: (x[0] or "", x[1]))
    both = {(r.platform, r.name): r.id for r in with_surrogates(names, old).collect()}
    assert sorted(both.values()) == list(range(1, 2003)) and both.items() >= first.items()
    dealt = names.repartitionByRange("platform", "name").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) > 2 and max(r["count"] for r in dealt) < 1000


def test_running_sums_over_blocks(spark):
    rows = [(k, i + 1, (i * 7) % 11) for k, n in (("a", 50), ("b", 1), (None, 9)) for i in range(n)]
    table = spark.createDataFrame(rows, "k string, n long, v long")
    got = {(r.k, r.n): r.s for r in running(table, "k", "n", {"s": "v"}, block=8).collect()}
    assert got == {(k, n): sum(v for a, m, v in rows if a == k and m <= n) for k, n, _ in rows}
