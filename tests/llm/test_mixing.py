from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm.mixing import BLOCKS, LEAST_BLOCKS, SEED, mix, mixed_rows, shuffled_rows, split, targets
from weirflow.llm.queries import op8_mixing


def test_targets_share_and_stop_at_three_times():
    got = targets([1000, 10, 1000], [1, 5, 2])
    assert got[1] == 30 and abs(sum(got) - 2010) < 1e-6 and abs(got[2] / got[0] - 2) < 1e-9
    assert targets([0, 0], [5, 2]) == [0.0, 0.0]


def test_tree_keeps_quotas():
    quotas = np.array([500, 30, 0, 170])
    parts = split(quotas, 8, np.random.default_rng(1))
    assert (sum(parts) == quotas).all() and max(p.sum() for p in parts) - min(p.sum() for p in parts) <= 3


def test_words_taken_near_targets(spark, sf_dir):
    rows = op8_mixing(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by = {}
    for r in rows:
        assert r["size"] == len(docs[r.doc_id].text.split()) and r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"])
        by.setdefault(docs[r.doc_id].source, []).append(r)
    order = sorted(by)
    sizes = [sum(r["size"] for r in by[s]) for s in order]
    want = targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, size, target in zip(order, sizes, want, strict=True):
        assert by[s][0].source_size == size and abs(by[s][0].target - target) < 1e-6
        assert abs(sum(r.taken for r in by[s]) - target) <= max(r["size"] for r in by[s])
    assert sorted(map(tuple, op8_mixing(spark, sf_dir).collect())) == sorted(map(tuple, rows))


def drawn_plainly(rows, shards):
    """(source, key) -> the sorted lists of shards of its rows, by walking every row in the order of its hash."""
    by = defaultdict(list)
    for source, key, text in rows:
        by[source].append((key, len((text or "").split())))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, n in by[s]) for s in order]
    goal, total = targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))]) if sum(sizes) else [0] * len(order), max(1, sum(sizes))
    blocks = [max(LEAST_BLOCKS, round(BLOCKS * s / total)) if s else 0 for s in sizes]
    quotas = np.array([min(round(g / s * b), 3 * b) if s else 0 for g, s, b in zip(goal, sizes, blocks)], dtype=np.int64)
    ends = np.cumsum(split(quotas, shards, np.random.default_rng(SEED)), axis=0)
    out = defaultdict(list)
    for i, source in enumerate(order):
        at = 0
        for key, n in sorted(by[source]):
            middle, copies = at + n / 2, []
            at += n
            for turn in range(3) if sizes[i] else ():
                for shard in range(shards):
                    last, rest = divmod(int(ends[shard][i]), blocks[i])
                    if (turn, middle) < (last, rest * sizes[i] / blocks[i]):
                        copies.append(shard)
                        break
            out[source, key].append(copies)
    return {k: sorted(v) for k, v in out.items()}


SCHEMA = "doc_id long, text string, source string"
TABLES = {
    "plain": [(i, "w " * (i % 17), f"s{i % 3}") for i in range(900)],
    "null ids": [(None, "w " * 10, "few") for _ in range(1000)] + [(i, "v " * 9, "many") for i in range(3000)],
    "repeats": [(i // 50, "w " * (i // 50), "a") for i in range(2000)] + [(i, "v v v", None) for i in range(700)],
    "null ids, texts that differ": [(None, f"w{i} " * 7, "few") for i in range(400)] + [(i, None, "many") for i in range(9)] + [(None, "x " * 5000, "many")],
}


@pytest.mark.parametrize("name", TABLES)
def test_draws_equal_a_plain_walk_and_totals_are_near(spark, name):
    docs = spark.createDataFrame(TABLES[name], SCHEMA).repartition(5)
    rows = mix(docs, 8).select("row.source", "key", "row.text", "shards", "size", "target").collect()
    keyed = docs.select("source", F.xxhash64(F.lit(SEED), "doc_id", "text").alias("key"), "text").collect()
    got = defaultdict(list)
    for r in rows:
        got[r.source, r.key].append(list(r.shards))
    assert {k: sorted(v) for k, v in got.items()} == drawn_plainly([tuple(r) for r in keyed], 8)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.size * len(r.shards) for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 2


def test_equal_rows_in_chunks(spark, monkeypatch):
    monkeypatch.setattr("weirflow.llm.mixing.CHUNK", 7)
    docs = spark.createDataFrame([(1, "w w w", "a", x % 2) for x in range(100)] + [(i, "v v", "b", 0) for i in range(200)], SCHEMA + ", extra int")
    rows = mix(docs, 4).select("row.*", "size", "shards", "target", "turn").collect()
    assert len(rows) == 300 and sorted(r.turn for r in rows if r.source == "a") == list(range(100)) and sum(r.extra for r in rows) == 50
    assert abs(sum(r.size * len(r.shards) for r in rows if r.source == "a") - next(r.target for r in rows if r.source == "a")) <= 3


def test_copies_odd_rows_and_clashing_columns(spark):
    schema = "doc_id long, text string, source string, shard string, position string, size string, key string, row string, _copy string, run string"
    assert mix(spark.createDataFrame([], schema)).collect() == [] and shuffled_rows(spark.createDataFrame([], schema)).collect() == []
    more = ("p", "q", "r", "s", "t", "u", "v")
    rows = [(i, "w " * (i % 7), "big", *more) for i in range(300)] + [(1000 + i, "v v", None, *more) for i in range(6)] + [(None, None, "big", *more), (2000, "", "none", *more)]
    docs = spark.createDataFrame(rows, schema)
    out = mix(docs, 4).collect()
    assert len(out) == len(rows) and all(len(r.shards) <= 3 and r["row"]["shard"] == "p" for r in out)
    copies = mixed_rows(docs, 4)
    assert copies.columns == [*docs.columns, "shard_", "position_"]
    assert copies.count() == sum(len(r.shards) for r in out) and {r.shard_ for r in copies.collect()} <= {0, 1, 2, 3}
    assert shuffled_rows(docs, 4).select(*docs.columns).distinct().count() <= len(rows) and {tuple(r)[3:10] for r in shuffled_rows(docs, 4).collect()} == {more}
    nothing = spark.createDataFrame([(1, "", "a"), (2, None, None)], SCHEMA)
    assert [(r.target, r.shards) for r in mix(nothing).collect()] == [(0.0, [])] * 2
