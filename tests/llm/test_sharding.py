import zlib

from weirflow.llm.queries import op2_sharding
from weirflow.llm.sharding import measured, minimax_cuts, prefix_sums, runs_of, shard


def test_capacity_equals_plain_search_and_rows_are_whole(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    groups = prefix_sums(measured(docs))
    sizes = [r["size"] for r in groups.orderBy("group").select("size").collect()]
    capacity, _ = minimax_cuts(groups, 8)
    assert capacity == runs_of(sizes, 8)
    rows, texts = op2_sharding(spark, sf_small).collect(), {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()))
    by_shard, by_text = {}, {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
        by_text.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert max(sum(r["size"] for r in part) for part in by_shard.values()) == capacity
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by_shard.values())
    assert all(len(s) == 1 for s in by_text.values())


def test_odd_rows(spark):
    schema = "doc_id long, text string, shard string"
    assert shard(spark.createDataFrame([], schema), 8).collect() == []
    rows = shard(spark.createDataFrame([(None, None, "x"), (1, None, None), (2, "", "a"), (3, "é" * 100_000, ""), (3, "é" * 100_000, "")], schema), 3).collect()
    assert sorted(r["size"] for r in rows) == [1, 1, 1, 200_001, 200_001]
    assert len({r.shard for r in rows if r["size"] == 1}) == 1 and len({r.shard for r in rows}) == 2
