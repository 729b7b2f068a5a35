from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from weirflow.llm.mixing import mixed_rows, shuffled_rows
from weirflow.llm.queries import op8_mixing


def corpus(spark):
    return spark.range(600).selectExpr("id AS doc_id", "concat('w', id, ' a b c') AS text", "if(id < 60, 'few', 'many') AS source").coalesce(2)


def test_shards_lie_in_sorted_runs(spark):
    docs = corpus(spark)
    rows = shuffled_rows(docs, 4, part_rows=50).withColumn("task", F.spark_partition_id()).collect()
    want = sorted((r.shard, r.position, r.doc_id) for r in mixed_rows(docs, 4).collect())
    assert sorted((r.shard, r.position, r.doc_id) for r in rows) == want
    runs = defaultdict(list)
    for r in rows:
        runs[r.task].append((r.shard, r.position))
    assert all(x == sorted(x) for x in runs.values()) and max(map(len, runs.values())) < len(want) / 2


def test_copies_of_a_document_are_apart_in_the_stage(spark):
    ids = [r.doc_id for r in corpus_pipeline.mixing(spark, corpus(spark), "").collect()]
    assert len(set(ids)) < len(ids)
    assert sum(a == b for a, b in zip(ids, ids[1:], strict=False)) < (len(ids) - len(set(ids))) / 4


def test_op8_gives_a_position_for_each_copy(spark, sf_small):
    rows = op8_mixing(spark, sf_small).where("shards <> ''").collect()
    assert rows and all(len(set(r.positions.split(","))) == len(r.shards.split(",")) for r in rows)
