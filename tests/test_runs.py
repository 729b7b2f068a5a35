"""Runs of words looked up in a table too large for a task: what is shuffled, blocks and ranges, equal hashes, odd words."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirflow.functions import lexicon, runs
from weirflow.functions.text import PUNCTUATION


def shuffled_rows(spark, job):
    context = spark.sparkContext
    store, none, quantiles = context._jsc.sc().statusStore(), context._jvm.java.util.ArrayList(), context._gateway.new_array(context._jvm.double, 0)

    def stages():
        found = store.stageList(none, False, False, quantiles, none)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    job()
    return sum(n for k, n in stages().items() if k not in before)


def corpus(spark, texts=400, words=200):
    word = F.concat(F.lit("w"), F.pmod(F.xxhash64("id", "i"), F.lit(5000)))
    return spark.range(texts).select("id", F.explode(F.sequence(F.lit(1), F.lit(words))).alias("i")).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", word.alias("w")))), lambda x: x["w"]), " ").alias("t")).cache()


def test_runs_of_words_are_not_shuffled_as_rows(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "BROADCAST_TERMS", 0)
    rows = corpus(spark)
    names = rows.where("id < 100").select(F.explode(F.split("t", " ")).alias("term")).distinct().withColumn("name", F.col("term")).cache()
    assert rows.count() == 400 and names.count() > 4000
    assert shuffled_rows(spark, lambda: lexicon.topics_by_table(rows, "t", names, ["id"]).collect()) < 20_000  # of 80,000 words, 159,600 runs


def test_sentiment_does_not_shuffle_its_hits(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "BROADCAST_TERMS", 0)
    rows = corpus(spark)
    terms = rows.where("id < 100").select(F.explode(F.split("t", " ")).alias("term")).distinct().selectExpr("term", "'valence' AS kind", "1.5D AS value").cache()
    assert rows.count() == 400 and terms.count() > 4000
    assert shuffled_rows(spark, lambda: lexicon.sentiment_by_table(rows, "t", terms, ["id"]).collect()) < 20_000  # nearly each of 80,000 words is a hit


@pytest.mark.parametrize("longest", [None, 3])
def test_blocks_and_ranges_tell_what_one_table_tells(spark, monkeypatch, longest):
    rows = corpus(spark, 60, 50).unionByName(spark.createDataFrame([(100, None), (101, ""), (102, " \n"), (103, "W7 w8, ÉTÉ ... (w9)!"), (103, "W7 w8, ÉTÉ ... (w9)!")], "id long, t string"))
    found = rows.select(F.explode(F.split("t", " ")).alias("term")).where("term rlike '^w[0-9]+$'").distinct()
    two = rows.where("id < 60").select(F.explode(F.sequence(F.lit(0), F.lit(40), F.lit(4))).alias("i"), F.split("t", " ").alias("w")).select(F.concat_ws(" ", F.get("w", F.col("i")), F.get("w", F.col("i") + 1), F.when(F.col("i") % 8 == 0, F.get("w", F.col("i") + 2))).alias("term"))
    terms = found.unionByName(two).unionByName(spark.createDataFrame([("w7",), ("été",), ("",), (" w9",)], "term string")).distinct()
    terms = terms.withColumns({"kind": F.element_at(F.array(*map(F.lit, ("valence", "booster", "negation", "contrast", "valence"))), (F.length("term") % 5 + 1).cast("int")), "value": F.length("term") - 4.25}).cache()

    def told():
        told = lexicon.sentiment_by_table(rows, "t", terms, ["id"], *longest_of).collect(), lexicon.topics_by_table(rows, "t", terms.withColumn("name", F.col("term")), ["id"], 8, *longest_of).collect(), lexicon.hits(rows, F.col("t"), terms, *longest_of).collect()
        return [sorted(map(repr, x)) for x in told]

    longest_of = ()
    small = told()
    assert len(small[0]) == len(small[1]) == 65 and len(small[2]) > 1000
    for name, value in (("BLOCK", 700), ("RANGE", 3000)):
        monkeypatch.setattr(runs, name, value)
    if longest is None:
        monkeypatch.setattr(lexicon, "BROADCAST_TERMS", 0)
    else:
        longest_of = (longest,)
    assert told() == small


@pytest.mark.parametrize("bits", [3, 40])
def test_equal_hashes_do_no_harm(monkeypatch, bits):
    monkeypatch.setattr(runs, "SHIFT", np.uint64(64 - bits))
    texts = ["a b c d", "B c, a", "", None, "d d d é É", "x"]
    table = runs.Table(pa.table({"term": ["b c", "a", "d d", "é é", "x y", "c d", "a", "b"]}))
    found = runs.hits_of(runs.Words(pa.array(texts), PUNCTUATION), table, 2)
    words = found.words
    got = [(int(words.row[p]), int(words.at[p]), int(n), table.term[int(t)].as_py()) for p, n, t in zip(found.place, found.n, found.term, strict=True)]
    assert got == [(0, 0, 1, "a"), (0, 1, 2, "b c"), (1, 0, 2, "b c"), (1, 2, 1, "a"), (4, 0, 2, "d d"), (4, 3, 2, "é é")]
    hashes = runs.different(words.hashes >> runs.SHIFT)
    assert len(table.terms) == 7 and (runs.unpacked(runs.packed(hashes), len(hashes)) == hashes).all()
