import zlib

import numpy as np

from weirflow.llm.langid import Filters, WordVotes, grams, identify, keep_identified, split_and_identify, train_filters, words_of
from weirflow.llm.queries import op5_langid


def test_held_out_accuracy_and_scores(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op5_langid(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_filter_equals_profiles(spark):
    """Votes are those of plain sets of n-grams, but for false positives, which only add."""
    rows = [("en", "the thing that the weather"), ("de", "der die das wetter"), ("fr", None), ("es", "")]
    filters = train_filters(spark.createDataFrame(rows, "lang string, text string"), contrast=0.0)
    assert filters.languages == ["de", "en"]
    sets = {lang: set(grams(words_of(text))[0].tolist()) for lang, text in rows if text}
    votes = WordVotes(filters).of([["weather", "wetter"], []])
    x = grams(["weather", "wetter"])[0].tolist()
    assert votes[0].tolist() == [sum(g in sets["de"] for g in x), sum(g in sets["en"] for g in x), len(x)] and not votes[1].any()


def test_more_than_64_languages(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = [(f"l{i:03d}", " ".join(alphabet[i % 26] + alphabet[i // 26] * 2 + c for c in "xyz")) for i in range(70)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = identify(docs, train_filters(docs, contrast=0.0)).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 65


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    assert split_and_identify(spark.createDataFrame([], schema)).collect() == []
    rows = [(i, "the weather and the sea", "en", "") for i in range(9)] + [(100, None, "en", ""), (101, "", None, ""), (102, "123 !!", "en", ""), (103, "the " * 50_000, None, ""), (None, "the sea", "en", ""), (104, "漢字", None, "")]
    docs = spark.createDataFrame(rows, schema)
    got = {r.doc_id: r for r in split_and_identify(docs).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "en"] and got[104].lang_pred == "en" and got[104].score == 0
    assert all(r.lang_pred == "und" for r in identify(docs, Filters([], np.zeros((1, 1 << 20), dtype=np.uint64))).collect())
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(9), 103, None}
