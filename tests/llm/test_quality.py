import re
from collections import Counter

from weirflow.llm.quality import assess, host_verdicts, keep_good
from weirflow.llm.queries import op7_quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_plain_python(spark, sf_small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    for r in op7_quality(spark, sf_small).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r.doc_id])


def test_odd_rows(spark):
    schema = "doc_id long, text string, source string, kept string"
    assert assess(spark.createDataFrame([], schema)).collect() == []
    texts = [None, "", " \n ", "a b c d e f g h a b c d e f g h", "x\n\nx\nx y", "wörd " * 30_000, "wörd " * 30_000]
    docs = spark.createDataFrame([(None if i == 2 else i, t, None if i < 2 else "h", "?") for i, t in enumerate(texts)], schema)
    rows = assess(docs).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == sorted(map(plain, texts))
    assert keep_good(docs).columns == docs.columns and keep_good(docs).count() == 0


def test_bad_host_goes_and_good_hosts_stay(spark):
    rows = [("bad", i < 190) for i in range(200)] + [(f"good{h}", i < 5) for h in range(20) for i in range(100)] + [("tiny", True)]
    verdict = {r.host: r.host_kept for r in host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert not verdict.pop("bad")
    assert verdict.pop("tiny") in (True, False) and all(verdict.values())
    clean = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, clean if h == "good" or i % 20 == 0 else "short", h) for h in ("good", "bad") for i in range(100)], "doc_id long, text string, source string")
    assert {r.source for r in keep_good(docs).collect()} == {"good"}
