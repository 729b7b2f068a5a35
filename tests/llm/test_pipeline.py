import re
from collections import Counter
from glob import glob
from itertools import combinations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

WORD = re.compile("[^\x20\x09-\x0d]+")


def good(text):
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w) >= 20 and 100 * len(covered) <= 30 * len(w)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def least_of_groups(texts):
    """The least id of each group linked by five-word shingles shared to 0.8 or more."""
    root, sets = {d: d for d in texts}, {d: shingles(t) for d, t in texts.items()}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(texts), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {find(d) for d in texts}


def test_every_stage_against_plain_python(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_small)
        kept[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    assert {r.doc_id for r in kept["quality"]} == {d for d, t in texts.items() if good(t)}
    assert {r.doc_id for r in kept["language"]} == {r.doc_id for r in kept["quality"] if any(c.isalpha() for c in r.text)}
    unlike = least_of_groups({r.doc_id: r.text for r in kept["language"]})
    assert sorted(r.doc_id for r in kept["near_dedup"]) == sorted(unlike)
    assert {r.doc_id for r in kept["mixing"]} <= unlike
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(model.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept["mixing"])
    assert sum(r.length for r in kept["packing"]) == want


def test_run_is_the_stages(spark, sf_small):
    assert corpus_pipeline.run(spark, sf_small).count() > 0


def test_stages_leave_the_mix_alone(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_small)
    folders = lambda: set(glob(spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/rdd-*"))
    before = folders()
    mix = corpus_pipeline.after(spark, sf_small, len(corpus_pipeline.STAGES) - 1)
    assert len(folders() - before) == 1
    assert Counter(r.doc_id for r in mix.collect()) == Counter(r.doc_id for r in docs.collect()) != Counter()


NAMES = ("_host", "_counts", "_failed", "counts", "failed", "of_host", "_told", "told", "_kept", "_rows", "own", "kept_id", "kept_digest", "_digest", "class", "key", "shard", "position", "_copy", "_size", "size", "row", "run", "start", "length")


def odd(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame([(*r, None, *NAMES) for r in rows], schema)


def test_stages_with_nulls_repeats_and_clashing_columns(spark, sf_small):
    clean = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    extra = [(None, clean[0][1], None, None), (None, None, "en", "src0"), (7, "", None, None), clean[1], clean[1], (None, "word " * 40_000, None, "src1")]
    docs = odd(spark, clean + extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_small)
        assert out.columns == docs.columns and all(tuple(r)[5:] == NAMES for r in out.collect()), name
        docs = out
    pieces = corpus_pipeline.packing(spark, docs, sf_small).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()} and len(pieces) > 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, sf_small, name, stage):
    assert stage(spark, odd(spark, []), sf_small).collect() == []
