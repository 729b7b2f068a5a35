import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weirflow.llm import simhash
from weirflow.llm.queries import op4_simhash
from weirflow.llm.simhash import components, keep_one, near_links, near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text, k=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, near=4):
    fps = sorted(set(fps))
    root, a = list(range(len(fps))), np.array(fps, dtype=np.uint64)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= near) + i + 1:
            root[find(int(j))] = find(i)
    return {fp: find(i) for i, fp in enumerate(fps)}


def test_whole_table_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {d: plain(t) for d, t in texts.items()}
    of = groups(fps.values())
    least = {}
    for d, f in fps.items():
        least[of[f]] = min(d, least.get(of[f], d))
    rows = op4_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{f:016x}", least[of[f]]) for d, f in fps.items()}


@pytest.mark.parametrize("hot", [4096, 20])
def test_links_of_dense_balls_and_hot_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(7)
    fps = {0}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    fps |= {rng.getrandbits(64) for _ in range(300)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    roots = {r.node: r.root for r in components(near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4)).collect()}
    want, got = groups(fps), {}
    for f, s in zip(fps, signed, strict=True):
        got.setdefault(roots.get(s, s), set()).add(f)
    parts = {}
    for f, g in want.items():
        parts.setdefault(g, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, parts.values()))


def test_odd_rows_and_keeping_one(spark):
    schema = "doc_id long, text string, fp string"
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None, ""), (4, "", ""), (4, "", ""), (9, long, ""), (8, long.replace("w29999", "other"), ""), (7, "A b\tC", ""), (6, "a B c", ""), (None, "z", "")]
    docs = spark.createDataFrame(rows, schema)
    out = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert out == {5: 4, 4: 4, 9: 8, 8: 8, 7: 6, 6: 6, None: None}
    assert sorted((r.doc_id or 0) for r in keep_one(docs).collect()) == [0, 4, 6, 8] and keep_one(docs).columns == docs.columns
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == [] and docs.where(F.lit(False)).count() == 0
