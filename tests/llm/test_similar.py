import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weirflow.llm.similar import described, keep_similar_one, similar_links
from weirflow.llm.simhash import components, keep_one, majority, shingle_hashes

SCHEMA = "doc_id long, text string"


def shared(a, b, k=5):
    a, b = set(shingle_hashes(a, k).tolist()), set(shingle_hashes(b, k).tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def least_of_groups(texts):
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(texts), 2):
        if shared(texts[a], texts[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {find(d) for d in texts}


def planted():
    """Documents with copies of which 1 to 12 runs of words are changed: similarities on both sides of 0.8."""
    rng, texts = random.Random(3), {}
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(240)]
        texts[len(texts)] = " ".join(base)
        for edits in (1, 3, 4, 5, 6, 12):
            copy = list(base)
            for at in rng.sample(range(0, 240, 8), edits):
                copy[at] = f"n{rng.randrange(10**9)}"
            texts[len(texts)] = " ".join(copy)
    return texts


def test_stage_equals_exact_jaccard_on_both_sides_of_the_threshold(spark):
    texts = planted()
    docs = spark.createDataFrame(list(texts.items()), SCHEMA).repartition(4)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == least_of_groups(texts) and 60 < len(got) < len(texts)


@pytest.mark.parametrize("keep", [keep_similar_one, keep_one])
def test_null_and_repeated_ids_lose_no_text(spark, keep):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(None, a), (None, b), (7, c), (None, c), (8, a), (9, "x y"), (9, "p q"), (9, "x y"), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.text) for r in keep(docs).collect())
    assert got == sorted([(8, a), (0, b), (7, c), (9, "x y"), (9, "p q"), (5, "")])
    assert keep(docs.where("false")).collect() == []


def test_pairs_near_in_fingerprint_meet_without_a_common_band(spark):
    """Fingerprints and their pivot tables find candidates of their own; what they find is verified by Jaccard, too."""
    texts = planted()
    base = " ".join(f"r{i}" for i in range(40))
    texts |= {900: base, 901: f"{base} {base}", 902: "one", 903: "two"}
    docs = spark.createDataFrame(list(texts.items()), SCHEMA).repartition(4)
    rows = described(docs, 5, "doc_id", "text")
    prints = {d: majority(shingle_hashes(t, 5)) for d, t in texts.items()}
    assert {r._id: r.fp for r in rows.collect()} == prints
    alone = rows.withColumn("keys", F.array("class")).cache()
    links = similar_links(docs, alone, 5, 0.8, "text")
    roots = {r.node: r.root for r in components(links).collect()}
    of = {r._id: roots.get(r["class"], r["class"]) for r in alone.collect()}
    near = [(a, b) for a, b in combinations(texts, 2) if (prints[a] ^ prints[b]).bit_count() <= 4 and shared(texts[a], texts[b]) >= 0.8]
    assert len(near) > 20 and all(of[a] == of[b] for a, b in near)
    first = {r["class"]: texts[r._id] for r in alone.collect()}
    assert all(shared(first[r.a], first[r.b]) >= 0.8 for r in links.collect())
