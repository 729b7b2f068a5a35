import random
import re

from weirflow.llm.licenses import BASE, NOTICES, SHORT, scan
from weirflow.llm.queries import op10_licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def check(rows, texts):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))


def test_base_equals_plain_search(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op10_licenses(spark, sf_dir).collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    check(rows, texts)


def test_notices_edits_and_odd_rows(spark):
    texts = {0: None, 1: "", 2: "MIT License, MIT license! mit-license", 3: "Redistribution and use in source or binary forms, with or without any modification, are permitted", 4: "x " * 50_000 + "CC BY", 5: "gnu general public gnu general public license", 6: "license mit"}
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] + [(2, texts[2], 1)], "doc_id long, text string, labels int")
    rows = scan(docs).collect()
    check(rows, texts)
    assert len(rows) == len(texts) + 1 and "bsd-text" in next(r.labels for r in rows if r.doc_id == 3)
    assert scan(spark.createDataFrame([], docs.schema)).collect() == []
    assert scan(spark.createDataFrame([(None, "the MIT license", 1)], docs.schema)).collect()[0].base_labels == "mit"


def labels_of(spark, texts):
    rows = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [set(filter(None, r.labels.split(","))) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_versions_and_families_are_told_apart(spark):
    body = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation"
    got = labels_of(spark, [
        "GNU General Public License version 2", "GNU General Public License, version 3 or later", "GNU Lesser General Public License version 3", "GNU Affero General Public License version 3",
        "GNU General Public License version 9", "x version 2 of it. GNU General Public License version 3", "Apache License, Version 2.0", "Apache License, Version 1.1", "Mozilla Public License, version 2.0",
        "Mozilla Public License 1.1", body.format("GNU General Public License"), body.format("GNU Affero General Public License"), "CC BY-SA 4.0", "CC BY 4.0",
        "GNU General (Public) Licence License version 3", "the cat sat on the mat and the dog is in the garden with any of the other cats",
    ])
    assert got == [
        {"gpl", "gpl-2.0"}, {"gpl", "gpl-3.0"}, {"lgpl"}, {"agpl"}, {"gpl"}, {"gpl", "gpl-3.0"}, {"apache", "apache-2.0"}, {"apache"}, {"mpl", "mpl-2.0"}, {"mpl"},
        {"gpl", "gpl-text"}, {"agpl"}, {"cc-by", "cc-by-sa"}, {"cc-by"}, {"gpl-3.0"}, set(),
    ]


def test_wanted_labels_of_near_notices(spark):
    clause = "GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    wanted = {
        "The program is not under the MIT License": {"mit"}, "Released under the MIT License.": {"mit", "mit-notice"}, "released under the (old) MIT license": {"mit", "mit-notice"},
        "Mozilla Public License. In version 2 0 of the browser": {"mpl"}, "Mozilla Public License, version 2.0": {"mpl", "mpl-2.0"},
        "GNU General Public License, version 2 or version 3": {"gpl", "gpl-2.0", "gpl-3.0"}, "GNU General Public License, version 3 and 2": {"gpl", "gpl-2.0", "gpl-3.0"},
        "GNU General Public License v2 or v3": {"gpl", "gpl-2.0", "gpl-3.0"}, "GNU General Public License versions 2 and 3": {"gpl", "gpl-2.0", "gpl-3.0"},
        "GNU General Public License version 2 or later. Version 3 of this program": {"gpl", "gpl-2.0"}, clause.format(3): {"gpl", "gpl-3.0"}, clause.format(2): {"gpl", "gpl-2.0"},
        clause.format(3).replace("General", "Lesser General"): {"lgpl"}, "all the rights are reserved": set(), "Creative works under Commons rules": set(),
    }
    assert dict(zip(wanted, labels_of(spark, list(wanted)), strict=True)) == wanted


def in_order(w, phrase):
    """Whether all words of the phrase stand in ``w`` in order, with at most one other word in all between them, by plain search."""
    t = phrase.split()
    gaps = [t, *(t[:i] + [None] + t[i:] for i in range(2, len(t) - 1))]
    return any(all(y is None or x == y for x, y in zip(w[i : i + len(g)], g, strict=True)) for g in gaps for i in range(len(w) - len(g) + 1))


def test_short_notices_against_plain_search_in_shuffled_words(spark):
    """Words of short notices drawn at random, most in order: a label that is no base label stands for a notice whose words are all
    there, and a whole notice has its label."""
    rng, texts = random.Random(3), []
    short = [(p, label) for p, label, _ in NOTICES if len(p.split()) <= SHORT]
    for _ in range(400):
        w = rng.choice(short)[0].split() + rng.choice(short)[0].split()
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w))
            w[i : i + rng.randrange(2)] = [rng.choice(["of", "version", "3", "license", "x"])]
        texts.append(" ".join(w))
    base = {label for _, label in BASE}
    for text, found in zip(texts, labels_of(spark, texts), strict=True):
        w = text.split()
        assert {label for p, label in short if f" {p} " in f" {text} "} <= found
        for label in found - base:
            assert any(set(p.split()) <= set(w) for p, name in short if name == label), (text, label)
        assert not any(label in found and not any(in_order(w, p) for p, name in short if name == label) for label in found - base if len(w) <= 8), text


def test_labels_hold_against_a_plain_search_for_whole_notices(spark, sf_dir):
    """Without the join: a text with all words of a notice in a row has its label; a label's own words stand near each other."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = {r.doc_id: set(r.labels.split(",")) for r in op10_licenses(spark, sf_dir).collect()}
    for d, text in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        line, near = f" {' '.join(w)} ", [f" {' '.join(w[i : i + 30])} " for i in range(len(w))]
        for phrase, label, _ in NOTICES:
            assert f" {phrase} " not in line or label in found[d]
        for label in found[d] - {"", *(label for _, label in BASE)}:
            assert any(all(f" {x} " in part for x in own.split()) for _, name, own in NOTICES if name == label for part in near)
        assert "gpl-2.0" not in found[d] or " version 2 " in line or " v2 " in line
