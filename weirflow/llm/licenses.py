"""License scans by diagonal voting.

All rolling word k-grams of every text are hashed and joined to the k-gram positions of license templates. A hit at
word p of a text and word t of a template votes for the diagonal p - t. Votes are counted by (text, template, diagonal);
neighbouring diagonals are merged, so that a few words put in or left out do not split a match. A span is verified word by
word: a template word is aligned if a k-gram that holds it was hit on one of the span's diagonals. Templates of up to ``SHORT``
words need all their words, longer ones ``VERIFIED`` of them; and every k-gram with one of the template's own words (a version
and its number, the word that tells one license of a family from another) must be hit, so a near match of another version or
family is none. Of several versions in a row each has its template. K-grams of function words
alone are in every English text; templates are not indexed by them. Base phrases count where one diagonal holds the whole phrase.

DataFrame functions only. The k-grams are made and joined in one stage: the template table is fixed and small (its rows are
the words below), so it is broadcast and nothing but hits is shuffled, by text; a common license line is many texts, not one
group. Rows without a hit are joined back narrow, without their texts.

Defined results: null and empty texts have no words, labels or places; repeated rows each get the same result (hits are
keyed by id and text); null ids are allowed; ties of diagonals cannot change a count; extra columns are not looked at.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm.common import bind, lower_ascii, text_of

#: The contract's phrases and labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Words of common license notices and texts, the label each adds, and the template's own words.
NOTICES = (
    ("apache license version 2 0", "apache-2.0", "apache version 2 0"),
    ("apache license 2 0", "apache-2.0", "apache 2 0"),
    ("gnu general public license version 2", "gpl-2.0", "gnu general version 2"),
    ("gnu general public license v2", "gpl-2.0", "gnu general v2"),
    ("gnu general public license version 3", "gpl-3.0", "gnu general version 3"),
    ("gnu general public license v3", "gpl-3.0", "gnu general v3"),
    ("gnu lesser general public license", "lgpl", "lesser"),
    ("gnu library general public license", "lgpl", "library"),
    ("gnu affero general public license", "agpl", "affero"),
    ("mozilla public license", "mpl", "mozilla"),
    ("mozilla public license version 2 0", "mpl-2.0", "mozilla version 2 0"),
    ("eclipse public license", "epl", "eclipse"),
    ("boost software license", "bsl", "boost"),
    ("released under the mit license", "mit-notice", ""),
    ("licensed under the mit license", "mit-notice", ""),
    ("cc by nc", "cc-by-nc", "nc"),
    ("cc by sa", "cc-by-sa", "sa"),
    ("cc by nd", "cc-by-nd", "nd"),
    ("creative commons attribution", "creative-commons", "creative attribution"),
    ("all rights reserved", "all-rights-reserved", "rights"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit-text", ""),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit-text", ""),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-text", ""),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd-text", ""),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-text", ""),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2.0", "apache 2 0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-text", "gnu general"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered"),
    ("this software is provided as is without any express or implied warranty", "zlib-text", ""),
    ("everyone is permitted to copy and distribute verbatim copies of this license document", "gpl-family-text", ""),
)
#: Words of which no k-gram of a template may consist alone.
FUNCTION_WORDS = frozenset("a an and any are as at be by can for from in into is it its may nor not of on or shall that the this to used with without you".split())
#: Words a k-gram has, diagonals apart that still merge, words up to which all of a template's must be in a verified span, and
#: the least share of a longer one's.
K, NEAR, SHORT, VERIFIED = 2, 2, 10, 0.7


def version_notices(family: str, own: str, versions: dict[str, str]) -> list[tuple[str, str, str]]:
    """Notices of a family that name several versions in a row, for the label of each, and that name one behind a relative clause."""
    out = []
    for version, label in versions.items():
        clause = f"{family} as published by the free software foundation"
        out += [(f"{clause} {either}version {version} of the license", label, f"{own} {either}version {version}") for either in ("either ", "")]
        for other in versions:
            if other != version:
                for joint in ("or", "and"):
                    out += [(f"{family} version {other} {joint} {again}{version}", label, f"{own} version {other} {joint} {version}") for again in ("", "version ")]
                    out += [(f"{family} v{other} {joint} v{version}", label, f"{own} v{other} {joint} v{version}")]
                    out += [(f"{family} versions {x} {joint} {y}", label, f"{own} versions {x} {joint} {y}") for x, y in ((version, other), (other, version))]
    return out


NOTICES += tuple(version_notices("gnu general public license", "gnu general", {"2": "gpl-2.0", "3": "gpl-3.0"}))


def template_grams() -> list[tuple]:
    """template, label, base, grams (how many are indexed), own (how many of them must be hit), size (how many words they hold),
    least (how many of these must be aligned), at, the two words of a k-gram, and whether it must be hit."""
    out = []
    for i, (phrase, label, *own) in enumerate(BASE + NOTICES):
        w, mine = phrase.split(" "), set(own[0].split()) if own else set()
        grams = [(at, a, b) for at, (a, b) in enumerate(zip(w, w[1:], strict=False)) if not {a, b} <= FUNCTION_WORDS]
        needed = [bool({a, b} & mine) for _, a, b in grams]
        size = len({at + j for at, *_ in grams for j in range(K)})
        least = size if len(w) <= SHORT else ceil(VERIFIED * size)
        out += [(i, label, i < len(BASE), len(grams), sum(needed), size, least, at, a, b, n) for (at, a, b), n in zip(grams, needed, strict=True)]
    return out


def license_words(text: Column) -> Column:
    """Letters and digits in lower case, and all beyond ASCII."""
    return F.array_remove(F.split(lower_ascii(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def gram_hashes(words: Column) -> Column:
    """One hash for each word that starts a k-gram."""
    return bind(words, lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - (K - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, K)])))


def templates(spark: SparkSession) -> DataFrame:
    """template, label, base, grams, own, size, least, at, needed, gram: the k-gram positions of all templates (a fixed table of some two hundred rows)."""
    rows = spark.createDataFrame(template_grams(), "template int, label string, base boolean, grams int, own int, size int, least int, at int, a string, b string, needed boolean")
    return rows.select("template", "label", "base", "grams", "own", "size", "least", "at", "needed", F.xxhash64("a", "b").alias("gram"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    t = text_of(text)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.md5(t).alias("digest"), license_words(t).alias("w"))
    grams = rows.select("doc_id", "digest", F.posexplode(gram_hashes(F.col("w"))).alias("place", "gram"))
    hits = grams.join(F.broadcast(templates(docs.sparkSession)), "gram")
    of = ["doc_id", "digest", "template", "label", "base", "grams", "own", "size", "least"]
    diagonals = hits.groupBy(*of, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.collect_set(F.when(F.col("needed"), F.col("at"))).alias("needs"))
    by = Window.partitionBy("doc_id", "digest", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= NEAR, 0).otherwise(1)
    merged = diagonals.withColumn("apart", apart).withColumn("span", F.sum("apart").over(by))
    whole = F.col("base") & (F.size("ats") == F.col("grams"))
    spans = merged.groupBy(*of, "span").agg(
        F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("ats")), lambda at: F.sequence(at, at + (K - 1)))))).alias("aligned"), F.size(F.array_distinct(F.flatten(F.collect_list("needs")))).alias("met"),
        F.count_if(whole).alias("places"), F.min(F.when(whole, F.col("diagonal"))).alias("first"), F.max(F.when(whole, F.col("diagonal"))).alias("last"),
    )
    found = spans.groupBy("doc_id", "digest").agg(
        F.sum("places").alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        F.sort_array(F.collect_set(F.when(F.col("places") > 0, F.col("label")))).alias("base_labels"),
        F.sort_array(F.collect_set(F.when((F.col("places") > 0) | (~F.col("base") & (F.col("aligned") >= F.col("least")) & (F.col("met") == F.col("own"))), F.col("label")))).alias("labels"),
        F.max(F.col("aligned") / F.col("size")).alias("score"),
    )
    found = found.withColumnsRenamed({"doc_id": "_id", "digest": "_digest"})
    all_rows = rows.select("doc_id", "digest", F.size("w").cast("long").alias("n_words"))
    joined = all_rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return joined.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", listed("base_labels").alias("base_labels"), listed("labels").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def sql() -> str:
    """DuckDB twin of op10, with the words of the k-grams in place of their hashes."""
    rows = ", ".join(f"({i}, '{label}', {base}, {grams}, {own}, {size}, {least}, {at}, '{a} {b}', {needed})" for i, label, base, grams, own, size, least, at, a, b, needed in template_grams())
    return rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
tg AS (SELECT * FROM (VALUES {rows}) v(template, label, base, grams, own, size, least, tpos, g, needed)),
dg AS (SELECT doc_id, i - 1 AS place, w[i] || ' ' || w[i + 1] AS g FROM (SELECT *, unnest(range(1, len(w))) AS i FROM d)),
diagonals AS (SELECT doc_id, template, label, base, grams, own, size, least, place - tpos AS diagonal, list(DISTINCT tpos) AS ats, coalesce(list(DISTINCT tpos) FILTER (WHERE needed), []) AS needs FROM dg JOIN tg USING (g) GROUP BY ALL),
apart AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {NEAR} THEN 0 ELSE 1 END AS new FROM diagonals),
merged AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM apart),
spans AS (SELECT doc_id, label, base, own, size, least, len(list_distinct(flatten(list(list_concat(ats, list_transform(ats, lambda x: x + 1)))))) AS aligned, len(list_distinct(flatten(list(needs)))) AS met, count(*) FILTER (WHERE base AND len(ats) = grams) AS places,
  min(diagonal) FILTER (WHERE base AND len(ats) = grams) AS a, max(diagonal) FILTER (WHERE base AND len(ats) = grams) AS b FROM merged GROUP BY doc_id, template, label, base, grams, own, size, least, span),
found AS (SELECT doc_id, sum(places)::BIGINT AS n_base, min(a)::BIGINT AS first_word, max(b)::BIGINT AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE places > 0) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE places > 0 OR (NOT base AND aligned >= least AND met = own)) AS labels, max(aligned / size) AS score FROM spans GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN found USING (doc_id)
"""
