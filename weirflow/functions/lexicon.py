"""Terms of a table found in texts, and what is told from them: sentiment by rules, entity topics.

Terms may be phrases and the table may have any size: ``runs`` has how the texts' runs of words meet it. What is told of a text is
told where its hits are found, so these are never shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions import runs
from weirflow.functions.text import PUNCTUATION, clean_topics

#: Terms up to which every task has the whole table (some 50 MB).
BROADCAST_TERMS = 500_000

#: Weights of the published rules: capitals, fading of a booster by distance, negation, clauses around a contrast, marks.
CAPITALS, FADE, TURN, BEFORE, BEHIND = 0.733, (1.0, 0.95, 0.9), -0.74, 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS, QUESTION, MANY_QUESTIONS = 0.292, 4, 0.18, 0.96
VALENCE, BOOSTER, NEGATION, CONTRAST = 1, 2, 3, 4
KINDS = {"valence": VALENCE, "booster": BOOSTER, "negation": NEGATION, "contrast": CONTRAST}


def words_of(text: Column) -> Column:
    """Words between white space, without outer punctuation, as written."""
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), "\\s+"), ""), lambda w: F.btrim(w, F.lit(PUNCTUATION)))


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def looked_up(rows: DataFrame, terms: DataFrame, tell: runs.Tell, schema: T.StructType, longest: int | None) -> DataFrame:
    """What ``tell`` says of every row's hits. Without ``longest`` the table is counted, and one of up to BROADCAST_TERMS is small."""
    terms, small = terms.where("term IS NOT NULL"), False
    if longest is None:
        size, longest = terms.agg(F.count("*"), F.coalesce(F.max(F.size(F.split("term", " "))), F.lit(1))).first()
        small = size <= BROADCAST_TERMS
    return (runs.by_small if small else runs.by_range)(rows, terms, longest, PUNCTUATION, tell, schema)


def hits(rows: DataFrame, text: Column, terms: DataFrame, longest: int | None = None) -> DataFrame:
    """(text_key, at, n, loud, and the columns of ``terms``) of every place of a text where a run of n words is a term:
    of terms that start at one place the longest, and none that starts inside a longer one. ``loud``: its words are in
    capitals, and the text has others. Case and outer punctuation don't count; repeated terms are one, and so are copies of a text.
    ``longest``: the words of the longest term, of a table that is large and not to be counted."""

    def tell(block: pa.Table, found: runs.Hits, table: pa.Table) -> pa.Table:
        own = {"text_key": block.column("text_key").take(pa.array(found.words.row[found.place])), "at": pa.array(found.words.at[found.place], pa.int32()), "n": pa.array(found.n, pa.int32()), "loud": pa.array(found.loud)}
        return pa.table(own | {c: table.column(c).take(pa.array(found.term)) for c in table.column_names})

    texts = rows.select(text.alias("_text")).distinct().withColumn("text_key", text_key(F.col("_text")))
    fields = [T.StructField("text_key", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("loud", T.BooleanType())]
    return looked_up(texts, terms, tell, T.StructType([*fields, *terms.schema]), longest)


def sums(found: runs.Hits, kind: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The sum of each text's valences by the rules. kind and value are those of the terms."""
    words, size = found.words, len(found.words.row)
    kinds, values, loud = np.zeros(size, np.int8), np.zeros(size), np.zeros(size)
    kinds[found.place], values[found.place], loud[found.place] = kind[found.term], value[found.term], CAPITALS * found.loud
    boosters = np.where(kinds == BOOSTER, values + loud * np.sign(values), 0.0)
    v = np.flatnonzero(kinds == VALENCE)
    boost, turned = np.zeros(len(v)), np.zeros(len(v), bool)
    for d, fade in enumerate(FADE, 1):
        before = np.where(words.at[v] >= d, v - d, v)  # its own place is neither a booster nor a negation
        boost += boosters[before] * fade
        turned |= kinds[before] == NEGATION
    contrasts, first = np.flatnonzero(kinds == CONTRAST)[::-1], np.full(len(words.count), -1)
    first[words.row[contrasts]] = contrasts
    of_text = first[words.row[v]]
    clause = np.where(of_text < 0, 1.0, np.where(v < of_text, BEFORE, np.where(v > of_text, BEHIND, 1.0)))
    value = (values[v] + (loud[v] + boost) * np.sign(values[v])) * np.where(turned, TURN, 1.0) * clause
    billionths = np.zeros(len(words.count), np.int64)  # exact, so in any order the same
    np.add.at(billionths, words.row[v], (np.floor(np.abs(value) * 1e9 + 0.5) * np.sign(value)).astype(np.int64))
    return billionths / 1e9


def carried(rows: DataFrame, keep: list[str], **more: Column) -> tuple[DataFrame, list[str]]:
    """``keep`` of the rows under names of their own beside ``more``, and these names."""
    names = [f"_keep{i}" for i in range(len(keep))]
    return rows.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], *[c.alias(n) for n, c in more.items()]), names


def sentiment_by_table(rows: DataFrame, text: str, lexicon: DataFrame, keep: list[str], longest: int | None = None) -> DataFrame:
    """``keep`` of every row with sentiment_compound in [-1, 1] of its whole text. ``lexicon`` has term, kind and value: a valence;
    a booster, which adds to valences of the three words behind it, less by distance; a negation, which turns these; a contrast, the
    first of which halves what comes before it and raises what comes behind. Words in capitals in a text of mixed case weigh more,
    exclamation and question marks raise the whole. Null and empty texts and texts without a term have 0. ``longest``: as in ``hits``."""
    kind = F.coalesce(*[F.when(F.col("kind") == name, F.lit(code)) for name, code in KINDS.items()], F.lit(0)).cast("byte")
    terms = lexicon.select("term", kind.alias("kind"), F.coalesce(F.nanvl(F.col("value").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("value"))
    count = lambda mark: F.length(F.coalesce(F.col(text), F.lit(""))) - F.length(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(mark), F.lit("")))
    asked = count("?")
    raised = F.least(count("!"), F.lit(MOST_EXCLAMATIONS)) * F.lit(EXCLAMATION) + F.when(asked > 3, F.lit(MANY_QUESTIONS)).when(asked > 1, asked * F.lit(QUESTION)).otherwise(F.lit(0.0))
    slim, names = carried(rows, keep, _raised=raised, _text=F.col(text))
    own = [*names, "_raised"]

    def tell(block: pa.Table, found: runs.Hits, table: pa.Table) -> pa.Table:
        return block.select(own).append_column("_sum", pa.array(sums(found, *(table.column(c).to_numpy() for c in ("kind", "value")))))

    out = looked_up(slim, terms, tell, T.StructType([*slim.select(*own).schema, T.StructField("_sum", T.DoubleType())]), longest)
    out = out.withColumn("_s", F.col("_sum") + F.signum("_sum") * F.col("_raised"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], F.round(F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + 15), 4).alias("sentiment_compound"))


def first_names(found: runs.Hits, names: pa.Array, most: int) -> pa.Array:
    """The first names of each text, each once, in order of appearance; a null is none."""
    code = pc.fill_null(names.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)[found.term].astype(np.int64)
    named = np.flatnonzero(code >= 0)
    row = found.words.row[found.place[named]].astype(np.int64)
    first = np.flatnonzero(~pd.Series(row * (len(names) + 1) + code[named]).duplicated().to_numpy())
    n = np.bincount(row[first], minlength=len(found.words.count))
    rank = np.arange(len(first)) - (np.cumsum(n) - n)[row[first]]
    taken = first[rank < most]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.minimum(n, most))]), pa.int32()), names.take(pa.array(found.term[named[taken]])))


def topics_by_table(rows: DataFrame, text: str, patterns: DataFrame, keep: list[str], most: int = 8, longest: int | None = None) -> DataFrame:
    """``keep`` of every row with the topics of its whole text: names of the patterns (term, name) found there, the longest first
    where they overlap, in order of appearance, without noise and repeats, at most ``most``; none is an empty list. ``longest``: as
    in ``hits``."""
    terms = patterns.select("term", F.get(clean_topics(F.array("name")), F.lit(0)).alias("name"))
    slim, names = carried(rows, keep, _text=F.col(text))

    def tell(block: pa.Table, found: runs.Hits, table: pa.Table) -> pa.Table:
        return block.select(names).append_column("topics", first_names(found, table.column("name").combine_chunks(), most))

    out = looked_up(slim, terms, tell, T.StructType([*slim.select(*names).schema, T.StructField("topics", T.ArrayType(T.StringType()))]), longest)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "topics")
