"""Language identification with language-bitmask n-gram filters.

Training counts the n-grams (orders 1 to 3, word ends marked) of every learned document's words by language. An n-gram is in
a language's profile if its relative frequency there is at least ``least`` and at least ``contrast`` of its highest in any
language; a profile so has at most 1 / ``least`` n-grams whatever the corpus. The profiles are kept in one bit-sliced Bloom
filter: each slot holds a bit for every language, and the AND of an n-gram's slots is the set of languages that contain it.
A text's votes are the per-language popcounts over all its n-grams, less the false positives expected from each language's
fill; the language with most votes is predicted, and the score grows with its lead over the second.

At scale: one pass counts, with one row per task, language and n-gram to the shuffle; the filter has a fixed number of slots
(SLOTS), so what the driver gathers and broadcasts (8 MB for each 64 languages) does not grow with the data. Prediction is
a scan without a shuffle; votes of words are kept by the worker in a table of bounded size.

Defined results: a null text, or one without a letter, is ``und`` with score 0; equal votes go to the language first in code
point order; a text none of whose n-grams is known gets the first language with score 0; without any learned language all
is ``und``. A null id counts as the empty text in the split. Repeated rows stay, an empty table gives an empty result,
extra columns are not looked at, and whole texts are read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import held, reliable, slices, unused

SLOTS, HASHES, ORDERS = 1 << 20, 4, 3
#: Words whose votes a worker keeps; distinct words that a task counts before it hands them on; words cut into n-grams at once.
CACHE_WORDS, FLUSH_WORDS, CHUNK_WORDS = 150_000, 200_000, 16_384
#: Least share of a text's n-grams of two letters and more that its language must hold. Documents of sf0.1 (the first 6,000 that
#: pass the quality rules) have 0.57 and more, nine texts of random letters 0.17 and less, one each in Finnish and Turkish, not learned, 0.29 and less.
LEAST_EVIDENCE = 0.45
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all n-grams of the words, and the word each is of."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer(("_" + "__".join(words) + "_").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    of, left = np.repeat(np.arange(len(words)), lengths), np.repeat(np.cumsum(lengths), lengths) - np.arange(lengths.sum())
    hashes, owners, h = [], [], np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, ORDERS + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        inside = (left[: len(h)] >= n) & ((codes != ord("_")) if n == 1 else True)  # a word's end alone tells nothing
        hashes.append(h[inside])
        owners.append(of[: len(h)][inside])
    x = np.concatenate(hashes)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31)), np.concatenate(owners)


def slots_of(x: np.ndarray) -> list[np.ndarray]:
    step = (x >> np.uint64(32)) | np.uint64(1)
    return [(((x & np.uint64(0xFFFFFFFF)) + np.uint64(j) * step) % np.uint64(SLOTS)).astype(np.int64) for j in range(HASHES)]


def gram_counts(train: DataFrame) -> DataFrame:
    """lang, gram (signed hash), n: counts over all texts of ``train`` (lang, text)."""

    def expand(lang: str | None, words: Counter) -> pa.RecordBatch:
        """All n-grams of the counted words, cut and summed chunk by chunk."""
        order, grams_of, counts = list(words), [np.empty(0, np.uint64)], [np.empty(0)]
        for at in range(0, len(order), CHUNK_WORDS):
            some = order[at : at + CHUNK_WORDS]
            x, of = grams(some)
            gram, where = np.unique(x, return_inverse=True)
            grams_of.append(gram)
            counts.append(np.bincount(where, weights=np.fromiter(map(words.__getitem__, some), np.float64, len(some))[of]))
        gram, where = np.unique(np.concatenate(grams_of), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate(counts), minlength=len(gram)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for part in slices(batches, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > FLUSH_WORDS:
                yield from map(expand, held, held.values())
                held.clear()
        yield from map(expand, held, held.values())

    return train.select("lang", "text").mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """The bit-sliced filter: ``masks[slice][slot]`` has a bit for each of 64 languages."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks, self.name = languages, masks, uuid.uuid4().hex
        fill = [np.count_nonzero(masks[i // 64] & np.uint64(1 << i % 64)) / SLOTS for i in range(len(languages))]
        self.false = np.array(fill) ** HASHES

    def votes(self, words: list[str]) -> np.ndarray:
        """For each word its n-grams in each language's filter and, in one more column, all its n-grams; then the same for those
        of two letters and more in words of two letters and more."""
        x, of = grams(words)
        at, longer, n = slots_of(x), sum(map(len, words)), len(self.languages) + 1  # single letters come first
        out = np.empty((len(words), 2 * n), dtype=np.float32)
        for s, mask in enumerate(self.masks):
            held = mask[at[0]]
            for a in at[1:]:
                held = held & mask[a]
            for i in range(64 * s, min(64 * s + 64, len(self.languages))):
                bit = (held >> np.uint64(i % 64)) & np.uint64(1)
                out[:, i] = np.bincount(of, weights=bit, minlength=len(words))
                out[:, n + i] = np.bincount(of[longer:], weights=bit[longer:], minlength=len(words))
        out[:, n - 1] = np.bincount(of, minlength=len(words))
        out[:, -1] = np.bincount(of[longer:], minlength=len(words))
        out[np.fromiter(map(len, words), np.int64, len(words)) < 2, n:] = 0  # a lone letter is no evidence
        return out


def confidence(votes: np.ndarray) -> np.ndarray:
    """0 without votes, else the logistic of the lead over the second in standard deviations of its count: 0.5 to 1."""
    top = np.sort(np.column_stack([votes, np.zeros(len(votes))]), axis=1)[:, -2:]
    total = top.sum(axis=1)
    return np.where(total > 0, 1 / (1 + np.exp(-(top[:, 1] - top[:, 0]) / np.sqrt(np.where(total > 0, total, 1.0)))), 0.0)


class WordVotes:
    """A worker's table of votes by word."""

    def __init__(self, filters: Filters):
        self.filters = filters
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.empty((0, 2 * len(self.filters.languages) + 2), dtype=np.float32)

    def of(self, texts: list[list[str]]) -> np.ndarray:
        """Summed votes of each list of words."""
        return self.both(texts)[:, : len(self.filters.languages) + 1]

    def both(self, texts: list[list[str]]) -> np.ndarray:
        """The same, with the votes of longer n-grams."""
        new = set().union(*texts).difference(self.at)
        if len(self.at) + len(new) > CACHE_WORDS:
            self.clear()
            new = set().union(*texts)
        if new:
            order = list(new)
            self.at.update(zip(order, range(len(self.at), len(self.at) + len(order)), strict=True))
            self.rows = np.concatenate([self.rows, *[self.filters.votes(order[i : i + CHUNK_WORDS]) for i in range(0, len(order), CHUNK_WORDS)]])
        out = np.zeros((len(texts), self.rows.shape[1]))
        for i, words in enumerate(texts):
            if words:
                out[i] = self.rows[list(map(self.at.__getitem__, words))].sum(axis=0, dtype=np.float64)
        return out


def train_filters(train: DataFrame, *, least: float = 1e-5, contrast: float = 0.5) -> Filters:
    """The filters of all learned languages, from rows of (lang, text)."""
    counts = reliable(gram_counts(train))
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    languages = sorted(totals)
    masks = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), dtype=np.uint64)
    if not languages:
        return Filters([], masks)
    numbers = counts.sparkSession.createDataFrame([(x, i, float(totals[x])) for i, x in enumerate(languages)], "lang string, number int, total double")
    rates = counts.join(F.broadcast(numbers), "lang").groupBy("gram").agg(F.collect_list(F.struct("number", (F.col("n") / F.col("total")).alias("rate"))).alias("rates"))  # a row for each language at most
    top = F.array_max(F.transform("rates", lambda r: r["rate"]))
    profile = rates.withColumn("top", top).select("gram", F.explode(F.filter("rates", lambda r: (r["rate"] >= least) & (r["rate"] >= contrast * F.col("top")))).alias("r"))
    low, step = F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1).cast("long"))
    slot = F.explode(F.array(*[F.pmod(low + j * step, F.lit(SLOTS)) for j in range(HASHES)])).alias("slot")
    bits = profile.select(slot, F.floor(F.col("r.number") / 64).cast("int").alias("slice"), F.expr("shiftleft(1L, r.number % 64)").alias("bit"))
    slots = bits.groupBy("slot", "slice").agg(F.bit_or("bit").alias("mask")).toPandas()  # SLOTS rows a slice at most
    masks[slots["slice"].to_numpy(), slots["slot"].to_numpy(dtype=np.int64)] = slots["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return Filters(languages, masks)


def prediction(docs: DataFrame, filters: Filters, text: str = "text") -> Column:
    """lang_pred, score and evidence (the share of the text's n-grams of two letters and more that the predicted language
    holds, less its false positives) as one struct."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def of(texts: list[list[str]], table: WordVotes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        filters, rows = table.filters, np.arange(len(texts))
        some = np.fromiter(map(has_letter, texts), bool, len(texts))
        if not filters.languages:
            return np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
        votes = table.both(texts)
        true, longer = (np.maximum(0.0, (v[:, :-1] - v[:, -1:] * filters.false) / (1 - filters.false)) for v in np.split(votes, 2, axis=1))
        best = true.argmax(axis=1)
        share = longer[rows, best] / np.maximum(votes[:, -1], 1.0)
        return np.where(some, best, len(filters.languages)), np.where(some, confidence(true), 0.0), np.where(some, share, 0.0)

    @F.arrow_udf("struct<lang_pred:string,score:double,evidence:double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        filters = shared.value
        table = held("word votes", filters.name, lambda: WordVotes(filters))
        names = pa.array([*filters.languages, "und"])
        for batch in batches:
            parts = [of([words_of(t) for t in part.column(0).to_pylist()], table) for part in slices([pa.RecordBatch.from_arrays([batch], names=["t"])], "t", 1_000_000)]
            best, score, evidence = (np.concatenate([np.empty(0), *x]) for x in (zip(*parts, strict=True) if parts else ((), (), ())))
            yield pa.StructArray.from_arrays([names.take(pa.array(best.astype(np.int64))), pa.array(score), pa.array(evidence)], names=["lang_pred", "score", "evidence"])

    return predicted(F.coalesce(F.col(text), F.lit("")))


def identify(docs: DataFrame, filters: Filters, *, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, in the place of any columns of these names."""
    (told,) = unused(docs, "told")
    return docs.withColumn(told, prediction(docs, filters, text)).withColumns({"lang_pred": F.col(f"{told}.lang_pred"), "score": F.col(f"{told}.score")}).drop(told)


def remainder(id_col: str, parts: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts


def learned(docs: DataFrame, id_col: str, text: str, lang: str) -> Filters:
    """Filters of the documents that aren't held out and have a language."""
    return train_filters(docs.where((remainder(id_col, 3) != 1) & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text")))


def split_and_identify(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with held_out, lang_pred and score, learned from the documents that aren't held out."""
    return identify(docs.withColumn("held_out", remainder(id_col, 3) == 1), learned(docs, id_col, text, lang), text=text)


def keep_identified(docs: DataFrame, least_score: float = 0.0, least_evidence: float = LEAST_EVIDENCE, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents whose language is told with a score over ``least_score`` and with at least ``least_evidence`` of their
    n-grams in its filter, with their own columns."""
    (told,) = unused(docs, "told")
    found = docs.withColumn(told, prediction(docs, learned(docs, id_col, text, lang), text))
    return found.where((F.col(f"{told}.lang_pred") != "und") & (F.col(f"{told}.score") > least_score) & (F.col(f"{told}.evidence") >= least_evidence)).drop(told)
