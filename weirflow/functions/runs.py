"""Runs of words of texts looked up in a table of terms.

A small table goes to every task. A larger one is met by hash: texts are dealt into blocks of about BLOCK bytes; each block asks once
for every run of words that it holds, by BITS bits of the run's hash, packed by range of hashes; each range answers with its terms of
these hashes; and a block compares answers with its runs word for word, so equal hashes do no harm. What is shuffled is the texts once,
a few bytes for each different run of a block, and each term once for every block that holds it. Nothing that grows is broadcast."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text in a block, and of those whose runs share a range of hashes; bits of a hash that are asked for.
BLOCK, RANGE, BITS = 8_000_000, 64_000_000, 40
SHIFT = np.uint64(64 - BITS)


def cased(words: pa.Array, of_ascii: Callable[[pa.Array], pa.Array], of_one: Callable[[str], str]) -> pa.Array:
    """Words without line breaks in another case: ``of_ascii`` for those of ASCII, ``of_one`` for the others, all in one call."""
    other = pc.invert(pc.string_is_ascii(words))
    rest = words.filter(other)
    if not len(rest):
        return of_ascii(words)
    line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest), "\n")[0].as_py()
    return pc.replace_with_mask(of_ascii(words), other, pa.array(of_one(line).split("\n"), pa.string()))


def lowered(words: pa.Array) -> pa.Array:
    return cased(words, pc.ascii_lower, str.lower)


def in_capitals(words: pa.Array, low: pa.Array) -> np.ndarray:
    """Which words are in capitals, given their lower case."""
    return pc.and_(pc.equal(cased(words, pc.ascii_upper, str.upper), words), pc.not_equal(low, words)).to_numpy(zero_copy_only=False).astype(bool)


def different(values: np.ndarray) -> np.ndarray:
    """Each value once, in order."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def hashed(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.empty(0, np.uint64)


def joined(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a run with one more word."""
    h = run * np.uint64(0x9E3779B97F4A7C15) + word
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words between white space, and the row of each."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(real).dictionary_encode(), np.repeat(np.arange(len(n), dtype=np.int32), n)[real.to_numpy(zero_copy_only=False).astype(bool)]


def plain(words: pa.DictionaryArray, punctuation: str) -> pa.Array:
    return pc.ascii_trim(words.dictionary.cast(pa.string()), characters=punctuation)


class Words:
    """Words of texts between white space, without outer punctuation: ``number`` into ``forms`` (in lower case), the ``row`` of the
    text, the place ``at`` in it, and how many words the text has from there."""

    def __init__(self, texts: pa.Array, punctuation: str):
        coded, self.row = split(texts)
        self.number = coded.indices.to_numpy(zero_copy_only=False)
        self.count = np.bincount(self.row, minlength=len(texts)).astype(np.int32)
        self.at = np.arange(len(self.row), dtype=np.int32) - (np.cumsum(self.count, dtype=np.int32) - self.count)[self.row]
        self.left = self.count[self.row] - self.at
        written = plain(coded, punctuation)
        self.forms = lowered(written)
        self.capital = in_capitals(written, self.forms)
        self.hashes = hashed(self.forms)

    def runs(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, where they start, their hashes) of the runs of n words, for each n up to the longest; of one word, each form once."""
        word = self.hashes[self.number]
        start, run = np.arange(len(word), dtype=np.int32), word
        yield 1, np.arange(len(self.hashes), dtype=np.int32), self.hashes >> SHIFT
        for n in range(2, longest + 1):
            more = self.left[start] >= n
            start = start[more]
            if not len(start):
                return
            run = joined(run[more], word[start + n - 1])
            yield n, start, run >> SHIFT

    def same(self, n: int, start: np.ndarray, terms: pa.Array) -> np.ndarray:
        """Which of the runs are the terms beside them."""
        parts = [self.forms.take(pa.array(start if n == 1 else self.number[start + d])) for d in range(n)]
        return pc.equal(pc.binary_join_element_wise(*parts, " "), terms).to_numpy(zero_copy_only=False).astype(bool)


def packed(hashes: np.ndarray) -> bytes:
    """Hashes in order, as their differences, byte by place."""
    return pa.compress(np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * 8, "zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)


def hashes_of(terms: pa.Array) -> np.ndarray:
    """The hash of each term's words, which single blanks part."""
    lists = pc.split_pattern(terms, " ")
    sizes, word = pc.list_value_length(lists).to_numpy(zero_copy_only=False), hashed(lists.flatten())
    first = np.cumsum(sizes) - sizes
    run = word[first] if len(word) else np.empty(0, np.uint64)
    for n in range(1, sizes.max(initial=1)):
        more = np.flatnonzero(sizes > n)
        run[more] = joined(run[more], word[first[more] + n])
    return run >> SHIFT


class Table:
    """Terms in the order of their hashes, each once."""

    def __init__(self, terms: pa.Table, hashes: np.ndarray | None = None):
        hashes = hashes_of(terms.column("term").combine_chunks()) if hashes is None else hashes
        order = np.argsort(hashes, kind="stable")
        terms, hashes = terms.take(pa.array(order)), hashes[order]
        if (hashes[1:] == hashes[:-1]).any():
            coded = terms.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            once = np.sort(pd.Series(coded).drop_duplicates().index.to_numpy())
            terms, hashes = terms.take(pa.array(once)), hashes[once]
        self.terms, self.hashes = terms.combine_chunks(), hashes
        self.term = terms.column("term").combine_chunks()

    def span(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the hashes have terms, where these start, and how many they are."""
        if not len(self.hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        start = np.searchsorted(self.hashes, hashes)
        hit = np.flatnonzero(self.hashes[np.minimum(start, len(self.hashes) - 1)] == hashes)
        start = start[hit]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            return hit, start, np.searchsorted(self.hashes, hashes[hit], side="right") - start
        return hit, start, np.ones(len(hit), np.int64)


@dataclass
class Hits:
    """Where terms were found: the place among the words, the length, whether it is loud, and which term, in order of place."""

    words: Words
    place: np.ndarray
    n: np.ndarray
    loud: np.ndarray
    term: np.ndarray


def hits_of(words: Words, table: Table, longest: int) -> Hits:
    """Of terms that start at one place the longest, and none that starts inside a longer one."""
    n, term = np.zeros(len(words.row), np.int32), np.zeros(len(words.row), np.int32)
    for size, start, hashes in words.runs(longest):
        hit, first, several = table.span(hashes)
        own, start = np.full(len(hit), -1, np.int32), start[hit]
        for c in range(several.max(initial=0)):
            asked = np.flatnonzero(several > c)
            right = asked[words.same(size, start[asked], table.term.take(pa.array(first[asked] + c)))]
            own[right] = first[right] + c
        if size == 1:
            of_form = np.full(len(words.forms), -1, np.int32)
            of_form[start] = own
            start, own = np.arange(len(words.row), dtype=np.int32), of_form[words.number]
        found = own >= 0
        n[start[found]], term[start[found]] = size, own[found]
    inside = np.zeros(len(n), bool)
    for d in range(1, longest):
        inside[d:] |= n[:-d] > d
    place = np.flatnonzero((n > 0) & ~inside)
    n = n[place]
    capitals = np.concatenate([[0], np.cumsum(words.capital[words.number])]) if len(words.row) else np.zeros(1, np.int64)
    of_text = np.bincount(words.row, words.capital[words.number], len(words.count))
    mixed = (of_text > 0) & (of_text < words.count)
    return Hits(words, place, n, mixed[words.row[place]] & (capitals[place + n] - capitals[place] == n), term[place])


#: What is told of texts and their hits: (carried columns, hits, the table of terms) -> the result's columns.
Tell = Callable[[pa.Table, Hits, pa.Table], pa.Table]


def in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """In runs of rows with about BLOCK bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // BLOCK
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    yield from (batch.slice(a, b - a) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a)


def forms(rows: DataFrame, text: Column, punctuation: str) -> DataFrame:
    """The different words (term) of the texts, in lower case and without outer punctuation."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch):
                words = lowered(plain(split(part.column("_text"))[0], punctuation))
                yield pa.RecordBatch.from_arrays([pc.unique(words)], ["term"])

    return rows.select(text.alias("_text")).mapInArrow(told, "term string").distinct()


def by_small(rows: DataFrame, terms: DataFrame, longest: int, punctuation: str, tell: Tell, schema: T.StructType) -> DataFrame:
    """With the whole table in every task."""
    table = rows.sparkSession.sparkContext.broadcast(Table(terms.toArrow()))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch):
                own = pa.Table.from_batches([part])
                yield from tell(own, hits_of(Words(own.column("_text").combine_chunks(), punctuation), table.value, longest), table.value.terms).combine_chunks().to_batches()

    return rows.mapInArrow(told, schema)


def by_range(rows: DataFrame, terms: DataFrame, longest: int, punctuation: str, tell: Tell, schema: T.StructType) -> DataFrame:
    """By blocks of texts and ranges of hashes."""
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks, ranges = 1 + size // BLOCK, 1 + size // RANGE
    told_apart = [f.name for f in rows.schema if isinstance(f.dataType, T.AtomicType)]  # copies of a text are spread by what is beside them
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(*told_apart), F.lit(blocks)))
    range_of = lambda hashes: (hashes * np.uint64(ranges) >> np.uint64(BITS)).astype(np.int64)
    words_of = lambda block: Words(block.column("_text").combine_chunks(), punctuation)

    def asked(block: pa.Table) -> pa.Table:
        hashes = different(np.concatenate([different(h) for _, _, h in words_of(block).runs(longest)]))
        of = range_of(hashes)
        bounds = np.searchsorted(of, np.arange(ranges + 1))
        cut = [(r, hashes[a:b]) for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        return pa.table({"_range": pa.array([r for r, _ in cut], pa.int64()), "_of": pa.array([block.column("_block")[0].as_py()] * len(cut), pa.int64()), "_n": pa.array([len(h) for _, h in cut], pa.int64()), "_hashes": pa.array([packed(h) for _, h in cut], pa.binary())})

    def with_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = hashes_of(batch.column("term"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes.astype(np.int64)), pa.array(range_of(hashes))], [*batch.schema.names, "_hash", "_range"])

    def answered(asks: pa.Table, own: pa.Table) -> pa.Table:
        out = {"_block": [], "_n": [], "_hashes": [], "_bytes": [], "_terms": []}
        table = Table(own.drop_columns(["_hash", "_range"]), own.column("_hash").to_numpy().astype(np.uint64))
        for of, n, data in zip(*(asks.column(c).to_pylist() for c in ("_of", "_n", "_hashes")), strict=True) if len(own) else ():
            found = spread(*table.span(unpacked(data, n))[1:])
            if len(found):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.terms.schema) as to:
                    to.write_table(table.terms.take(pa.array(found)).combine_chunks())
                sent = sink.getvalue()
                for c, value in zip(out, (of, len(found), packed(table.hashes[found]), sent.size, pa.compress(sent, "zstd", asbytes=True)), strict=True):
                    out[c].append(value)
        return pa.table({c: pa.array(v, pa.binary() if c in ("_hashes", "_terms") else pa.int64()) for c, v in out.items()})

    def told(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(block):
            return schema_arrow.empty_table()
        got = [(unpacked(h, n), pa.ipc.open_stream(pa.decompress(t, size, "zstd")).read_all()) for n, h, size, t in zip(*(answers.column(c).to_pylist() for c in ("_n", "_hashes", "_bytes", "_terms")), strict=True)]
        table = Table(pa.concat_tables([t for _, t in got]), np.concatenate([h for h, _ in got])) if got else Table(terms_arrow.empty_table())
        return tell(block, hits_of(words_of(block), table, longest), table.terms)

    schema_arrow, terms_arrow = arrow_schema(rows.sparkSession, schema), arrow_schema(rows.sparkSession, terms.schema)
    asks = dealt.groupBy("_block").applyInArrow(asked, "_range long, _of long, _n long, _hashes binary")
    ranged = terms.mapInArrow(with_range, T.StructType([*terms.schema, T.StructField("_hash", T.LongType()), T.StructField("_range", T.LongType())]))
    answers = asks.groupBy("_range").cogroup(ranged.groupBy("_range")).applyInArrow(answered, "_block long, _n long, _hashes binary, _bytes long, _terms binary")
    return dealt.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(told, schema)


def arrow_schema(spark, schema: T.StructType) -> pa.Schema:
    return spark.createDataFrame([], schema).toArrow().schema
