"""Hierarchical multi-length packing.

A document's ids (with the closing id) are cut into full windows of ``WINDOW`` ids; what is left goes to the smallest tier
that holds it. Tiers are packed from long to short: the longest pending piece opens a window of its tier, the gap takes the
largest shorter pieces that fit, and what still gapes is filled by the head of a shorter piece, whose tail waits in its own
tier. So every window is full: none is padded, and lengths are powers of two. At a task's end the last pieces are laid into
windows of falling powers of two. Windows of a tier form step groups of ``STEP`` ids each, so steps carry equal loads.

Packing is local to a task: a scan without a shuffle, a pool of bounded size, ids made once. At scale a task holds millions
of ids, so the few short windows at its end don't count. A rerun of a lost task gives the same windows, as window numbers
hold the partition's number and nothing depends on other tasks.

Encoding: where white space is single blanks and line feeds between words, no pre-token spans a line feed, and lines of short
words in Latin letters are encoded from the vocabulary's ranks in one call, the same merges as the library's; of other lines
each word is encoded on its own, from a small table kept by the worker. Any other text, and any with a special token's string,
goes whole through the library. A worker holds the texts of about 4 MB at a time, whatever Spark's batches are.

Defined results: null and empty texts are the closing id alone; null ids and repeated rows are packed like others; an empty
table gives an empty result; extra columns are not looked at; texts of any length are packed whole.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import held, slices

WINDOW, LEAST_TIER, STEP = 1024, 128, 8192
#: Pending ids at which a task packs, down to the second figure.
POOL, REST = 1 << 19, 1 << 16
#: Words of the worker's table (about 200 bytes each), and the longest word kept there; the longest that ranks encode.
CACHE_WORDS, CACHED_CHARS, LONG = 50_000, 48, 200
CLOSING = b"\0\0\0\0"
_OTHER_SPACE = re.compile(r"[^\S \n]")
_LONG_WORD = re.compile(rf"(?:^|[ \n])[^ \n]{{{LONG}}}")
_NOT_LATIN = re.compile("[\u0250-\U0010ffff]")


class Table(dict):
    """Word -> ids as little-endian unsigned 32-bit integers, filled on first use and emptied when full."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class TextIds:
    """Ids of texts, as the library gives them; from the vocabulary's ranks, where given, at a fifth of its cost."""

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.merged = ranked(ranks) if ranks else None
        self.words = Table(self.word)
        self.feed = self.library("\n")

    def library(self, text: str) -> bytes:
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, text: str) -> bool:
        """Short words in Latin letters only."""
        return self.merged is not None and (text.isascii() or not _NOT_LATIN.search(text)) and not _LONG_WORD.search(text)

    def from_ranks(self, text: str) -> bytes:
        return array("I", self.merged.encode_ordinary(text)).tobytes()

    def word(self, word: str) -> bytes:
        return self.from_ranks(word) if word and self.plain(word) else self.library(word)

    def line(self, line: str) -> bytes:
        if self.plain(line):
            return self.from_ranks(line)
        first, *later = line.split(" ")
        return b"".join([self.words[first], *[self.words[" " + w] for w in later]])

    def regular(self, text: str) -> bool:
        return not (_OTHER_SPACE.search(text) or text[-1] in " \n" or any(s in text for s in ("  ", "\n\n", " \n", "\n ")) or any(s in text for s in self.special))

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.regular(text):
            return self.library(text)
        if self.plain(text):
            return self.from_ranks(text)
        return self.feed.join([self.line(x) if x else b"" for x in text.split("\n")])


def ranked(ranks: str):
    """The byte-pair encoder of a file of ranks."""
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def tier_of(n: int) -> int:
    """The smallest tier that holds ``n`` ids."""
    return max(LEAST_TIER, 1 << (n - 1).bit_length())


class Packer:
    """Packs one task's documents. A piece is (length, number, doc, start, ids, doc_tokens)."""

    def __init__(self, first_sequence: int):
        self.sequence = self.first = first_sequence
        self.pending: list[tuple] = []
        self.waiting = self.number = 0
        self.lengths: Counter = Counter()
        self.groups: dict[tuple[int, int], int] = {}
        self.out: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        n, start = len(ids) // 4, 0
        while n - start >= WINDOW:
            self.window([(WINDOW, 0, doc, start, ids[4 * start : 4 * (start + WINDOW)], n)], WINDOW)
            start += WINDOW
        if start < n:
            self.wait((n - start, 0, doc, start, ids[4 * start :], n))
        if self.waiting > POOL:
            self.pack(REST)

    def wait(self, piece: tuple) -> None:
        self.number += 1
        insort(self.pending, (piece[0], self.number, *piece[2:]))
        self.waiting += piece[0]

    def take(self, at: int) -> tuple:
        piece = self.pending.pop(at)
        self.waiting -= piece[0]
        return piece

    def cut(self, piece: tuple, n: int) -> tuple:
        """The first ``n`` ids; the others wait."""
        length, _, doc, start, ids, total = piece
        if length > n:
            self.wait((length - n, 0, doc, start + n, ids[4 * n :], total))
        return (n, 0, doc, start, ids[: 4 * n], total)

    def pack(self, rest: int) -> None:
        """Fill windows, longest pieces first, while more than ``rest`` ids wait."""
        while self.waiting > rest:
            first = self.take(-1)
            tier, row = tier_of(first[0]), [first]
            gap = tier - first[0]
            if gap > self.waiting:
                self.wait(first)
                return
            while gap:
                at = bisect_right(self.pending, (gap, self.number + 1)) - 1
                row.append(self.take(at) if at >= 0 else self.cut(self.take(0), gap))
                gap -= row[-1][0]
            self.window(row, tier)

    def finish(self) -> None:
        self.pack(0)
        while self.waiting:
            size = gap = min(WINDOW, 1 << (self.waiting.bit_length() - 1))
            row = []
            while gap:
                piece = self.take(-1)
                row.append(self.cut(piece, min(gap, piece[0])))
                gap -= row[-1][0]
            self.window(row, size)

    def window(self, row: list[tuple], size: int) -> None:
        turn = (size, self.lengths[size] * size // STEP)
        self.lengths[size] += 1
        group, offset = self.groups.setdefault(turn, self.first + len(self.groups)), 0
        for length, _, doc, start, ids, total in row:
            self.out.append((doc, start, length, ids, total, self.sequence, offset, size, group))
            offset += length
        self.sequence += 1

    def rows(self) -> pa.RecordBatch:
        columns, self.out = list(zip(*self.out, strict=True)) or [[]] * len(SCHEMA), []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SCHEMA.types, strict=True)], schema=SCHEMA)


SCHEMA = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "tier": pa.int32(), "step_group": pa.int64()})
#: Pieces that a task hands on at once.
ROWS = 5000


def pack(docs: DataFrame, path: str, ranks: str | None = None, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset, tier and step_group of every piece."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, packer = held("text ids", (path, ranks), lambda: TextIds(path, ranks)), Packer(TaskContext.get().partitionId() << 40)
        for part in slices(batches, "text"):
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                packer.add(doc, table.of(text) + CLOSING)
                if len(packer.out) >= ROWS:
                    yield packer.rows()
        packer.finish()
        yield packer.rows()

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(packed, schema)
