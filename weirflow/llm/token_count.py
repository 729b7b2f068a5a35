"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut where no merge can reach (before a run of spaces, around line feeds), and each unit is merged on its own: the
adjacent pairs sit in a heap by rank, ties to the left, symbols in a doubly linked list. Popping the best pair joins two
symbols and offers at most two new pairs, so a unit of n characters costs O(n log n). The count is the number of initial
symbols minus the merges; no identifiers are made. Characters outside the vocabulary count as their UTF-8 bytes.

Units repeat, so each Python worker keeps the counts of short ones in a table of bounded size. Documents are independent
rows: the job is one scan without a shuffle, and a lost task is simply run again.

Defined results: null and empty texts have 0 tokens and 0 bytes; repeated rows stay; other columns are carried, but those named
n_bytes, n_tokens or over_limit are replaced; an empty table gives an empty result; a text of any length is counted whole: a unit
beyond 65,536 characters is merged in windows that close where no merge can cross, so only a window's symbols are held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.pieces import WINDOW, Merging

#: Entries of a worker's table of unit counts (about 150 bytes each), and the longest unit kept there.
CACHE_UNITS, CACHED_CHARS = 600_000, 48
_UNIT = re.compile(" +[^ \n]*|[^ \n]+|\n")


def merge_count(word: str, score: dict[str, float]) -> int:
    """Tokens of one unit: initial symbols minus merges."""
    n = len(word)
    symbols = list(word)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        s = score.get(word[i : i + 2])
        if s is not None:
            heap.append((-s, i, i + 1, 2))
    heapify(heap)
    merges = 0
    while heap:
        _, i, j, size = heappop(heap)
        a, b = symbols[i], symbols[j]
        if not a or not b or len(a) + len(b) != size:
            continue  # one side has been merged since
        symbols[i], symbols[j] = a + b, ""
        merges += 1
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
            pair = symbols[i] + symbols[k]
            s = score.get(pair)
            if s is not None:
                heappush(heap, (-s, i, k, len(pair)))
        h = before[i]
        if h >= 0:
            pair = symbols[h] + symbols[i]
            s = score.get(pair)
            if s is not None:
                heappush(heap, (-s, h, i, len(pair)))
    return n - merges + sum(len(s.encode()) - 1 for s in symbols if s and s not in score)


class UnitCounts(dict):
    """Unit (space for the word mark) -> tokens, filled on first use and emptied when full."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        special = (model.is_control, model.is_unknown, model.is_byte)
        self.score = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)}

    def __missing__(self, unit: str) -> int:
        marked = unit.replace(" ", "▁")
        n = merge_count(marked, self.score) if len(unit) <= WINDOW else sum(1 if p in self.score else len(p.encode()) for p in Merging(self.score).pieces(marked))
        if len(unit) <= CACHED_CHARS:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[unit] = n
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, _UNIT.findall(" " + text.replace("▁", " "))))


@lru_cache(maxsize=2)
def unit_counts(model_path: str) -> UnitCounts:
    """The worker's table for a model; it outlives a task."""
    return UnitCounts(model_path)


def token_count(text: Column, model_path: str) -> Column:
    """Number of tokens of a whole text under a byte-pair model with byte fallback."""

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = unit_counts(model_path)
        for batch in texts:
            yield pd.Series([table.of(t) for t in batch], dtype="int64")

    return counted(text)


def with_token_counts(docs: DataFrame, model_path: str, *, text: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""
    return docs.withColumns({"n_bytes": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"), "n_tokens": token_count(F.coalesce(F.col(text), F.lit("")), model_path)}).withColumn("over_limit", F.col("n_tokens") > limit)
