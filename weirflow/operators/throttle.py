"""Token buckets over time lines of any length.

A bucket holds at most ``size`` tokens and gains them with time; a row goes through if a token is there, and takes it. Each
decision depends on the one before, but what a stretch of rows does to the level is a function of the level it starts with: one
of few pieces, each the level plus a constant, or a constant where the bucket was full on the way (a gap that fills it makes the
whole function one constant, so nothing before such a gap matters). These functions compose. So a platform's rows are numbered by
ranges, dealt in blocks, each block's function is found on its own, functions of neighbouring blocks are composed level by level,
the levels at the start of every block come back down, and the blocks are decided side by side. Levels are integers (``TOKEN`` to
a token), so the result is the plain walk's, whatever the blocks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.numbering import numbered
from weirflow.operators.state import kept

#: Parts of a token.
TOKEN = 10**12

#: A function of the level: (from this level on, 1 to add the value or 0 to be it, value), in ascending order from 0.
Pieces = list[tuple[int, int, int]]


def refill_of(rate: float, burst_seconds: float) -> tuple[int, int]:
    """Parts gained a microsecond, and the size of the bucket, of ``rate`` tokens a second."""
    return round(rate * TOKEN / 1e6), max(TOKEN, round(rate * burst_seconds * TOKEN))


def taken(level: int) -> int:
    return level - TOKEN if level >= TOKEN else level


def put(pieces: Pieces, start: int, slope: int, value: int) -> None:
    if not pieces or pieces[-1][1:] != (slope, value):
        pieces.append((start, slope, value))


def after_row(pieces: Pieces, gain: int, size: int) -> Pieces:
    """The function, and then a row that comes ``gain`` parts later."""
    out: Pieces = []
    for i, (start, slope, value) in enumerate(pieces):
        if not slope:
            put(out, start, 0, taken(min(size, value + gain)))
            continue
        end = pieces[i + 1][0] if i + 1 < len(pieces) else size + 1
        shift = value + gain
        enough, full = (min(max(start, bound - shift), end) for bound in (TOKEN, size))
        for a, b, piece in ((start, enough, (1, shift)), (enough, full, (1, shift - TOKEN)), (full, end, (0, size - TOKEN))):
            if a < b:
                put(out, a, *piece)
    return out


def applied(pieces: Pieces, level: int) -> int:
    _, slope, value = pieces[bisect_right(pieces, level, key=lambda p: p[0]) - 1]
    return level * slope + value


def composed(first: Pieces, second: Pieces, size: int) -> Pieces:
    """``first`` and then ``second``."""
    out: Pieces = []
    for i, (start, slope, value) in enumerate(first):
        if not slope:
            put(out, start, 0, applied(second, value))
            continue
        end = first[i + 1][0] if i + 1 < len(first) else size + 1
        for j, (low, s, v) in enumerate(second):
            high = second[j + 1][0] if j + 1 < len(second) else size + 1
            a, b = max(start, low - value), min(end, high - value)
            if a < b:
                put(out, a, s, v + value * s)
    return out


def flat(pieces: Pieces) -> list[int]:
    return [x for piece in pieces for x in piece]


def deep(values: list[int]) -> Pieces:
    return [tuple(map(int, values[i : i + 3])) for i in range(0, len(values), 3)]


IDENTITY: Pieces = [(0, 1, 0)]


def lookup(values: dict[str, int], platform: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), platform)


def in_blocks(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a block side by side and in order, for a task that reads them once."""
    return rows.repartition("platform", "block").sortWithinPartitions("platform", "block", *keys)


def functions_of(rows: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """platform, block and the function of each block's rows (n, gain)."""

    def found(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, pieces = None, IDENTITY
        for part in parts:
            out = []
            for platform, block, gain in zip(part["platform"], part["block"], part["gain"], strict=True):
                if (platform, block) != now:
                    out += [(*now, flat(pieces))] if now else []
                    now, pieces = (platform, block), IDENTITY
                pieces = after_row(pieces, int(gain), sizes[platform])
            yield pd.DataFrame(out, columns=["platform", "block", "pieces"])
        if now:
            yield pd.DataFrame([(*now, flat(pieces))], columns=["platform", "block", "pieces"])

    return in_blocks(rows.select("platform", "block", "n", "gain"), "n").mapInPandas(found, "platform string, block long, pieces array<long>")


def levels_of(functions: DataFrame, sizes: dict[str, int], starts: dict[str, int], fan: int) -> DataFrame:
    """platform, block, level: the level at the start of each block. Up to ``fan`` neighbours are composed by one task; their
    functions are blocks again, until a platform has no more than ``fan``."""
    functions = kept(functions)
    if (functions.agg(F.max("block")).first()[0] or 0) < fan:
        given = functions.withColumns({"parent": F.lit(0).cast("long"), "level": lookup(starts, F.col("platform")).cast("long")})
    else:

        def joined(part: pd.DataFrame) -> pd.DataFrame:
            pieces = IDENTITY
            for values in part.sort_values("block")["pieces"]:
                pieces = composed(pieces, deep(values), sizes[part["platform"].iloc[0]])
            return pd.DataFrame([(part["platform"].iloc[0], part["parent"].iloc[0], flat(pieces))], columns=["platform", "block", "pieces"])

        children = functions.withColumn("parent", F.floor(F.col("block") / fan))
        parents = children.groupBy("platform", "parent").applyInPandas(joined, "platform string, block long, pieces array<long>")
        above = levels_of(parents, sizes, starts, fan).withColumnRenamed("block", "parent")
        given = children.join(above, ["platform", "parent"])

    def walked(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        level, out = int(part["level"].iloc[0]), []
        for values in part["pieces"]:
            out.append(level)
            level = applied(deep(values), level)
        return pd.DataFrame({"platform": part["platform"], "block": part["block"], "level": out})

    return given.groupBy("platform", "parent").applyInPandas(walked, "platform string, block long, level long")


def metered(rows: DataFrame, rates: dict[str, float], *, burst_seconds: float = 3.0, state: dict[str, tuple[int, int]] | None = None, block: int = 4096, fan: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(rows that go through, the buckets after them: platform, level, at), for the platforms with a rate of 0 or more; others go
    through unmetered. Rows are taken by (captured_at, seq); ``state`` (platform: level, last time in microseconds) is what an
    earlier call left, and rows older than it refill nothing. Rows without a time come last and refill nothing."""
    rates = {p: r for p, r in rates.items() if r >= 0}
    free = ~F.coalesce(F.col("platform").isin(list(rates)), F.lit(False))
    if not rates:
        return rows, rows.sparkSession.createDataFrame([], "platform string, level long, at long")
    of = {p: refill_of(r, burst_seconds) for p, r in rates.items()}
    sizes = {p: size for p, (_, size) in of.items()}
    starts = {p: (state or {}).get(p, (size, 0))[0] for p, size in sizes.items()}
    last = {p: (state or {}).get(p, (0, -(2**62)))[1] for p in sizes}
    told = rows.where(~free)
    held = numbered(told, ["platform"], [F.col("captured_at").asc_nulls_last(), F.col("seq").asc()], "_n")
    held = kept(held.withColumn("_block", F.floor((F.col("_n") - 1) / block)))
    slim = held.select("platform", F.col("_block").alias("block"), F.col("_n").alias("n"), F.greatest(F.unix_micros("captured_at"), lookup(last, F.col("platform"))).alias("at"), F.col("captured_at").isNotNull().alias("timed"))
    # a block's first row meets the last time of the block before it; the very first meets the state's, or itself
    ends = slim.groupBy("platform", "block").agg(F.max("at").alias("end"))
    before = ends.select("platform", (F.col("block") + 1).alias("block"), F.col("end").alias("before"))
    timed = slim.join(before, ["platform", "block"], "left")
    known = lookup({p: (last[p] if p in (state or {}) else 2**62) for p in sizes}, F.col("platform"))
    w = Window.partitionBy("platform", "block").orderBy("n")
    gap = F.col("at") - F.coalesce(F.lag("at").over(w), F.when(F.col("n") > 1, F.col("before")).otherwise(F.least(known, F.col("at"))))
    longest = lookup({p: -(-size // max(1, per)) for p, (per, size) in of.items()}, F.col("platform"))
    gap = F.when(F.col("timed"), F.greatest(gap, F.lit(0))).otherwise(F.lit(0))
    gain = F.least(gap, longest) * lookup({p: per for p, (per, _) in of.items()}, F.col("platform"))
    timed = kept(timed.withColumn("gain", F.least(gain, lookup(sizes, F.col("platform")))))
    functions = kept(functions_of(timed, sizes))
    levels = kept(levels_of(functions, sizes, starts, fan))

    def decided(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, level = None, 0
        for part in parts:
            through = []
            for platform, b, gain, start in zip(part["platform"], part["block"], part["gain"], part["level"], strict=True):
                if (platform, b) != now:
                    now, level = (platform, b), int(start)
                filled = min(sizes[platform], level + int(gain))
                level = taken(filled)
                through.append(filled >= TOKEN)
            yield part.loc[through, ["platform", "block", "n"]]

    through = in_blocks(timed.join(levels, ["platform", "block"]).select("platform", "block", "n", "gain", "level"), "n").mapInPandas(decided, "platform string, block long, n long")
    through = through.select(F.col("platform").alias("_p"), F.col("block").alias("_b"), F.col("n").alias("_m"))
    admitted = held.join(through, (F.col("platform") == F.col("_p")) & (F.col("_block") == F.col("_b")) & (F.col("_n") == F.col("_m")), "left_semi").select(*rows.columns)

    @F.udf("long")
    def end_level(pieces: list[int], level: int) -> int:
        return applied(deep(pieces), level)

    final = functions.join(levels, ["platform", "block"]).join(ends, ["platform", "block"]).groupBy("platform").agg(F.max_by(F.struct("pieces", "level"), "block").alias("l"), F.max("end").alias("at"))
    return admitted.unionByName(rows.where(free)), final.select("platform", end_level("l.pieces", "l.level").alias("level"), "at")


def token_bucket(rows: DataFrame, rates: dict[str, float], *, burst_seconds: float = 3.0, block: int = 4096, fan: int = 1024) -> DataFrame:
    """Rows that a bucket of each platform lets through, by event time: refilled at the platform's rate, holding
    ``burst_seconds`` of it; no rate or a negative one lets all through."""
    return metered(rows, rates, burst_seconds=burst_seconds, block=block, fan=fan)[0]
