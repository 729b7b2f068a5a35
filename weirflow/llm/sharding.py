"""Sharding by a minimax contiguous partition.

Rows with equal texts form an atomic group. Groups stand in the order of their text's hash; a shard is a run of groups.
The smallest capacity that ``shards`` runs can hold is found by binary search, each probe checked greedily: a shard takes
groups as long as they fit. Then the runs are cut there, so the largest shard is as small as any contiguous partition allows.

At scale: group sizes come from one aggregation with map-side sums (a hot text is one group, summed before the shuffle).
Their prefix sums are taken in blocks of the hash order: sums of the blocks (``blocks`` rows, a fixed number), then running
sums inside each block. A probe's step asks for the last prefix sum up to a target; one pass over the prefix sums answers
that for all probes of five levels of the binary search at once, so the whole search is a few dozen scans of one narrow
table, whose answers are single rows. The cuts are hash values, so every row finds its shard without a join.
Slots are dealt in (shard, hash block) pieces, of which no single task holds more than a thin slice.

Defined results: a null text has no bytes and is grouped with empty ones; repeated rows are members of one group and have
slots of their own; null ids are allowed; an empty table gives an empty result; extra columns are not looked at. A group
larger than the mean shard is kept whole, and the capacity is then its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import reliable, text_of

#: Probes of one pass: five levels of the binary search.
PROBES = 31


def measured(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the group key of every row."""
    t = text_of(text)
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(t) + F.lit(1)).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.md5(t).alias("group"))


def prefix_sums(rows: DataFrame, block_digits: int = 3) -> DataFrame:
    """group, size and end: the summed sizes of all groups up to this one, in the order of ``group``."""
    groups = rows.groupBy("group").agg(F.sum("size").alias("size")).withColumn("block", F.substring("group", 1, block_digits))
    inside = Window.partitionBy("block").orderBy("group").rowsBetween(Window.unboundedPreceding, 0)
    groups = reliable(groups.withColumn("within", F.sum("size").over(inside)))
    blocks = groups.groupBy("block").agg(F.sum("size").alias("block_size"))  # 16 ** block_digits rows at most
    before = F.sum("block_size").over(Window.orderBy("block")) - F.col("block_size")
    return groups.join(F.broadcast(blocks.select("block", before.alias("before"))), "block").select("group", "size", (F.col("before") + F.col("within")).alias("end"))


def greedy(ends: DataFrame, total: int, largest: int, capacities: list[int], shards: int) -> list[list[int]]:
    """For each capacity the ends of up to ``shards`` greedily filled runs."""
    runs: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards):
        open_ = [i for i, r in enumerate(runs) if not r or r[-1] < total]
        if not open_:
            break
        targets = {i: (runs[i][-1] if runs[i] else 0) + capacities[i] for i in open_}
        near = ends.where(F.col("end").between(min(targets.values()) - largest, max(targets.values())))
        found = near.agg(*[F.max(F.when(F.col("end") <= t, F.col("end"))).alias(f"t{i}") for i, t in targets.items()]).first()
        for i in open_:
            runs[i].append(found[f"t{i}"])
    return runs


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The least capacity, and the last group of each shard but the last."""
    ends = groups.select("size", "end")
    total, largest = ends.agg(F.max("end"), F.max("size")).first()
    if total is None:
        return 0, []
    mean = -(-total // shards)
    low, high = max(mean, largest), min(total, mean + largest)  # mean + largest always fits
    best: list[int] | None = None
    while low < high or best is None:
        steps = min(PROBES, high - low)
        probes = sorted({low + (high - low) * i // (steps + 1) for i in range(steps + 1)} | ({high} if low == high else set()))
        runs = greedy(ends, total, largest, probes, shards)
        fits = [r[-1] == total for r in runs]
        if True in fits:
            first = fits.index(True)
            high, best = probes[first], runs[first]
            low = probes[first - 1] + 1 if first else high
        else:
            low = probes[-1] + 1
    cuts = [e for e in best if e < total]
    return high, [r["group"] for r in groups.where(F.col("end").isin(cuts)).orderBy("end").select("group").collect()] if cuts else []


def with_slots(rows: DataFrame, blocks: int = 512) -> DataFrame:
    """A gapless slot from 0 in every shard."""
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("doc_id", "group"), F.lit(blocks)))
    pieces = rows.groupBy("shard", "piece").agg(F.count("*").alias("n"))  # shards * blocks rows at most
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")
    rank = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("doc_id", "group"))
    return rows.join(F.broadcast(pieces.select("shard", "piece", before.alias("before"))), ["shard", "piece"]).withColumn("slot", F.col("before") + rank - 1).drop("piece", "before")


def shard(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, group, shard and slot of every row; shards nearly equal in bytes, equal texts together."""
    rows = reliable(measured(docs, id_col=id_col, text=text))
    _, cuts = minimax_cuts(reliable(prefix_sums(rows)), shards)
    number = sum((F.col("group") > c).cast("int") for c in cuts) if cuts else F.lit(0)
    return with_slots(rows.withColumn("shard", number))


def runs_of(sizes: list[int], shards: int) -> int:
    """The least capacity by plain search over one machine's list; what the tests hold the job against."""

    def fits(capacity: int) -> bool:
        used, runs = 0, 1
        for s in sizes:
            if used + s > capacity:
                used, runs = 0, runs + 1
            used += s
        return runs <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


__all__ = ["measured", "minimax_cuts", "prefix_sums", "runs_of", "shard", "with_slots"]
