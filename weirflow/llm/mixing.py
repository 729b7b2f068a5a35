"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source gets a target number of words by weight, at most ``most`` times its size; the excess is shared anew by weight.
A source's documents stand in the order of a hash of id and text, cut into blocks of equal words; a document is of the block
that holds its middle word. A source's quota is the number of blocks nearest to its target, pass after pass over the permuted
blocks. The quotas of all sources are split over the output shards by a tree: each node hands its left half a
multivariate-hypergeometric draw of its blocks. A shard draws its blocks of a source as one run after those of the shards
before it, so shards hold disjoint runs; a document is taken as often as its block is drawn, and only by that. Rows of a
shard are shuffled locally by a second hash.

DataFrame functions only. At scale no text is shuffled: ids' hashes and sizes are checkpointed narrow, sums by (source, hash piece) are built on the map side, the
ends of runs are placed on them, and only the pieces that hold one are read again to find the hash value there. Which shards
draw a document is then a comparison of its hash with the row of its source. What the driver holds is a
row for each source and run; up to ``BROADCAST_SOURCES`` sources it is broadcast, beyond that joined. Of rows that share id
and text, an end can fall between; only those groups are counted on the map side and dealt out again by number, in chunks.

Defined results: null texts have size 0; a null source is a source, the last; null and repeated ids are rows like others (equal
rows are told apart by number only); sources of size 0 have target 0 unless all are (then nothing is taken); empty tables
give an empty result; extra columns are carried along, whatever their names. Reruns agree, as all randomness is hashed from
``seed``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import reliable, text_of, unused, words

WEIGHTS = (5, 2, 1)
#: Hash pieces of a source (a power of two); word blocks of the whole mix, and of a source at least; the most sources whose
#: table is broadcast; rows numbered at once.
PIECE_BITS, BLOCKS, LEAST_BLOCKS, BROADCAST_SOURCES, CHUNK = 10, 1 << 24, 4096, 10_000, 100_000
#: Documents in a run of a shard that is sorted by position.
PART_ROWS = 2048
#: What all randomness is hashed from unless told otherwise.
SEED = 11


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of all sizes by weight; none above ``most`` times its size, the excess reshared by weight."""
    out, left, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free:
        per = left / sum(weights[i] for i in free)
        full = {i for i in free if weights[i] * per > most * sizes[i]}
        for i in full or free:
            out[i] = most * sizes[i] if full else weights[i] * per
        if not full:
            break
        left -= sum(out[i] for i in full)
        free -= full
    return out


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Block quotas of each shard: the splitting tree."""
    if shards == 1:
        return [quotas]
    left = shards // 2
    drawn = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * left // shards) if quotas.sum() else quotas
    return split(drawn, left, rng) + split(quotas - drawn, shards - left, rng)


def source_key(source: Column) -> Column:
    """Never null, and distinct for a null source."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("-"))


def keyed(docs: DataFrame, id_col: str, text: str, source: str, seed: int) -> DataFrame:
    """row (all columns of docs), size (words), source, key (permuting hash) and piece (its first bits)."""
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.size(words(text_of(text))).cast("long").alias("size"), source_key(F.col(source)).alias("source"), key.alias("key"))
    return rows.withColumn("piece", F.shiftright("key", 64 - PIECE_BITS))


def plan(rows: DataFrame, shards: int, most: float, seed: int) -> list[dict]:
    """A dict for each source: size, target and the (pass, words) at which the run of each shard ends."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    order = sorted(found, key=lambda r: (r["source"] == "-", r["source"]))
    sizes = [r["size"] for r in order]
    total = sum(sizes)
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))], most) if total else [0.0] * len(sizes)
    least = max(1, min(LEAST_BLOCKS, (1 << 27) // max(1, len(sizes))))
    blocks = [max(least, round(BLOCKS * s / total)) if s else 0 for s in sizes]
    quotas = np.array([min(round(g / s * b), int(most * b)) if s else 0 for g, s, b in zip(goal, sizes, blocks, strict=True)], dtype=np.int64)
    ends = np.cumsum(split(quotas, shards, np.random.default_rng(seed)), axis=0) if len(order) else []
    return [
        {"source": r["source"], "size": s, "target": g, "ends": [(int(e[i]) // b, int(e[i]) % b * s / b) if b else (0, 0.0) for e in ends]}
        for i, (r, s, g, b) in enumerate(zip(order, sizes, goal, blocks, strict=True))
    ]


def cut_keys(rows: DataFrame, cuts: list[tuple[str, int, float]]) -> dict[tuple[str, int], tuple[int, int, int]]:
    """For each (source, number, words) the hash at which so many words are reached, how many of the rows there have their
    middle before the cut, and how many there are."""
    pieces = rows.groupBy("source", "piece").agg(F.sum("size").alias("n"))
    pieces = pieces.withColumn("end", F.sum("n").over(Window.partitionBy("source").orderBy("piece"))).withColumn("start", F.col("end") - F.col("n"))
    asked = rows.sparkSession.createDataFrame(cuts, "source string, cut int, words double")
    held = pieces.join(asked, "source").where((F.col("start") <= F.col("words")) & (F.col("words") < F.col("end"))).select("source", "piece", "start", "cut", "words")
    near = held.select("source", "piece").distinct()
    keys = rows.join(F.broadcast(near) if len(cuts) <= 16 * BROADCAST_SOURCES else near, ["source", "piece"], "left_semi").groupBy("source", "piece", "key").agg(F.sum("size").alias("n"), F.count("*").alias("m"))
    within = F.sum("n").over(Window.partitionBy("source", "piece").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    found = held.join(keys.withColumn("within", within), ["source", "piece"]).where(F.col("start") + F.col("within") > F.col("words"))
    left = F.col("words") - (F.col("start") + F.col("within") - F.col("n"))
    before = F.least(F.greatest(F.ceil(left * F.col("m") / F.col("n") - 0.5), F.lit(0)), F.col("m"))
    first = found.groupBy("source", "cut").agg(F.min(F.struct("key", before.alias("before"), "m")).alias("f"))
    return {(r["source"], r["cut"]): (r["f"]["key"], int(r["f"]["before"]), r["f"]["m"]) for r in first.collect()}


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``turn``, from 0 up among those of a (source, key). Equal rows are counted, not gathered."""
    variants = rows.groupBy("row", "size", "source", "key").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "key").orderBy(F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = variants.withColumn("before", before).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK)))).repartition("key", "chunk")
    turns = F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1)
    return chunks.select("row", "size", "source", "key", "before", F.explode(turns).alias("at")).select("row", "size", "source", "key", (F.col("before") + F.col("at")).alias("turn"))


def mix(docs: DataFrame, shards: int = 8, *, most: float = 3.0, seed: int = SEED, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """row (the columns of docs), size, source_size, target, key, turn and shards: of each time that a row is drawn, the shard."""
    wide = keyed(docs, id_col, text, source, seed)
    rows = reliable(wide.select("source", "piece", "key", "size"))
    sources = plan(rows, shards, most, seed)
    cuts = [(s["source"], i, float(words)) for s in sources if s["size"] for i, (_, words) in enumerate(s["ends"]) if words > 0]
    keys = cut_keys(rows, cuts) if cuts else {}
    none = (None, 0, 0)
    table, shared = [], 0
    for s in sources:
        at = [(p, *keys.get((s["source"], i), none)) for i, (p, _) in enumerate(s["ends"])]
        halved = sorted({key for _, key, before, m in at if 0 < before < m})
        shared += len(halved)
        table.append((s["source"], s["size"], float(s["target"]), [(p, key, before) for p, key, before, _ in at], halved))
    table = docs.sparkSession.createDataFrame(table, "source string, source_size long, target double, ends array<struct<pass:int,key:bigint,before:bigint>>, halved array<bigint>")
    table = F.broadcast(table) if len(sources) <= BROADCAST_SOURCES else table
    joined = wide.drop("piece").join(table, "source")
    if shared:
        apart = F.array_contains("halved", F.col("key"))
        own = numbered(joined.where(apart).select("row", "size", "source", "key")).join(table, "source")
        joined = joined.where(~apart).withColumn("turn", F.lit(0).cast("long")).unionByName(own)
    else:
        joined = joined.withColumn("turn", F.lit(0).cast("long"))

    def drawn_before(end: Column, turn: Column) -> Column:
        """Whether the run ends after this pass of the row."""
        inside = (F.col("key") < end["key"]) | ((F.col("key") == end["key"]) & (F.col("turn") < end["before"]))
        return (end["pass"] > turn) | ((end["pass"] == turn) & F.coalesce(inside, F.lit(False)))

    # pass t of a row is drawn by the first shard whose run ends after it
    passes = F.array(*[F.lit(t) for t in range(int(most) + 1)])
    past = F.transform(passes, lambda t: F.size(F.filter("ends", lambda e: ~drawn_before(e, t))))
    drawn = F.when(F.col("source_size") > 0, F.filter(past, lambda shard: shard < shards)).otherwise(F.array().cast("array<int>"))
    return joined.select("row", "size", "source_size", "target", "key", "turn", drawn.alias("shards"))


def position(seed: int, copy: Column) -> Column:
    """Where a copy stands in its shard: the sort key of the local shuffle."""
    return F.xxhash64(F.lit(seed + 1), F.col("key"), F.col("turn"), copy)


def mixed_rows(docs: DataFrame, shards: int = 8, *, seed: int = SEED, **options) -> DataFrame:
    """The mix itself: docs' columns once for every copy taken, with shard and position (the local shuffle's sort key); columns
    of docs with these names stay, and the new ones get an underscore."""
    drawn = mix(docs, shards, seed=seed, **options)
    copies = drawn.select("row", "key", "turn", F.posexplode("shards").alias("copy", "shard"))
    shard, place = unused(docs, "shard", "position")
    return copies.select("row.*", F.col("shard").alias(shard), position(seed, F.col("copy")).alias(place))


def shuffled_rows(docs: DataFrame, shards: int = 8, *, part_rows: int = PART_ROWS, **options) -> DataFrame:
    """The mix with every shard in the order of its positions. A shard is cut by position into runs of about ``part_rows``
    documents, so no task holds a large shard; a run lies in one partition, sorted."""
    runs = max(1, -(-docs.count() // (shards * part_rows)))
    shard, place, name = unused(docs, "shard", "position", "run")
    # the highest 31 bits of the position, from 0 up, give its run
    run = F.floor((F.shiftright(place, 33) + F.lit(1 << 30)) * runs / F.lit(float(1 << 31))).cast("int")
    dealt = mixed_rows(docs, shards, **options).withColumn(name, run).repartition(shards * runs, shard, name)
    return dealt.sortWithinPartitions(shard, place).drop(name)
