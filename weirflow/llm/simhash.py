"""SimHash near-duplicates with pivot distance tables.

A fingerprint has a bit where over half the hashes of a text's word shingles have it. Equal fingerprints are one class. Each
class has its row in a pivot table: its Hamming distances to PIVOTS fixed reference fingerprints. Two fingerprints within
``near`` bits differ by at most ``near`` in every coordinate, so pairs with a larger coordinate difference are discarded, and
the survivors are verified on the fingerprints.

A pivot table alone has no key to join on: distances of unrelated fingerprints all lie near 32, and it would have to meet
all pairs. Classes are therefore met by exact keys first: 64 bits in near + 2 blocks leave at least two blocks untouched by
``near`` changes, so every link shares the key of one pair of blocks. That loses no link. Pivots then work inside a bucket.

At scale: shuffled are narrow rows (key, fingerprint, packed distances), one for each class and pair of blocks. Keys with one
class never reach Python. A bucket is searched breadth first: a fingerprint is compared only with those not reached yet,
and a bucket of m gives at most m - 1 links, so near copies are never expanded into pairs. A bucket of more than ``HOT`` is
met again by near + 1 pieces of its other bits, of which a link leaves one untouched: a row each, in far smaller buckets. What
is then still larger is split into cells of two chunks, each a task's work of its own. Components come from alternating large
and small stars over classes in the order of their least ids, so a root is its component's name; each round is checkpointed,
its joins are plain ones, which Spark splits where a hub is large. Nothing but counters reaches the driver.

Defined results: null and empty texts have fingerprint zero, linked like any other; repeated rows are in one component;
null ids are left out when a component is named (null if it has no other); an empty table gives an empty result; extra
columns are not looked at; whole texts are hashed, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import reliable, text_of, unused

PIVOTS, HOT, PAIRWISE = 16, 4096, 8
#: Hot keys up to which their table is broadcast (16 MB).
BROADCAST_KEYS = 1_000_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of every k-word shingle of the whole text, repeats included."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().translate(_LOWER).split()
    flat, n = b" ".join(w), max(len(w) - k + 1, min(1, len(w)))
    if n <= 1:
        return np.array([xxh64_intdigest(flat, 42)] * n, dtype=np.uint64)
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n]
    return np.fromiter((xxh64_intdigest(flat[a:b], 42) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint, as a signed 64-bit number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, k: int) -> Column:
    @F.arrow_udf("long")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([majority(shingle_hashes(t.as_py(), k)) for t in batch], pa.int64())

    return of(F.coalesce(text, F.lit("")))


def pivots() -> list[int]:
    return np.random.default_rng(64).integers(-(1 << 63), (1 << 63) - 1, PIVOTS, dtype=np.int64).tolist()


def with_pivot_table(classes: DataFrame) -> DataFrame:
    """d0, d1, ...: a class's distances to the pivots, eight to a long."""
    away = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long") for p in pivots()]
    packed = {}
    for at in range(0, PIVOTS, 8):
        whole = F.lit(0).cast("long")
        for i, d in enumerate(away[at : at + 8]):
            whole = whole.bitwiseOR(F.shiftleft(d, 8 * i))
        packed[f"d{at // 8}"] = whole
    return classes.withColumns(packed)


def pieces_of(bits: list[int], n: int) -> list[int]:
    """Masks (signed) of n runs of the bits."""
    masks = [sum(1 << b for b in bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def block_masks(near: int) -> list[tuple[int, list[int]]]:
    """For each pair of near + 2 blocks its mask, and the masks of near + 1 pieces of the other bits."""
    blocks, out = pieces_of(list(range(64)), near + 2), []
    for i, j in combinations(range(near + 2), 2):
        both = blocks[i] | blocks[j]
        out.append((both, pieces_of([b for b in range(64) if not both >> b & 1], near + 1)))
    return out


def block_keys(near: int) -> list[Column]:
    """A key for each pair of near + 2 blocks."""
    return [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(mask))) for t, (mask, _) in enumerate(block_masks(near))]


class Bucket:
    """Links among the classes of one key, or of the two chunks of one cell."""

    def __init__(self, fp: np.ndarray, table: np.ndarray, near: int):
        self.fp, self.table, self.near = fp, table, near

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs (a, b) link: discarded by the pivot table, coordinate after coordinate, then verified."""
        left = np.arange(max(a.size, b.size))
        pick = lambda x: x[left] if x.size > 1 else x
        for c in range(self.table.shape[1]):
            if left.size <= 16:
                break
            left = left[np.abs(self.table[pick(a), c] - self.table[pick(b), c]) <= self.near]
        return left[np.bitwise_count(self.fp[pick(a)] ^ self.fp[pick(b)]) <= self.near]

    def forest(self, rows: np.ndarray) -> list[tuple[int, int]]:
        """A spanning forest of the links, breadth first; each row is compared with the unreached ones."""
        out, unreached = [], rows
        while unreached.size:
            queue, root, unreached = [unreached[0]], unreached[0], unreached[1:]
            while queue and unreached.size:
                hit = self.linked(np.array([queue.pop()]), unreached)
                if hit.size:
                    queue += unreached[hit].tolist()
                    out += [(root, x) for x in unreached[hit].tolist()]
                    unreached = np.delete(unreached, hit)
        return out


def links_of(rows: pd.DataFrame, near: int) -> pd.DataFrame:
    """Links of whole buckets, whose rows lie together by key."""
    fp = rows["fp"].to_numpy(dtype=np.int64)
    table = np.stack([rows[f"d{i}"].to_numpy(dtype=np.int64) for i in range(PIVOTS // 8)], axis=1).copy().view(np.int8)
    bucket, key = Bucket(fp.view(np.uint64), table.astype(np.int16), near), rows["key"].to_numpy(dtype=np.int64)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    small = np.repeat(sizes <= PAIRWISE, sizes)
    found = [np.empty((0, 2), dtype=np.int64)]
    for step in range(1, PAIRWISE):
        a = np.flatnonzero(small[:-step] & (key[:-step] == key[step:])) if len(key) > step else np.empty(0, dtype=np.int64)
        if not a.size:
            break
        hit = a[bucket.linked(a, a + step)] if a.size > 1 else a[np.bitwise_count(bucket.fp[a] ^ bucket.fp[a + step]) <= near]
        found.append(np.stack([hit, hit + step], axis=1))
    for s, n in zip(starts[sizes > PAIRWISE], sizes[sizes > PAIRWISE], strict=True):
        found.append(np.array(bucket.forest(np.arange(s, s + n)), dtype=np.int64).reshape(-1, 2))
    pairs = np.concatenate(found)
    return pd.DataFrame({"a": fp[pairs[:, 0]], "b": fp[pairs[:, 1]]})


def search(buckets: DataFrame, near: int) -> DataFrame:
    """a, b: links of all buckets of ``key``; a bucket's rows come in one run of a sorted partition."""

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch])
            if rows.empty:
                continue
            open_ = rows["key"].to_numpy() == rows["key"].iloc[-1]  # the last bucket may go on in the next batch
            held, whole = rows[open_], rows[~open_]
            if len(whole):
                yield links_of(whole, near)
        if held is not None:
            yield links_of(held, near)

    return buckets.sortWithinPartitions("key").mapInPandas(searched, "a long, b long")


def counted_hot(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys that hold HOT at most; those of larger ones, with the count n, or None if there are none."""
    hot = reliable(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT))
    n_hot = hot.count()
    if not n_hot:
        return rows, None
    hot = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
    return rows.join(hot, "key", "left_anti"), rows.join(hot, "key")


def near_links(classes: DataFrame, near: int) -> DataFrame:
    """a, b: links that connect what lies within ``near`` bits of each other (no link between components, none missing)."""
    packed = [f"d{i}" for i in range(PIVOTS // 8)]
    met = lambda rows: rows.withColumn("met", F.count("*").over(Window.partitionBy("key"))).where(F.col("met") > 1)
    rows = with_pivot_table(classes.select("fp")).select("fp", *packed, F.posexplode(F.array(*block_keys(near))).alias("pair", "key"))
    normal, hot = counted_hot(rows)
    links = search(met(normal).select("key", "fp", *packed), near)
    if hot is not None:
        masks = F.array(*[F.array(*[F.lit(m) for m in rest]) for _, rest in block_masks(near)])
        inner = F.transform(F.get(masks, F.col("pair")), lambda mask, i: F.xxhash64("key", i, F.col("fp").bitwiseAND(mask)))
        normal, hot = counted_hot(hot.select("fp", *packed, F.explode(inner).alias("key")))
        links = links.union(search(met(normal).select("key", "fp", *packed), near))
    if hot is not None:
        chunks = hot.withColumn("chunks", F.ceil(F.col("n") / HOT).cast("int")).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        cells = chunks.select("fp", *packed, "key", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        cells = cells.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fp", *packed)
        links = links.union(search(cells.repartition("key"), near))
    return links.distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node of every component, by alternating large and small stars; nodes of any type with an order.

    Least neighbours are written before they are joined: each join then reads two plain exchanges, and Spark splits a hub."""
    edges = reliable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = reliable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = reliable(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        root = reliable(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(root, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = reliable(small)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, *, k: int = 4, near: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (signed) and component_id (the least doc_id reachable) of every row."""
    rows = reliable(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text), k).alias("fp")))
    name = F.struct(F.col("least").isNull().alias("none"), "least", "fp")  # classes in the order of their least ids, null last
    classes = reliable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", name.alias("name")))
    links = near_links(classes, near)
    named = links.join(classes.select(F.col("fp").alias("a"), F.col("name").alias("na")), "a").join(classes.select(F.col("fp").alias("b"), F.col("name").alias("nb")), "b")
    roots = components(named.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    owned = classes.join(roots.select(F.col("node.fp").alias("fp"), F.col("root.least").alias("component_id"), F.lit(True).alias("linked")), "fp", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("name.least"))
    owned = reliable(owned.select("fp", component.alias("component_id")))  # read by itself, the join can split a fingerprint of many copies
    return rows.join(owned, "fp").select("doc_id", "fp", "component_id")


def digest(text: str) -> Column:
    return F.xxhash64(text_of(text))


def keep_rows(docs: DataFrame, named: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row of ``docs`` for each root of ``named`` (_id, _digest, root): the least id, nulls last, then the least hash of the
    text. Texts are shuffled once, to meet the rows kept; only where id and text occur more than once are they then reduced."""
    least = named.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_digest")).alias("m"))
    own, kid, kept_digest = unused(docs, "own", "kept_id", "kept_digest")
    kept = reliable(least.select(F.col("m._id").alias(kid), F.col("m._digest").alias(kept_digest)))
    same = lambda i, d: F.col(i).eqNullSafe(F.col(kid)) & (F.col(d) == F.col(kept_digest))
    found = docs.withColumn(own, digest(text)).join(kept, same(id_col, own))
    if named.join(kept, same("_id", "_digest")).groupBy("_id", "_digest").count().where("count > 1").isEmpty():
        return found.select(*docs.columns)
    return found.dropDuplicates([id_col, own]).select(*docs.columns)


def keep_one(docs: DataFrame, *, k: int = 4, near: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with its own columns: that of the least id, nulls last, then of the least text hash."""
    rows = reliable(docs.select(F.col(id_col).alias("_id"), digest(text).alias("_digest"), fingerprint(F.col(text), k).alias("fp")))
    roots = components(near_links(reliable(rows.select("fp").distinct()), near))
    named = rows.join(roots, rows["fp"] == roots["node"], "left").select("_id", "_digest", F.coalesce("root", "fp").alias("root"))
    return keep_rows(docs, reliable(named), id_col, text)
