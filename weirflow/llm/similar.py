"""Near-duplicates by SimHash fingerprints with pivot distance tables, and MinHash bands for what fingerprints can't reach; every
link is verified by the exact Jaccard similarity of the word-shingle sets.

Texts with equal sets are one class. Its fingerprints (``simhash``: block keys, pivot tables inside the buckets, stars) fall into
components of NEAR bits; a component is a key, so all pairs within NEAR bits are candidates, for certain. Sets shared to 0.8
differ in 9.7 of 64 bits on average, and a radius that holds them leaves block keys of three bits; for pairs beyond NEAR bits
a class has BANDS further keys of BAND_ROWS min-hashes each. Two classes that share a key of either kind are linked only if
their sets are verified to be shared to ``least`` or more. A pair shared to exactly 0.8 has no band in common with probability
(1 - 0.8^4)^24, about 3 in a million, and fewer above.

At scale: shuffled are narrow rows (key, class). Keys with one class, and keys whose classes are those of another key, are
dropped; only classes of the keys left have their sets made again from the text. A bucket is searched breadth first, so near
copies are never expanded into pairs. A bucket whose sets hold more than ``BUCKET`` bytes is split into cells of two chunks,
each a task's work of its own; workers hold the texts of about 4 MB at a time.

Defined results: null and empty texts have the empty set, equal to itself only; of a group the row with the least id is kept
(null ids last, then by the text's hash); rows that share id and text are one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import reliable, slices, text_of
from weirflow.llm.simhash import BROADCAST_KEYS, components, digest, keep_rows, majority, near_links, shingle_hashes

NEAR, BANDS, BAND_ROWS = 4, 24, 4
#: Bytes of the sets in a bucket that one task searches.
BUCKET = 32_000_000


@lru_cache(1)
def multipliers() -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 63, (BANDS * BAND_ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        x = shingles[None, at : at + 4096] * multipliers()
        least = np.minimum(least, ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ column) * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def class_of(shingles: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    n = xxh64_intdigest(shingles.astype("<u8").tobytes(), 7)
    return n - (1 << 64) if n >> 63 else n


def described(docs: DataFrame, k: int, id_col: str, text: str) -> DataFrame:
    """_id, _digest, class, bytes (of its set), fp (op4's fingerprint, of k-word shingles) and keys (bands) of every row."""
    # ids travel as text, whatever their type
    rows = docs.select(digest(text).alias("_digest"), F.col(id_col).cast("string").alias("_id"), text_of(text).alias("_text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            classes, sizes, prints, keys = [], [], [], [np.empty(0, np.int64)]
            for text in part.column("_text").to_pylist():
                shingles = shingle_hashes(text, k)
                prints.append(majority(shingles))
                shingles = np.unique(shingles)
                classes.append(class_of(shingles))
                sizes.append(8 * len(shingles))
                keys.append(band_keys(shingles))
            keyed = pa.ListArray.from_arrays(pa.array(np.arange(len(classes) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([part.column("_digest"), part.column("_id"), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), keyed], names=["_digest", "_id", "class", "bytes", "fp", "keys"])

    made = rows.mapInArrow(of, "_digest long, _id string, class long, bytes long, fp long, keys array<long>")
    return made.withColumn("_id", F.col("_id").cast(docs.schema[id_col].dataType))


def forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs shared to ``least`` or more, breadth first; each is compared with the unreached ones."""
    sizes, flat = np.array(list(map(len, sets))), np.concatenate(sets)
    starts = np.cumsum(sizes) - sizes
    out, unreached = [], np.arange(len(sets))
    while unreached.size:
        queue, unreached = [int(unreached[0])], unreached[1:]
        while queue and unreached.size:
            one = queue.pop()
            fit = np.minimum(sizes[unreached], sizes[one]) >= least * np.maximum(sizes[unreached], sizes[one]) - 1e-9
            near = unreached[fit & (sizes[unreached] > 0)]
            if not near.size or not sizes[one]:
                continue
            ends = np.cumsum(sizes[near])
            values = flat[np.repeat(starts[near] - (ends - sizes[near]), sizes[near]) + np.arange(ends[-1])]
            found = sets[one][np.minimum(np.searchsorted(sets[one], values), sizes[one] - 1)] == values
            common = np.add.reduceat(found.astype(np.int64), ends - sizes[near])
            hit = near[common >= least * (sizes[near] + sizes[one] - common) - 1e-9]
            queue += hit.tolist()
            out += [(one, int(x)) for x in hit]
            unreached = unreached[~np.isin(unreached, hit)]
    return out


def search(buckets: DataFrame, least: float) -> DataFrame:
    """a, b: verified links of all buckets of ``key`` (key, class, shingles)."""

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        names, key = rows.column("class").to_numpy(), rows.column("key").to_numpy()
        sets = [np.frombuffer(s, dtype="<u8") for s in rows.column("shingles").to_pylist()]
        bounds = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        pairs = [(a + i, a + j) for a, b in zip(bounds[:-1], bounds[1:], strict=True) for i, j in forest(sets[a:b], least)]
        at = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(names[at[:, 0]]), pa.array(names[at[:, 1]])], names=["a", "b"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last bucket may go on in the next batch
        for batch in slices(batches, "shingles", BUCKET):
            key = batch.column("key").to_numpy(zero_copy_only=False)
            open_ = int(np.argmax(key == key[-1]))
            if held and open_ == 0 and held[0].column("key")[0].as_py() == key[-1]:
                held.append(batch)
                continue
            whole = [*held, batch.slice(0, open_)]
            if sum(map(len, whole)):
                yield from links(pa.Table.from_batches(whole))
            held = [batch.slice(open_)]
        if held:
            yield from links(pa.Table.from_batches(held))

    return buckets.select("key", "class", "shingles").repartition("key").sortWithinPartitions("key").mapInArrow(searched, "a long, b long")


def fingerprint_keys(rows: DataFrame, near: int = NEAR) -> DataFrame:
    """class, bytes and key of ``rows`` (described): the component of fingerprints within ``near`` bits that holds a class."""
    owned = reliable(rows.select("class", "bytes", "fp").distinct())
    roots = components(near_links(reliable(owned.select("fp").distinct()), near))
    return owned.join(roots, owned["fp"] == roots["node"], "left").select("class", "bytes", F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key"))


def similar_links(docs: DataFrame, rows: DataFrame, k: int, least: float, text: str) -> DataFrame:
    """a, b: links that connect the classes of ``rows`` (described ``docs``) shared to ``least`` or more."""
    bands = rows.select("class", "bytes", F.explode("keys").alias("key"))
    keyed = reliable(fingerprint_keys(rows).union(bands).distinct())
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("class")).alias("x"), F.min("class").alias("lo"), F.sum("bytes").alias("weight")).where("n > 1")
    chosen = buckets.groupBy("n", "x", "lo").agg(F.min(F.struct("key", "weight")).alias("c")).select("c.key", "c.weight")
    members = reliable(keyed.join(chosen, "key").select("key", "class", "weight"))
    # copies of a text are summed up before they meet the members' classes
    asked = reliable(rows.groupBy("class").agg(F.min("_digest").alias("_digest")).join(members.select("class").distinct(), "class", "left_semi"))
    small = asked.count() <= BROADCAST_KEYS
    texts = docs.select(digest(text).alias("_digest"), text_of(text).alias("_text")).join(F.broadcast(asked) if small else asked, "_digest").select("class", "_text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            first = {c: t for c, t in zip(part.column("class").to_pylist(), part.column("_text").to_pylist(), strict=True)}
            sets = [np.unique(shingle_hashes(t, k)).astype("<u8").tobytes() for t in first.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.int64()), pa.array(sets, pa.binary())], names=["class", "shingles"])

    sets = texts.mapInArrow(made, "class long, shingles binary").dropDuplicates(["class"])
    large = members.where(F.col("weight") > BUCKET)
    if not large.isEmpty():
        chunks = large.withColumn("chunks", F.ceil(2 * F.col("weight") / BUCKET).cast("int")).withColumn("mine", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
        cells = chunks.select("class", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        cells = cells.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "class")
        members = members.where(F.col("weight") <= BUCKET).select("key", "class").union(cells)
    return search(members.join(sets, "class"), least).distinct()


def keep_similar_one(docs: DataFrame, *, k: int = 5, least: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group linked by pairs shared to ``least`` or more, with its own columns."""
    rows = reliable(described(docs, k, id_col, text))
    roots = components(similar_links(docs, rows, k, least, text))
    named = rows.join(roots, rows["class"] == roots["node"], "left").select("_id", "_digest", F.coalesce("root", "class").alias("root"))
    return keep_rows(docs, reliable(named), id_col, text)
