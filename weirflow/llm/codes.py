"""Vector code compression: product codes whose entries are found by equal-average search.

Vectors of integers are cut into equal consecutive parts; every part position has a codebook, which starts as that part of
the first vectors and is refined by rounds of assignment and integer means. The nearest entry of a part is found by sums:
entries stand in the order of their component sums, and the search goes outward from the part's own sum on both sides. For
two parts of ``width`` components the squared distance is at least (difference of the sums)^2 / width, so a side is closed
once that bound strictly exceeds the best distance so far; an equal bound is still looked at, as ties go to the lower index.

At scale: each pass is one scan without a join. A task sums its own parts by entry, so a round shuffles one number for each
component of the codebooks and task; what the driver holds are the codebooks (``entries`` times the vector's components),
whatever the table's size. Labels are summed before they are joined, and the joined table is broadcast only if counted small.

Defined results: a vector that is null or holds null or non-finite components gets no code and its row is left out, as is one
whose length differs from that of the first kept vector (least id, null ids last, then least vector) or is no multiple of
``parts``. Components beyond +-16384 count as these, so that all sums fit in 64 bits. With fewer kept vectors than ``entries``
the codebooks are that small. Repeated rows are coded each; null ids are ids like others; extra columns are carried in a
struct, whatever their names; an empty table gives an empty result and empty codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from weirflow.llm.common import reliable

#: Components as integers: floor(SCALE * x), held to +-LARGEST.
SCALE, LARGEST = 256, 1 << 22
#: Groups up to which a table of their sums is broadcast (some 50 MB); beyond, it joins by shuffle and hot groups are split.
BROADCAST_GROUPS = 500_000


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def integers(vector: Column) -> Column:
    """The components as integers; all floors go down."""
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor(x * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)).cast("long"))


def equal_average(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of every point (rows of integers); ties to the lower index."""
    n, width = points.shape
    order = np.argsort(entries.sum(axis=1), kind="stable")
    sums, own = entries.sum(axis=1)[order], points.sum(axis=1)
    best = np.full(n, np.iinfo(np.int64).max // width)
    index = np.full(n, len(entries))
    above = np.searchsorted(sums, own)
    sides = [(above, 1, np.flatnonzero(above < len(sums))), (above - 1, -1, np.flatnonzero(above > 0))]
    while any(len(rows) for _, _, rows in sides):
        for i, (at, step, rows) in enumerate(sides):
            gap = sums[at[rows]] - own[rows]
            rows = rows[gap * gap <= best[rows] * width]
            found = order[at[rows]]
            distance = ((points[rows] - entries[found]) ** 2).sum(axis=1)
            better = (distance < best[rows]) | ((distance == best[rows]) & (found < index[rows]))
            best[rows[better]], index[rows[better]] = distance[better], found[better]
            at[rows] += step
            sides[i] = (at, step, rows[(at[rows] >= 0) & (at[rows] < len(sums))])
    return index, best


def cut(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """The batch's vectors as (rows, parts, width)."""
    values = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, parts, -1)


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts, entries, width) after one round over all rows; unused entries stay."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, 1 + width), dtype="int64")
        for batch in batches:
            if batch.num_rows:
                points = cut(batch, parts)
                for p in range(parts):
                    index, _ = equal_average(points[:, p], books[p])
                    total[p, :, 0] += np.bincount(index, minlength=entries)
                    np.add.at(total[p, :, 1:], index, points[:, p])
        flat = total.reshape(-1)
        slots = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(flat[slots], pa.int64())], ["slot", "value"])

    found = rows.select("vector").mapInArrow(sums, "slot long, value long").groupBy("slot").agg(F.sum("value").alias("value"))
    total = np.zeros(books.size + parts * entries, dtype="int64")
    for r in found.collect():  # parts * entries * (1 + width) rows at most
        total[r["slot"]] = r["value"]
    total = total.reshape(parts, entries, 1 + width)
    used = total[:, :, 0] > 0
    out = books.copy()
    out[used] = total[used][:, 1:] // total[used][:, :1]
    return out


def fit(rows: DataFrame, parts: int, entries: int, rounds: int, id_col: str) -> np.ndarray:
    """Codebooks of ``rows`` (id_col, vector of integers), refined from the parts of the first rows."""
    first = rows.orderBy(F.col(id_col).asc_nulls_last(), "vector").limit(entries).collect()
    width = len(first[0]["vector"]) // parts if first else 1
    books = np.array([r["vector"] for r in first], dtype="int64").reshape(len(first), parts, width).transpose(1, 0, 2)
    for _ in range(rounds if first else 0):
        books = refined(rows, books)
    return books


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(row, code, error) of every kept vector, ``row`` a struct of all columns but the vector, ``code`` a byte a part, ``error``
    the squared distances summed over parts; and the codebooks (parts, entries, width)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: entries must be 1 to 256")
    values = F.col(vector).cast("array<double>")
    kept = vectors.where(usable(values)).withColumn(vector, values)
    first = kept.orderBy(F.col(id_col).asc_nulls_last(), vector).select(F.size(vector)).first()
    length = first[0] if first else parts
    kept = kept.where((F.size(vector) == length) & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    rows = kept.select(F.struct(*[c for c in vectors.columns if c != vector]).alias("row"), integers(F.col(vector)).alias("vector"))
    books = fit(rows.select(F.col(f"row.{id_col}").alias("id"), "vector"), parts, entries, rounds, "id")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = cut(batch, parts)
                found = [equal_average(points[:, p], books[p]) for p in range(parts)]
                codes = np.stack([index for index, _ in found], axis=1).astype("uint8")
                errors = np.sum([distance for _, distance in found], axis=0)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors, pa.int64())], ["row", "code", "error"])

    schema = StructType([rows.schema["row"], StructField("code", BinaryType()), StructField("error", LongType())])
    return rows.mapInArrow(coded, schema), books


def decompress(code: bytes, books: np.ndarray) -> list[int]:
    """The vector of integers that a code stands for."""
    return [int(x) for part, index in zip(books, code, strict=True) for x in part[index]]


def books_sha256(books: np.ndarray) -> str:
    """Digest of all entries' components, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_group_total(rows: DataFrame, key: Column, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows of an equal key, nulls together."""
    rows = reliable(rows.withColumn("_key", key))
    totals = rows.groupBy(F.col("_key").alias("_of")).agg(F.sum(value).alias(name))
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_GROUPS else totals
    return rows.join(totals, F.col("_key").eqNullSafe(F.col("_of")), "left").drop("_key", "_of")


def _assigned(n: int) -> str:
    """Parts by nearest entry of book ``n``."""
    distance = "list_sum(list_transform(range(1, len(q.x) + 1), lambda j: (q.x[j] - b.x[j]) * (q.x[j] - b.x[j])))"
    return f"""near{n} AS (SELECT n, p, x, d // 64 AS distance, d % 64 AS e FROM (SELECT q.n, q.p, any_value(q.x) AS x, min({distance}::BIGINT * 64 + b.e) AS d FROM parts q JOIN book{n} b USING (p) GROUP BY q.n, q.p))"""


def _refined(n: int) -> str:
    return f"""book{n + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{n} b LEFT JOIN (SELECT p, e, list(floor(s / c)::BIGINT ORDER BY j) AS x FROM (SELECT p, e, j, sum(x[j]) AS s, count(*) AS c FROM near{n}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS j) GROUP BY p, e, j) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"""


#: Plain search over all entries of every part.
SQL = f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda x: floor(x * 256)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT n, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) r(p)),
book0 AS (SELECT p, n - 1 AS e, x FROM parts WHERE n <= 64),
{_assigned(0)}, {_refined(0)}, {_assigned(1)}, {_refined(1)}, {_assigned(2)},
coded AS (SELECT n, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, sum(distance)::BIGINT AS error FROM near2 GROUP BY n),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (n), books"""
