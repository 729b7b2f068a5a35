"""Approximate nearest neighbours: stable projections in a kd-tree, stopped by a chi-square test.

Unit vectors are projected onto ``dims`` Gaussian directions. For a point at true distance d, its squared projected distance
over d squared follows a chi-square law with ``dims`` degrees. The index is a kd-tree over the projected points; a query takes
its leaves by their distance in the projection and verifies the points in them by their true distance, until the next leaf
lies so far off that, at confidence ``p``, no closer point than the k-th found can lie there or beyond.

At scale: a first kd-tree, over the projections of a bounded sample of the rows (about ``SAMPLE``, taken by a hash of the id),
cuts the projected space into cells; all vectors are dealt by cell, large cells in chunks, and each chunk's own tree is built
once for all queries that come to it, in a task that holds one chunk and streams its queries. A query first searches the cell
it lies in, which bounds its k-th distance, and then goes only to those cells whose box the stopping test still reaches. Cells
that many queries reach are handed to several tasks. Of equal vectors only the k + 1 of least id can be an answer, so others
are no candidates: a vector that a third of the rows share costs no more than any other. Nothing but the sample's
projections passes through the driver.

Scores are exact cosines in double precision of the original vectors, summed alike for every row, so equal vectors tie
exactly; ties go to the smaller id, and all ties at the k-th score of a block are ranked before it is cut.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, as query or candidate, nor
does a null id. Vectors of different lengths are not compared. An id that repeats counts once, with the first of its vectors
in component order. An empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import reliable

SAMPLE, LEAF = 16384, 32
#: Sampled points a cell has at least; a chunk's bytes and rows at most and its rows at least; rows of a cell table that is broadcast.
CELL_SAMPLE, BLOCK_BYTES, BLOCK_ROWS, LEAST_ROWS, SMALL = 8, 64_000_000, 131_072, 2048, 16_384
EPS = 1e-9
FOUND = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, dims: int) -> float:
    """Wilson and Hilferty's approximation."""
    a = 2 / (9 * dims)
    return dims * (1 - a + NormalDist().inv_cdf(p) * a**0.5) ** 3


def projection(length: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, length]).standard_normal((length, dims))


def leaves_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A kd-tree's leaves: the order of points, each leaf's start, and its box."""
    order, starts, stack = np.arange(len(points)), [], [(0, len(points))]
    while stack:
        a, b = stack.pop()
        part = points[order[a:b]]
        if b - a <= LEAF or not (spread := np.ptp(part, axis=0)).max():
            starts.append(a)
            continue
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, spread.argmax()], middle)]
        stack += [(a + middle, b), (a, a + middle)]
    starts = np.array(sorted(starts))
    return order, starts, np.minimum.reduceat(points[order], starts), np.maximum.reduceat(points[order], starts)


def cosines(vector: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Each row summed in the same way, whatever its place."""
    return (others * vector).sum(axis=1) / np.sqrt((vector * vector).sum()) / np.sqrt((others * others).sum(axis=1))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


class Block:
    """The candidates of one chunk and their kd-tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, dims: int, seed: int):
        self.ids, self.vectors, self.units = ids, vectors, unit(vectors)
        self.directions = projection(vectors.shape[1], dims, seed)
        self.order, self.starts, self.low, self.high = leaves_of(self.units @ self.directions)
        self.ends = np.append(self.starts[1:], len(self.order))

    def search(self, asked_ids: np.ndarray, asked: np.ndarray, bounds: np.ndarray, k: int, limit: float) -> pd.DataFrame:
        """The k best of the chunk for each query, ties at the k-th score included before the cut."""
        asked_units = unit(asked)
        shadows = asked_units @ self.directions
        queries, places_of, scores = [], [], []
        for q in range(len(asked)):
            gap = np.maximum(np.maximum(self.low - shadows[q], shadows[q] - self.high), 0.0)
            away = (gap * gap).sum(axis=1)
            by = away.argsort(kind="stable")
            kth, best, places, at, leaves = bounds[q], np.empty(0), np.empty(0, dtype=np.int64), 0, 8
            while at < len(by) and away[by[at]] <= limit * (2 - 2 * kth) + EPS:
                step = by[at : at + leaves]
                at, leaves = at + len(step), 2 * leaves
                rows = np.concatenate([self.order[self.starts[x] : self.ends[x]] for x in step])
                rows = rows[self.ids[rows] != asked_ids[q]]
                near = self.units[rows] @ asked_units[q]
                best, places = np.concatenate([best, near]), np.concatenate([places, rows])
                if len(best) >= k:
                    kth = max(kth, np.partition(best, len(best) - k)[len(best) - k])
                    keep = best >= kth - EPS
                    best, places = best[keep], places[keep]
            if len(places):
                score = cosines(asked[q], self.vectors[places])
                top = np.lexsort((self.ids[places], -score))[:k]
                queries.append(np.full(len(top), asked_ids[q]))
                places_of.append(places[top])
                scores.append(score[top])
        if not queries:
            return pd.DataFrame({"query_id": asked_ids[:0], "vec_id": self.ids[:0], "score": bounds[:0]})
        return pd.DataFrame({"query_id": np.concatenate(queries), "vec_id": self.ids[np.concatenate(places_of)], "score": np.concatenate(scores)})


def cut(points: np.ndarray, least: int) -> np.ndarray:
    """A kd-tree's splits, a row each: axis, value, the rows of its lower and upper part. A leaf has axis -1 and its cell."""
    splits, cells, stack = [[-1.0, 0.0, 0.0, 0.0]], 0, [(0, points)]
    while stack:
        at, part = stack.pop()
        axis = int(np.ptp(part, axis=0).argmax()) if len(part) else 0
        value = np.median(part[:, axis]) if len(part) >= 2 * least else np.nan
        upper = part[:, axis] >= value
        if upper.all() or not upper.any():
            splits[at][1], cells = float(cells), cells + 1
            continue
        splits[at] = [float(axis), float(value), float(len(splits)), float(len(splits) + 1)]
        stack += [(len(splits) + 1, part[upper]), (len(splits), part[~upper])]
        splits += [[-1.0, 0.0, 0.0, 0.0], [-1.0, 0.0, 0.0, 0.0]]
    return np.array(splits)


def cell_of(points: np.ndarray, splits: np.ndarray) -> np.ndarray:
    at = np.zeros(len(points), dtype=np.int64)
    while (inner := np.flatnonzero(splits[at, 0] >= 0)).size:
        node = splits[at[inner]]
        upper = points[inner, node[:, 0].astype(np.int64)] >= node[:, 1]
        at[inner] = np.where(upper, node[:, 3], node[:, 2]).astype(np.int64)
    return splits[at, 1].astype(np.int64)


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """One row an id, of the vectors that take part."""
    v = F.col(vector)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def projected(rows: DataFrame, dims: int, seed: int) -> DataFrame:
    """The rows with the length of their vectors and the projection of their unit vectors."""

    @F.pandas_udf("array<double>")
    def shadow(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        for length, part in vectors.groupby(vectors.map(len)):
            points = unit(matrix(part)) @ projection(length, dims, seed)
            for i, point in zip(part.index, points, strict=True):
                out.at[i] = point
        return out

    return rows.withColumn("length", F.size("embedding")).withColumn("shadow", shadow("embedding"))


def with_cells(rows: DataFrame, n: int, block_rows: int) -> DataFrame:
    """The rows with the cell of their projection, by trees over a sample; a length that is not in the sample is one cell."""
    share = max(1, n // SAMPLE)
    sampled = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0).select("vec_id", "length", "shadow").orderBy("vec_id").limit(4 * SAMPLE).toPandas()
    least = max(CELL_SAMPLE, round(block_rows * len(sampled) / max(1, n)))
    trees = {length: cut(matrix(part), least) for length, part in sampled.groupby("length")["shadow"]}

    @F.pandas_udf("long")
    def cell(lengths: pd.Series, shadows: pd.Series) -> pd.Series:
        out = pd.Series(0, index=lengths.index, dtype="int64")
        for length, part in shadows.groupby(lengths):
            if length in trees:
                out[part.index] = cell_of(matrix(part), trees[length])
        return out

    return rows.withColumn("cell", cell("length", "shadow"))


def small(cells: DataFrame) -> DataFrame:
    """A table of cells, to be broadcast where it is counted small (where not, lengths are many and keys spread)."""
    return F.broadcast(cells) if cells.count() <= SMALL else cells


def searched(data: DataFrame, routes: DataFrame, boxes: DataFrame, k: int, dims: int, limit: float, seed: int, block_rows: int, query_rows: int) -> DataFrame:
    """The k best of each chunk for each query that ``routes`` (vec_id, embedding, bound, length, cell) sends to its cell."""
    cell, block = ["length", "cell"], ["length", "cell", "chunk", "part"]
    visits = routes.groupBy(*cell).agg(F.count("*").alias("visits"))
    load = reliable(boxes.join(visits, cell).select(*cell, F.ceil(F.col("n") / block_rows).alias("chunks"), F.ceil(F.col("visits") / query_rows).alias("parts")))
    tasks = load.agg(F.sum(F.col("chunks") * F.col("parts"))).first()[0] or 1
    load = small(load)
    whole = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    dealt = lambda count, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(count))
    kept = data.join(load, cell).withColumn("chunk", dealt("chunks", 1)).select(*block[:3], whole("parts").alias("part"), F.lit(0).alias("kind"), "vec_id", "embedding", F.lit(0.0).alias("bound"))
    sent = routes.join(load, cell).withColumn("part", dealt("parts", 2)).select(*cell, whole("chunks").alias("chunk"), "part", F.lit(1).alias("kind"), "vec_id", "embedding", "bound")
    rows = kept.unionByName(sent).repartition(min(tasks, 32_768), *block).sortWithinPartitions(*block, "kind")

    def answers(frames):
        key, held, index = None, [], None
        for frame in frames:
            for group, part in frame.groupby([*block, "kind"], sort=True):
                if group[:4] != key:
                    key, held, index = group[:4], [], None
                ids, vectors = part["vec_id"].to_numpy(), matrix(part["embedding"])
                if group[4] == 0:
                    held.append((ids, vectors))
                elif held or index:
                    if index is None:
                        index = Block(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), dims, seed)
                        held = []
                    yield index.search(ids, vectors, part["bound"].to_numpy(), k, limit)

    return rows.mapInPandas(answers, FOUND)


def top(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query, k: int = 5, *, dims: int = 12, p: float = 0.99, seed: int = 7, block_rows: int | None = None, query_rows: int = 16_384, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by cosine for the rows where ``is_query`` (a column) holds."""
    rows = reliable(projected(usable(vectors, id_col, vector), dims, seed))
    n, longest = rows.agg(F.count("*"), F.max("length")).first()
    block_rows = block_rows or max(LEAST_ROWS, min(n // 64, BLOCK_ROWS, BLOCK_BYTES // (8 * (longest or 1))))
    limit = chi_square_quantile(p, dims)
    rows = with_cells(rows, n, block_rows)
    equal = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    data = reliable(rows.withColumn("equal", equal).where(F.col("equal") <= k + 1).drop("equal"))
    corner = [f(F.col("shadow")[i]).alias(f"{name}{i}") for i in range(dims) for name, f in (("low", F.min), ("high", F.max))]
    boxes = reliable(data.groupBy("length", "cell").agg(F.count("*").alias("n"), *corner))
    queries, data = rows.where(is_query), data.drop("shadow")
    settings = (k, dims, limit, seed, block_rows, query_rows)
    first = reliable(top(searched(data, queries.withColumn("bound", F.lit(-1.0)), boxes, *settings), k))
    bounds = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-1.0)).alias("bound"))
    bounded = queries.withColumnRenamed("cell", "home").join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-1.0)))
    gaps = [F.greatest(F.col(f"low{i}") - F.col("shadow")[i], F.col("shadow")[i] - F.col(f"high{i}"), F.lit(0.0)) for i in range(dims)]
    near = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]) <= F.lit(limit) * (2 - 2 * F.col("bound")) + EPS
    routes = bounded.join(small(boxes), "length").where((F.col("cell") != F.col("home")) & near).select("vec_id", "embedding", "bound", "length", "cell")
    return top(first.drop("rank").unionByName(searched(data, routes, boxes, *settings)), k)
