"""Product codes against a plain search, and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import codes


@pytest.mark.parametrize("width", [1, 3, 8])
def test_search_finds_the_nearest_of_all_entries(width):
    draw = np.random.default_rng(width)
    points, entries = draw.integers(-6, 6, (400, width)), draw.integers(-6, 6, (40, width))  # many ties
    index, distance = codes.equal_average(points, entries)
    every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def plain(rows, parts=4, entries=3, rounds=2):
    """{place: (code, error)} and the books, by nested loops."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors = [[int(np.floor(256 * x)) for x in r[1]] for r in kept]
    width = len(vectors[0]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    books = [[cut(v, p) for v in vectors[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in vectors:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    return sorted((-1 if r[0] is None else r[0], bytes(near(cut(v, p), books[p])[1] for p in range(parts)), sum(near(cut(v, p), books[p])[0] for p in range(parts))) for r, v in zip(kept, vectors, strict=True)), books


def test_odd_vectors_clashing_names_and_repeats(spark):
    draw = np.random.default_rng(5)
    rows = [(i if i != 7 else None, [round(float(x), 3) for x in draw.normal(size=8)], f"t{i}") for i in range(60)]
    rows += [rows[3], rows[3], (100, None, "x"), (101, [1.0] * 7 + [None], "x"), (102, [float("nan")] * 8, "x"), (103, [float("-inf")] * 8, "x"), (104, [1.0] * 4, "x"), (105, [], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string").withColumns({"error": F.lit("e"), "row": F.lit(1), "vector": F.lit(2), "_key": F.lit(3)})
    coded, books = codes.compress(table.repartition(5), parts=4, entries=3)
    want, plain_books = plain(rows[:-2])
    got = coded.collect()
    named = lambda i: -1 if i is None else i
    assert sorted((named(r.row.vec_id), bytes(r.code), r.error) for r in got) == want and books.tolist() == plain_books
    assert all(r.row.error == "e" and r.row.vector == 2 for r in got)
    row = next(r for r in got if r.row.vec_id == 0)
    assert len(codes.decompress(bytes(row.code), books)) == 8
    empty, none = codes.compress(table.limit(0))
    assert empty.count() == 0 and none.size == 0
    few, small = codes.compress(table.where("vec_id < 2"), parts=4)
    assert few.count() == 2 and small.shape == (4, 2, 2) and all(r.error == 0 for r in few.collect())


def test_sums_over_equal_labels_join_small_and_large(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, None, 7), (4, None, 8), (5, "b", 9)], "id long, label string, error long")
    for bound in (codes.BROADCAST_GROUPS, 0):
        monkeypatch.setattr(codes, "BROADCAST_GROUPS", bound)
        got = codes.with_group_total(rows, F.col("label"), "error", "total")
        assert {r.id: r.total for r in got.collect()} == {1: 11, 2: 11, 3: 15, 4: 15, 5: 9}


def test_large_components_saturate(spark):
    rows = spark.createDataFrame([(1, [1e30, -1e30] * 8), (2, [0.5] * 16)], "vec_id long, embedding array<double>")
    coded, books = codes.compress(rows)
    assert coded.count() == 2 and abs(books).max() == codes.LARGEST
