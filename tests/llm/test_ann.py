import numpy as np
from pyspark.sql import functions as F

from weirflow.llm.ann import nearest
from weirflow.llm.queries import op3_nearest


def brute(rows, ask, k=5):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    out = {}
    for i in np.flatnonzero([ask(v) for v in ids]):
        s = x @ x[i]
        by = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in by]
    return out


def test_recall_against_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()], lambda v: v % 50 == 0)
    got = {}
    for r in op3_nearest(spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = sum(len({a for a, _ in want[q]} & {a for a, _ in got[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.9 * 5 * len(want)
    scores = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - scores[q][v]) < 1e-12 for q, part in got.items() for v, s in part if v in scores[q])


def test_ties_many_blocks_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0], "x") for i in range(20)] + [(i, rng.standard_normal(3).tolist(), "x") for i in range(20, 60)]
    odd = [(100, None, "x"), (150, [0.0, 0.0, 0.0], "x"), (200, [1.0, None, 2.0], "x"), (250, [float("nan"), 1.0, 1.0], "x"), (300, [float("inf"), 1.0, 1.0], "x"), (0, [1.0, 2.0, 3.0], "x"), (None, [1.0, 1.0, 1.0], "x")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score string")
    got = nearest(table, F.col("vec_id") % 50 == 0, 5, block_rows=10, query_rows=1).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0] == [1, 2, 3, 4, 5]
    assert {r.query_id for r in got} == {0, 50}
    assert [r.vec_id for r in got if r.query_id == 50] == [v for v, _ in brute([r[:2] for r in rows], lambda v: v == 50)[50]]


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).collect() == []
    assert nearest(spark.createDataFrame([(0, [1.0, 0.0])], schema), F.col("vec_id") % 50 == 0).collect() == []
    rows = nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], schema), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in rows] == [(0, 1, 1)]


def test_cells_against_brute_force_with_a_vector_that_many_rows_share(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.15 * rng.standard_normal(16)).tolist()) for i in range(600)] + [(i, centres[0].tolist()) for i in range(600, 900)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, lambda v: v % 20 == 0)
    got = {}
    for r in nearest(table, F.col("vec_id") % 20 == 0, 5, block_rows=24, query_rows=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({a for a, _ in want[q]} & set(got[q])) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    assert all(got[q] == [a for a, _ in want[q]] for q in got if q >= 600)


def test_trees_tell_every_point_a_cell():
    from weirflow.llm.ann import cell_of, cut

    points = np.vstack([np.random.default_rng(2).standard_normal((500, 4)), np.ones((300, 4))])
    cells = cell_of(points, cut(points, 20))
    assert len(set(cells.tolist())) > 10 and set(cells.tolist()) == set(range(cells.max() + 1))
    assert len(set(cells[500:].tolist())) == 1
    assert set(cell_of(points[:3], cut(points[:1], 20)).tolist()) == {0}
