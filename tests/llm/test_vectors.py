"""Operator 3 against brute force."""

import numpy as np
import pyarrow.parquet as pq
from helpers import SF, save
from pyspark.sql import functions as F

import __spark_entry__ as E
from tactica.llm import ann


def brute(rows, asks, k):
    """query_id -> [(vec_id, score)] of the k largest inner products, ties to the smaller id."""
    clean = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v)
             and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in clean:
        if asks(q):
            best = sorted(((float((x * y).sum()), i) for i, y in clean if i != q), key=lambda p: (-p[0], p[1]))
            out[q] = [(i, s) for s, i in best[:k]]
    return out


def result(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_chi_square_quantile():
    # fixed values from tables of the distribution
    for p, m, x in ((0.95, 8, 15.507), (0.99, 4, 13.277), (0.5, 10, 9.342)):
        assert abs(ann.chi_square_quantile(p, m) - x) < 2e-3


def test_op3_recall(spark):
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    want = brute(list(zip(table["vec_id"], table["embedding"])), lambda i: i % 20 == 0, 20)
    got = result(E.queries()["op3_nearest_neighbours"](spark, "/root/testdata/sf0.1"))
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    assert recall(got, want) >= 0.95
    exact = {q: dict(w) for q, w in want.items()}
    assert all(abs(s - exact[q][i]) < 1e-9 for q, g in got.items() for i, s in g if i in exact[q])


def test_many_cells_and_groups(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 24)) * 2
    rows = [(i, (centres[i % 12] + rng.standard_normal(24)).astype("float32").tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = result(ann.nearest(df, F.col("vec_id") % 10 == 0, k=10, cell_rows=100, group_queries=40))
    want = brute(rows, lambda i: i % 10 == 0, 10)
    assert recall(got, want) >= 0.93 and all(len(g) == 10 for g in got.values())


def test_ties_and_bad_vectors(spark, tmp_path):
    same = [1.0, 2.0, 0.5]
    rows = [(i, same) for i in range(0, 90)] + [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 2.0]), (160, [1.0, float("nan"), 0.0]),
            (180, [float("inf"), 0.0, 0.0]), (200, [9.0, 0.0, 0.0]), (201, [-1.0, 0.0, 0.0]), (None, same)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = result(ann.nearest(df, F.col("vec_id") % 20 == 0, k=20, cell_rows=16))
    want = brute(rows, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want)
    assert [i for i, _ in got[0]] == [200, *range(1, 20)] and got == want
    few = df.where("vec_id IN (20, 21, 22)")
    assert [i for i, _ in result(ann.nearest(few, F.col("vec_id") % 20 == 0))[20]] == [21, 22]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    folder = save(spark, tmp_path, embeddings=df.limit(0).drop("score"))
    assert E.queries()["op3_nearest_neighbours"](spark, folder).columns == ["query_id", "rank", "vec_id", "score"]


def test_query_row_repeated_beside_equal_vectors(spark):
    rng = np.random.default_rng(8)
    same = [3.0, 1.0, 2.0]
    rows = [(20, same)] * 30 + [(i, same) for i in (21, 22, 22, 22, 23, 40)] + [(41, same)] * 9
    rows += [(i, (rng.standard_normal(3) / 4).tolist()) for i in range(101, 140) if i % 20]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(ann.nearest(df, F.col("vec_id") % 20 == 0, k=5))
    want = brute(rows, lambda i: i % 20 == 0, 5)
    assert [i for i, _ in got[20]] == [21, 22, 22, 22, 23] and [i for i, _ in got[40]] == [20] * 5
    assert got == want


def test_op3_small(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    want = brute(list(zip(table["vec_id"], table["embedding"])), lambda i: i % 20 == 0, 20)
    assert recall(result(E.queries()["op3_nearest_neighbours"](spark, SF)), want) >= 0.95


def test_rows_are_copied_only_where_many_queries_go(spark):
    rows = spark.createDataFrame([(i, i % 4, 0) for i in range(400)] + [(i, 2, 1) for i in range(400, 450)], "vec_id long, cell long, part long")
    asked = spark.createDataFrame([(q, 1, 0) for q in range(5)] + [(q, 2, p) for q in range(1000) for p in (0, 1)], "query_id long, cell long, part long")
    left, right = ann.meet(rows, asked, 250)
    copies = {(r.cell, r.part): r["count"] for r in left.groupBy("cell", "part").count().collect()}
    assert copies == {(1, 0): 100, (2, 0): 4 * 100, (2, 1): 4 * 50}
    assert right.count() == 5 + 2 * 1000 and right.where("cell = 2").select("query_id", "turn").distinct().count() == 1000
    assert max(r["count"] for r in right.groupBy("cell", "part", "turn").count().collect()) < 350
