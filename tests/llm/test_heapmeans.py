"""Operator 11 against plain rounds over all vectors and centroids."""

import hashlib
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import SF, save

import __spark_entry__ as E
from tactica.llm import heapmeans


def brute(rows, k=8, rounds=10, dim=64):
    """sorted (vec_id, cluster, distance, cluster_inertia, inertia, centroid) by plain integer rounds."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [x for _, x in order[:k]]

    def assign():
        out = []
        for _, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centres]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        own = assign()
        for c in range(len(centres)):
            mine = [x for (_, x), (o, _) in zip(kept, own) if o == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine)]
    own = assign()
    per = [sum(d for o, d in own if o == c) for c in range(len(centres))]
    return sorted(((i, o, d, per[o], sum(per), tuple(centres[o])) for (i, _), (o, d) in zip(kept, own)), key=repr)


def result(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_rounds_equal_plain_ones(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    middle = rng.standard_normal((5, 6))
    rows = [(i, (middle[i % 5] + rng.standard_normal(6) / 3).tolist()) for i in range(300)]
    report = []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(heapmeans.cluster(df, k=8, rounds=10, dim=6, block_rows=block_rows, report=report))
    assert got == brute(rows, dim=6)
    # the bounds leave most vectors alone once the centroids move little
    assert report[0] == 300 and all(n < 300 for n in report[2:])


def test_ties_copies_and_bad_vectors(spark):
    rows = [(i, [float(i % 3), 0.5]) for i in range(20)] + [(7, [1.0, 0.5])] * 30 + [(None, [2.0, 0.25]), (None, [2.0, -0.25])]
    bad = [(100, None), (101, []), (102, [1.0]), (103, [1.0, None]), (104, [float("nan"), 0.0]), (105, [float("inf"), 0.0]), (106, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows + bad],
                               "vec_id long, embedding array<float>, cluster string, distance int")
    for k, rounds in ((8, 10), (2, 1), (1, 3), (3, 0)):
        assert result(heapmeans.cluster(df, k=k, rounds=rounds, dim=2)) == brute(rows + bad, k, rounds, 2)
    few = rows[:3] + bad
    assert result(heapmeans.cluster(df.where("vec_id < 3 OR vec_id > 99"), k=8, dim=2)) == brute(few, dim=2)


def test_empty_and_too_large(spark, tmp_path):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    folder = save(spark, tmp_path, embeddings=df)
    out = E.queries()["op11_heap_clusters"](spark, folder)
    assert out.count() == 0
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    huge = spark.createDataFrame([(1, [1e6, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64-bit"):
        heapmeans.cluster(huge, dim=2).count()


def test_op11_table(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    want = [(*r[:5], hashlib.sha256(",".join(map(str, r[5])).encode()).hexdigest())
            for r in brute(list(zip(table["vec_id"], table["embedding"])))]
    got = [tuple(r) for r in E.queries()["op11_heap_clusters"](spark, SF).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
