"""Folds with the user's own functions against plain loops."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactica.operators import folds


def _table(spark, n=900):
    r = random.Random(3)
    rows = [(i, "hot" if r.random() < 0.5 else r.choice(["a", "b", "c"]), r.randint(-9, 30)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, g string, x int").repartition(17, "id")


def test_user_fold_merges_in_a_tree_and_reports_failures(spark):
    rows, df = _table(spark)
    count = lambda s, rs: s + rs.num_rows if min(rs.column(rs.schema.get_field_index("x")).to_pylist()) >= 0 else 1 / 0
    for fan_in, held in ((64, 10_000), (2, 1)):
        out, failed = folds.user_fold(df, ["g"], int, count, lambda a, b: a + b, lambda s: s, T.LongType(), ids=["id"], fan_in=fan_in, held_groups=held)
        good = [r for r in rows if r[2] >= 0]
        assert {r.g: r.folded for r in out.collect()} == {g: sum(r[1] == g for r in good) for g in {r[1] for r in good}}
        assert sorted((r.id, r.g, r.error) for r in failed.collect()) == sorted((i, g, "ZeroDivisionError: division by zero") for i, g, x in rows if x < 0)


def test_user_fold_edges(spark):
    def odd_sum(state, rows):
        xs = rows.column(rows.schema.get_field_index("x")).to_pylist()
        if any(x < 0 for x in xs):
            raise ValueError(f"negative {[x for x in xs if x < 0][0]}")
        return {"n": state["n"] + len(xs), "bits": state["bits"] ^ sum(1 << (x % 7) for x in xs) % 128}

    df = spark.createDataFrame([(1, None, 3), (2, None, 4), (3, "bad", -1), (4, "bad", -2)], "id long, g string, x int")
    out, failed = folds.user_fold(df, ["g"], lambda: {"n": 0, "bits": 0}, odd_sum, lambda a, b: {"n": a["n"] + b["n"], "bits": a["bits"] ^ b["bits"]},
                                  lambda s: s["n"], T.IntegerType(), ids=["id"])
    assert [(r.g, r.folded) for r in out.collect()] == [(None, 2)]
    assert sorted((r.id, r.error) for r in failed.collect()) == [(3, "ValueError: negative -1"), (4, "ValueError: negative -2")]
    empty, none = folds.user_fold(df.limit(0), ["g"], int, lambda s, rs: s, max, lambda s: s, T.LongType())
    assert empty.count() == 0 and none.count() == 0


@pytest.mark.parametrize("chunk_rows", [50_000, 90])
def test_ordered_fold_hands_its_state_on(spark, chunk_rows):
    rows, df = _table(spark, 500)

    def step(state, rs):
        for i, x in zip(rs.column(rs.schema.get_field_index("id")).to_pylist(), rs.column(rs.schema.get_field_index("x")).to_pylist()):
            if x == 13:
                raise KeyError(i)
            state = (state * 31 + x) % 1_000_003
        return state

    out, failed = folds.ordered_fold(df, ["g"], ["id"], lambda: 7, step, lambda s: s, T.LongType(), ids=["id"], chunk_rows=chunk_rows)
    want = {}
    for i, g, x in sorted(rows):
        if x != 13:
            want[g] = (want.get(g, 7) * 31 + x) % 1_000_003
    assert {r.g: r.folded for r in out.collect()} == want
    assert sorted((r.id, r.error) for r in failed.collect()) == [(i, f"KeyError: {i}") for i, g, x in sorted(rows) if x == 13]
    none, _ = folds.ordered_fold(df.where(F.lit(False)), ["g"], ["id"], int, step, int, T.LongType())
    assert none.count() == 0
