"""Loops over graphs send nothing but counts through the driver, and gather only what can matter."""

import pytest

from tactica.operators import graph as G
from tactica.operators import paths as P

DAG = [(k, k // d) for k in range(2, 60) for d in (2, 3) if 1 <= k // d]
EDGES = sorted(set(DAG))

CALLS = {
    "g10_transitive_reduction": lambda e, c: G.transitive_reduction(e)[0],
    "g12_cycle_checked_insert": lambda e, c: P.cycle_checked_insert(e, c),
    "g12_closed_cycles_all": lambda e, c: P.closed_cycles(e, e.selectExpr("dst AS src", "src AS dst")),
    "g14_named_premises": lambda e, c: G.named_premises(e, e.selectExpr("src AS start", "src AS key").distinct(), e.where("src % 3 = 0").selectExpr("src AS key")),
    "g11_irreducible_paths": lambda e, c: P.irreducible_paths(e, 59, 1),
    "g11_path_counts": lambda e, c: P.path_counts(e, e.selectExpr("src AS x", "src div 36 AS y").where("y > 0"), P.reachability_index(e)),
    "g12_closed_cycles": lambda e, c: P.closed_cycles(e, e.where("src >= 6").selectExpr("src div 6 AS src", "src AS dst")),
    "g11_irreducible_paths_limited": lambda e, c: P.paths_by_rank(e, e.selectExpr("src AS x", "src div 36 AS y").where("y > 0"), 4),
}


@pytest.mark.parametrize("name", CALLS)
def test_no_broadcast_in_a_loop(spark, monkeypatch, capsys, name):
    plans, kept = [], G._ckpt

    def explained(df):
        df.explain()
        plans.append(capsys.readouterr().out)
        return kept(df)

    monkeypatch.setattr(G, "_ckpt", explained)
    monkeypatch.setattr(P, "_ckpt", explained)
    edges = spark.createDataFrame(EDGES, "src long, dst long")
    cand = spark.createDataFrame([(k, 5 * (k // 5) + (k + 1) % 5) for k in range(60)], "src long, dst long")
    explained(CALLS[name](edges, cand))
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]


def test_sequential_insert_searches_inside_components_only(spark, monkeypatch):
    """The rings close cycles inside their blocks; the closure of the graph, which is far larger, is not gathered."""
    found, search = [], G.reach_from

    def counted(*args):
        out = search(*args)
        found.append(out.count())
        return out

    monkeypatch.setattr(G, "reach_from", counted)
    cand = sorted({(k, 5 * (k // 5) + (k + 1) % 5) for k in range(60)} | {(12, 11), (7, 7), (70, 71), (71, 70), (1, 99)})
    got = {(r["src"], r["dst"]): r["accepted"] for r in G.cycle_checked_insert_sequential(
        spark.createDataFrame(EDGES, "src long, dst long"), spark.createDataFrame(cand, "src long, dst long")).collect()}
    after = {}
    for a, b in EDGES:
        after.setdefault(a, set()).add(b)
    want = {}
    for a, b in cand:
        seen, todo = {b}, [b]
        while todo:
            new = after.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        want[a, b] = a not in seen
        if want[a, b]:
            after.setdefault(a, set()).add(b)
    assert got == want
    assert sum(found) < 2 * len(cand)


def test_what_is_known_moves_once(spark, capsys):
    """The closure's known pairs and its edges keep partitioning and order in their checkpoints."""
    edges = spark.createDataFrame(EDGES, "src long, dst long")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    known = G._KnownSet(edges.distinct(), ["src", "dst"])
    known.add(known.unseen(edges.selectExpr("dst AS src", "src AS dst").distinct()))
    rows = edges.selectExpr("dst AS src", "src + 1 AS dst")
    for piece in known.pieces:
        rows.hint("merge").join(piece, ["src", "dst"], "left_anti").explain()
        plan = capsys.readouterr().out
        assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    assert known.all().count() == 2 * len(EDGES) and spark.conf.get("spark.sql.adaptive.enabled") == adaptive
