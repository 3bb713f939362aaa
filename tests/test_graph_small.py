"""Graph operators against brute force on small literal graphs."""

import itertools

from pyspark.sql import functions as F

import pytest

import __spark_entry__ as E
from tactica.operators import graph as G
from tactica.operators import paths as P

EDGES = [(6, 3), (6, 2), (3, 1), (2, 1), (6, 1), (5, 2), (4, 2), (4, 1)]


def _edges(spark, edges=EDGES):
    return spark.createDataFrame(edges, "src long, dst long")


def _closure(edges):
    c = set(edges)
    while True:
        new = {(a, d) for (a, b) in c for (cc, d) in edges if b == cc} - c
        if not new:
            return c
        c |= new


def test_closure_and_reduction(spark):
    e = _edges(spark)
    got = {(r["src"], r["dst"]) for r in G.transitive_closure(e).collect()}
    assert got == _closure(EDGES)
    reduced, cycles = G.transitive_reduction(e)
    red = {(r["src"], r["dst"]) for r in reduced.collect()}
    assert (6, 1) not in red and (4, 1) not in red and cycles.count() == 0
    assert _closure(sorted(red)) == _closure(EDGES)          # same closure


def test_topological_order_respects_edges(spark):
    nodes = spark.createDataFrame([(k,) for k in range(1, 7)], "key long")
    pos = {r["key"]: r["position"] for r in G.topological_order(nodes, _edges(spark)).collect()}
    assert all(pos[a] < pos[b] for a, b in EDGES)


def test_strong_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6)]
    nodes = spark.createDataFrame([(k,) for k in range(1, 8)], "key long")
    comp = {r["key"]: r["component"] for r in G.strong_components(nodes, _edges(spark, edges)).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}


def _paths(spark, edges, x, y):
    rows = P.irreducible_paths(_edges(spark, edges), x, y).collect()
    out = {}
    for r in rows:
        out.setdefault(r["path_id"], []).append((r["pos"], r["key"]))
    return sorted([k for _, k in sorted(p)] if p != [(None, None)] else [] for p in out.values())


def test_irreducible_paths_by_hand(spark):
    # a diamond with a shortcut: 1 -> 4 is implied by 1 -> 2 -> 4
    diamond = [(1, 2), (1, 3), (2, 4), (3, 4), (1, 4)]
    assert _paths(spark, diamond, 1, 4) == [[1, 2, 4], [1, 3, 4]]
    # a chain with both shortcuts keeps the chain
    assert _paths(spark, [(1, 2), (2, 3), (3, 4), (1, 3), (2, 4)], 1, 4) == [[1, 2, 3, 4]]
    # two diamonds in a row: two times two paths
    twice = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (4, 6), (5, 7), (6, 7)]
    assert _paths(spark, twice, 1, 7) == [[1, 2, 4, 5, 7], [1, 2, 4, 6, 7], [1, 3, 4, 5, 7], [1, 3, 4, 6, 7]]
    # nodes that 1 does not reach give nothing
    assert _paths(spark, [*diamond, (9, 4)], 1, 4) == [[1, 2, 4], [1, 3, 4]]
    assert _paths(spark, diamond, 4, 1) == []
    assert _paths(spark, diamond, 2, 2) == [[]]
    assert _paths(spark, [*diamond, (2, 2)], 2, 2) == [[2]]


def test_cycles_are_refused_or_reported(spark):
    ring = [(1, 2), (2, 3), (3, 2), (3, 4)]
    nodes = spark.createDataFrame([(k,) for k in range(1, 5)], "key long")
    for call in (lambda: G.longest_paths(nodes, _edges(spark, ring)), lambda: G.longest_paths(nodes, _edges(spark, [(1, 2), (2, 3), (3, 4), (4, 1)])),
                 lambda: P.irreducible_paths(_edges(spark, ring), 1, 4)):
        with pytest.raises(ValueError, match="cycle"):
            call()
    reduced, cycles = G.transitive_reduction(_edges(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (1, 4), (2, 4)]))
    assert sorted(tuple(r) for r in reduced.collect()) == [(1, 2), (2, 3), (3, 4)] and cycles.count() == 0
    assert sorted(r["key"] for r in G.transitive_reduction(_edges(spark, [*ring, (4, 4)]))[1].collect()) == [2, 3, 4]
    cand = spark.createDataFrame([(4, 1), (1, 4), (5, 5)], "src long, dst long")
    got = {}
    for r in P.closed_cycles(_edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4)]), cand).collect():
        got.setdefault((r["src"], r["dst"], r["cycle_id"]), []).append((r["pos"], r["key"]))
    assert sorted(got) == [(4, 1, "4>1>2>4"), (4, 1, "4>1>3>4"), (5, 5, "5>5")]
    assert [k for _, k in sorted(got[4, 1, "4>1>2>4"])] == [4, 1, 2, 4]


def test_every_edge_turned_round_closes_its_cycles(spark, sf_small):
    nodes = {r[0] for r in spark.read.parquet(f"{sf_small}/part.parquet").select("p_partkey").collect()}
    edges = {(k, k // d) for k in nodes for d in (2, 3) if 1 <= k // d != k}
    after = {k: [b for a, b in edges if a == k] for k in nodes}
    irreducible = {(a, b) for a, b in edges if not any(b in after.get(m, ()) for m in after[a])}

    def paths(x, y):
        return [[x]] if x == y else [[x, *p] for a, b in irreducible if a == x and b >= y for p in paths(b, y)]

    want = {(b, a, ">".join(map(str, [b, *p]))): [b, *p] for a, b in edges for p in paths(a, b)}
    got = {}
    for r in sorted(E.queries()["g12_closed_cycles_all"](spark, sf_small).collect(), key=lambda r: r["pos"]):
        got.setdefault((r["src"], r["dst"], r["cycle_id"]), []).append(r["key"])
    assert got == want and {(b, a) for a, b in edges} == {k[:2] for k in got}


def test_cycle_in_a_long_graph_is_found_early(spark):
    edges = [(i, i + 1) for i in range(30)] + [(20, 10), (30, 31)] + [(100 + i, 101 + i) for i in range(400)]
    nodes = spark.createDataFrame([(k,) for k in {x for e in edges for x in e}], "key long")
    with pytest.raises(ValueError, match="cycle"):
        G.longest_paths(nodes, _edges(spark, edges[:32]).unionByName(_edges(spark, edges[32:40])))
    with pytest.raises(ValueError, match="cycle"):
        G.longest_paths(nodes.where("key < 3"), _edges(spark, [(0, 1), (1, 1), (1, 2)]))


def test_trimmed_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(12)] + [(20, 21), (21, 22), (22, 20), (22, 5), (11, 30)]
    nodes = spark.createDataFrame([(k,) for k in [*range(13), 20, 21, 22, 30, 40]], "key long")
    comp = {r["key"]: r["component"] for r in G.strong_components(nodes, _edges(spark, edges)).collect()}
    assert comp == {**{k: k for k in [*range(13), 30, 40]}, 20: 20, 21: 20, 22: 20}


def test_reachable_within_limit(spark):
    roots = spark.createDataFrame([(6, 1), (5, 2), (4, 3)], "key long, ordinal long")
    out = {r["key"]: r for r in G.reachable_within_limit(_edges(spark), roots, 5).collect()}
    assert out[6]["adds"] == 4 and out[6]["taken"]          # 6,3,2,1
    assert out[5]["adds"] == 1 and out[5]["taken"]          # total 5
    assert not out[4]["taken"]                              # pushes over 5


def _sequential_insert(edges, candidates):
    succ = {}
    for a, b in edges:
        succ.setdefault(a, set()).add(b)

    def reaches(a, b):
        seen, stack = {a}, [a]
        while stack:
            u = stack.pop()
            if u == b:
                return True
            for v in succ.get(u, ()):
                if v not in seen:
                    seen.add(v)
                    stack.append(v)
        return False

    out = {}
    for x, y in sorted(set(candidates)):
        ok = x != y and not reaches(y, x)
        if ok:
            succ.setdefault(x, set()).add(y)
        out[(x, y)] = ok
    return out


def test_cycle_checked_insert_sequential_brute_force(spark):
    import random
    for seed in (5, 11, 23):
        rnd = random.Random(seed)
        n = 14
        dag = sorted({(a, b) for a in range(n) for b in range(n) if a > b and rnd.random() < 0.15})
        cands = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(25)] + [(0, 1), (1, 2), (2, 0)]
        e = _edges(spark, dag)
        cdf = spark.createDataFrame(cands, "src long, dst long")
        got = {(r["src"], r["dst"]): r["accepted"]
               for r in G.cycle_checked_insert_sequential(e, cdf).collect()}
        assert got == _sequential_insert(dag, cands), seed


def test_edge_test_update_and_size(spark):
    e = _edges(spark)
    pairs = spark.createDataFrame([(6, 3), (3, 6)], "src long, dst long")
    got = {(r["src"], r["dst"]): r["is_edge"] for r in G.edge_test(e, pairs).collect()}
    assert got == {(6, 3): True, (3, 6): False}
    nodes = spark.createDataFrame([(k, f"n{k}") for k in range(1, 7)], "key long, info string")
    upd = G.update_nodes(nodes, spark.createDataFrame([(2, "two")], "key long, info string"))
    assert {r["key"]: r["info"] for r in upd.collect()}[2] == "two"
    size = G.graph_size(nodes, e).first()
    assert (size["nodes"], size["edges"]) == (6, len(set(EDGES)))
    empty = G.graph_size(nodes.limit(0), e.limit(0)).first()
    assert (empty["nodes"], empty["edges"]) == (0, 0)


def _all_paths(edges, x, y):
    """Irreducible paths of an acyclic graph, by length and then by keys."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    irreducible = {(a, b) for a, b in edges if not any(b in after.get(m, ()) for m in after[a] if m not in (a, b))}

    def walk(z):
        return [[z]] if z == y else [[z, *p] for a, b in irreducible if a == z for p in walk(b)]

    return sorted(walk(x), key=lambda p: (len(p), p))


def test_paths_by_rank_with_limits(spark):
    import random
    r = random.Random(2)
    edges = [(a, b) for a in range(14) for b in range(14) if a > b and r.random() < 0.3]
    pairs = [(a, b) for a in range(14) for b in range(14) if a >= b]
    df, e = spark.createDataFrame(pairs, "x long, y long"), _edges(spark, edges)
    want = {p: _all_paths(edges, *p) for p in pairs}
    index = P.reachability_index(e)
    assert index[1]
    counts = {(c.x, c.y): (c.paths, c.shortest, c.longest) for c in P.path_counts(e, df, index).collect()}
    assert counts == {p: (len(w), len(w[0]) - 1, len(w[-1]) - 1) for p, w in want.items() if w}
    for limit, by in ((None, index), (2, None)):
        got = {}
        for row in sorted(P.paths_by_rank(e, df, limit, by).collect(), key=lambda q: (q.x, q.y, q.path, q.pos)):
            got.setdefault((row.x, row.y), {}).setdefault(row.path, []).append(row.key)
        assert {p: [g[i] for i in range(len(g))] for p, g in got.items()} == {p: w[:limit] for p, w in want.items() if w}


def test_a_limit_cuts_what_could_not_be_listed(spark, monkeypatch):
    # 9 diamonds in a row: 512 paths
    monkeypatch.setattr(P, "MOST_PATHS", 100)
    edges = [(3 * i + a, 3 * i + b) for i in range(9) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))]
    pair = spark.createDataFrame([(0, 27)], "x long, y long")
    got = {}
    for r in P.paths_by_rank(_edges(spark, edges), pair, limit=5).orderBy("path", "pos").collect():
        got.setdefault(r.path, []).append(r.key)
    assert list(got.values()) == [[3 * i + d for i in range(9) for d in (0, 1 + (i >= 6 and n >> (8 - i) & 1))] + [27] for n in range(5)]
    with pytest.raises(ValueError, match="limit"):
        P.paths_by_rank(_edges(spark, edges), pair)


def test_insert_check_equals_search_on_any_graph(spark):
    import random
    r = random.Random(9)
    for share in (0.06,):
        edges = [(a, b) for a in range(30) for b in range(30) if a != b and r.random() < share] + [(40, 41), (41, 42), (42, 42)]
        cand = [(a, b) for a in range(30) for b in range(30) if r.random() < 0.3] + [(42, 40), (40, 42), (99, 98), (5, 5)]
        got = {(c["src"], c["dst"]): c["accepted"] for c in P.cycle_checked_insert(_edges(spark, edges), spark.createDataFrame(cand, "src long, dst long")).collect()}
        assert got == {c: _sequential_insert(edges, [c])[c] for c in cand}
