"""Registered queries: graph operators over the part-key DAG and cyclic graph
(G01-G10, G12-G14, J05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactica.operators import graph as G
from tactica.operators import paths as P
from tactica.operators.ordering import number_rows
from tactica.plans.registry import query
from tactica.sources import adapters as ad


def _dag(spark, sf_dir):
    return ad.dag_nodes(spark, sf_dir), ad.dag_edges(spark, sf_dir)


_CLOSURE = """
, c(src, dst) AS (SELECT src, dst FROM dag_edges
                  UNION SELECT c.src, e.dst FROM c JOIN dag_edges e ON e.src = c.dst)
"""


@query("g01_build_graph", """
WITH adj AS (SELECT p_partkey AS key, list_filter([p_partkey // 2, p_partkey // 3],
                 lambda t: t >= 1 AND t <> p_partkey) AS succs FROM part)
SELECT DISTINCT key AS src, unnest(succs) AS dst FROM adj""", ())
def g01_build_graph(spark, sf_dir):
    k = F.col("p_partkey")
    adj = ad.table(spark, sf_dir, "part").select(k.alias("key"), F.filter(
        F.array(F.floor(k / 2).cast("long"), F.floor(k / 3).cast("long")),
        lambda t: (t >= 1) & (t != k)).alias("succs"))
    nodes, edges, errors = G.build_graph(adj)
    return edges.select("src", "dst")


@query("g01_build_graph_errors", """
SELECT p_partkey AS key, 'duplicate node' AS error FROM part GROUP BY p_partkey HAVING count(*) > 1""", ())
def g01_build_graph_errors(spark, sf_dir):
    k = F.col("p_partkey")
    adj = ad.table(spark, sf_dir, "part").select(k.alias("key"), F.filter(
        F.array(F.floor(k / 2).cast("long"), F.floor(k / 3).cast("long")),
        lambda t: (t >= 1) & (t != k)).alias("succs"))
    return G.build_graph(adj)[2]


@query("g02_adjacency", """
, s AS (SELECT src AS key, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS succs, count(*) AS out_degree
        FROM dag_edges GROUP BY src)
, p AS (SELECT dst AS key, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS preds, count(*) AS in_degree
        FROM dag_edges GROUP BY dst)
SELECT n.key, coalesce(succs, '') AS succs, coalesce(preds, '') AS preds,
       coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree
FROM dag_nodes n LEFT JOIN s USING (key) LEFT JOIN p USING (key)""", ("dag_nodes", "dag_edges"))
def g02_adjacency(spark, sf_dir):
    a = G.adjacency(*_dag(spark, sf_dir))
    return a.select("key", F.array_join(F.transform("succs", lambda x: x.cast("string")), ",").alias("succs"),
                    F.array_join(F.transform("preds", lambda x: x.cast("string")), ",").alias("preds"),
                    F.size("succs").alias("out_degree"), F.size("preds").alias("in_degree"))


@query("g03_extremal_nodes", """
SELECT key, key NOT IN (SELECT dst FROM dag_edges) AS minimal, key NOT IN (SELECT src FROM dag_edges) AS maximal,
       key NOT IN (SELECT dst FROM dag_edges) AND key NOT IN (SELECT src FROM dag_edges) AS isolated
FROM dag_nodes""", ("dag_nodes", "dag_edges"))
def g03_extremal_nodes(spark, sf_dir):
    return G.extremal_nodes(*_dag(spark, sf_dir))


@query("g04_reachability", """
, r(key) AS (SELECT key FROM dag_nodes WHERE info LIKE '%red%'
             UNION SELECT e.dst FROM r JOIN dag_edges e ON e.src = r.key)
SELECT key FROM r""", ("dag_nodes", "dag_edges"))
def g04_reachability(spark, sf_dir):
    nodes, edges = _dag(spark, sf_dir)
    return G.reachable(edges, nodes.where(F.col("info").contains("red")))


@query("g05_topological_order", """
, lv(key, level) AS (SELECT key, 0 FROM dag_nodes WHERE key NOT IN (SELECT dst FROM dag_edges)
                     UNION SELECT e.dst, lv.level + 1 FROM lv JOIN dag_edges e ON e.src = lv.key)
, m AS (SELECT key, max(level) AS level FROM lv GROUP BY key)
SELECT key, level, row_number() OVER (ORDER BY level, key) - 1 AS position FROM m""",
       ("dag_nodes", "dag_edges"))
def g05_topological_order(spark, sf_dir):
    return G.topological_order(*_dag(spark, sf_dir)).select("key", "level", "position")


@query("g06_longest_path_height", """
, ht(key, h) AS (SELECT key, 0 FROM dag_nodes WHERE key NOT IN (SELECT src FROM dag_edges)
                 UNION SELECT e.src, ht.h + n.p_size FROM ht JOIN dag_edges e ON e.dst = ht.key
                       JOIN part n ON n.p_partkey = ht.key)
SELECT key, max(h) AS height FROM ht GROUP BY key""", ("dag_nodes", "dag_edges"))
def g06_longest_path_height(spark, sf_dir):
    nodes, edges = _dag(spark, sf_dir)
    size = ad.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_size")
    lv = G.longest_paths(nodes.join(size, "key"), edges, F.col("p_size"), backward=True, name="height")
    return lv.select("key", "height")


@query("g07_reachable_within_limit", """
, roots AS (SELECT key, row_number() OVER (ORDER BY key) AS ordinal FROM dag_nodes WHERE info LIKE '%red%')
, lab(key, label) AS (SELECT key, ordinal FROM roots
                      UNION SELECT e.dst, lab.label FROM lab JOIN dag_edges e ON e.src = lab.key)
, owner AS (SELECT key, min(label) AS ordinal FROM lab GROUP BY key)
, w AS (SELECT ordinal, count(*) AS adds FROM owner GROUP BY ordinal)
, r AS (SELECT roots.key, roots.ordinal, coalesce(w.adds, 0) AS adds,
               sum(coalesce(w.adds, 0)) OVER (ORDER BY roots.ordinal ROWS UNBOUNDED PRECEDING) AS total
        FROM roots LEFT JOIN w USING (ordinal))
SELECT key, ordinal, adds, CAST(total AS BIGINT) AS total,
       ordinal = 1 OR (SELECT min(ordinal) FROM r WHERE total > 300) IS NULL
         OR ordinal < (SELECT min(ordinal) FROM r WHERE total > 300) AS taken
FROM r""", ("dag_nodes", "dag_edges"))
def g07_reachable_within_limit(spark, sf_dir):
    nodes, edges = _dag(spark, sf_dir)
    roots = number_rows(nodes.where(F.col("info").contains("red")).withColumn("_all", F.lit(0)),
                        ["_all"], ["key"], "ordinal", base=1).select("key", "ordinal")
    out = G.reachable_within_limit(edges, roots, 300)
    return out.select("key", "ordinal", "adds", "total", "taken")


@query("g08_strong_components", """
, c(src, dst) AS (SELECT src, dst FROM cyclic_edges
                  UNION SELECT c.src, e.dst FROM c JOIN cyclic_edges e ON e.src = c.dst)
, mutual AS (SELECT c1.src AS u, c1.dst AS v FROM c c1 JOIN c c2 ON c1.src = c2.dst AND c1.dst = c2.src)
SELECT p_partkey AS key, least(p_partkey, coalesce(min(u), p_partkey)) AS component
FROM part LEFT JOIN mutual ON v = p_partkey GROUP BY p_partkey""", ("cyclic_edges",))
def g08_strong_components(spark, sf_dir):
    nodes = ad.dag_nodes(spark, sf_dir)
    return G.strong_components(nodes, ad.cyclic_edges(spark, sf_dir))


@query("g09_transitive_closure", _CLOSURE + "SELECT src, dst FROM c", ("dag_edges",))
def g09_transitive_closure(spark, sf_dir):
    return G.transitive_closure(ad.dag_edges(spark, sf_dir))


@query("g10_transitive_reduction", _CLOSURE + """
, implied AS (SELECT DISTINCT e.src, c.dst FROM dag_edges e JOIN c ON c.src = e.dst)
SELECT src, dst FROM dag_edges EXCEPT SELECT src, dst FROM implied""", ("dag_edges",))
def g10_transitive_reduction(spark, sf_dir):
    reduced, _ = G.transitive_reduction(ad.dag_edges(spark, sf_dir))
    return reduced


@query("g12_cycle_checked_insert", _CLOSURE + """
, cand AS (SELECT DISTINCT p_partkey AS src, 5 * (p_partkey // 5) + (p_partkey + 1) % 5 AS dst
           FROM part)
SELECT cand.src, cand.dst,
       NOT EXISTS (SELECT 1 FROM c WHERE c.src = cand.dst AND c.dst = cand.src) AND cand.src <> cand.dst
         AS accepted
FROM cand""", ("dag_edges",))
def g12_cycle_checked_insert(spark, sf_dir):
    k = F.col("p_partkey")
    blk = F.floor(k / 5).cast("long")
    cand = ad.table(spark, sf_dir, "part").select(
        k.alias("src"), (blk * 5 + (k + 1) % 5).alias("dst"))
    return P.cycle_checked_insert(ad.dag_edges(spark, sf_dir), cand)


@query("g13_subgraph", """
, keep AS (SELECT p_partkey AS key FROM part WHERE p_size <= 25)
SELECT src, dst FROM dag_edges WHERE src IN (SELECT key FROM keep) AND dst IN (SELECT key FROM keep)""",
       ("dag_edges",))
def g13_subgraph(spark, sf_dir):
    size = ad.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_size")
    _, e = G.subgraph(size, ad.dag_edges(spark, sf_dir), F.col("p_size") <= 25)
    return e.select("src", "dst")


@query("g14_named_premises", """
, named AS (SELECT p_partkey AS key FROM part WHERE p_size > 25)
, walk(start, key) AS (SELECT key, key FROM dag_nodes
                       UNION SELECT w.start, e.dst FROM walk w JOIN dag_edges e ON e.src = w.key
                       WHERE w.key = w.start OR w.key NOT IN (SELECT key FROM named))
SELECT DISTINCT start, key FROM walk WHERE key <> start AND key IN (SELECT key FROM named)""",
       ("dag_nodes", "dag_edges"))
def g14_named_premises(spark, sf_dir):
    nodes, edges = _dag(spark, sf_dir)
    named = ad.table(spark, sf_dir, "part").where(F.col("p_size") > 25).select(F.col("p_partkey").alias("key"))
    starts = nodes.select(F.col("key").alias("start"), "key")
    return G.named_premises(edges, starts, named)


@query("j05_local_in_dependency_order", """
, lv(key, level) AS (SELECT key, 0 FROM dag_nodes WHERE key NOT IN (SELECT dst FROM dag_edges)
                     UNION SELECT e.dst, lv.level + 1 FROM lv JOIN dag_edges e ON e.src = lv.key)
SELECT key, max(level) AS level FROM lv
WHERE key IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#1') GROUP BY key""",
       ("dag_nodes", "dag_edges"))
def j05_local_in_dependency_order(spark, sf_dir):
    nodes, edges = _dag(spark, sf_dir)
    brand = ad.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_brand")
    return G.local_in_dependency_order(nodes.join(brand, "key"), edges, F.col("p_brand") == "Brand#1")


@query("g11_irreducible_paths", """
, irr AS (SELECT src, dst FROM dag_edges e WHERE NOT EXISTS (
            SELECT 1 FROM dag_edges a JOIN dag_edges b ON b.src = a.dst WHERE a.src = e.src AND b.dst = e.dst AND a.dst <> e.src AND a.dst <> e.dst))
, walk(z, path) AS (SELECT max(key), [max(key)] FROM dag_nodes
                    UNION ALL SELECT irr.dst, list_append(walk.path, irr.dst) FROM walk JOIN irr ON irr.src = walk.z)
, done AS (SELECT path FROM walk WHERE z = 1)
SELECT array_to_string(path, '>') AS path_id, i - 1 AS pos, path[i] AS key
FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM done)""", ("dag_nodes", "dag_edges"))
def g11_irreducible_paths(spark, sf_dir):
    """All Hasse-diagram paths from the largest part key down to key 1."""
    nodes, edges = _dag(spark, sf_dir)
    hi = nodes.agg(F.max("key")).first()[0]
    return P.irreducible_paths(edges, int(hi), 1)


_IRREDUCIBLE_WALKS = """
, irr AS (SELECT src, dst FROM dag_edges e WHERE NOT EXISTS (
            SELECT 1 FROM dag_edges a JOIN dag_edges b ON b.src = a.dst WHERE a.src = e.src AND b.dst = e.dst AND a.dst <> e.src AND a.dst <> e.dst))
, walk(x, y, z, path) AS (SELECT key, key // 36, key, [key] FROM dag_nodes WHERE key >= 36
                          UNION ALL SELECT x, y, irr.dst, list_append(path, irr.dst) FROM walk JOIN irr ON irr.src = z WHERE irr.dst >= y)
, done AS (SELECT x, y, path, row_number() OVER (PARTITION BY x, y ORDER BY len(path), path) - 1 AS rank FROM walk WHERE z = y)
"""


def _distant(spark, sf_dir):
    """Every node and the one that two halvings and two thirdings lead to."""
    return ad.dag_nodes(spark, sf_dir).where("key >= 36").select(F.col("key").alias("x"), F.floor(F.col("key") / 36).alias("y"))


@query("g11_irreducible_paths_limited", _IRREDUCIBLE_WALKS + """
SELECT x, y, rank AS path, len(path) - 1 AS length, i - 1 AS pos, path[i] AS key
FROM (SELECT x, y, rank, path, unnest(range(1, len(path) + 1)) AS i FROM done WHERE rank < 4)""", ("dag_nodes", "dag_edges"))
def g11_irreducible_paths_limited(spark, sf_dir):
    """The first four paths from every node to a distant one."""
    edges = ad.dag_edges(spark, sf_dir)
    return P.paths_by_rank(edges, _distant(spark, sf_dir), limit=4, index=P.reachability_index(edges))


@query("g11_path_counts", _IRREDUCIBLE_WALKS + """
SELECT x, y, count(*) AS paths, min(len(path)) - 1 AS shortest, max(len(path)) - 1 AS longest FROM done GROUP BY x, y""", ("dag_nodes", "dag_edges"))
def g11_path_counts(spark, sf_dir):
    """How many paths lead from every node to a distant one, counted without making them."""
    edges = ad.dag_edges(spark, sf_dir)
    return P.path_counts(edges, _distant(spark, sf_dir), P.reachability_index(edges))


@query("g02_neighbours", """
SELECT src AS key, 'succ' AS side, dst AS other FROM dag_edges UNION ALL SELECT dst, 'pred', src FROM dag_edges
WHERE dst IN (SELECT key FROM dag_nodes)""", ("dag_nodes", "dag_edges"))
def g02_neighbours(spark, sf_dir):
    return G.neighbours(*_dag(spark, sf_dir))


@query("g01_build_graph_dangling", """
WITH adj AS (SELECT p_partkey AS key, [p_partkey + 1, p_partkey + 1, p_partkey * 3] AS succs FROM part
             UNION ALL SELECT p_partkey, [p_partkey + 1] FROM part WHERE p_partkey % 10 = 0)
, e AS (SELECT DISTINCT key AS src, unnest(succs) AS dst FROM adj)
SELECT key, 'duplicate node' AS error FROM adj GROUP BY key HAVING count(*) > 1
UNION ALL SELECT dst, 'edge to unknown node' FROM e WHERE dst NOT IN (SELECT key FROM adj)""", ())
def g01_build_graph_dangling(spark, sf_dir):
    """Every tenth node comes twice, and many edges leave the graph."""
    k = F.col("p_partkey")
    part = ad.table(spark, sf_dir, "part")
    adj = part.select(k.alias("key"), F.array(k + 1, k + 1, k * 3).alias("succs"))
    return G.build_graph(adj.unionByName(part.where(k % 10 == 0).select(k.alias("key"), F.array(k + 1).alias("succs"))))[2]


@query("g12_cycle_checked_insert_sequential")
def g12_cycle_checked_insert_sequential(spark, sf_dir):
    """The ring edges inserted one by one in key order into the part DAG; an
    edge closing a cycle with the graph or with earlier-accepted ring edges
    is refused (checked against brute force on small graphs; no SQL twin)."""
    k = F.col("p_partkey")
    blk = F.floor(k / 5).cast("long")
    cand = ad.table(spark, sf_dir, "part").select(
        k.alias("src"), (blk * 5 + (k + 1) % 5).alias("dst"))
    return G.cycle_checked_insert_sequential(ad.dag_edges(spark, sf_dir), cand)
