"""Paths between pairs of nodes: irreducible paths (G11) and the cycles that new edges would close.

* ``reachability_index`` gives every node a few numbers that can only fall
  (minimal hashes of what it reaches) or only rise (its height) along a path
  backwards. Most pairs without a path are told from the numbers alone, and a
  search for the others visits only nodes that may still lie between the two.
* ``path_counts`` counts paths by dynamic programming: the paths of length n
  from a node are those of length n-1 from its successors. Work grows with
  edges times lengths, not with the number of paths.
* ``paths_by_rank`` turns a number into its path: at each node the running
  sums of the successors' counts say where the path goes on. All paths are
  walked side by side, a round for each position; a limit is exact, and no
  array of a path is carried along.

Joins carry the hint ``merge``, as in ``graph``: nothing is broadcast through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactica.operators.graph import _ckpt, _keyed, _KnownSet, _trim, _union

#: Minimal hashes of a node in the index.
HASHES = 4
#: More paths than this can't be listed without a limit.
MOST_PATHS = 1 << 40
#: Path numbers that one row makes at most.
CHUNK = 1 << 16


def reachability_index(edges: DataFrame) -> tuple[DataFrame, bool]:
    """(key, m0, m1, ..., height) for every node of ``edges``, and whether the graph is known to have no cycle.

    m_i is the smallest i-th hash of any node that the key reaches, itself
    included: along a path it never falls. height is the length of the longest
    path from the key; it is null everywhere if the graph has a cycle. A round
    passes on only what changed in the round before; a node's number of rounds
    is the longest path at most. Edges from a node to itself count for nothing.
    """
    e = edges.where("src <> dst").select("src", "dst").distinct()
    into = _keyed(e, "dst")
    names = [f"m{i}" for i in range(HASHES)]
    nodes = into.select(F.col("src").alias("key")).unionByName(into.select(F.col("dst").alias("key"))).distinct()
    state = _keyed(nodes.select("key", *[F.xxhash64("key", F.lit(i)).alias(n) for i, n in enumerate(names)],
                                F.lit(0).cast("long").alias("height"), F.lit(True).alias("_new")), "key")
    rounds, probe = 0, 24
    while True:
        told = (state.where("_new").hint("merge").join(into, F.col("key") == F.col("dst")).groupBy(F.col("src").alias("key"))
                .agg(*[F.min(n).alias(f"_{n}") for n in names], (F.max("height") + 1).alias("_height")))
        better = F.lit(False)
        for n in names:
            better = better | F.coalesce(F.col(f"_{n}") < F.col(n), F.lit(False))
        higher = F.coalesce(F.col("_height") > F.col("height"), F.lit(False))
        state = _ckpt(state.drop("_new").hint("merge").join(told, "key", "left").select(
            "key", *[F.least(n, f"_{n}").alias(n) for n in names], F.greatest("height", "_height").alias("height"),
            (better | higher).alias("_new"), better.alias("_better")))
        left = state.agg(F.count_if("_new").alias("new"), F.count_if("_better").alias("better")).first()
        state, rounds = state.drop("_better"), rounds + 1
        if not left["new"]:
            return state.drop("_new"), True
        if not left["better"] and rounds >= probe:
            core, _ = _trim(nodes, e)  # what stays when nodes without a way in or out are taken away
            if not core.isEmpty():
                return state.drop("_new").withColumn("height", F.lit(None).cast("long")), False
            probe *= 4


def between(edges: DataFrame, pairs: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(x, y, z): for each pair (x, y) the nodes z on a path from x that the index does not tell to miss y.

    All nodes on paths from x to y are among them, y itself only if x reaches
    it. Without an index, which pays off for many pairs, all that x reaches."""
    if index is None:
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("key")).distinct()
        index = nodes.select("key", *[F.lit(0).cast("long").alias(f"m{i}") for i in range(HASHES)], F.lit(None).cast("long").alias("height"))
    names = [f"m{i}" for i in range(HASHES)]
    mark = lambda p: [F.col("key").alias(f"_{p}"), *[F.col(n).alias(f"{p}_{n}") for n in [*names, "height"]]]

    def may(z: str, y: str):
        ok = F.coalesce(F.col(f"{z}_height") > F.col(f"{y}_height"), F.lit(True))
        for n in names:
            ok = ok & (F.col(f"{z}_{n}") <= F.col(f"{y}_{n}"))
        return ok

    goal = [f"y_{n}" for n in [*names, "height"]]
    pairs = pairs.select("x", "y").distinct()
    marked = (pairs.where("x <> y").hint("merge").join(index.select(*mark("y")), F.col("y") == F.col("_y"))
              .hint("merge").join(index.select(*mark("x")), F.col("x") == F.col("_x")).where(may("x", "y")))
    front = marked.select("x", "y", F.col("x").alias("z"), *goal)
    ways = _keyed(edges.select("src", "dst").distinct().hint("merge").join(index.select(*mark("z")), F.col("dst") == F.col("_z"))
                  .select("src", "dst", *[f"z_{n}" for n in [*names, "height"]]), "src")
    known = _KnownSet(front, ["x", "y", "z"])
    front = known.pieces[0]
    while True:
        step = (front.where("z <> y").hint("merge").join(ways, F.col("z") == F.col("src")).where((F.col("dst") == F.col("y")) | may("z", "y"))
                .select("x", "y", F.col("dst").alias("z"), *goal).distinct())
        front = known.unseen(step)
        if front.isEmpty():
            return known.all().select("x", "y", "z").unionByName(pairs.where("x = y").select("x", "y", F.col("x").alias("z")))
        known.add(front)


# ------------------------------------------------------------------ G11

def irreducible_edges(edges: DataFrame) -> DataFrame:
    """Edges p -> z that no other predecessor q of z lies between: there is no
    p -> q with q -> z. An anti-join of the edges with their two-step pairs."""
    e = edges.select("src", "dst").distinct()
    two = (e.select("src", F.col("dst").alias("mid")).hint("merge").join(e.select(F.col("src").alias("mid"), "dst"), "mid")
            .where((F.col("mid") != F.col("src")) & (F.col("mid") != F.col("dst"))).select("src", "dst"))
    return e.hint("merge").join(two, ["src", "dst"], "left_anti")


def _counted_steps(edges: DataFrame, pairs: DataFrame, cap: int,
                   index: tuple[DataFrame, bool] | None = None) -> tuple[DataFrame, DataFrame | None, int]:
    """(totals, steps, longest length) of the irreducible paths of the pairs.

    totals: (x, y, length, n) = number of paths of a length, at most ``cap``.
    steps: (x, y, z, w, left, low, n): n paths of length ``left`` - 1 go on from
    w, and ``low`` go on from smaller successors of z than w. Counts are cut
    at ``cap``, which changes no path with a number below it.
    """
    nodes = _ckpt(between(edges, pairs, index[0] if index else None))
    at = nodes.select("x", "y", F.col("z").alias("w"))
    steps = (nodes.where("z <> y").hint("merge").join(irreducible_edges(edges), F.col("z") == F.col("src"))
             .select("x", "y", "z", F.col("dst").alias("w")).hint("merge").join(at, ["x", "y", "w"], "left_semi"))
    steps = _ckpt(steps.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", "y", "w"))
    met, n, probe = steps.where("z = w").limit(1).collect(), None if index and index[1] else steps.count(), 64
    if met:
        raise ValueError(f"the graph has a cycle through {met[0]['z']}")
    count = at.where("w = y").withColumn("n", F.lit(1).cast("long"))
    totals, made, length = [], [], 0
    before = Window.partitionBy("x", "y", "z").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        totals.append(count.where("w = x").select("x", "y", F.lit(length).alias("length"), "n"))
        step = _ckpt(steps.hint("merge").join(count, ["x", "y", "w"]).select(
            "x", "y", "z", "w", F.lit(length + 1).alias("left"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("low"), "n"))
        if step.isEmpty():
            return _union(totals), _union(made) if made else None, length
        if n is not None and (length == probe or length > n):  # not known to have no cycle: looked at now and then
            place = lambda z: F.xxhash64("x", "y", z)
            own = steps.select(place("z").alias("src"), place("w").alias("dst")).distinct()
            core, _ = _trim(own.select(F.explode(F.array("src", "dst")).alias("key")).distinct(), own)
            met = steps.hint("merge").join(core, place("z") == F.col("key"), "left_semi").limit(1).collect()
            if met:
                raise ValueError(f"the graph has a cycle through {met[0]['z']}")
            probe *= 4
        made.append(step)
        length += 1
        count = _ckpt(step.groupBy("x", "y", F.col("z").alias("w")).agg(F.least(F.sum("n"), F.lit(cap)).alias("n")))


def path_counts(edges: DataFrame, pairs: DataFrame, index: tuple[DataFrame, bool] | None = None) -> DataFrame:
    """(x, y, paths, shortest, longest) for each pair with an irreducible path from x to y; none is made.
    Numbers above 2^40 stand for that many or more."""
    totals, _, _ = _counted_steps(edges, pairs, MOST_PATHS, index)
    return totals.groupBy("x", "y").agg(F.least(F.sum("n"), F.lit(MOST_PATHS)).alias("paths"),
                                        F.min("length").alias("shortest"), F.max("length").alias("longest"))


def paths_by_rank(edges: DataFrame, pairs: DataFrame, limit: int | None = None,
                  index: tuple[DataFrame, bool] | None = None) -> DataFrame:
    """(x, y, path, length, pos, key), a row for each node of each irreducible path from x to y.

    Paths are numbered from 0 by length, then by their keys in order; with
    ``limit`` exactly the first ``limit`` of a pair are made (all, if fewer).
    A pair with x = y has one path, of that node alone. A cycle between x and y is
    an error, and so are more than 2^40 paths without a limit.
    """
    cap = MOST_PATHS if limit is None else limit
    totals, steps, longest = _counted_steps(edges, pairs, cap, index)
    before = Window.partitionBy("x", "y").orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    if limit is None and (totals.agg(F.max(F.col("first") + F.col("n")).alias("n")).first()["n"] or 0) >= MOST_PATHS:
        raise ValueError("a pair has too many paths to list them all; give a limit")
    totals = totals.withColumn("n", F.least("n", F.lit(cap) - F.col("first"))).where("n > 0")
    # numbers are made in two steps, so that no row makes more than CHUNK of them
    chunks = totals.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk"))
    low = F.col("chunk") * CHUNK
    at = chunks.select("x", "y", "first", "length", F.explode(F.sequence(low, F.least(F.col("n"), low + CHUNK) - 1)).alias("rank"))
    at = _ckpt(at.select("x", "y", (F.col("first") + F.col("rank")).alias("path"), "length", F.lit(0).alias("pos"),
                         F.col("x").alias("key"), F.col("length").alias("left"), "rank"))
    done = [at]
    if steps is not None:
        steps = _ckpt(steps.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", "y", "z", "left"))
    for pos in range(1, longest + 1):
        at = _ckpt(at.withColumnRenamed("key", "z").hint("merge").join(steps, ["x", "y", "z", "left"])
                   .where((F.col("low") <= F.col("rank")) & (F.col("rank") < F.col("low") + F.col("n")))
                   .select("x", "y", "path", "length", F.lit(pos).alias("pos"), F.col("w").alias("key"),
                           (F.col("left") - 1).alias("left"), (F.col("rank") - F.col("low")).alias("rank")))
        done.append(at)
    return _union(done).select("x", "y", "path", "length", "pos", "key")


def irreducible_path_set(edges: DataFrame, pairs: DataFrame, limit: int | None = None,
                         index: tuple[DataFrame, bool] | None = None) -> DataFrame:
    """G11 for each row (x, y) of ``pairs``: (x, y, path) with the path's keys as an array."""
    rows = paths_by_rank(edges, pairs, limit, index).groupBy("x", "y", "path").agg(F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("_keys"))
    return rows.select("x", "y", F.col("_keys.key").alias("path"))


def irreducible_paths(edges: DataFrame, x: int, y: int) -> DataFrame:
    """Every Hasse-diagram path from ``x`` to ``y`` as (path_id, pos, key)
    rows. For x = y without a self-loop there is one path, which is empty: a
    row with an empty id and null pos and key."""
    spark = edges.sparkSession
    if x == y:
        loop = not edges.where((F.col("src") == x) & (F.col("dst") == x)).isEmpty()
        return spark.createDataFrame([(str(x), 0, x) if loop else ("", None, None)], "path_id string, pos int, key long")
    paths = irreducible_path_set(edges, spark.createDataFrame([(x, y)], "x long, y long"))
    name = F.array_join(F.transform("path", lambda k: k.cast("string")), ">")
    return paths.select(name.alias("path_id"), F.posexplode("path").alias("pos", "key"))


# ------------------------------------------------------------------ G12

def cycle_checked_insert(edges: DataFrame, candidates: DataFrame, index: tuple[DataFrame, bool] | None = None) -> DataFrame:
    """Candidates (src, dst) with ``accepted`` = the edge closes no cycle
    in the graph: rejected when dst reaches src (or src = dst). The index
    answers most candidates; the others are searched between their ends only."""
    cand = _ckpt(candidates.select("src", "dst").distinct())
    index = index or reachability_index(edges)
    back = between(edges, cand.select(F.col("dst").alias("x"), F.col("src").alias("y")), index[0]).where("z = y")
    bad = back.select(F.col("y").alias("src"), F.col("x").alias("dst"), F.lit(True).alias("_cyc"))
    return cand.hint("merge").join(bad, ["src", "dst"], "left").select("src", "dst", F.col("_cyc").isNull().alias("accepted"))


def closed_cycles(edges: DataFrame, candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """The cycles that refused candidates would close: (src, dst, cycle_id,
    pos, key), each an irreducible path from dst back to src behind src; with
    ``limit`` the first so many of a candidate. The graph itself has no cycle."""
    index = reachability_index(edges)
    refused = _ckpt(cycle_checked_insert(edges, candidates, index).where(~F.col("accepted") & (F.col("src") != F.col("dst"))))
    paths = irreducible_path_set(edges, refused.select(F.col("dst").alias("x"), F.col("src").alias("y")), limit, index)
    cycle = F.concat(F.array("y"), F.col("path"))
    loops = candidates.where("src = dst").distinct().select(F.col("src").alias("y"), F.col("src").alias("x"),
                                                             F.array("src", "src").alias("cycle"))
    out = paths.select("y", "x", cycle.alias("cycle")).unionByName(loops)
    name = F.array_join(F.transform("cycle", lambda k: k.cast("string")), ">")
    return out.select(F.col("y").alias("src"), F.col("x").alias("dst"), name.alias("cycle_id"),
                      F.posexplode("cycle").alias("pos", "key"))
