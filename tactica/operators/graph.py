"""Graph operators over ``nodes(key, ...)`` and ``edges(src, dst)``.

Iterative operators are semi-naive DataFrame loops: each round joins only
the newly found rows (the frontier) with the edges, removes what is already
known with a ``left_anti`` join, and checkpoints the state into the shared
folder named by ``spark.checkpoint.dir`` (``tactica.session``), so lineage
stays short and a lost executor recomputes one round, not the whole loop.
The only driver interaction is one ``count()`` per round to test for the
fixpoint. Joins of a loop carry the hint ``merge``: without it each round's
small side is broadcast, which sends it through the driver.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactica.session import ensure_checkpoint_dir


def _ckpt(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _placed(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitioned and sorted by ``keys`` in a checkpoint that says so: joins
    on the keys neither shuffle nor sort it again. The plan of an adaptive query
    has no partitioning that a checkpoint could keep, so this one is not adaptive."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return _ckpt(df.repartition(n, *keys).sortWithinPartitions(*keys))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


# The accumulated state is a union of checkpointed per-round pieces; it is
# itself checkpointed every few rounds so plans stay small.
STATE_CKPT_EVERY = 4


def _keyed(df: DataFrame, key: str) -> DataFrame:
    """A loop-invariant table, placed by its join key once: every round's join
    shuffles and sorts only the (small) frontier, never the edges again."""
    return _placed(df, key)


def _grow(state: DataFrame, new: DataFrame, rnd: int) -> DataFrame:
    out = state.unionByName(new)
    return _ckpt(out) if rnd % STATE_CKPT_EVERY == 0 else out


def _union(pieces: list[DataFrame]) -> DataFrame:
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out


class _KnownSet:
    """The rows found so far, kept as hash-partitioned checkpointed pieces.

    A union of pieces loses its partitioning, so anti-joining new rows
    against it would reshuffle everything known in every round. Instead the
    new rows are anti-joined against each piece (pieces never move, and are
    sorted once) and the pieces are merged into one every few rounds.
    """

    def __init__(self, first: DataFrame, keys: list[str]):
        self.keys = keys
        self.pieces = [_placed(first, *keys)]

    def unseen(self, rows: DataFrame) -> DataFrame:
        for p in self.pieces:
            rows = rows.hint("merge").join(p, self.keys, "left_anti")
        return _placed(rows, *self.keys)

    def add(self, new: DataFrame) -> None:
        self.pieces.append(new)
        if len(self.pieces) > STATE_CKPT_EVERY:
            merged = self.pieces[0]
            for p in self.pieces[1:]:
                merged = merged.unionByName(p)
            self.pieces = [_placed(merged, *self.keys)]

    def all(self) -> DataFrame:
        out = self.pieces[0]
        for p in self.pieces[1:]:
            out = out.unionByName(p)
        return out


# ------------------------------------------------------------------ G01 - G03

def build_graph(adjacency: DataFrame, key: str = "key", succs: str = "succs",
                converse: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, errors) from adjacency lists. Duplicate nodes and
    edges to unknown nodes are reported in ``errors``; duplicate edges have
    no effect."""
    nodes = adjacency.select(F.col(key).alias("key")).distinct()
    e = adjacency.select(F.col(key).alias("src"), F.explode(succs).alias("dst"))
    if converse:
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    edges = e.distinct()
    dup = adjacency.groupBy(F.col(key).alias("key")).count().where("count > 1") \
                   .select("key", F.lit("duplicate node").alias("error"))
    dangling = edges.join(nodes.withColumnRenamed("key", "dst"), "dst", "left_anti") \
                    .select(F.col("dst").alias("key"), F.lit("edge to unknown node").alias("error"))
    return nodes, edges, dup.unionByName(dangling)


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node the sorted successor and predecessor sets and degrees."""
    succ = edges.groupBy(F.col("src").alias("key")).agg(F.sort_array(F.collect_set("dst")).alias("succs"))
    pred = edges.groupBy(F.col("dst").alias("key")).agg(F.sort_array(F.collect_set("src")).alias("preds"))
    out = nodes.select("key").join(succ, "key", "left").join(pred, "key", "left")
    empty = F.array().cast("array<long>")
    return out.select("key", F.coalesce("succs", empty).alias("succs"),
                      F.coalesce("preds", empty).alias("preds"))


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G02 in long form: (key, side, other), one row per neighbour, and degrees
    by partial counts; nothing is gathered per node."""
    e = edges.select("src", "dst").distinct()
    rows = e.select(F.col("src").alias("key"), F.lit("succ").alias("side"), F.col("dst").alias("other")).unionByName(
        e.select(F.col("dst").alias("key"), F.lit("pred").alias("side"), F.col("src").alias("other")))
    return rows.join(nodes.select("key").distinct(), "key", "left_semi")


def edge_test(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (src, dst) with ``is_edge``."""
    hit = edges.select("src", "dst").distinct().withColumn("is_edge", F.lit(True))
    return pairs.join(hit, ["src", "dst"], "left").withColumn("is_edge", F.coalesce("is_edge", F.lit(False)))


def update_nodes(nodes: DataFrame, updates: DataFrame, info: str = "info") -> DataFrame:
    """Node info replaced where ``updates`` (key, info) has a row; node
    lookup is a plain semi join on key."""
    u = updates.select("key", F.col(info).alias("_new"))
    return nodes.join(u, "key", "left").withColumn(info, F.coalesce("_new", F.col(info))).drop("_new")


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of nodes and of distinct edges, one row (0, 0 when empty),
    as one partial aggregate over tagged rows."""
    n = nodes.select(F.lit(1).alias("_n"), F.lit(0).alias("_e"))
    e = edges.select("src", "dst").distinct().select(F.lit(0).alias("_n"), F.lit(1).alias("_e"))
    return n.unionByName(e).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("nodes"),
                                F.coalesce(F.sum("_e"), F.lit(0)).alias("edges"))


def extremal_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Flags minimal (no predecessor), maximal (no successor), isolated."""
    has_pred = edges.select(F.col("dst").alias("key")).distinct().withColumn("_p", F.lit(True))
    has_succ = edges.select(F.col("src").alias("key")).distinct().withColumn("_s", F.lit(True))
    x = nodes.select("key").join(has_pred, "key", "left").join(has_succ, "key", "left")
    p, s = F.col("_p").isNotNull(), F.col("_s").isNotNull()
    return x.select("key", (~p).alias("minimal"), (~s).alias("maximal"), (~p & ~s).alias("isolated"))


# ------------------------------------------------------------------ G04, G09

def reachable(edges: DataFrame, seeds: DataFrame, backward: bool = False) -> DataFrame:
    """Every node reachable from the ``seeds`` (column ``key``), the
    seeds themselves included; ``backward`` follows edges in reverse."""
    e = _keyed(edges.select(F.col("dst" if backward else "src").alias("key"),
                            F.col("src" if backward else "dst").alias("next")), "key")
    known = _KnownSet(seeds.select("key").distinct(), ["key"])
    frontier = known.pieces[0]
    while True:
        step = frontier.hint("merge").join(e, "key").select(F.col("next").alias("key")).distinct()
        new = known.unseen(step)
        if new.isEmpty():
            return known.all()
        known.add(new)
        frontier = new


def transitive_closure(edges: DataFrame) -> DataFrame:
    """All pairs (src, dst) joined by a path of >= 1 edge (semi-naive)."""
    e = edges.select("src", "dst").distinct()
    known = _KnownSet(e, ["src", "dst"])
    by_src = _keyed(e.select(F.col("src").alias("mid"), "dst"), "mid")
    delta = known.pieces[0]
    while True:
        step = (delta.select("src", F.col("dst").alias("mid"))
                     .hint("merge").join(by_src, "mid")
                     .select("src", "dst").distinct())
        new = known.unseen(step)
        if new.isEmpty():
            return known.all()
        known.add(new)
        delta = new


# ------------------------------------------------------------------ G05, G06

def longest_paths(nodes: DataFrame, edges: DataFrame, weight: Column | None = None,
                  backward: bool = False, name: str = "level") -> DataFrame:
    """Longest weighted path length to every node, starting at 0 at
    the minimal nodes (``backward``: from the maximal nodes against the
    edges). The weight of the node left behind counts (1 when ``weight`` is
    None).

    Wave L holds the nodes that a path of exactly L edges reaches, with the
    largest weight of such a path; the result is the maximum over the waves,
    which are only ever appended. A cycle is an error that names keys: a node
    that no wave reaches, or nodes that stay when all others are trimmed away,
    which is looked at whenever the number of waves reaches a power of four
    from 64 on.
    """
    w = nodes.select("key", (weight if weight is not None else F.lit(1)).cast("long").alias("_w"))
    e = _keyed(edges.select(F.col("dst" if backward else "src").alias("key"),
                            F.col("src" if backward else "dst").alias("next")).hint("merge").join(w, "key"), "key")
    has_in = e.select(F.col("next").alias("key")).distinct()
    wave = _ckpt(nodes.select("key").hint("merge").join(has_in, "key", "left_anti").withColumn(name, F.lit(0).cast("long")))
    n = nodes.count()
    waves, length, probe = [wave], 0, 64
    while not wave.isEmpty():
        length += 1
        if length == probe or length > n:
            core, _ = _trim(nodes.select("key").distinct(), edges.select("src", "dst").distinct())
            core = core.unionByName(edges.where("src = dst").select(F.col("src").alias("key")))
            keys = [r["key"] for r in core.limit(5).collect()]
            if keys or length > n:
                raise ValueError(f"the graph has a cycle around {keys}")
            probe *= 4
        wave = _ckpt(wave.hint("merge").join(e, "key").groupBy(F.col("next").alias("key"))
                         .agg(F.max(F.col(name) + F.col("_w")).alias(name)))
        waves.append(wave)
        if len(waves) > STATE_CKPT_EVERY:
            waves = [_ckpt(_union(waves).groupBy("key").agg(F.max(name).alias(name)))]
    level = _ckpt(_union(waves).groupBy("key").agg(F.max(name).alias(name)))
    lost = nodes.select("key").hint("merge").join(level, "key", "left_anti")
    if level.count() < n and (keys := [r["key"] for r in lost.limit(5).collect()]):
        raise ValueError(f"the graph has a cycle through or before {keys}")
    return level


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, level, position): every edge goes from a lower to a higher
    level, so ordering by (level, key) is a topological order."""
    lv = longest_paths(nodes, edges)
    from pyspark.sql import Window

    from tactica.operators.ordering import number_rows
    # position = nodes on lower levels + rank of the key inside its level;
    # the level sizes are a small table, the rank is bucketed by key
    sizes = lv.groupBy("level").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("level", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    ranked = number_rows(lv, ["level"], ["key"], "_rk")
    return ranked.join(offsets, "level").withColumn("position", F.col("_off") + F.col("_rk")) \
                 .drop("_off", "_rk")


# ------------------------------------------------------------------ G07

def min_label(edges: DataFrame, labels: DataFrame, name: str = "label") -> DataFrame:
    """Propagate the minimum ``name`` along edges to every reachable node."""
    e = _keyed(edges.select(F.col("src").alias("key"), F.col("dst").alias("next")), "key")
    lab = _ckpt(labels.groupBy("key").agg(F.min(name).alias(name)))
    frontier = lab
    rnd = 0
    while True:
        cand = frontier.hint("merge").join(e, "key").groupBy(F.col("next").alias("key")).agg(F.min(name).alias(name))
        better = _ckpt(cand.hint("merge").join(lab.withColumnRenamed(name, "_old"), "key", "left")
                           .where(F.col("_old").isNull() | (F.col(name) < F.col("_old"))).select("key", name))
        if better.isEmpty():
            return lab
        rnd += 1
        lab = lab.hint("merge").join(better.select("key"), "key", "left_anti").unionByName(better)
        lab = _ckpt(lab) if rnd % STATE_CKPT_EVERY == 0 else lab
        frontier = better


def reachable_within_limit(edges: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """Take roots in ``ordinal`` order, each adding every node it newly
    reaches; stop before the root that pushes the total over ``limit`` (the
    first root is always taken). Owner of a node = smallest root ordinal
    reaching it (min-label propagation); the running total over ordinals is
    the skew-safe bucketed running sum and the cut a global ``min``."""
    from tactica.operators.ordering import running_sum
    owners = min_label(edges, roots.select("key", F.col("ordinal").alias("label")))
    weight = owners.groupBy(F.col("label").alias("ordinal")).agg(F.count(F.lit(1)).alias("adds"))
    r = roots.join(weight, "ordinal", "left").withColumn("adds", F.coalesce("adds", F.lit(0)).cast("long"))
    r = running_sum(r.withColumn("_all", F.lit(0)), ["_all"], ["ordinal"], {"total": F.col("adds")}).drop("_all")
    # two scalars (a partial aggregate), fetched once and used as literals
    stop, first = r.agg(F.min(F.when(F.col("total") > limit, F.col("ordinal"))),
                        F.min("ordinal")).first()
    taken = F.col("ordinal") == F.lit(first)
    if stop is not None:
        taken = taken | (F.col("ordinal") < F.lit(stop))
    else:
        taken = F.lit(True)
    return r.withColumn("taken", taken)


# ------------------------------------------------------------------ G08

def _trim(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop nodes without an edge in or without an edge out, wave by wave, each over
    the edges that the last one left."""
    inner = edges.where("src <> dst").hint("merge").join(nodes.withColumnRenamed("key", "src"), "src", "left_semi") \
                 .hint("merge").join(nodes.withColumnRenamed("key", "dst"), "dst", "left_semi")
    e = _keyed(inner, "src")
    rest = nodes
    while True:
        both = e.select(F.col("src").alias("key")).distinct().hint("merge").join(e.select(F.col("dst").alias("key")).distinct(), "key", "left_semi")
        kept = _ckpt(rest.hint("merge").join(both, "key", "left_semi"))
        smaller = _ckpt(e.hint("merge").join(kept.withColumnRenamed("key", "src"), "src", "left_semi")
                         .hint("merge").join(kept.withColumnRenamed("key", "dst"), "dst", "left_semi"))
        if smaller.count() == e.count():
            return kept, smaller
        rest, e = kept, smaller


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Strongly connected components, id = smallest key (coloring method).

    Nodes without a predecessor or a successor among the rest are components
    of their own and are trimmed first, wave by wave. Then, in rounds, forward
    min-key propagation colours every node; a node whose
    colour is its own key is a root; its component is the set of same-colour
    nodes that reach it (backward propagation inside the colour). Those nodes
    are removed and the loop repeats on the rest.
    """
    known = nodes.select("key").distinct()
    rest, e = _trim(known, edges.select("src", "dst").distinct())
    done = _ckpt(known.hint("merge").join(rest, "key", "left_anti").withColumn("component", F.col("key")))
    while not rest.isEmpty():
        e = _ckpt(e.hint("merge").join(rest.withColumnRenamed("key", "src"), "src", "left_semi")
                   .hint("merge").join(rest.withColumnRenamed("key", "dst"), "dst", "left_semi"))
        color = min_label(e, rest.withColumn("label", F.col("key")))
        # backward inside colour classes, starting from the roots
        members = _ckpt(color.where(F.col("key") == F.col("label")).select("key", "label"))
        frontier = members
        back = e.select(F.col("dst").alias("key"), F.col("src").alias("prev"))
        while True:
            step = (frontier.hint("merge").join(back, "key").select(F.col("prev").alias("key"), "label")
                            .hint("merge").join(color.withColumnRenamed("label", "_c"), "key")
                            .where(F.col("_c") == F.col("label")).select("key", "label").distinct())
            new = _ckpt(step.hint("merge").join(members, "key", "left_anti"))
            if new.isEmpty():
                break
            members = _ckpt(members.unionByName(new))
            frontier = new
        done = _ckpt(done.unionByName(members.select("key", F.col("label").alias("component"))))
        rest = _ckpt(rest.hint("merge").join(members, "key", "left_anti"))
    return done


# ------------------------------------------------------------------ G10 - G14

def reach_from(edges: DataFrame, starts: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Pairs (seed, key): ``key`` is reached from a row (seed, key) of ``starts``
    by any number of edges; semi-naive, keyed by both. ``keep`` (seed, last)
    with ``key`` levels in ``edges`` column ``level`` stops a seed's search at
    nodes above ``last``."""
    e = _keyed(edges.select(F.col("src").alias("key"), F.col("dst").alias("next"),
                            *([F.col("level")] if keep is not None else [])), "key")
    known = _KnownSet(starts.select("seed", "key").distinct(), ["seed", "key"])
    frontier = known.pieces[0]
    while True:
        step = frontier.hint("merge").join(e, "key")
        if keep is not None:
            step = step.hint("merge").join(keep, "seed").where(F.col("level") <= F.col("last"))
        new = known.unseen(step.select("seed", F.col("next").alias("key")).distinct())
        if new.isEmpty():
            return known.all()
        known.add(new)
        frontier = new


def transitive_reduction(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reduced edges, cycle nodes). x -> y is dropped when some z has
    x -> z and a path z to y. On an acyclic graph only nodes with two or more
    successors can lose an edge, and a path from them is followed only up to
    the level of their highest successor (a path climbs in level). Nodes on a
    cycle are returned; the reduction is only defined when there are none."""
    e = _ckpt(edges.select("src", "dst").distinct())
    nodes = e.select(F.col("src").alias("key")).unionByName(e.select(F.col("dst").alias("key"))).distinct()
    try:
        level = longest_paths(nodes, e)
        cycles = nodes.limit(0)
    except ValueError:
        comp = strong_components(nodes, e)
        large = comp.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("component")
        loops = e.where("src = dst").select(F.col("src").alias("key"))
        level = None
        cycles = _ckpt(comp.hint("merge").join(large, "component", "left_semi").select("key").unionByName(loops).distinct())
    forked = e.groupBy(F.col("src").alias("seed")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("seed")
    firsts = e.select(F.col("src").alias("seed"), F.col("dst").alias("key"))
    if level is not None:
        starts = firsts.hint("merge").join(forked, "seed", "left_semi")
        last = starts.hint("merge").join(level, "key").groupBy("seed").agg(F.max("level").alias("last"))
        lifted = e.hint("merge").join(level.withColumnRenamed("key", "dst"), "dst")
        step = starts.hint("merge").join(lifted.select(F.col("src").alias("key"), F.col("dst").alias("next"), "level"), "key") \
                     .hint("merge").join(last, "seed").where("level <= last").select("seed", F.col("next").alias("key"))
        implied = reach_from(lifted, step, last)
    else:
        step = firsts.hint("merge").join(e.select(F.col("src").alias("key"), F.col("dst").alias("next")), "key")
        implied = reach_from(e, step.select("seed", F.col("next").alias("key")))
    reduced = e.hint("merge").join(implied.select(F.col("seed").alias("src"), F.col("key").alias("dst")), ["src", "dst"], "left_anti")
    return reduced, cycles


def subgraph(nodes: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Keep nodes satisfying ``keep`` and the edges between kept nodes."""
    n = nodes.where(keep)
    k = n.select("key")
    e = (edges.join(k.withColumnRenamed("key", "src"), "src", "left_semi")
              .join(k.withColumnRenamed("key", "dst"), "dst", "left_semi"))
    return n, e


def named_premises(edges: DataFrame, starts: DataFrame, named: DataFrame) -> DataFrame:
    """From each start walk the dependencies; stop at named nodes (they
    are reported), go on through unnamed ones; each node visited once per
    start. Output distinct (start, key) with key named."""
    e = _keyed(edges.select(F.col("src").alias("key"), F.col("dst").alias("next")), "key")
    nm = _keyed(named.select("key").distinct().withColumn("_named", F.lit(True)), "key")
    known = _KnownSet(starts.select("start", "key").distinct(), ["start", "key"])
    frontier, hits = known.pieces[0], [starts.select("start", "key").limit(0)]
    while True:
        new = known.unseen(frontier.hint("merge").join(e, "key").select("start", F.col("next").alias("key")).distinct())
        if new.isEmpty():
            return _union(hits)
        known.add(new)
        hits.append(new.hint("merge").join(nm, "key", "left_semi").select("start", "key"))
        frontier = new.hint("merge").join(nm, "key", "left_anti")


def local_in_dependency_order(nodes: DataFrame, edges: DataFrame, local: Column) -> DataFrame:
    """Local nodes in dependency order (G05 levels, then key)."""
    lv = longest_paths(nodes, edges)
    return lv.join(nodes.where(local).select("key"), "key", "left_semi")


# ------------------------------------------------------------------ G12, one by one

def cycle_checked_insert_sequential(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """G12 with the reference's sequential meaning: candidates are inserted one
    by one in (src, dst) order and each is refused when its target already
    reaches its source through the graph plus the candidates accepted before it.

    A cycle never leaves a strongly connected component of the graph with all
    candidates in it, so a candidate between two components is accepted, and
    for the others only the edges inside their component count.

    Reduction to a small candidate graph K: i -> j when candidate i's target
    reaches candidate j's source in the graph (closure, or equal). A candidate
    is refused iff it is refused by the graph alone (target reaches source) or
    lies on a cycle of K made of earlier-accepted candidates. Candidates on no
    cycle of K are always accepted; only the strongly connected components of
    K need an ordered pass, done per component (the dependency is inherent).
    """
    import pandas as pd

    from tactica.operators.ordering import number_rows

    everyone = _ckpt(candidates.select("src", "dst").distinct())
    whole = edges.select("src", "dst").unionByName(everyone)
    place = strong_components(whole.select(F.explode(F.array("src", "dst")).alias("key")), whole)

    def inside(pairs: DataFrame) -> DataFrame:
        at = lambda end: place.select(F.col("key").alias(end), F.col("component").alias(f"_{end}"))
        return pairs.hint("merge").join(at("src"), "src").hint("merge").join(at("dst"), "dst") \
                    .where("_src = _dst").select("src", "dst")

    edges, cand = _ckpt(inside(edges.select("src", "dst"))), inside(everyone)
    cand = number_rows(cand.withColumn("_all", F.lit(0)), ["_all"], ["src", "dst"], "cid").drop("_all")
    cand = _ckpt(cand)
    # from the targets of the candidates only, and only to their sources
    found = reach_from(edges, cand.select(F.col("dst").alias("seed"), F.col("dst").alias("key")))
    reach = _ckpt(found.hint("merge").join(cand.select(F.col("src").alias("key")).distinct(), "key", "left_semi")
                  .select(F.col("seed").alias("a"), F.col("key").alias("b")))
    refused = (cand.hint("merge").join(reach, (F.col("dst") == F.col("a")) & (F.col("src") == F.col("b")), "left_semi")
                   .unionByName(cand.where(F.col("src") == F.col("dst"))).select("cid").distinct())
    rest = _ckpt(cand.hint("merge").join(refused, "cid", "left_anti"))
    ri = rest.select(F.col("cid").alias("i"), F.col("dst").alias("y"))
    rj = rest.select(F.col("cid").alias("j"), F.col("src").alias("x"))
    via = ri.hint("merge").join(reach, F.col("y") == F.col("a")).hint("merge").join(rj, F.col("b") == F.col("x")).select("i", "j")
    k_edges = _ckpt(via.distinct().where(F.col("i") != F.col("j")))
    comp = strong_components(rest.select(F.col("cid").alias("key")),
                             k_edges.select(F.col("i").alias("src"), F.col("j").alias("dst")))
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    comp = comp.hint("merge").join(size, "component")
    free = comp.where(F.col("_n") == 1).select(F.col("key").alias("cid"), F.lit(True).alias("accepted"))
    tangled = comp.where(F.col("_n") > 1).select(F.col("key").alias("cid"), "component")
    inner = (k_edges.hint("merge").join(tangled.select(F.col("cid").alias("i"), "component"), "i")
                    .hint("merge").join(tangled.select(F.col("cid").alias("j"), F.col("component").alias("_c2")), "j")
                    .where(F.col("component") == F.col("_c2")).select("component", "i", "j"))
    rows = (tangled.select("component", F.col("cid").alias("i"), F.lit(None).cast("long").alias("j"))
                   .unionByName(inner))

    def ordered_pass(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf["i"].astype("int64")))
        succ: dict[int, list[int]] = {}
        for a, b in pdf.dropna(subset=["j"])[["i", "j"]].itertuples(index=False):
            succ.setdefault(int(a), []).append(int(b))
        accepted: set[int] = set()
        out = []
        for node in nodes:
            seen, stack, cyc = set(), [node], False
            while stack and not cyc:
                u = stack.pop()
                for v in succ.get(u, ()):
                    if v == node:
                        cyc = True
                        break
                    if v in accepted and v not in seen:
                        seen.add(v)
                        stack.append(v)
            if not cyc:
                accepted.add(node)
            out.append((node, not cyc))
        return pd.DataFrame(out, columns=["cid", "accepted"])

    ordered = rows.groupBy("component").applyInPandas(ordered_pass, "cid long, accepted boolean")
    verdict = (refused.withColumn("accepted", F.lit(False)).unionByName(free).unionByName(ordered))
    judged = cand.hint("merge").join(verdict, "cid").select("src", "dst", "accepted")
    return everyone.hint("merge").join(judged, ["src", "dst"], "left") \
                   .select("src", "dst", F.coalesce("accepted", F.lit(True)).alias("accepted"))
