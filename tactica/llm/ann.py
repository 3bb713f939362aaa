"""Operator 3: nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Largest inner product is made a nearest-neighbour question: with M the largest
norm, a vector x gets the coordinate sqrt(M^2 - |x|^2), and a query the
coordinate 0, so that squared distance is |q|^2 + M^2 - 2 q.x.

A Gaussian (2-stable) matrix projects to few dimensions. The squared projected
distance of a pair over its squared distance has a chi-square distribution, so
projected neighbours are taken in order of their distance and verified on the
vectors themselves, until the next one lies beyond
``d_k^2 * quantile(chi-square, confidence)``, with d_k the k-th smallest
distance found: a true neighbour is then missed with a chance of
``1 - confidence`` at most.

The kd-tree has two levels. Its upper splits, fitted on a bounded sample, make
cells that are spread over the cluster; every row is filed in its cell, and a
cell with many rows (one vector may fill a third of the table) is dealt over
several groups, as are the queries of a cell that many are sent to. Each group builds its own lower tree. Queries first search
their home cell; the k-th distance found there then tells which other cells the
stopping test lets them reach.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactica.llm.common import written

#: Rows that the upper splits and the matrix size are fitted on, at most about.
SAMPLE_ROWS = 20_000
MAX_CELLS = 4096
LEAF = 64


def chi_square_quantile(p: float, m: int) -> float:
    """By bisection of the distribution function's series."""
    def below(x: float) -> float:
        term = total = 1 / math.gamma(m / 2 + 1)
        k = 1
        while term > total * 1e-15:
            term *= x / 2 / (m / 2 + k)
            total += term
            k += 1
        return total * math.exp(-x / 2 + m / 2 * math.log(x / 2))

    lo, hi = 1e-9, 20.0 * m + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return lo


class Space:
    """The matrix, the largest norm and the upper splits; small, and sent to every task."""

    def __init__(self, dim: int, m: int, top_norm: float, seed: int):
        self.top = top_norm
        self.matrix = np.random.default_rng(seed).standard_normal((dim + 1, m))
        self.low = np.full((1, m), -np.inf)
        self.high = np.full((1, m), np.inf)
        self.splits: list[tuple] = []

    def project(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top ** 2 - (x * x).sum(1), 0))
        # one row at a time in effect, so that equal vectors get equal places
        return np.einsum("ij,jk->ik", np.column_stack([x, last]), self.matrix)

    def split(self, sample: np.ndarray, cells: int) -> None:
        """Median splits along the widest side; a cell whose sample is one point stays whole."""
        boxes = [(np.arange(len(sample)), self.low[0], self.high[0], 0)]
        nodes: list[list] = [[None]]
        while len(boxes) < cells:
            i = max(range(len(boxes)), key=lambda b: len(boxes[b][0]))
            rows, low, high, node = boxes[i]
            spread = np.ptp(sample[rows], axis=0) if len(rows) > 1 else np.zeros(1)
            axis = int(spread.argmax())
            cut = float(np.median(sample[rows, axis])) if spread.max() > 0 else None
            right = sample[rows, axis] >= cut if cut is not None else None
            if right is None or right.all() or not right.any():
                boxes[i] = (rows[:1], low, high, node)
                if all(len(b[0]) <= 1 for b in boxes):
                    break
                continue
            l_high, r_low = high.copy(), low.copy()
            l_high[axis] = r_low[axis] = cut
            nodes[node][:] = [axis, cut, len(nodes), len(nodes) + 1]
            boxes[i] = (rows[~right], low, l_high, len(nodes))
            boxes.append((rows[right], r_low, high, len(nodes) + 1))
            nodes += [[None], [None]]
        for number, (_, _, _, node) in enumerate(boxes):
            nodes[node][:] = [None, number]
        self.splits = [tuple(n) for n in nodes]
        self.low, self.high = np.array([b[1] for b in boxes]), np.array([b[2] for b in boxes])

    def cells_of(self, points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            split = self.splits[node]
            if split[0] is None:
                out[rows] = split[1]
            elif len(rows):
                right = points[rows, split[0]] >= split[1]
                todo += [(split[2], rows[~right]), (split[3], rows[right])]
        return out

    def reach(self, point: np.ndarray) -> np.ndarray:
        """Squared distance from a point to each cell."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(1)


class Tree:
    """A lower tree: blocks of near points with their boxes."""

    def __init__(self, points: np.ndarray):
        blocks, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            spread = np.ptp(points[rows], axis=0)
            if len(rows) <= LEAF or spread.max() == 0:
                blocks.append(rows)
                continue
            order = rows[np.argpartition(points[rows, spread.argmax()], len(rows) // 2)]
            todo += [order[:len(rows) // 2], order[len(rows) // 2:]]
        self.blocks = blocks
        self.low = np.array([points[b].min(0) for b in blocks])
        self.high = np.array([points[b].max(0) for b in blocks])


def _first_of_equals(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows by id, of equal vectors the first ``2 * k`` of those with at most ``k`` to an id.

    Whichever id a query leaves out, the first ``k`` of the others are there.
    """
    seen: dict[bytes, list[int]] = {}
    keep = []
    for i in np.argsort(ids, kind="stable").tolist():
        # rows kept, the last id, its rows kept
        n = seen.setdefault(x[i].tobytes(), [0, 0, 0])
        if n[1] != ids[i]:
            n[1:] = int(ids[i]), 0
        if n[0] < 2 * k and n[2] < k:
            n[0] += 1
            n[2] += 1
            keep.append(i)
    return np.array(keep, np.int64)


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best rows of each query, largest score first, ties by id."""
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    keep = rank < k
    return q[keep], ids[keep], score[keep]


def search(space: Space, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray,
           k: int, factor: float) -> tuple[np.ndarray, ...]:
    """(query_id, vec_id, score) of up to ``k`` nearest of each query. ``kth``: scores that a row has to reach.

    All queries go on together: in each round every query takes the next few
    blocks in the order of their projected distance, as long as the stopping
    test lets it, and a block is verified for all queries that reached it.
    """
    keep = _first_of_equals(ids, x, k)
    ids, x = ids[keep], x[keep]
    tree = Tree(space.project(x))
    points = space.project(queries, query=True)
    reach = np.empty((len(queries), len(tree.blocks)))
    for i, p in enumerate(points):
        gap = np.maximum(np.maximum(tree.low - p, p - tree.high), 0)
        reach[i] = (gap * gap).sum(1)
    order = np.argsort(reach, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], 1)
    base = (queries * queries).sum(1) + space.top ** 2
    slack = 1e-9 * (1 + space.top * np.sqrt((queries * queries).sum(1)))
    bound = kth.astype(float).copy()
    hits = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    at, step = 0, 2
    while at < order.shape[1]:
        # the stopping test: what lies further can't be near enough, but for the chance allowed
        limit = np.maximum(base - 2 * bound, 0) * factor * (1 + 1e-9)
        wanted = (rank >= at) & (rank < at + step) & (reach <= limit[:, None])
        if not (reach[rank >= at].size and (wanted.any() or ((rank >= at) & (reach <= limit[:, None])).any())):
            break
        found = [hits]
        for block in np.flatnonzero(wanted.any(0)).tolist():
            asks, rows = np.flatnonzero(wanted[:, block]), tree.blocks[block]
            # a product of matrices finds the rows worth a look; their scores are summed one by one
            i, j = np.nonzero(queries[asks] @ x[rows].T >= (bound - slack)[asks][:, None])
            q, r = asks[i], rows[j]
            other = ids[r] != query_ids[q]
            q, r = q[other], r[other]
            for part in range(0, len(q), 1 << 15):
                pq, pr = q[part:part + (1 << 15)], r[part:part + (1 << 15)]
                found.append((pq, ids[pr], (x[pr] * queries[pq]).sum(1)))
        hits = _best(*(np.concatenate(c) for c in zip(*found)), k)
        counts = np.bincount(hits[0], minlength=len(queries))
        full = counts == k
        last = np.cumsum(counts) - 1
        bound[full] = np.maximum(bound[full], hits[2][last[full]])
        at, step = at + step, min(2 * step, 16)
    good = hits[2] >= kth[hits[0]]
    return query_ids[hits[0][good]], hits[1][good], hits[2][good]


RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _searched(space, factor: float, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return RESULT.empty_table()
        col = lambda t, n: t.column(n).combine_chunks()
        found = search(space.value, col(left, "vec_id").to_numpy(), _matrix(col(left, "v")), col(right, "query_id").to_numpy(),
                       _matrix(col(right, "q")), col(right, "kth").to_numpy(), k, factor)
        return pa.table([pa.array(c, f.type) for c, f in zip(found, RESULT)], schema=RESULT)

    return run


def meet(rows: DataFrame, asked: DataFrame, group_queries: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (cell, part, ...) and ``asked`` (query_id, cell, part, ...; a query is sent to all parts of
    a cell), both with a turn: in a cell and turn are about ``group_queries`` queries at most. Rows are
    copied only in cells that more queries are sent to; rows of cells without queries are left out."""
    # one row per cell, at most MAX_CELLS
    turns = F.broadcast(asked.where("part = 0").groupBy("cell").agg(F.ceil(F.count("*") / group_queries).cast("int").alias("turns")))
    rows = rows.join(turns, "cell").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
    asked = asked.join(turns, "cell").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int")).drop("turns")
    return rows, asked


def nearest(vectors: DataFrame, is_query, k: int = 20, dims: int = 8, confidence: float = 0.98, cell_rows: int = 8192,
            group_queries: int = 20_000, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products found for each query row.

    ``vectors``: vec_id, embedding (all of one length). Vectors that are null,
    zero, or hold a null or non-finite number take no part, as query or
    candidate. A row whose vec_id is the query's is no candidate. Ties go to the
    smaller vec_id; fewer candidates than ``k`` are all returned; a repeated
    candidate row is returned as often as it is there, of repeated query rows
    the smallest vector asks. Rows without vec_id take no part. Further columns
    are ignored. An empty table gives no rows. Vectors of different lengths
    fail the job.
    """
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), is_query.alias("asks")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = clean.agg(F.count("*").alias("n"), F.max(norm).alias("top"), F.max(F.size("v")).alias("dim"),
                      F.sum(F.col("asks").cast("long")).alias("asking")).first()
    if not facts["n"] or not facts["asking"]:
        return empty
    space = Space(facts["dim"], dims, facts["top"], seed)
    rate = min(1.0, SAMPLE_ROWS / facts["n"])
    sample = (clean.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(math.ceil(rate * 1_000_000)))
              .select("v").limit(2 * SAMPLE_ROWS).toArrow().column("v").combine_chunks())
    if len(sample):
        cells = min(MAX_CELLS, max(1, round(facts["n"] / cell_rows)))
        space.split(space.project(_matrix(sample)), cells)
    else:
        space.split(np.zeros((1, dims)), 1)
    shared = spark.sparkContext.broadcast(space)
    factor = chi_square_quantile(confidence, dims)

    def file_rows(batches):
        for batch in batches:
            if batch.num_rows:
                cell = shared.value.cells_of(shared.value.project(_matrix(batch.column(1))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec_id", "v", "asks", "cell"])

    filed = written(clean.mapInArrow(file_rows, "vec_id long, v array<double>, asks boolean, cell long"), "ann")
    # one row per cell, at most MAX_CELLS
    parts = {r["cell"]: -(-r["n"] // (2 * cell_rows)) for r in filed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    wide = [c for c, n in parts.items() if n > 1]
    n_parts = F.coalesce(F.create_map(*[F.lit(x) for c in wide for x in (c, parts[c])])[F.col("cell")], F.lit(1)) if wide else F.lit(1)
    rows = filed.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id", F.lit(1)), n_parts).alias("part"))
    queries = filed.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    keys = ["cell", "part", "turn"]
    look = _searched(shared, factor, k)
    schema = "query_id long, vec_id long, score double"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def send(first: bool):
        def run(batches):
            space = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                qs = _matrix(batch.column(1))
                points = space.project(qs, query=True)
                home = space.cells_of(points)
                ids, kths = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                out = []
                for i, point in enumerate(points):
                    if first:
                        to, kth = [int(home[i])], -math.inf
                    else:
                        kth = -math.inf if kths[i] is None else kths[i]
                        limit = (float((qs[i] * qs[i]).sum()) + space.top ** 2 - 2 * kth) * factor
                        to = [c for c in np.flatnonzero(space.reach(point) <= limit * (1 + 1e-9)).tolist() if c != home[i]]
                    out += [(ids[i], qs[i], kth, c, p) for c in to for p in range(parts.get(c, 0))]
                if out:
                    a, b, s, c, p = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, pa.int64()), pa.array(list(b), pa.list_(pa.float64())),
                         pa.array(s, pa.float64()), pa.array(c, pa.int64()), pa.array(p, pa.int64())],
                        ["query_id", "q", "kth", "cell", "part"])
        return run

    sent = "query_id long, q array<double>, kth double, cell long, part long"

    def searched(asked: DataFrame) -> DataFrame:
        filed_rows, asks = meet(rows, written(asked, "ann-asked"), group_queries)
        return filed_rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(look, schema)

    near = searched(queries.withColumn("kth", F.lit(None).cast("double")).mapInArrow(send(True), sent))
    near = written(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ann-home")
    bounds = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    far = searched(queries.join(bounds, "query_id", "left").select("query_id", "q", "kth").mapInArrow(send(False), sent))
    both = near.drop("rank").unionByName(far)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
