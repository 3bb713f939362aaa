"""Operator 11: centroid clustering with heap-ordered bounds.

Vectors lie in blocks of a few thousand. A block keeps one heap for each
cluster; an entry is a vector of the cluster, its key the gap between the lower
bound of the distance to any other centroid and the upper bound of the distance
to its own, plus the drift that the cluster had accumulated when the entry was
made. In every round a centroid moves and its cluster's drift grows by its own
way and the longest way of another. A key above the accumulated drift proves
that the vector stays; only entries whose gap has expired are popped, and these
vectors are rescanned exactly. All sums and distances are integers, so the
result is that of the plain rounds; the bounds only decide what is looked at.

Between rounds the driver holds the centroids and their integer sums (a fixed
size). The vectors are dealt by block once and checkpointed, which keeps their
partitioning; a round shuffles only the heaps (12 bytes a vector).
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactica.llm.common import written
from tactica.session import ensure_checkpoint_dir

SCALE = 1024
#: Vectors of a block.
BLOCK_ROWS = 4096
#: Integer components beyond this could overflow a squared distance of 64 bits.
LARGEST = 1 << 27
#: Share by which bounds are widened against the rounding of square roots.
SAFE = 1e-9

_STATE = "block long, keys array<double>, at array<int>, sizes array<int>, moved array<long>, popped long"


def _blocks(vectors: DataFrame, vector_col: str, id_col: str, dim: int, block_rows: int) -> DataFrame:
    """block, ids, rows: the kept vectors as little-endian 32-bit integers, ``block_rows`` to a row at most."""

    def run(batches):
        part, made = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            vector = batch.column(1)
            keep = np.array([n == dim for n in pa.compute.list_value_length(vector).to_pylist()], bool)
            if not keep.any():
                continue
            kept = batch.filter(pa.array(keep))
            x = kept.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
            fine = np.isfinite(x).all(axis=1)
            ids = kept.column(0).filter(pa.array(fine))
            z = np.floor(SCALE * x[fine])
            if z.size and np.abs(z).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST // SCALE}: its squared distance has no 64-bit value")
            z = z.astype("<i4")
            for i in range(0, len(z), block_rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part + made]), pa.array([ids.slice(i, block_rows).to_pylist()], pa.list_(pa.int64())),
                     pa.array([z[i:i + block_rows].tobytes()], pa.binary())], ["block", "ids", "rows"])
                made += 1

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(
        run, "block long, ids array<long>, rows binary")


def _matrix(data, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").reshape(-1, dim).astype(np.int64)


def _starts(blocks: DataFrame, dim: int, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of ``salt`` and id; ties by the components, null ids last."""

    def run(batches):
        for batch in batches:
            for ids, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = _matrix(data.as_buffer(), dim)
                first = heapq.nsmallest(k, ((i is None, hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), x[j].tolist())
                                            for j, i in enumerate(ids)))
                none, digest, vector = zip(*first)
                yield pa.RecordBatch.from_arrays([pa.array(none), pa.array(digest), pa.array(vector, pa.list_(pa.int64()))],
                                                 ["none", "digest", "vector"])

    found = blocks.select("ids", "rows").mapInArrow(run, "none boolean, digest string, vector array<long>")
    rows = found.orderBy("none", "digest", "vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], np.int64).reshape(-1, dim)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a column for each centroid."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for c, centre in enumerate(centroids):
        d = x - centre
        out[:, c] = np.einsum("ij,ij->i", d, d)
    return out


def _rescan(x: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (ties: the smaller number) and the key of its new entry."""
    d = _distances(x, centroids)
    own = d.argmin(axis=1)
    near = np.sqrt(d[np.arange(len(x)), own].astype(float))
    d[np.arange(len(x)), own] = np.iinfo(np.int64).max
    other = np.sqrt(d.min(axis=1).astype(float)) if d.shape[1] > 1 else np.full(len(x), math.inf)
    gap = np.where(np.isinf(other), other, other * (1 - SAFE) - near * (1 + SAFE) - SAFE)
    return own, gap + drift[own]


def _round(data, heaps: list[list], centroids: np.ndarray, drift: np.ndarray, dim: int):
    """One round of a block: the heaps after it, what its moves add to each cluster's sums, the entries popped.

    ``heaps`` is empty in the first round: every vector counts as expired, of no cluster.
    """
    k = len(centroids)
    moved = np.zeros((k, dim + 1), np.int64)
    if heaps:
        gone, was = [], []
        for c, heap in enumerate(heaps):
            while heap and heap[0][0] <= drift[c]:
                gone.append(heapq.heappop(heap)[1])
                was.append(c)
        if not gone:
            return heaps, moved, 0
        at = np.array(gone)
        x = np.frombuffer(data, "<i4").reshape(-1, dim)[at].astype(np.int64)
        was = np.array(was)
    else:
        heaps = [[] for _ in range(k)]
        x = _matrix(data, dim)
        at, was = np.arange(len(x)), None
    own, key = _rescan(x, centroids, drift)
    for c in range(k):
        mine = own == c
        entries = list(zip(key[mine].tolist(), at[mine].tolist()))
        if heaps[c]:
            for entry in entries:
                heapq.heappush(heaps[c], entry)
        else:
            heapq.heapify(entries)
            heaps[c] = entries
        came = mine if was is None else mine & (was != c)
        moved[c, :dim] += x[came].sum(axis=0)
        moved[c, dim] += int(came.sum())
        if was is not None:
            left = (was == c) & ~mine
            moved[c, :dim] -= x[left].sum(axis=0)
            moved[c, dim] -= int(left.sum())
    return heaps, moved, len(at)


def _heaps(state: pa.Table) -> list[list]:
    keys, at, sizes = (state.column(n)[0].as_py() for n in ("keys", "at", "sizes"))
    cuts = np.cumsum([0, *sizes]).tolist()
    return [list(zip(keys[i:j], at[i:j])) for i, j in zip(cuts, cuts[1:])]


def _state(block: int, heaps: list[list], moved: np.ndarray, popped: int) -> pa.Table:
    entries = [e for h in heaps for e in h]
    return pa.table([
        pa.array([block]), pa.array([[e[0] for e in entries]], pa.list_(pa.float64())),
        pa.array([[e[1] for e in entries]], pa.list_(pa.int32())), pa.array([[len(h) for h in heaps]], pa.list_(pa.int32())),
        pa.array([moved.ravel().tolist()], pa.list_(pa.int64())), pa.array([popped])],
        names=["block", "keys", "at", "sizes", "moved", "popped"])


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, vector_col: str = "embedding", id_col: str = "vec_id",
            salt: str = "3:", block_rows: int = BLOCK_ROWS, report: list | None = None) -> DataFrame:
    """id, cluster, distance (squared, to the final centroid), cluster_inertia, inertia, centroid (its integers).

    One row for each vector of exactly ``dim`` components, none of them null or
    not finite; other vectors take no part. Each component x counts as
    floor(1024 x). Rows that repeat an id are vectors of their own; rows without
    id are clustered, and start a cluster only where fewer than ``k`` vectors
    have an id. With fewer than ``k`` vectors there are as many clusters as
    vectors; an empty table gives an empty result. A component beyond 131,072
    is refused, as squared distances would leave 64 bits. Columns other than
    the two named are not looked at. ``report`` collects the vectors rescanned
    in each round.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt by block once: the checkpoint keeps the partitioning, so no round moves a vector again
    blocks = _blocks(vectors, vector_col, id_col, dim, block_rows).repartition(parts, "block").checkpoint()
    centroids = _starts(blocks, dim, k, salt)
    n = len(centroids)
    sums = np.zeros((n, dim + 1), np.int64)
    drift = np.zeros(n)
    state = None

    def advance(state: DataFrame | None) -> DataFrame:
        """The state after all vectors are assigned to ``centroids``."""
        now, ways = centroids, drift
        if state is None:
            def first(batches):
                for batch in batches:
                    for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                        yield from _state(block, *_round(data.as_buffer(), [], now, ways, dim)).to_batches()
            return blocks.select("block", "rows").mapInArrow(first, _STATE).checkpoint()

        def step(left: pa.Table, right: pa.Table) -> pa.Table:
            found = _round(left.column("rows").chunk(0)[0].as_buffer(), _heaps(right), now, ways, dim)
            return _state(left.column("block")[0].as_py(), *found)

        return (blocks.select("block", "rows").groupBy("block")
                .cogroup(state.select("block", "keys", "at", "sizes").groupBy("block")).applyInArrow(step, _STATE).checkpoint())

    for _ in range(rounds if n else 0):
        state = advance(state)
        added = (state.select("popped", F.posexplode("moved").alias("place", "value")).groupBy("place")
                 .agg(F.sum("value").alias("value"), F.sum("popped").alias("popped")).collect())
        change = np.zeros(n * (dim + 1), np.int64)
        for r in added:
            change[r["place"]] = r["value"]
        if report is not None:
            report.append(added[0]["popped"])
        sums = sums + change.reshape(n, dim + 1)
        full = sums[:, dim] > 0
        after = centroids.copy()
        after[full] = sums[full, :dim] // sums[full, dim:]  # floor
        if (after == centroids).all():
            break  # every further round would repeat this one
        way = np.sqrt(((after - centroids).astype(float) ** 2).sum(axis=1)) * (1 + SAFE)
        longest = np.array([max((w for j, w in enumerate(way) if j != c), default=0.0) for c in range(n)])
        drift = (drift + way + longest) * (1 + SAFE)
        centroids = after
    else:
        state = advance(state) if n else None
    schema = "id long, cluster int, distance long"
    if state is None:
        placed = blocks.select(F.lit(0).cast("long").alias("id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
    else:
        final = centroids

        def place(left: pa.Table, right: pa.Table) -> pa.Table:
            x = _matrix(left.column("rows").chunk(0)[0].as_buffer(), dim)
            own = np.empty(len(x), np.int32)
            for c, heap in enumerate(_heaps(right)):
                own[[e[1] for e in heap]] = c
            d = x - final[own]
            return pa.table([left.column("ids")[0].values, pa.array(own), pa.array(np.einsum("ij,ij->i", d, d))],
                            names=["id", "cluster", "distance"])

        placed = (blocks.groupBy("block").cogroup(state.select("block", "keys", "at", "sizes").groupBy("block"))
                  .applyInArrow(place, schema))
    placed = written(placed, "clusters")
    # one row a cluster: at most k
    totals = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = spark.createDataFrame([(c, totals[c], sum(totals.values()), centroids[c].tolist()) for c in sorted(totals)],
                                  "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return placed.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(clusters: DataFrame) -> DataFrame:
    """``cluster``'s result with the sha256 of the centroid's decimal integers, joined by commas, for the centroid."""
    text = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return clusters.select(*[c for c in clusters.columns if c != "centroid"], F.sha2(text, 256).alias("centroid_sha256"))
