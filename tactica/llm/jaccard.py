"""Operator 5: an exact join of word-shingle sets by Jaccard similarity, as a metric-space join.

Jaccard distance is a metric, so regions around pivots and the triangle
inequality decide which documents have to meet. Every step keeps each pair
within the distance together in some region; none is dropped.

1. Equal sets are one class, which its smallest doc_id stands for.
2. First pivots: sets of one shingle. Seen from these, a document is nearest to
   the pivots of its own shingles; ties go by one order for all (rare shingles
   before frequent ones). Two sets within the distance share a shingle among
   the first ``n - ceil(0.8 n) + 1`` of both: that window of regions is where
   a document is sent. (Pivots that are documents can't do this step: most
   documents share nothing with them and lie at distance 1 from all.)
3. Regions join by a contraction of the space: counts of a set's hashes in a few
   buckets under the Soergel distance, which is a metric and never larger
   than the Jaccard distance. What stays together makes the next regions.
4. Those join exactly, on the whole sets. In steps 3 and 4 documents serve as
   pivots; a pair is compared only if it is not yet connected and the distances
   of both to earlier pivots don't exclude it by the triangle inequality.

A region of step 3 or 4 of more than ``MEMBERS`` documents or ``REGION_BYTES``
bytes is divided by pivots of its own into Voronoi cells with windows of
boundary documents, and a cell that is still too large is divided again by
pivots of the cell (``divide``). So the pairs that one task compares are
bounded, whatever the size of a group.

Sets hold 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactica.llm.common import slices, written
from tactica.llm.components import components
from tactica.llm.shingles import mix, shingle_sets

#: Similarity of a link, in hundredths: 100 * intersection >= SIMILAR * union.
SIMILAR = 80
#: One document in so many is looked at for frequent shingles, of which at most FREQUENT (the most
#: frequent) go to the tasks. This only sets the order of the first pivots; the result is exact for any.
SAMPLE_SHARE, FREQUENT = 16, 1_000_000
#: Bytes of sketches or sets, and documents, of a region that is joined in memory; larger ones are divided.
#: A division is a row of jobs of its own, so it is left to regions beyond 4,096 documents (8 million pairs).
REGION_BYTES = 16 << 20
MEMBERS = 4096
#: Lists of ids up to this length are broadcast (16 MB); longer ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Hashes of shingles seen more than once in the sample, rarest first."""
    def run(batches):
        for _, texts in slices(batches, "text"):
            sets = shingle_sets(texts)
            values, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["s", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SAMPLE_SHARE)) == 0).select("text")
    found = (sample.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where("n > 1")
             .orderBy(F.desc("n"), "s").limit(FREQUENT).select("s").toArrow().column("s").to_numpy())
    return found[::-1].copy().view(np.uint64)


class Order:
    """The order of the first pivots: by hash, then the frequent shingles, rarest first."""

    def __init__(self, frequent: np.ndarray):
        self.rank = np.argsort(frequent)
        self.sorted = frequent[self.rank]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[frequent >> np.uint64(44)] = True

    def window(self, values: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
        """The first shingles of a sorted set, enough to meet every set within the distance."""
        n = len(values)
        size = n - -(-similar * n // 100) + 1
        maybe = np.flatnonzero(self.seen[values >> np.uint64(44)])
        if len(maybe):
            at = np.searchsorted(self.sorted, values[maybe])
            hit = self.sorted[np.minimum(at, len(self.sorted) - 1)] == values[maybe]
            maybe, rank = maybe[hit], self.rank[at[hit]]
            if len(maybe):
                rare = np.delete(values, maybe)
                values = rare if len(rare) >= size else np.concatenate([rare, values[maybe][np.argsort(rank)]])
        return values[:size]


def sketch(values: np.ndarray) -> np.ndarray:
    """Counts of a set's hashes in 32 or more buckets, 4 to 8 hashes to a bucket in large sets."""
    bits = max(5, (len(values) // 4).bit_length() - 1)
    while True:
        counts = np.bincount((values >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        bits += 1


def measure(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n, hi, lo (a digest of the set), window, sketch of every document; written once."""
    order = docs.sparkSession.sparkContext.broadcast(Order(frequent_shingles(docs)))

    def run(batches):
        for batch, texts in slices(batches, "text", 1 << 19):
            sets = shingle_sets(texts)
            n = np.array([len(s) for s in sets], np.int64)
            ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            digests = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
            windows = [order.value.window(s, similar) if len(s) else s for s in sets]
            ends = np.cumsum([0, *map(len, windows)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(windows).view(np.int64))),
                 pa.array([sketch(s).tobytes() if len(s) else b"" for s in sets], pa.binary())],
                ["doc_id", "n", "hi", "lo", "window", "sketch"])

    return written(docs.mapInArrow(run, "doc_id long, n long, hi long, lo long, window array<long>, sketch binary"), "jaccard")


def few(ids: DataFrame) -> DataFrame:
    """``ids`` (one or two long columns), with the hint to broadcast it if its counted length allows that."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def first_regions(rows: DataFrame) -> DataFrame:
    """region, key of the first pivots' regions that hold two documents or more, each set of members once.

    The rows of a pivot arrive in order and are looked at as they stream by.
    """
    def run(batches):
        known: set[int] = set()
        s = key = np.empty(0, np.int64)
        spilled = None  # a region longer than the buffer: its rows go out as they come

        def flush(s, key):
            nonlocal spilled
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            size = np.diff(np.append(first, len(s)))
            region = np.add.reduceat(mix(key.view(np.uint64)), first).view(np.int64)
            keep = size > 1
            if spilled is not None and s[0] == spilled:
                region[0], keep[0] = mix(np.array([spilled]).view(np.uint64)).view(np.int64)[0], True
            for i in np.flatnonzero(keep).tolist():
                r = int(region[i])
                if r in known and not (i == 0 and s[0] == spilled):
                    keep[i] = False
                elif len(known) < 500_000:
                    known.add(r)
            if keep.any():
                rows = np.repeat(keep, size)
                return pa.RecordBatch.from_arrays([pa.array(np.repeat(region, size)[rows]), pa.array(key[rows])], ["region", "key"])
            return None

        for batch in batches:
            s = np.concatenate([s, batch.column(0).to_numpy()])
            key = np.concatenate([key, batch.column(1).to_numpy()])
            if not len(s):
                continue
            cut = int(np.searchsorted(s, s[-1]))
            if cut == 0 and len(s) > 500_000:
                spilled, cut = int(s[0]), len(s)
            if cut:
                out = flush(s[:cut], key[:cut])
                if out is not None:
                    yield out
                s, key = s[cut:], key[cut:]
        if len(s):
            out = flush(s, key)
            if out is not None:
                yield out

    return rows.repartition("s").sortWithinPartitions("s", "key").mapInArrow(run, "region long, key long")


def _folded(x: np.ndarray, buckets: int) -> np.ndarray:
    """Counts (a row each) in fewer buckets: neighbours are added up."""
    return x if x.shape[1] == buckets else x.reshape(len(x), buckets, -1).sum(2, dtype=np.uint32)


class Sketches:
    """Intersections and unions of multisets: never less similar than the sets.

    A pair is compared in the buckets of its smaller sketch; distances that are
    set against each other (``all``) are taken in ``least`` buckets for all.
    """

    def __init__(self, blobs: list[bytes], least: int | None = None):
        self.width = np.array([len(b) for b in blobs])
        self.least = least or int(self.width.min())
        self.place = np.empty(len(blobs), np.int64)
        self.x = {}
        for w in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == w)
            self.place[rows] = np.arange(len(rows))
            self.x[w] = np.frombuffer(b"".join(blobs[i] for i in rows.tolist()), np.uint8).reshape(len(rows), w)
        self.n = np.array([self.x[w][i].sum(dtype=np.int64) for w, i in zip(self.width.tolist(), self.place.tolist())])

    def _shared(self, p: int, rows: np.ndarray, least: int) -> np.ndarray:
        shared = np.empty(len(rows), np.int64)
        for w in np.unique(self.width[rows]).tolist():
            at = np.flatnonzero(self.width[rows] == w)
            m = min(w, int(self.width[p]), least)
            own = _folded(self.x[int(self.width[p])][self.place[p]:self.place[p] + 1], m)
            for i in range(0, len(at), 1024):
                part = at[i:i + 1024]
                shared[part] = np.minimum(_folded(self.x[w][self.place[rows[part]]], m), own).sum(1, dtype=np.int64)
        return shared

    def both(self, p: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = self._shared(p, rows, 1 << 40)
        return shared, self.n[rows] + self.n[p] - shared

    def all(self, p: int) -> np.ndarray:
        shared = self._shared(p, np.arange(len(self.n)), self.least)
        return 1 - shared / (self.n + self.n[p] - shared)


class Sets:
    """Intersections and unions of whole sets."""

    def __init__(self, blobs: list[bytes], least: int | None = None):
        self.x = [np.frombuffer(b, np.uint64) for b in blobs]
        self.n = np.array([len(x) for x in self.x])

    def both(self, p: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.x[p]
        shared = np.zeros(len(rows), np.int64)
        for i, r in enumerate(rows.tolist()):
            other = self.x[r]
            at = np.searchsorted(own, other)
            at[at == len(own)] = 0
            shared[i] = np.count_nonzero(own[at] == other)
        return shared, self.n[rows] + self.n[p] - shared

    def all(self, p: int) -> np.ndarray:
        shared, union = self.both(p, np.arange(len(self.x)))
        return 1 - shared / union


def linked(space, similar: int, labels: list | None = None) -> np.ndarray:
    """For each point the smallest point of its component under the links of ``space``; points of one
    label (not None) are connected from the start.

    Points serve as pivots in turn. Two points of one component are not compared,
    nor two whose distances to an earlier pivot differ by more than a link's.
    """
    m = len(space.n)
    root = np.arange(m)
    first: dict = {}
    for i, label in enumerate(labels or ()):
        if label is not None:
            root[i] = first.setdefault(label, i)
    known = np.empty((0, m))
    reach = 1 - similar / 100 + 1e-9
    for p in range(m - 1):
        rest = np.arange(p + 1, m)
        rest = rest[root[rest] != root[p]]
        if not len(rest):
            if (root == root[0]).all():
                break
            continue
        if len(known):
            rest = rest[(np.abs(known[:, rest] - known[:, [p]]) <= reach).all(0)]
        if len(rest) > 64 and len(known) < 4:
            known = np.vstack([known, space.all(p)])  # a pivot whose distances to all are kept
            rest = rest[known[-1][rest] <= reach]
        small, large = np.minimum(space.n[rest], space.n[p]), np.maximum(space.n[rest], space.n[p])
        rest = rest[100 * small >= similar * large]
        if not len(rest):
            continue
        shared, union = space.both(p, rest)
        hit = rest[100 * shared >= similar * union]
        if len(hit):
            joined = np.unique(np.append(root[hit], root[p]))
            root[np.isin(root, joined)] = joined[0]
    return root


def _groups(batches):
    """(keys, blobs, labels) of each run of equal regions, across batches; repeated rows once."""
    region, rows = None, {}
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            for r, *row in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                if r != region:
                    if len(rows) > 1:
                        yield tuple(zip(*rows))
                    region, rows = r, {}
                rows[tuple(row)] = None
    if len(rows) > 1:
        yield tuple(zip(*rows))


def _space(exact: bool):
    return Sets if exact else Sketches


def join_regions(rows: DataFrame, exact: bool, similar: int) -> DataFrame:
    """Links a, b that connect what is connected within the regions of ``rows`` (region, key, blob, label)."""
    def run(batches):
        a: list[int] = []
        b: list[int] = []
        for keys, blobs, labels in _groups(batches):
            root = linked(_space(exact)(list(blobs)), similar, list(labels))
            for i in np.flatnonzero(root != np.arange(len(root))).tolist():
                a.append(keys[i])
                b.append(keys[root[i]])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return (rows.select("region", "key", "blob", "label").repartition("region").sortWithinPartitions("region", "key")
            .mapInArrow(run, "a long, b long"))


#: Pivots of a region that is divided, and how often its cells are divided again; what is still too
#: large then, or no smaller than before, meets in blocks.
PIVOTS, DEPTH = 48, 2


def weight(bytes_, limit: int):
    """Bytes of a document, but never so few that more than ``MEMBERS`` documents fit into ``limit``."""
    return F.greatest(bytes_, F.lit(limit // MEMBERS)).cast("long")


def divide(slim: DataFrame, blobs: DataFrame, exact: bool, similar: int, limit: int, depth: int = DEPTH) -> tuple[DataFrame, DataFrame | None]:
    """Regions of at most about ``limit`` for ``join_regions``, and links found on the way.

    ``slim``: region, key, bytes, label (a key that this one is known to be connected with, or null);
    ``blobs``: key, blob. A larger region is measured against pivots drawn from it, a chunk of rows
    at a time. Rows near one pivot are linked; pivots that rows connect are one component with their
    rows, and only pairs across components are still open. Each row lives in the Voronoi cell of its nearest
    pivot. Rows outside the region's largest component also visit the cells whose pivot is at most
    twice the join distance further than their own: the window in which their partners live. Cells
    without visitors are done. A cell that is too large, with its visitors, is a region again, if it
    is a good deal smaller than the one that it comes from; else it is cut into blocks of residents
    and of visitors that meet two by two.
    """
    slim = slim.withColumn("weight", weight(F.col("bytes"), limit))
    sizes = slim.groupBy("region").agg(F.sum("weight").alias("total"), F.count("*").alias("members"), F.min("key").alias("first"),
                                         (F.min("bytes") - 64).alias("least"))
    sizes = written(sizes.where(F.col("total") > limit), "large-regions")
    whole = slim.select("region", "key", "label")
    if sizes.isEmpty():
        return whole.join(blobs, "key").select("region", "key", "blob", "label"), None
    rest = whole.join(sizes.select("region"), "region", "left_anti")
    large = slim.join(sizes, "region")
    wanted = F.least(F.lit(PIVOTS), F.greatest(F.lit(12), F.ceil(4 * F.col("total") / limit)))
    chunks = F.ceil(F.col("total") / limit).cast("int")
    # other pivots at every depth
    drawn = (F.col("key") == F.col("first")) | (F.pmod(F.xxhash64("key", "region", F.lit(1)), F.col("members")) < wanted)
    pivots = written(large.where(drawn).select("region", "key", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
                     .join(blobs, "key").select("region", "chunk", "key", "blob"), "pivots")
    rows = (large.withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(2)), chunks).cast("int"))
            .join(blobs, "key").select("region", "chunk", "key", "bytes", "weight", "blob", "least", "label"))
    near, twice = 1 - similar / 100, 2 * (1 - similar / 100) + 1e-9

    def measured(left: pa.Table, right: pa.Table) -> pa.Table:
        own, others = left.column("blob").to_pylist(), right.sort_by("key").column("blob").to_pylist()
        names = right.sort_by("key").column("key").to_pylist()
        k = len(others)
        space = _space(exact)(others + own, left.column("least")[0].as_py() if len(own) else None)
        d, linked_to = np.empty((k, len(own))), np.zeros((k, len(own)), bool)
        for i in range(k if own else 0):
            d[i] = space.all(i)[k:]
            close = np.flatnonzero(d[i] <= near + 1e-9)
            shared, union = space.both(i, k + close)
            linked_to[i, close] = 100 * shared >= similar * union
        home = d.argmin(0) if len(own) else np.empty(0, np.int64)
        # a row's link to one pivot, and to others only where that connects pivots: links in proportion to the rows
        root, first, ties = np.arange(k), [], []
        for x in linked_to.T:
            at = np.flatnonzero(x)
            first.append(names[at[0]] if len(at) else None)
            more = []
            for i in at[1:].tolist():
                if root[i] != root[at[0]]:
                    root[root == root[i]] = root[at[0]]
                    more.append(names[i])
            ties.append(more)
        return pa.table({
            "region": left.column("region"), "key": left.column("key"), "bytes": left.column("bytes"), "weight": left.column("weight"),
            "home": pa.array(home.astype(np.int32)),
            "window": pa.array([np.flatnonzero(x <= x.min() + twice).astype(np.int32) for x in d.T], pa.list_(pa.int32())),
            "pivot": pa.array(first, pa.int64()), "ties": pa.array(ties, pa.list_(pa.int64())), "label": left.column("label")})

    def tied(pairs: pa.Table) -> pa.Table:
        """The smallest pivot that each is connected with; a region has few pivots and pairs of them."""
        root: dict[int, int] = {}
        for a, b in zip(pairs.column("pivot").to_pylist(), pairs.column("tie").to_pylist()):
            a, b = root.setdefault(a, a), root.setdefault(b, b)
            for x in [x for x, r in root.items() if r == max(a, b)]:
                root[x] = min(a, b)
        return pa.table({"region": pa.array([pairs.column("region")[0].as_py()] * len(root), pa.int64()),
                         "pivot": pa.array(list(root), pa.int64()), "root": pa.array(list(root.values()), pa.int64())})

    schema = "region long, key long, bytes long, weight long, home int, window array<int>, pivot long, ties array<long>, label long"
    seen = written(rows.groupBy("region", "chunk").cogroup(pivots.groupBy("region", "chunk")).applyInArrow(measured, schema), "measured")
    links = seen.select(F.col("key").alias("a"), F.explode(F.concat(F.array("pivot"), "ties")).alias("b")).where("a <> b")
    pairs = seen.select("region", "pivot", F.explode("ties").alias("tie")).distinct()
    comps = pairs.groupBy("region").applyInArrow(tied, "region long, pivot long, root long")
    seen = seen.join(comps, ["region", "pivot"], "left").withColumn("label", F.coalesce("root", "pivot", "label", "key")).drop("root", "pivot", "ties")
    weights = seen.groupBy("region", "label").agg(F.sum("weight").alias("w"))
    main = weights.groupBy("region").agg(F.max_by("label", F.struct("w", "label")).alias("main"), F.sum("w").alias("total"))
    seen = written(seen.join(main, "region").withColumn("open", F.col("label") != F.col("main")).drop("main"), "cells")
    slot = ["region", "total", "key", "bytes", "weight", "label"]
    residents = seen.select(*slot, F.col("home").alias("cell"))
    visitors = seen.where("open").select(*slot, F.explode("window").alias("cell"))
    sums = lambda d, name, *more: d.groupBy("region", "cell").agg(F.sum("weight").alias(name), *more)
    plan = sums(residents, "w_res", F.first("total").alias("total")).join(sums(visitors, "w_vis"), ["region", "cell"])
    size = F.col("w_res") + F.col("w_vis")
    deeper = (size > 2 * limit) & (4 * size <= 3 * F.col("total")) if depth else F.lit(False)
    plan = written(plan.select("region", "cell", deeper.alias("deeper"), F.ceil(2 * F.col("w_res") / limit).cast("int").alias("n_res"),
                               F.ceil(2 * F.col("w_vis") / limit).cast("int").alias("n_vis")), "plan")
    blocks = plan.where("NOT deeper").drop("deeper")
    mark = lambda d, own, seed, other, fixed, free: (
        d.join(blocks, ["region", "cell"]).withColumn(fixed, F.pmod(F.xxhash64("key", F.lit(seed)), F.col(own)).cast("int"))
        .withColumn(free, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        .select(F.xxhash64("region", "cell", "res", "vis").alias("region"), "key", "label"))
    cells = mark(residents, "n_res", 3, "n_vis", "res", "vis").unionByName(mark(visitors, "n_vis", 4, "n_res", "vis", "res")).distinct()
    out = rest.unionByName(cells).join(blobs, "key").select("region", "key", "blob", "label")
    again = plan.where("deeper").select("region", "cell")
    if not depth or again.isEmpty():
        return out, links
    inner = residents.unionByName(visitors).join(again, ["region", "cell"]).select(
        F.xxhash64("region", "cell").alias("region"), "key", "bytes", "label").distinct()
    below, found = divide(written(inner, "deeper"), blobs, exact, similar, limit, depth - 1)
    return out.unionByName(below), links if found is None else links.unionByName(found)


def join(docs: DataFrame, similar: int = SIMILAR, region_bytes: int = REGION_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have an empty set and are linked with nothing.
    Equal texts are linked. Rows that share a doc_id are one document: their
    component is one, and whatever one of their texts is linked with is linked
    with all. Rows without doc_id take no part and have a null component.
    Further columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = F.xxhash64("text")
    mixed = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b"))
                    .where("a <> b").select("doc_id", F.lit(True).alias("mixed")), "mixed")
    if mixed.isEmpty():
        return _join(docs, similar, region_bytes)
    # ids with different texts: each text is a document of its own, and the documents of an id are tied afterwards
    own = F.when(F.col("mixed"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    marked = docs.join(few(mixed), "doc_id", "left").withColumn("own", own)
    found = written(_join(marked.select(F.col("own").alias("doc_id"), "text"), similar, region_bytes)
                    .withColumnRenamed("doc_id", "own"), "parts")
    names = written(marked.where("mixed").select("own", "doc_id").distinct(), "names")
    parts = found.select("own", "component_id").distinct().join(names, "own").select("doc_id", "component_id").distinct()
    first = parts.groupBy("doc_id").agg(F.min("component_id").alias("b"))
    ties = written(components(parts.join(first, "doc_id").select(F.col("component_id").alias("a"), "b")), "ties")
    found = (found.join(ties.withColumnRenamed("node", "component_id"), "component_id", "left")
             .select("own", "n_shingles", F.coalesce("root", "component_id").alias("class")).join(names, "own", "left")
             .select(F.coalesce("doc_id", "own").alias("doc_id"), "n_shingles", "class"))
    # a class's smallest id, over its ids and not over the stand-ins
    least = found.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "class", "left").select("doc_id", "n_shingles", "component_id")


def _join(docs: DataFrame, similar: int, region_bytes: int) -> DataFrame:
    """``join`` of documents whose rows of one id all have the same text."""
    table = measure(docs, similar)
    slim = table.select("doc_id", "n", "hi", "lo")
    classes = slim.where("n > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copied = written(classes.where("copies > 1").select("hi", "lo", "rep"), "copies")
    member = written(slim.join(copied, ["hi", "lo"], "left").select(
        "doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("rep", "doc_id"))
        .otherwise(F.col("doc_id")).alias("rep")), "members")
    # a row is its class's own unless it is a copy of another document
    others = few(member.where("rep <> doc_id").select("doc_id").distinct())
    reps = table.where("n > 0 AND doc_id IS NOT NULL").join(others, "doc_id", "left_anti")
    regions = written(first_regions(reps.select(F.explode("window").alias("s"), F.col("doc_id").alias("key"))).distinct(), "first-regions")
    sketches = reps.select(F.col("doc_id").alias("key"), F.col("sketch").alias("blob"))
    bytes_ = reps.select(F.col("doc_id").alias("key"), (F.octet_length("sketch") + 64).cast("long").alias("bytes"),
                         F.lit(None).cast("long").alias("label"))
    rows, found = divide(regions.join(bytes_, "key"), sketches, False, similar, region_bytes)
    close = join_regions(rows, False, similar)
    near = written(components(close if found is None else close.unionByName(found)), "near")

    def sets(batches):
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], ["key", "blob"])

    def whole(ids):
        """key, blob: the whole sets of ``ids`` (doc_id)."""
        texts = docs.join(few(ids), "doc_id", "left_semi").select("doc_id", "text")
        return texts.mapInArrow(sets, "key long, blob binary").where(F.octet_length("blob") > 0)

    slim_near = near.select(F.col("root").alias("region"), F.col("node").alias("doc_id")).join(slim.where("n > 0"), "doc_id").select(
        "region", F.col("doc_id").alias("key"), (F.col("n") * 8 + 64).alias("bytes"), F.lit(None).cast("long").alias("label"))
    large = written(slim_near.groupBy("region").agg(F.sum(weight(F.col("bytes"), region_bytes)).alias("w"))
                    .where(F.col("w") > region_bytes).select(F.col("region").alias("root")), "large-near")
    # every document is in one region: its name goes with the text, and the set is sent once
    small = near.join(large, "root", "left_anti").select(F.col("node").alias("doc_id"), "root")
    rows, found = (whole(small.select("doc_id")).join(few(small.withColumnRenamed("doc_id", "key")), "key")
                   .select(F.col("root").alias("region"), "key", "blob", F.lit(None).cast("long").alias("label"))), None
    if not large.isEmpty():
        inside = near.join(large, "root", "left_semi").select(F.col("node").alias("doc_id"))
        divided, found = divide(slim_near.join(large.withColumnRenamed("root", "region"), "region", "left_semi"),
                                written(whole(inside), "sets"), True, similar, region_bytes)
        rows = rows.unionByName(divided)
    links = join_regions(rows, True, similar)
    if found is not None:
        links = links.unionByName(found)
    roots = components(links)
    return (member.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id")))
