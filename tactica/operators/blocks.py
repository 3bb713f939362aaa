"""Nested block segmentation of tagged command sequences.

A command may start blocks of some tags and end blocks of some tags. The
commands of a group are read in order with a stack of open blocks:

* a command that starts a block opens it inside the innermost open block;
* a command that ends blocks closes the innermost open block when that is of
  one of its tags; else it is an error and changes nothing (with no block
  open: "unbalanced close");
* a command that does both closes, if the first of its end tags is the tag of
  an open block, the outermost such block with all blocks inside it, and then
  opens its new block there; otherwise it only opens;
* any other command lies in the innermost open block, at level 0 in OTHER.

One group may hold a large share of the data, so it is never read by one task.
Each group is cut into chunks. First every chunk is reduced on its own: a
block that opens and closes properly inside it leaves the stack as it was and
drops out. The few commands that are left are read in order per group, which
gives the stack at the start of every chunk. Then each chunk is read again
from its stack. Tasks hold a stack, not a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactica.operators.ordering import bucket_of, number_rows, running_sum

OTHER = "OTHER"
_STACK = "array<struct<tag:string,id:long>>"


def _advance(stack: list[tuple[str, int]], pos: int, starts: list[str], ends: list[str]) -> list[tuple]:
    """Read one command: changes ``stack`` and returns its events
    (sub, delta, level, block_id, tag, error)."""
    events = []

    def close():
        tag, block = stack.pop()
        events.append((len(events), -1, len(stack) + 1, block, tag, None))

    if starts:
        depth = next((i for i, (tag, _) in enumerate(stack) if ends and tag == ends[0]), len(stack))
        while len(stack) > depth:
            close()
        stack.append((starts[0], pos))
        events.append((len(events), 1, len(stack), pos, starts[0], None))
    elif ends and stack and stack[-1][0] in ends:
        close()
    else:
        tag, block = stack[-1] if stack else (OTHER, None)
        error = None
        if ends:
            error = f"{tag} closed by {ends[0]}" if stack else "unbalanced close"
        events.append((0, 0, len(stack), block, tag, error))
    return events


def _reduced(rows: list[tuple]) -> list[tuple]:
    """What is left of (pos, starts, ends) rows when properly closed blocks and
    plain commands drop out."""
    left: list[tuple] = []
    for row in rows:
        _, starts, ends = row
        if ends and not starts and left and left[-1][1] and not left[-1][2] and left[-1][1][0] in ends:
            left.pop()
        elif starts or ends:
            left.append(row)
    return left


def _runs(batches, n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Pieces of (group, rows) in order; a long run comes in several pieces."""
    for batch in batches:
        key, rows = None, []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
        if rows:
            yield key, rows


def segment_blocks(df: DataFrame, key: Sequence[str], pos: str, starts: Sequence[tuple[str, Column]],
                   ends: Column | Sequence[tuple[str, Column]]) -> DataFrame:
    """The events of every command: (key, pos, sub, delta, level, block_id,
    tag, opens, error). delta is +1 for an opening, -1 for a closing, 0 for a
    command inside a block; block_id is the position of the block's opening
    (null at level 0, where the tag is OTHER). ``starts`` and ``ends`` list
    (tag, predicate); a single predicate as ``ends`` ends blocks of any tag."""
    if isinstance(ends, Column):
        ends = [(tag, ends) for tag, _ in starts]
    tags = lambda rules: F.filter(F.array(*[F.when(p, F.lit(t)) for t, p in rules]), lambda t: t.isNotNull())
    x = df.select(*key, F.col(pos).cast("long").alias(pos), tags(starts).alias("_starts"), tags(ends).alias("_ends"))
    x = x.withColumn("_chunk", F.lit(0) + bucket_of(x, key, [pos]))
    n = len(key) + 1
    fields = [x.schema[k] for k in key] + [T.StructField("_chunk", T.IntegerType())]
    names = [f.name for f in fields]
    x = x.select(*names, pos, "_starts", "_ends")
    ordered = lambda d: d.repartition(*names).sortWithinPartitions(*names, F.col(pos).asc_nulls_first())
    strings = pa.list_(pa.string())

    def batch_of(rows: list[tuple], kinds: Sequence[pa.DataType], like: pa.RecordBatch, columns: Sequence[str]):
        cols = list(zip(*rows))
        kept = [pa.array(c, like.schema.types[i]) for i, c in enumerate(cols[:len(cols) - len(kinds)])]
        return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols[len(kept):], kinds))], columns)

    def reduce(batches):
        last, left, like = None, [], None

        def rows():
            # the first row of a chunk only marks it
            return [(*last, None, [], []), *((*last, *r) for r in left)]

        out_kinds, out_names = [pa.int64(), strings, strings], [*names, pos, "_starts", "_ends"]
        for batch in batches:
            like = batch
            for k, part in _runs([batch], n):
                if k != last:
                    if last is not None:
                        yield batch_of(rows(), out_kinds, like, out_names)
                    last, left = k, []
                left = _reduced([*left, *part])
        if last is not None:
            yield batch_of(rows(), out_kinds, like, out_names)

    def stacks(batches):
        group, stack = None, []
        for batch in batches:
            out = []
            for k, part in _runs([batch], n):
                if k[:-1] != group:
                    group, stack = k[:-1], []
                for p, starts_, ends_ in part:
                    if p is None:
                        out.append((*k, None, [], [], [{"tag": t, "id": i} for t, i in stack]))
                    else:
                        _advance(stack, p, starts_, ends_)
            if out:
                yield batch_of(out, [pa.int64(), strings, strings, pa.list_(pa.struct([("tag", pa.string()), ("id", pa.int64())]))],
                               batch, [*names, pos, "_starts", "_ends", "_stack"])

    def replay(batches):
        chunk, stack = None, []
        for batch in batches:
            out = []
            for k, part in _runs([batch], n):
                if k != chunk:
                    chunk, stack = k, []
                for p, starts_, ends_, given in part:
                    if p is None:
                        stack = [(s["tag"], s["id"]) for s in given]
                    else:
                        out += [(*k[:-1], p, *e) for e in _advance(stack, p, starts_, ends_)]
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()]
                yield batch_of(out, kinds, batch, [*key, pos, "sub", "delta", "level", "block_id", "tag", "error"])

    command = [T.StructField(pos, T.LongType()), T.StructField("_starts", T.ArrayType(T.StringType())),
               T.StructField("_ends", T.ArrayType(T.StringType()))]
    left = ordered(x).mapInArrow(reduce, T.StructType([*fields, *command]))
    by_group = left.repartition(*key) if key else left.coalesce(1)
    known = by_group.sortWithinPartitions(*names, F.col(pos).asc_nulls_first()).mapInArrow(
        stacks, T.StructType([*fields, *command, T.StructField("_stack", T.ArrayType(T.StructType(
            [T.StructField("tag", T.StringType()), T.StructField("id", T.LongType())])))]))
    events = ordered(x.withColumn("_stack", F.lit(None).cast(_STACK)).unionByName(known)).mapInArrow(
        replay, T.StructType([*fields[:-1], command[0], *(T.StructField(c, t) for c, t in (
            ("sub", T.IntegerType()), ("delta", T.IntegerType()), ("level", T.IntegerType()), ("block_id", T.LongType()),
            ("tag", T.StringType()), ("error", T.StringType())))]))
    return events.withColumn("opens", F.when(F.col("delta") == 1, F.col("tag")))


def blocks(events: DataFrame, key: Sequence[str], pos: str) -> DataFrame:
    """One row per block: (key, block_id, tag, level, first, last,
    n_events, closed)."""
    return events.where(F.col("block_id").isNotNull()).groupBy(*key, "block_id", "tag", "level").agg(
        F.min(pos).alias("first"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("n_events"),
        (F.min("delta") == -1).alias("closed"))


def top_level_blocks(events: DataFrame, block_rows: DataFrame, key: Sequence[str], pos: str,
                     tag: str | None = None) -> DataFrame:
    """Outermost blocks; with ``tag``, the blocks of that tag not nested
    in another block of the same tag (the running count of its openings less
    its closings is 1 at their opening)."""
    if tag is None:
        return block_rows.where(F.col("level") == 1)
    turns = running_sum(events.where((F.col("tag") == tag) & (F.col("delta") != 0)), key, [pos, "sub"],
                        {"_tdepth": F.col("delta")})
    outer = turns.where((F.col("delta") == 1) & (F.col("_tdepth") == 1)).select(*key, "block_id")
    return block_rows.join(outer, [*key, "block_id"], "left_semi")


def latest_open(block_rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The innermost block still open at the end of each group."""
    open_ = block_rows.where(~F.col("closed"))
    return open_.groupBy(*key).agg(F.max_by("block_id", "level").alias("block_id"))


def flatten_trace(events: DataFrame, commands: DataFrame, key: Sequence[str], pos: str, action: str) -> DataFrame:
    """The block tree back to the ordered list of its actions, the inverse
    of W10: (key, n, action, block_id, level), n from 0; each command once,
    with the block that it is left in (its last event)."""
    at = events.groupBy(*key, pos).agg(F.max_by(F.struct("block_id", "level"), "sub").alias("_e"))
    x = at.join(commands.select(*key, F.col(pos).cast("long").alias(pos), F.col(action).alias("action")), [*key, pos])
    return number_rows(x, key, [pos], "n").select(*key, "n", "action", "_e.block_id", "_e.level")
