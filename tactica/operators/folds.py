"""Folds with functions of the user's own.

* ``user_fold``: a state is made per group inside each task, and the states of
  a group are merged in a tree, so no task ever holds a group's rows.
* ``ordered_fold``: for steps whose order matters and whose states can't be
  merged. Each group is cut into chunks along the order; a round takes the
  state of every group over its next chunk and hands it on.

States are pickled between tasks. ``step(state, rows)`` gets an Arrow batch of
one group's rows and returns the new state. If it raises, the rows are given to
it again one by one from the state before, and those that raise are reported
with their error in a second table and leave the state as it was.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactica.operators.ordering import number_rows
from tactica.session import ensure_checkpoint_dir

Step = Callable[[Any, pa.RecordBatch], Any]
#: States of a group that one task merges at most, about.
FAN_IN = 64
#: Groups whose states a task holds before it passes them on.
HELD_GROUPS = 10_000


def _stepped(step: Step, state: bytes, rows: pa.RecordBatch) -> tuple[bytes, list[tuple[int, str]]]:
    """The pickled state after ``rows``, and (row, error) of those that raised."""
    try:
        return pickle.dumps(step(pickle.loads(state), rows)), []
    except Exception:  # noqa: BLE001 - whatever the user's function raises is reported
        if rows.num_rows == 1:
            raise
    failed = []
    for i in range(rows.num_rows):
        try:
            state = pickle.dumps(step(pickle.loads(state), rows.slice(i, 1)))
        except Exception as e:  # noqa: BLE001
            failed.append((i, f"{type(e).__name__}: {e}"))
    return state, failed


def _safe(step: Step, state: bytes, rows: pa.RecordBatch) -> tuple[bytes, list[tuple[int, str]]]:
    try:
        return _stepped(step, state, rows)
    except Exception as e:  # noqa: BLE001 - a single row
        return state, [(0, f"{type(e).__name__}: {e}")]


def _groups(batch: pa.RecordBatch, width: int) -> list[tuple[tuple, pa.RecordBatch]]:
    """The batch's rows by the values of its first ``width`` columns."""
    places: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*[batch.column(c).to_pylist() for c in range(width)])):
        places.setdefault(key, []).append(i)
    if len(places) == 1:
        return [(next(iter(places)), batch)]
    return [(key, batch.take(pa.array(at))) for key, at in places.items()]


def _rows_out(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _shape(df: DataFrame, by: Sequence[str], ids: Sequence[str]) -> tuple[T.StructType, pa.Schema]:
    """Keys, ids of a failed row, state, error; as Spark's and as Arrow's schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    keyed = [T.StructField(f.name, f.dataType) for n in [*by, *ids] for f in df.schema.fields if f.name == n]
    schema = T.StructType([*keyed, T.StructField("_state", T.BinaryType()), T.StructField("_error", T.StringType())])
    return schema, to_arrow_schema(schema)


def user_fold(df: DataFrame, by: Sequence[str], zero: Callable[[], Any], step: Step, merge: Callable[[Any, Any], Any],
              finish: Callable[[Any], Any], out_type: T.DataType, name: str = "folded", ids: Sequence[str] = (),
              fan_in: int = FAN_IN, held_groups: int = HELD_GROUPS) -> tuple[DataFrame, DataFrame]:
    """(by..., ``name``) = ``finish`` of each group's state, and the failed rows (by..., ids..., error).

    ``step`` folds the rows of a group that a task meets, ``merge`` two states;
    it must not matter how rows are dealt to tasks. A group whose rows all fail
    has no result. Keys and ids must be different columns; a null key is a group.
    """
    by, ids = list(by), list(ids)
    schema, arrow = _shape(df, by, ids)
    start = pickle.dumps(zero())
    own = df.select(*by, *[c for c in df.columns if c not in by])
    at = [own.columns.index(i) for i in ids]
    blank = (None,) * len(ids)

    def fold(batches):
        states: dict[tuple, bytes] = {}
        for batch in batches:
            failed = []
            for key, rows in _groups(batch, len(by)):
                before = states.get(key)
                state, errors = _safe(step, before or start, rows)
                if before is not None or len(errors) < rows.num_rows:
                    states[key] = state
                failed += [(*key, *[rows.column(c)[i].as_py() for c in at], None, e) for i, e in errors]
            if failed:
                yield _rows_out(arrow, failed)
            if len(states) > held_groups:
                yield _rows_out(arrow, [(*k, *blank, s, None) for k, s in states.items()])
                states = {}
        yield _rows_out(arrow, [(*k, *blank, s, None) for k, s in states.items()])

    ensure_checkpoint_dir(df.sparkSession)
    made = own.mapInArrow(fold, schema).checkpoint()
    failed = made.where("_error IS NOT NULL").select(*by, *ids, F.col("_error").alias("error"))
    parts = made.where("_error IS NULL").select(*by, "_state")
    part_schema = T.StructType([schema[n] for n in [*by, "_state"]])

    def merged(rows: pa.Table):
        states = rows.column("_state").to_pylist()
        state = pickle.loads(states[0])
        for s in states[1:]:
            state = merge(state, pickle.loads(s))
        return rows.slice(0, 1), state

    def once(rows: pa.Table) -> pa.Table:
        first, state = merged(rows)
        return first.select([*by]).append_column("_state", pa.array([pickle.dumps(state)], pa.binary()))

    while (most := parts.groupBy(*by).count().agg(F.max("count").alias("n")).first()["n"] or 0) > fan_in:
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(-(-most // fan_in)))
        parts = parts.withColumn("_salt", salt).groupBy(*by, "_salt").applyInArrow(once, part_schema).checkpoint()
    out = T.StructType([schema[n] for n in by] + [T.StructField(name, out_type)])
    from pyspark.sql.pandas.types import to_arrow_type
    kind = to_arrow_type(out_type)

    def done(rows: pa.Table) -> pa.Table:
        first, state = merged(rows)
        return first.select([*by]).append_column(name, pa.array([finish(state)], kind))

    return parts.groupBy(*by).applyInArrow(done, out), failed


def ordered_fold(df: DataFrame, by: Sequence[str], order: Sequence[str], zero: Callable[[], Any], step: Step,
                 finish: Callable[[Any], Any], out_type: T.DataType, name: str = "folded", ids: Sequence[str] = (),
                 chunk_rows: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """A22 in order: as ``user_fold``, but the rows of a group reach ``step`` in ``order`` (ascending, unique inside a
    group), and no ``merge`` is needed.

    A task holds one chunk of a group at most. The rounds are as many as the
    largest group has chunks, each reads its own chunks only; where states can
    be merged, ``user_fold`` has no such rounds. Keys must not be null.
    """
    by, ids = list(by), list(ids)
    spark = df.sparkSession
    schema, arrow = _shape(df, by, ids)
    start = pickle.dumps(zero())
    numbered = number_rows(df, by, order, "_at").withColumn("_chunk", F.floor(F.col("_at") / chunk_rows))
    folder = f"{ensure_checkpoint_dir(spark)}/fold-{uuid.uuid4().hex}"
    numbered.write.partitionBy("_chunk").parquet(folder)
    rows = spark.read.schema(numbered.schema).parquet(folder)
    last = rows.agg(F.max("_chunk").alias("n")).first()["n"]
    states = rows.select(*by).limit(0).withColumn("_state", F.lit(None).cast("binary"))
    failed = rows.select(*by, *ids).limit(0).withColumn("error", F.lit(None).cast("string"))
    used = [*by, *[c for c in df.columns if c not in by]]
    at = [used.index(i) for i in ids]
    blank = (None,) * len(ids)

    def fold(chunk: pa.Table, state: pa.Table) -> pa.Table:
        key = tuple((chunk if chunk.num_rows else state).column(b)[0].as_py() for b in by)
        now = state.column("_state")[0].as_py() if state.num_rows else None
        out = []
        if chunk.num_rows:
            batch = chunk.sort_by("_at").select(used).combine_chunks().to_batches()[0]
            after, errors = _safe(step, now or start, batch)
            if now is not None or len(errors) < batch.num_rows:
                now = after
            out = [(*key, *[batch.column(c)[i].as_py() for c in at], None, e) for i, e in errors]
        if now is not None:
            out.append((*key, *blank, now, None))
        return pa.Table.from_batches([_rows_out(arrow, out)])

    for c in range(0 if last is None else last + 1):
        chunk = rows.where(F.col("_chunk") == c).drop("_chunk")
        made = chunk.groupBy(*by).cogroup(states.groupBy(*by)).applyInArrow(fold, schema).checkpoint()
        states = made.where("_error IS NULL").select(*by, "_state")
        failed = failed.unionByName(made.where("_error IS NOT NULL").select(*by, *ids, F.col("_error").alias("error")))
    from pyspark.sql.pandas.types import to_arrow_type
    kind = to_arrow_type(out_type)
    out = T.StructType([schema[n] for n in by] + [T.StructField(name, out_type)])

    def done(batches):
        for batch in batches:
            values = [finish(pickle.loads(s)) for s in batch.column(len(by)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(by)], pa.array(values, kind)], [*by, name])

    return states.mapInArrow(done, out), failed
