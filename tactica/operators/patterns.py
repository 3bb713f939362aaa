"""Segmentation of sequences by a pattern (W08), read by an automaton in chunks.

The pattern is compiled into the automaton of its prefixes: state ``s`` says
that the last ``s`` items since the last occurrence are the first ``s`` of the
pattern. Reading from left to right and starting over after each occurrence is
the leftmost-first choice of occurrences that don't overlap.

A group may hold a large share of the rows, so it is cut into chunks, and a
chunk is read before it is known in which state the automaton enters it: it is
read from every state at once. An item that is not in the pattern, or a few
that are, bring all of them together, so most of a chunk is read once. What a
chunk does is a function from states to states; these are composed along a
group (a row per chunk), and then each chunk's occurrences are those of the
state that it is entered in. The rows are shuffled once, whatever the length of
the pattern and however much of it overlaps with itself.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactica.operators.ordering import bucket_of
from tactica.session import ensure_checkpoint_dir


def automaton(codes: Sequence[int]) -> list[list[int]]:
    """next state by state and code (0 to the largest of ``codes``); state ``len(codes)`` is an occurrence."""
    width = max(codes) + 1
    table = [[0] * width]
    table[0][codes[0]] = 1
    restart = 0  # where the items after the first of the present prefix lead
    for state in range(1, len(codes)):
        table.append(list(table[restart]))
        restart = table[restart][codes[state]]
        table[state][codes[state]] = state + 1
    return table


class _Run:
    """Entry states that have come to the same state, with the occurrences since they were one."""

    def __init__(self, state: int):
        self.entry, self.state, self.ends = state, state, []
        self.joined: list[tuple[_Run, int]] = []  # runs that came in, and the number of occurrences then


class Chunk:
    """The automaton read from all its states at once."""

    def __init__(self, table: list[list[int]]):
        self.table, self.runs = table, [_Run(s) for s in range(len(table))]

    def _meet(self) -> None:
        at: dict[int, _Run] = {}
        for run in self.runs:
            other = at.setdefault(run.state, run)
            if other is not run:
                other.joined.append((run, len(other.ends)))
        self.runs = list(at.values())

    def _start_over(self) -> None:
        for run in self.runs:
            run.state = 0
        self._meet()

    def read(self, codes: np.ndarray, positions: np.ndarray) -> None:
        """Read items in order: codes (-1: not in the pattern) and their positions."""
        table, final, before = self.table, len(self.table), -1
        known = np.flatnonzero(codes >= 0)
        for i, code, pos in zip(known.tolist(), codes[known].tolist(), positions[known].tolist()):
            if i != before + 1:
                self._start_over()
            before = i
            for run in self.runs:
                run.state = table[run.state][code]
                if run.state == final:
                    run.ends.append(pos)
                    run.state = 0
            if len(self.runs) > 1:
                self._meet()
        if before != len(codes) - 1:
            self._start_over()

    def result(self) -> tuple[list[int], list[list[int]]]:
        """By entry state: the state at the end, and the last positions of the occurrences."""
        exits, ends = [0] * len(self.table), [[] for _ in self.table]
        todo = [(run, run.state, []) for run in self.runs]
        while todo:
            run, state, later = todo.pop()
            found = run.ends + later
            exits[run.entry], ends[run.entry] = state, found
            todo += [(other, state, found[n:]) for other, n in run.joined]
        return exits, ends


def _pieces(batch: pa.RecordBatch, n_keys: int):
    """(key, first row, rows) of runs of equal keys; a run may come in several pieces."""
    n = batch.num_rows
    cut = np.zeros(max(n - 1, 0), bool)
    for column in batch.columns[:n_keys]:
        cut |= pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, max(n - 1, 0))), True).to_numpy(zero_copy_only=False)
    starts = [0, *(np.flatnonzero(cut) + 1).tolist()] if n else []
    for a, b in zip(starts, [*starts[1:], n]):
        yield tuple(c[a].as_py() for c in batch.columns[:n_keys]), a, b - a


def segment_by_pattern(df: DataFrame, key: Sequence[str], pos: str, item: str,
                       pattern: Sequence[str]) -> DataFrame:
    """Cut each sequence at the occurrences of ``pattern`` that a reader
    from left to right finds, without overlaps; the pieces between them and the
    occurrences are kept: (key, start, end, is_match, length).

    Positions are dense (see ``sequences``) and group keys not null; a null item
    is in no pattern. An empty pattern leaves each sequence in one piece.
    """
    m = len(pattern)
    if m == 0:
        return df.groupBy(*key).agg(F.min(pos).alias("start"), F.max(pos).alias("end"),
                                    F.lit(False).alias("is_match"), F.count(F.lit(1)).alias("length"))
    code = {value: i for i, value in enumerate(dict.fromkeys(pattern))}
    table = automaton([code[value] for value in pattern])
    number = F.coalesce(*[F.when(F.col(item) == F.lit(value), F.lit(i)) for value, i in code.items()], F.lit(-1))
    place = df.schema[pos].dataType
    x = df.select(*key, F.col(pos).cast("long").alias("_pos"), number.alias("_code"))
    x = x.withColumn("_chunk", F.lit(0) + bucket_of(x, key, ["_pos"])).select(*key, "_chunk", "_pos", "_code")
    names = [*key, "_chunk"]
    fields = [x.schema[n] for n in names]
    longs = T.ArrayType(T.LongType())

    def read(batches):
        last, chunk, first, end, like = None, None, None, None, None

        def done():
            exits, ends = chunk.result()
            columns = [pa.array([v], t) for v, t in zip(last, like.schema.types)]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array([first]), pa.array([end]), pa.array([exits], pa.list_(pa.int32())),
                 pa.array([[e[-1] if e else None for e in ends]], pa.list_(pa.int64())),
                 pa.array([ends], pa.list_(pa.list_(pa.int64())))], [*names, "first", "last", "exits", "lasts", "ends"])

        for batch in batches:
            like = batch
            positions, codes = batch.column(len(names)).to_numpy(), batch.column(len(names) + 1).to_numpy()
            for k, at, n in _pieces(batch, len(names)):
                if k != last:
                    if last is not None:
                        yield done()
                    last, chunk, first = k, Chunk(table), int(positions[at])
                chunk.read(codes[at:at + n], positions[at:at + n])
                end = int(positions[at + n - 1])
        if last is not None:
            yield done()

    def compose(batches):
        """The state that each chunk of a group is entered in, and the end of the occurrence before it."""
        group, held, state, base = None, None, 0, None

        def out(rows, like):
            columns = list(zip(*rows))
            kept = [pa.array(c, t) for c, t in zip(columns, like.schema.types[:len(names)])]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(columns[len(names):], types))],
                                              [*names, "entry", "base", "last", "final"])

        like = None
        for batch in batches:
            like, rows = batch, []
            for *k, first, last, exits, lasts in zip(*(c.to_pylist() for c in batch.columns)):
                same = k[:-1] == group
                if held is not None:
                    rows.append((*held, not same))
                if not same:
                    group, state, base = k[:-1], 0, first - 1
                held = (*k, state, base, last)
                base = base if lasts[state] is None else lasts[state]
                state = exits[state]
            if rows:
                yield out(rows, like)
        if held is not None:
            yield out([(*held, True)], like)

    ensure_checkpoint_dir(df.sparkSession)
    schema = T.StructType([*fields, T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
                           T.StructField("exits", T.ArrayType(T.IntegerType())), T.StructField("lasts", longs),
                           T.StructField("ends", T.ArrayType(longs))])
    chunks = x.repartition(*names).sortWithinPartitions(*names, "_pos").mapInArrow(read, schema).checkpoint()
    functions = chunks.drop("ends")
    functions = functions.repartition(*key) if key else functions.coalesce(1)
    entered = functions.sortWithinPartitions(*names).mapInArrow(compose, T.StructType([
        *fields, T.StructField("entry", T.IntegerType()), T.StructField("base", T.LongType()), T.StructField("last", T.LongType()),
        T.StructField("final", T.BooleanType())]))
    found = chunks.select(*names, "ends").join(entered, names).withColumn("_e", F.col("ends")[F.col("entry")])
    piece = lambda start, end, match: F.struct(start.alias("start"), end.alias("end"), F.lit(match).alias("is_match"))
    before = F.concat(F.array("base"), "_e")
    inner = F.flatten(F.zip_with(F.slice(before, F.lit(1), F.size("_e")), F.col("_e"), lambda a, b: F.array(
        piece(a + 1, b - m, False), piece(b - m + 1, b, True))))
    rest = F.array(piece(F.element_at(before, -1) + 1, F.col("last"), False))
    pieces = F.concat(inner, F.when(F.col("final"), rest).otherwise(F.slice(rest, 1, 0)))
    return (found.select(*key, F.inline(F.filter(pieces, lambda p: p["start"] <= p["end"])))
            .select(*key, F.col("start").cast(place).alias("start"), F.col("end").cast(place).alias("end"), "is_match",
                    (F.col("end") - F.col("start") + 1).alias("length")))
