"""Operator 13: which filter removes what, in every order of the filters.

The words of the documents become a sparse document-term matrix. A shard is a
few megabytes of documents; the column numbers of its rows first refer to the
shard's own words. It is kept in pieces, rows that hold about a megabyte of
documents as packed compressed sparse rows, beside the words that the shard has
first seen there, so neither Python nor the JVM holds a shard's text or a long
row. The words of all shards are numbered once in a global dictionary, and each
shard gets the numbers of its words back, so its columns are those of the whole
corpus. Row sums are the documents' words and counts of non-zero columns their
different words: they decide the filters A and B. The other flags are attached
to the rows, equal texts are found by digest, and all orders are counted from
one small table of (part, flags) sums.
"""

from __future__ import annotations

import hashlib
import itertools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactica.llm.common import slices, written

FILTERS = "ABCDE"
#: Bytes of text in a shard at most (or one document); each document counts 64 more.
SHARD_BYTES = 16 << 20
#: Bytes of text in a piece at most (or one document).
PIECE_BYTES = 1 << 20
#: Pieces in a row group of the file: a reader holds a row group at a time.
_GROUP_PIECES = 16
#: The characters of filter D.
SIGNS = "#$%&*|"

_PIECE = "shard long, first int, words array<binary>, rows binary"
_SIGNS, _UPPER = SIGNS.encode(), bytes(range(65, 91))


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(rows.as_buffer(), options=pa.ipc.IpcReadOptions(use_threads=False)).read_next_batch()


def _piece(batch: pa.RecordBatch, texts: list) -> tuple:
    """The different words, where each row starts, its columns (numbers of these words), their counts, and the documents'
    ids, parts, digests of the texts and flags of C and D (bits 2 and 3)."""
    n, text = len(texts), batch.column(2).cast(pa.string())
    upper = np.array([len(t) - len(t.translate(None, _UPPER)) for t in texts])
    signs = np.array([len(t) > len(t.translate(None, _SIGNS)) for t in texts])
    flags = (100 * upper > 10 * pc.utf8_length(text).to_numpy().astype(np.int64)) * 4 + signs * 8
    split = pc.ascii_split_whitespace(text)
    coded = split.flatten().dictionary_encode()
    words, code = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(n), pc.list_value_length(split).to_numpy())
    blank = pc.index(words, pa.scalar(b"", pa.binary())).as_py()  # white space at an end of a text
    if blank >= 0:
        row, code = row[code != blank], code[code != blank]
    cell, counts = np.unique(row * len(words) + code, return_counts=True)
    starts = np.searchsorted(cell, np.arange(n + 1) * len(words)) if len(words) else np.zeros(n + 1, np.int64)
    columns = (cell % len(words) if len(words) else cell).astype(np.int32)
    return words, starts, columns, counts.astype(np.int32), [
        batch.column(0), batch.column(1), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(flags, pa.int32())]


def _shard(shard: int, pieces: list):
    """A row for each piece: columns get the numbers of the shard's words, rise in each document and are kept as differences."""
    words = pa.concat_arrays([p[0] for p in pieces]).dictionary_encode()
    numbers, at, first = words.indices.to_numpy(), 0, 0
    for own, starts, columns, counts, others in pieces:
        number = numbers[at:at + len(own)]
        columns = number[columns]
        order = np.lexsort((columns, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
        lists = lambda values: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))
        rows = pa.RecordBatch.from_arrays([*others, lists(np.diff(columns[order], prepend=np.int32(0))), lists(counts[order])],
                                          ["doc_id", "part", "digest", "flags", "steps", "counts"])
        end = max(first, int(number.max(initial=-1)) + 1)
        new = words.dictionary.slice(first, end - first)
        yield pa.RecordBatch.from_arrays([
            pa.array([shard]), pa.array([first], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), new),
            pa.array([_packed(rows)], pa.binary())], [f.split()[0] for f in _PIECE.split(", ")])
        at, first = at + len(own), end


def document_terms(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pieces of shards: the words (ASCII white space apart) that are new to the shard, the number of those before, and packed
    compressed sparse rows over the shard's words, up to ``shard_bytes`` of text in a shard, with each row's id, part, digest of
    the text and flags of C and D."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        shard, pieces, held = TaskContext.get().partitionId() << 32, [], 0
        for batch, texts in slices(batches, "text", min(PIECE_BYTES, shard_bytes)):
            size = sum(map(len, texts)) + 64 * len(texts)
            if pieces and held + size > shard_bytes:
                yield from _shard(shard, pieces)
                shard, pieces, held = shard + 1, [], 0
            pieces.append(_piece(batch, texts))
            held += size
        if pieces:
            yield from _shard(shard, pieces)

    return rows.mapInArrow(run, _PIECE)


def _numbered(shards: DataFrame, run, schema: str) -> DataFrame:
    """``run(number of the partition, batches)`` over (shard, at, word) of all shards, equal words side by side.

    One shuffle of the different words of each shard. The number of partitions
    is stated, so every use of the same shards deals and numbers words alike."""
    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = shards.select("shard", "first", F.posexplode("words").alias("at", "word")).where("word <> X''")
    words = words.select("shard", (F.col("first") + F.col("at")).alias("at"), "word")
    return words.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(
        lambda batches: run(TaskContext.get().partitionId(), batches), schema)


def _numbers(part: int, batches):
    """(batch, whether a row is the first of its word, the word's number): numbers rise from ``part`` << 40."""
    last, number = None, (part << 40) - 1
    for batch in batches:
        if batch.num_rows:
            words = batch.column(2)
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
            new[0] = words[0].as_py() != last
            numbers = number + np.cumsum(new)
            last, number = words[-1].as_py(), int(numbers[-1])
            yield batch, new, numbers


def global_dictionary(shards: DataFrame) -> DataFrame:
    """word, number: every word of all shards once. Numbers follow on each other inside a partition of the words'
    hashes; partitions begin 2^40 apart."""

    def run(part, batches):
        for batch, new, numbers in _numbers(part, batches):
            yield pa.RecordBatch.from_arrays([batch.column(2).filter(pa.array(new)), pa.array(numbers[new])], ["word", "number"])

    return _numbered(shards, run, "word binary, number long")


def column_numbers(shards: DataFrame) -> DataFrame:
    """shard, at, number: the dictionary's number of each word of each shard."""

    def run(part, batches):
        for batch, _, numbers in _numbers(part, batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers)], ["of", "at", "number"])

    return _numbered(shards, run, "of long, at int, number long")


def rows_of_matrix(shards: DataFrame) -> DataFrame:
    """doc_id, part, digest, n_words, n_distinct, flags, columns, counts: the rows of the globally numbered matrix.

    Each shard gets the numbers of its words: a shuffle of one pair for each
    different word of a shard, beside which the pieces (without their words)
    are dealt once. In a row ``columns`` rises.
    """

    def run(pieces: pa.Table, numbers: pa.Table) -> pa.Table:
        at = numbers.column("at").to_numpy()
        number = np.empty(at.max(initial=-1) + 1, np.int64)  # the empty string has no number, and no column
        number[at] = numbers.column("number").to_numpy()
        out = []
        for piece in pieces.column("rows"):
            rows = _unpacked(piece)
            starts, counts = rows.column("counts").offsets.to_numpy().astype(np.int64), rows.column("counts").values.to_numpy()
            columns = number[np.cumsum(rows.column("steps").values.to_numpy(), dtype=np.int64)]
            order = np.lexsort((columns, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
            total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            lists = lambda values: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values[order]))
            out.append(pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("part"), rows.column("digest"), pa.array(total[starts[1:]] - total[starts[:-1]]),
                 pa.array(np.diff(starts)), rows.column("flags"), lists(columns), lists(counts)],
                ["doc_id", "part", "digest", "n_words", "n_distinct", "flags", "columns", "counts"]))
        return pa.Table.from_batches(out)

    return shards.select("shard", "rows").groupBy("shard").cogroup(column_numbers(shards).groupBy("of")).applyInArrow(
        run, "doc_id long, part string, digest binary, n_words long, n_distinct long, flags int, columns array<long>, counts array<int>")


def document_flags(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, part, flags (a bit for each of ABCDE, A the lowest), n (rows with the same id and text).

    Rows without id are not copies of others, and others not of them."""
    matrix = rows_of_matrix(written(document_terms(docs, shard_bytes), "shards", compression="zstd",
                                    **{"parquet.block.row.count.limit": str(_GROUP_PIECES)}))
    a, b = F.col("n_words") < 100, 100 * F.col("n_distinct") < 80 * F.col("n_words")
    rows = matrix.select("doc_id", "part", "digest", (F.col("flags") + a.cast("int") + 2 * b.cast("int")).alias("flags"))
    # copies that share an id are one row from here on, so no id or text is a hot key below
    rows = written(rows.groupBy("doc_id", "part", "digest", "flags").agg(F.count("*").alias("n")), "flags")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    # joined by id and digest together: however many copies a text has, only the one that is no copy matches
    rows = rows.join(first.select("doc_id", "digest", F.lit(0).alias("copy")), ["doc_id", "digest"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("copy").isNull()
    return rows.select("doc_id", "part", (F.col("flags") + 16 * copy.cast("int")).alias("flags"), "n")


def audit(docs: DataFrame, labels: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part that ``docs`` (doc_id, text, lang) has, each of the
    120 orders and each step, zeros included; none for an empty table. A null
    lang is the part of the empty string, a null text an empty one; equal rows
    count each, and are copies only of smaller ids. Of several labels of one id any that says
    good (toxic) counts; labels without id and values other than 1 say nothing. Columns
    other than those named are not looked at.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = document_flags(docs, shard_bytes).join(marks, "doc_id", "left")
    # 128 sums a part at most
    cells = written(rows.groupBy("part", "flags", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
                    .agg(F.sum("n").alias("n")), "cells")
    steps = [("".join(order), k + 1, 1 << FILTERS.index(order[k]), sum(1 << FILTERS.index(f) for f in order[:k]))
             for order in itertools.permutations(FILTERS) for k in range(len(FILTERS))]
    plan = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "own", "before"), s)) for s in steps])),
                       "array<struct<filter_order string, step int, own int, before int>>")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    fails, earlier = F.col("flags").bitwiseAND(F.col("own")) != 0, F.col("flags").bitwiseAND(F.col("before")) != 0
    removed = fails & ~earlier
    table = cells.select("*", F.inline(plan)).groupBy("part", "filter_order", "step", "own").agg(
        n(~fails & ~earlier).alias("kept"), n(removed).alias("removed"), n(fails & earlier).alias("redundant"),
        n(F.col("flags") == F.col("own")).alias("unique_fails"), n(removed & (F.col("good") == 1)).alias("good_lost"),
        n(removed & (F.col("toxic") == 1)).alias("toxic_lost"))
    shapley = table.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return table.join(shapley, ["part", "own"]).drop("own")
