"""Operator 13 holds a piece of a shard at a time, in Python, in a row and in a reader."""

import glob
import random
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from test_filter_audit import brute, frames

from tactica.llm import filter_audit
from tactica.session import ensure_checkpoint_dir


def texts(n, words, seed=1):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(50_000)}" for _ in range(words)) for _ in range(n)]


def shards_in_process(monkeypatch, batches):
    """What document_terms does with these Arrow batches, in this process."""
    monkeypatch.setattr(filter_audit, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rows = SimpleNamespace(mapInArrow=lambda run, schema: run)
    return filter_audit.document_terms(SimpleNamespace(select=lambda *columns: rows))(iter(batches))


def batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array(["en"] * len(rows)),
                                       pa.array([t.encode() for _, t in rows], pa.binary())], ["doc_id", "part", "text"])


def test_python_holds_a_piece_at_a_time(spark, monkeypatch):
    rows = batch(list(enumerate(texts(600, 2000))))
    size = rows.column(2).nbytes
    assert 7e6 < size < filter_audit.SHARD_BYTES
    run = shards_in_process(monkeypatch, [rows])
    tracemalloc.start()
    largest = max(r.nbytes for r in run)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * size  # 8 bytes for each byte of text are too many
    assert largest < size / 3


def test_shards_do_not_end_with_a_batch(spark, monkeypatch):
    rows = list(enumerate(texts(600, 200)))
    out = list(shards_in_process(monkeypatch, [batch(rows[i:i + 20]) for i in range(0, 600, 20)]))
    assert {b.column(0)[0].as_py() for b in out} == {0}
    assert sum(len(b.column(b.schema.get_field_index("words"))[0]) for b in out) == len({w for _, t in rows for w in t.split()})


def test_row_groups_hold_few_pieces(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PIECE_BYTES", 2000)
    there = set(glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/llm-shards-*"))
    rows = [(i, t, random.Random(i).choice(["en", "de"])) for i, t in enumerate(texts(150, 120, 2) + ["", " ", None] * 3)]
    docs, marks = frames(spark, rows, [(1, 1, 0), (2, 0, 1)])
    got = filter_audit.audit(docs.coalesce(1), marks).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, [(1, 1, 0), (2, 0, 1)])
    new = set(glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/llm-shards-*")) - there
    files = [pq.ParquetFile(f).metadata for d in new for f in glob.glob(f"{d}/*.parquet")]
    assert sum(m.num_rows for m in files) > 40
    assert max(m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)) <= 16


def test_only_blanks(spark):
    docs, _ = frames(spark, [(1, "", "en"), (2, " \n", "en"), (3, None, "en")], [])
    rows = filter_audit.rows_of_matrix(filter_audit.document_terms(docs))
    assert rows.select("doc_id", "n_words", "n_distinct", F.size("columns")).sort("doc_id").collect() == [(i, 0, 0, 0) for i in (1, 2, 3)]
