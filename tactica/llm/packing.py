"""Operator 8: concatenate and cut. All documents' ids form one long line that is cut into windows.

Pass 1 tokenizes every document once and writes (partition, ids already before
it in that partition, ids) to the shared folder, so that places stay fixed when
tasks are run again. The token totals of the partitions (one small row each)
are summed up to global offsets. Pass 2 cuts each document where the global
windows end; a document that crosses window ends gives one boundary record for
each window it touches. Only totals of partitions are ever brought together.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


from tactica.llm.bpe import SPLIT, byte_letters, read_spec
from tactica.llm.common import slices, written

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, padded_length long")


class LibraryIds:
    """Ids as the tokenizers library gives them, as little-endian uint16 (ids < 65536) or uint32.

    A byte-level vocabulary whose ids follow the order of its merges is run by
    tiktoken, which gives the same ids several times faster; any other, and a
    text whose white space is too long for tiktoken's splitter, by tokenizers
    itself.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        data = json.loads(spec)
        vocab, letters = data["model"]["vocab"], byte_letters()
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in data["model"]["merges"]]
        added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.dtype = np.dtype("<u2" if max([*vocab.values(), *added.values()]) < 65536 else "<u4")
        in_order = [vocab[a + b] for a, b in merges] == list(range(256, 256 + len(merges))) and all(
            vocab.get(x, 256) < 256 for x in letters)
        steps = data.get("pre_tokenizer") or {}
        if in_order and not data.get("normalizer") and steps.get("type") == "ByteLevel" and steps.get(
                "use_regex") and not steps.get("add_prefix_space") and not any(
                t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in data.get("added_tokens", [])):
            import tiktoken
            ranks = {bytes(map(letters.__getitem__, t)): i for t, i in vocab.items()}
            self.fast = tiktoken.Encoding("byte-level", pat_str=SPLIT.format(L=r"\p{L}", N=r"\p{N}", S=r"\s"),
                                          mergeable_ranks=ranks, special_tokens=added)
        else:
            self.fast = None
        self.spec, self.tokenizer = spec, None

    def encode(self, text: str) -> bytes:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype(self.dtype).tobytes()
            except ValueError:  # the splitter's stack: runs of hundreds of thousands of blanks
                pass
        if self.tokenizer is None:
            from tokenizers import Tokenizer
            self.tokenizer = Tokenizer.from_str(self.spec)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


_libraries: dict[int, LibraryIds] = {}


def library(spec: str) -> LibraryIds:
    key = hash(spec)
    if key not in _libraries:
        _libraries.clear()
        _libraries[key] = LibraryIds(spec)
    return _libraries[key]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """part, before (ids before it in its partition), doc_id, ids: pass 1, written once."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches):
        lib = library(spec.value)
        part, before = TaskContext.get().partitionId(), 0
        end = np.array([end_id], lib.dtype).tobytes()
        for batch, texts in slices(batches, "text"):
            ids = [(lib.encode(t) if t else b"") + end for t in texts]
            sizes = np.array([len(x) // lib.dtype.itemsize for x in ids], np.int64)
            starts = before + np.cumsum(sizes) - sizes
            before = int(starts[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(sizes),
                 batch.column(0), pa.array(ids, pa.binary())], ["part", "before", "doc_tokens", "doc_id", "ids"])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(df.mapInArrow(run, "part int, before long, doc_tokens long, doc_id long, ids binary"), "packing")


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``length`` tokens.

    A document's ids are those of the tokenizers library and then ``end_id``;
    a null or empty text is ``end_id`` alone. Sequences are full but the last,
    which ``padded_length`` fills to ``length`` unless its length is a power of
    two. Each row of ``docs`` is a document of its own: repeated ids or null
    ids are packed row by row. No rows give no pieces. Further columns are ignored.
    """
    table = tokenized(docs, tokenizer, end_id)
    totals = table.groupBy("part").agg(F.max(F.col("before") + F.col("doc_tokens")).alias("total"))
    # one row for each partition of the input: a bounded table, whatever the rows hold
    order = Window.orderBy("part")
    offsets = totals.select("part", (F.sum("total").over(order) - F.col("total")).alias("offset0"),
                            F.sum("total").over(Window.partitionBy()).alias("all_tokens"))
    placed = table.join(F.broadcast(offsets), "part")
    wide = _is_wide(tokenizer)

    def run(batches):
        dtype = np.dtype("<u4" if wide else "<u2")
        for batch in batches:
            col = lambda n: batch.column(batch.schema.get_field_index(n))
            rows: list[tuple] = []
            for doc, ids, at, total in zip(col("doc_id").to_pylist(), col("ids"),
                                           (col("offset0").to_numpy() + col("before").to_numpy()).tolist(),
                                           col("all_tokens").to_pylist()):
                ids = np.frombuffer(ids.as_buffer(), dtype).astype("<u4").tobytes()
                n, start = len(ids) // 4, 0
                while start < n:
                    seq, offset = divmod(at + start, length)
                    take = min(length - offset, n - start)
                    filled = min(length, total - seq * length)
                    rows.append((doc, start, take, zlib.crc32(ids[4 * start:4 * (start + take)]), n, seq, offset,
                                 filled if filled & (filled - 1) == 0 else length))
                    start += take
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows)],
                [f.split()[0] for f in PIECES.split(", ")])

    return placed.mapInArrow(run, PIECES)


def _is_wide(tokenizer: str) -> bool:
    return library(read_spec(tokenizer)).dtype.itemsize == 4
