"""``prooffiles``: a Spark data source of one file per proof.

``spark.read.format("prooffiles")`` packs many small files into partitions of
even size; ``df.write.format("prooffiles")`` writes
``<path>/<logic>/<theory>/proof<N>.json``. A task writes into a folder of its
own attempt; the commit moves whole files to their places, so neither a failed
nor a repeated task leaves half a file or a second one. Files that are there
already are never touched.

Paths may be of any file system that Arrow opens (local, hdfs, s3, gs). For
stores that only Spark's readers open, ``corpus.scan_corpus`` reads the same
layout.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)
from pyspark.sql.types import StructType

from tactica.functions.pyjson import slices

SCHEMA = "path string, logic string, theory string, proof_num int, raw string"
WRITTEN = ("logic", "theory", "proof_num", "raw")
#: Bytes of a partition, and what opening a file counts for.
PARTITION_BYTES, OPEN_BYTES = 32 << 20, 64 << 10
#: Bytes of text in one batch handed to Spark.
BATCH_BYTES = 4 << 20
#: Fixed value: the names of proof files.
NAME = re.compile(r"proof(\d+)\.json")
_STAGING = "_staging"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``path`` and the path in it, without a slash at the end."""
    if "://" not in path:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path).rstrip("/")
    store, place = fs.FileSystem.from_uri(path)
    return store, place.rstrip("/")


def _place(logic: str, theory: str, number: int) -> str:
    """The path of a proof below the root. Characters that would change the layout are escaped as in URLs."""
    if not logic or not theory or number is None:
        raise ValueError(f"a proof needs logic, theory and number: {logic!r}, {theory!r}, {number!r}")
    parts = [quote(p, safe=" !#$&'()+,;=@[]{}") if p.strip(".") else p.replace(".", "%2E") for p in (logic, theory)]
    return "/".join([*[("%5F" + p[1:]) if p.startswith("_") else p for p in parts], f"proof{int(number)}.json"])


@dataclass
class Files(InputPartition):
    """Some files: their paths below the root, and sizes."""

    names: list[str]


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class ProofReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes = path, partition_bytes

    def partitions(self) -> list[Files]:
        """Files in order of their paths, cut where a partition is full."""
        store, root = _open(self.path)
        found = []
        for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = f.path[len(root) + 1:]
            if f.type == fs.FileType.File and NAME.fullmatch(name.rpartition("/")[2]) and not name.startswith(_STAGING + "/"):
                found.append((name, f.size + OPEN_BYTES))
        out, names, size = [], [], 0
        for name, n in sorted(found):
            if names and size + n > self.partition_bytes:
                out.append(Files(names))
                names, size = [], 0
            names.append(name)
            size += n
        return [*out, Files(names)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, root = _open(self.path)
        rows, size = [], 0
        for name in partition.names:
            with store.open_input_stream(f"{root}/{name}") as f:
                raw = f.read().decode("utf-8", "replace")
            parts = name.split("/")
            number = int(NAME.fullmatch(parts[-1])[1])
            rows.append((f"{self.path.rstrip('/')}/{name}", unquote(parts[0]) if len(parts) > 1 else None,
                         unquote(parts[-2]) if len(parts) > 1 else None, number, raw))
            size += len(raw)
            if size > BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "logic", "theory", "proof_num", "raw"])


class ProofWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = _open(self.path)
        task = TaskContext.get()
        staged = f"{_STAGING}/{self.job}/task-{task.partitionId()}-{task.taskAttemptId()}"
        store.create_dir(f"{root}/{staged}", recursive=True)
        folders = set()
        for batch in (part for whole in iterator for part in slices(whole)):
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in WRITTEN]
            for logic, theory, number, raw in zip(*columns):
                place = _place(logic, theory, number)
                if store.get_file_info(f"{root}/{place}").type != fs.FileType.NotFound:
                    continue
                folder = f"{root}/{staged}/{place.rpartition('/')[0]}"
                if folder not in folders:
                    store.create_dir(folder, recursive=True)
                    folders.add(folder)
                with store.open_output_stream(f"{root}/{staged}/{place}") as f:
                    f.write((raw or "").encode())
        return Staged(staged)

    def commit(self, messages: list[Staged | None]) -> None:
        """Move the files of the tasks that Spark took; of two proofs of one name the first stays."""
        store, root = _open(self.path)
        folders = set()
        for message in messages:
            if message is None:
                continue
            staged = f"{root}/{message.folder}"
            for f in store.get_file_info(fs.FileSelector(staged, recursive=True, allow_not_found=True)):
                if f.type == fs.FileType.File:
                    target = f"{root}/{f.path[len(staged) + 1:]}"
                    if store.get_file_info(target).type == fs.FileType.NotFound:
                        folder = target.rpartition("/")[0]
                        if folder not in folders:
                            store.create_dir(folder, recursive=True)
                            folders.add(folder)
                        store.move(f.path, target)
        self._clear(store, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*_open(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        """The job's own staging folder goes; those of other jobs stay."""
        staging = f"{root}/{_STAGING}/{self.job}"
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)
        if not store.get_file_info(fs.FileSelector(f"{root}/{_STAGING}", allow_not_found=True)):
            if store.get_file_info(f"{root}/{_STAGING}").type == fs.FileType.Directory:
                store.delete_dir(f"{root}/{_STAGING}")


class ProofFiles(DataSource):
    """Options: path, partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "prooffiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ProofReader:
        return ProofReader(self.options["path"], int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> ProofWriter:
        if overwrite:
            raise ValueError("proof files are only added: use mode append")
        missing = [c for c in WRITTEN if c not in schema.names]
        if missing:
            raise ValueError(f"columns are missing: {missing}")
        return ProofWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(ProofFiles)
