"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tactica.session import ensure_checkpoint_dir

#: Rows whose text bytes together stay under this go through Python at once.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Used where a result feeds several later steps: the work is done once, the
    lineage is cut, and a lost executor costs only the tasks that it ran.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut Arrow batches so that ``column`` holds at most ``limit`` bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pc.binary_length(values).fill_null(0).to_pylist()
        first, total = 0, 0
        for i, size in enumerate(sizes):
            if i > first and total + size > limit:
                yield batch.slice(first, i - first), values.slice(first, i - first).to_pylist()
                first, total = i, 0
            total += size
        yield batch.slice(first), values.slice(first).to_pylist()


def with_columns(batch: pa.RecordBatch, names: list[str], arrays: dict[str, pa.Array]) -> pa.RecordBatch:
    """``names`` in order, each from ``arrays`` or else from ``batch``."""
    return pa.RecordBatch.from_arrays(
        [arrays[n] if n in arrays else batch.column(batch.schema.get_field_index(n)) for n in names], names)


class WordCache:
    """A bounded word -> value memo: two generations, so frequent words outlive a flush."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get_many(self, words: list, compute) -> list:
        """The value of each word; ``compute(list of unknown words)`` gives the missing ones."""
        found = list(map(self.young.get, words))
        if None in found:
            missing = {}
            for i, value in enumerate(found):
                if value is None:
                    word = words[i]
                    value = self.old.get(word)
                    if value is None:
                        missing[word] = None
                    else:
                        self.young[word] = value
            if missing:
                unknown = list(missing)
                self.young.update(zip(unknown, compute(unknown)))
            found = list(map(self.young.__getitem__, words))
            if len(self.young) > self.limit:
                self.old, self.young = self.young, {}
        return found
