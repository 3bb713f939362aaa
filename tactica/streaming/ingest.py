"""Structured Streaming forms of the incremental behaviours (ST1, ST2).

* ST1 ``ingest_corpus``: new proof files under a root are picked up by the
  file source, parsed like S01 and appended to a table partitioned by logic;
  the checkpoint makes every file processed exactly once across restarts
  (it replaces the reference's progress file).
* ST2 ``running_metrics``: cumulative metric sums per run, kept in Spark's
  state store and emitted in update mode. Reports every N batches are in
  ``streaming.stateful``, as are ST3's timeouts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tactica.sources.corpus import PROOF_GLOB, with_place, with_record


def corpus_stream(spark: SparkSession, root: str, glob: str = PROOF_GLOB,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """ST1 source: one row per new proof file (whole text) with path parts."""
    reader = (spark.readStream.format("text").option("wholetext", "true")
                   .option("recursiveFileLookup", "true").option("pathGlobFilter", glob))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return with_record(with_place(raw, root)).select("path", "logic", "theory", "proof_num", "ok", "record")


def ingest_corpus(spark: SparkSession, root: str, out: str, checkpoint: str,
                  available_now: bool = True) -> StreamingQuery:
    """ST1: append newly arrived proofs to ``out`` (parquet, by logic)."""
    stream = corpus_stream(spark, root).select(
        "path", "logic", "theory", "proof_num", "ok",
        (F.coalesce(F.size("record.proof"), F.lit(0)) - 1).alias("num_steps"), "record")
    w = (stream.writeStream.format("parquet").option("path", out)
               .option("checkpointLocation", checkpoint).partitionBy("logic").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def running_metrics(events: DataFrame, run: str, loss: str, correct: str, total: str) -> DataFrame:
    """ST2: cumulative steps, mean loss and accuracy per run (streaming
    aggregate; the state store keeps one row per run)."""
    return events.groupBy(run).agg(
        F.count(F.lit(1)).alias("steps"), F.sum(loss).alias("loss_sum"),
        F.sum(correct).alias("correct"), F.sum(total).alias("total")).select(
        run, "steps", (F.col("loss_sum") / F.col("steps")).alias("avg_loss"),
        F.coalesce(F.try_divide(F.col("correct"), F.col("total")), F.lit(0.0)).alias("accuracy"))
