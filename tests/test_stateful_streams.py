"""Streams with state: any cut into micro-batches, late and repeated rows, restarts."""

import os
import random
import tempfile

from pyspark.sql import functions as F

from tactica.operators import evaluation as ev
from tactica.streaming import stateful as SF

BATCH = "run string, batch long, loss double, correct long, total long, ends boolean"
EVENT = "unit long, ts timestamp, kind string"


def _add(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def _drain(df, out, checkpoint):
    """Run the stream over what is there; a new call is a restart."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    assert q.awaitTermination(170) and q.exception() is None


def test_metrics_every_n_batches_for_any_cut(spark):
    SF.state_store(spark)
    r = random.Random(1)
    rows = [(run, b, float(r.randint(0, 9)), r.randint(0, 3), r.choice([0, 4]), b == n) for run, n in (("a", 47), ("b", 20), ("c", 3)) for b in range(1, n + 1)]
    want = {tuple(x) for x in ev.training_curve(spark.createDataFrame(rows, BATCH), "run", "batch", "loss", "correct", "total", every=10).collect()}
    assert len(want) == 5 + 2 + 1
    sent = rows + r.sample(rows, 25)  # some come twice
    r.shuffle(sent)
    src, out, checkpoint = (tempfile.mkdtemp() for _ in range(3))
    cuts = [0, 1, 30, 31, 64, len(sent)]
    stream = SF.metrics_every(spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(src),
                              "run", "batch", "loss", "correct", "total", F.col("ends"), every=10)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        _add(spark.createDataFrame(sent[a:b], BATCH), src)
        if i in (1, 4):  # two runs of the query, the second from the first one's checkpoint
            _drain(stream, out, checkpoint)
    got = [tuple(x) for x in spark.read.parquet(out).collect()]
    assert len(got) == len(want) and {(g[0], g[1], g[2], round(g[3], 9), round(g[4], 9)) for g in got} == {
        (w[0], w[1], w[2], round(w[3], 9), round(w[4], 9)) for w in want}


def test_time_limits_with_late_rows_restart_and_a_large_unit(spark):
    SF.state_store(spark)

    def events(*rows):
        return spark.createDataFrame(rows, "unit long, ts string, kind string").select("unit", F.to_timestamp("ts").alias("ts"), "kind")

    src, out, checkpoint = (tempfile.mkdtemp() for _ in range(3))
    stream = SF.unit_timeouts(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(src), "unit", "ts",
                              F.col("kind") == "end", limit="1 hour", watermark="10 minutes")
    many = spark.range(200_000).select(F.lit(5).cast("long").alias("unit"), F.to_timestamp(F.lit("2024-01-01 00:00:01")).alias("ts"), F.lit("go").alias("kind"))
    _add(events((1, "2024-01-01 00:00:00", "go"), (2, "2024-01-01 00:00:00", "go"), (3, "2024-01-01 00:20:00", "go")), src)
    _add(many, src)
    _add(events((1, "2024-01-01 00:30:00", "end")), src)
    _drain(stream, out, checkpoint)
    # late within the delay for a unit that was told, and after the restart the clock passes the deadlines of 2 and 5
    _add(events((1, "2024-01-01 00:25:00", "go"), (9, "2024-01-01 01:15:00", "go")), src)
    _add(events((2, "2024-01-01 00:10:00", "end")), src)  # too late: behind the watermark
    _drain(stream, out, checkpoint)
    got = sorted((x.proof, str(x.first_ts), x.finished, x.timed_out) for x in spark.read.parquet(out).collect())
    assert got == [(1, "2024-01-01 00:00:00", True, False), (2, "2024-01-01 00:00:00", False, True), (5, "2024-01-01 00:00:01", False, True)]
    assert os.listdir(checkpoint)
