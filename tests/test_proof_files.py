"""The data source of proof files: even partitions, whole files, nothing overwritten."""

import os

import pytest
from pyspark.sql import functions as F

from tactica.sources import corpus as C
from tactica.sources import proof_files as PF

COLUMNS = "logic string, theory string, proof_num int, raw string"


def _files(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, fs in os.walk(root) for f in fs}


def test_write_and_read_back(spark, tmp_path):
    PF.register(spark)
    root = str(tmp_path / "corpus")
    rows = [("HOL", "Main", i, '{"proof": %d}' % i) for i in range(40)] + [("A/B", "_x", 0, ""), ("ZF", "..", 1, "é\n"), ("ZF", "Nat", 7, None)]
    spark.createDataFrame([(*r, "more") for r in rows], COLUMNS + ", other string").repartition(7).write.format("prooffiles").mode("append").save(root)
    files = _files(root)
    assert len(files) == 43 and files["HOL/Main/proof7.json"] == '{"proof": 7}' and "ZF/%2E%2E/proof1.json" in files
    got = spark.read.format("prooffiles").option("partition_bytes", 10 * PF.OPEN_BYTES).load(root)
    assert sorted((r.logic, r.theory, r.proof_num, r.raw) for r in got.collect()) == sorted((a, b, n, r or "") for a, b, n, r in rows)
    per_part = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_part) >= 5 and max(r["count"] for r in per_part) <= 10
    # the plain scan sees the same files, but for the two empty ones, of which the text reader makes no row
    assert C.scan_corpus(spark, root).count() == 41


def test_existing_files_stay(spark, tmp_path):
    PF.register(spark)
    root = str(tmp_path)
    first = spark.createDataFrame([("HOL", "Main", 0, "old"), ("HOL", "Main", 1, "old")], COLUMNS)
    first.write.format("prooffiles").mode("append").save(root)
    again = spark.createDataFrame([("HOL", "Main", 1, "new"), ("HOL", "Main", 2, "new"), ("HOL", "Main", 2, "new")], COLUMNS)
    again.repartition(3).write.format("prooffiles").mode("append").save(root)
    assert _files(root) == {"HOL/Main/proof0.json": "old", "HOL/Main/proof1.json": "old", "HOL/Main/proof2.json": "new"}
    with pytest.raises(Exception, match="append"):
        first.write.format("prooffiles").mode("overwrite").save(root)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    PF.register(spark)
    root = str(tmp_path)
    bad = spark.createDataFrame([("HOL", "Main", i, "x") for i in range(20)] + [(None, "Main", 99, "x")], COLUMNS)
    with pytest.raises(Exception, match="needs logic"):
        bad.coalesce(2).write.format("prooffiles").mode("append").save(root)
    assert _files(root) == {}


def test_a_task_that_runs_twice_leaves_one_file(tmp_path, monkeypatch):
    import pyarrow as pa

    class Context:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            return self.attempt

    batch = pa.RecordBatch.from_pydict({"logic": ["L"] * 2, "theory": ["T"] * 2, "proof_num": [0, 1], "raw": ["a", "b"]})
    writer = PF.ProofWriter(str(tmp_path))

    def breaks():
        yield batch.slice(0, 1)
        raise RuntimeError("executor lost")

    monkeypatch.setattr(PF.TaskContext, "get", lambda: Context(1))
    with pytest.raises(RuntimeError):
        writer.write(breaks())
    monkeypatch.setattr(PF.TaskContext, "get", lambda: Context(2))
    message = writer.write(iter([batch]))
    assert not any(f.startswith("L/") for f in _files(tmp_path))  # nothing in place before the commit
    writer.commit([message])
    assert _files(tmp_path) == {"L/T/proof0.json": "a", "L/T/proof1.json": "b"} and os.listdir(tmp_path) == ["L"]


def test_empty_corpus(spark, tmp_path):
    PF.register(spark)
    assert spark.read.format("prooffiles").load(str(tmp_path / "none")).count() == 0
    spark.createDataFrame([], COLUMNS).write.format("prooffiles").mode("append").save(str(tmp_path / "new"))
    assert _files(tmp_path) == {}
