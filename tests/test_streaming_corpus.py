"""Corpus files, streaming ingest and stateful timeouts on small fixtures."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from tactica.sources import corpus as C
from tactica.streaming import ingest as ST
from tactica.streaming import stateful as SF

SKELETON = {"proof": [{"action": "lemma x: True", "user_state": "goal"},
                      {"action": "by simp", "user_state": "1 subgoal"}],
            "deps": [{"name": "a", "term": "b"}], "methods": ["simp"]}


def _tree(files):
    root = tempfile.mkdtemp(prefix="tactica-corpus-")
    for rel, text in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as f:
            f.write(text)
    return root


def test_scan_corpus_and_errors(spark):
    root = _tree({"HOL/Main/proof0.json": json.dumps(SKELETON),
                  "HOL/Main/proof1.json": '{"bad": ',
                  "HOL/Main/proof2.json": "{bad json:}",
                  "HOL/Main/proof3.json": '{"foo": "bar"}',
                  "HOL/Main/notaproof.txt": "x"})
    df = C.scan_corpus(spark, root)
    rows = {r["proof_num"]: r for r in df.collect()}
    assert set(rows) == {0, 1, 2, 3}
    assert rows[0]["logic"] == "HOL" and rows[0]["theory"] == "Main"
    assert rows[0]["ok"] and len(rows[0]["proof"]) == 2
    assert not rows[1]["ok"] and rows[1]["proof"] is None
    bad = C.find_erroneous(df).select("rel").collect()
    assert sorted(r["rel"] for r in bad) == ["HOL/Main/proof1.json", "HOL/Main/proof2.json"]
    clean, quarantined = C.quarantine(df)
    assert clean.count() == 2 and quarantined.count() == 2
    assert C.corpus_is_valid(spark, root)
    assert not C.corpus_is_valid(spark, _tree({"x/notaproof.txt": "x"}))


def test_grouping_tree(spark):
    from tactica.operators import stats
    root = _tree({"HOL/Main/proof3.json": '{"foo": "bar"}'})
    files = C.list_files(spark, root)
    g = stats.group_by_logic_theory(files).collect()
    assert [(r["logic"], r["theory"], r["proof_num"]) for r in g] == [("HOL", "Main.thy", 3)]


def test_repair_raw_newline(spark):
    df = spark.createDataFrame([('{"k": "a\nb"}',), ('{"ok": 1}',), ('{"bad": ',)], "raw string")
    out = {r["raw"]: r for r in C.repair_corrupt_json(df).collect()}
    fixed = out['{"k": "a\nb"}']
    assert fixed["status"] == "repaired" and json.loads(fixed["fixed"]) == {"k": "a\nb"}
    assert out['{"ok": 1}']["status"] == "valid"
    assert out['{"bad": ']["status"] == "failed"


def test_key_paths(spark):
    df = spark.createDataFrame([('{"a": {"b": 1}, "c": [{"d": 2}], "e": []}',)], "raw string")
    got = {r["path"] for r in C.key_paths(df).collect()}
    assert {"a.b", "c[].d", "e[]"} <= got


def test_write_proofs_skips_existing(spark):
    out = tempfile.mkdtemp(prefix="tactica-sink-")
    df = spark.createDataFrame([("HOL", "Main", 0, "a"), ("HOL", "Main", 1, "b")],
                               "logic string, theory string, proof_num int, text string")
    C.write_proofs(df, out)
    existing = spark.read.json(out)
    C.write_proofs(df, out, existing=existing)
    assert spark.read.json(out).count() == 2


def test_streaming_ingest_exactly_once(spark):
    root = _tree({"HOL/Main/proof0.json": json.dumps(SKELETON)})
    out, ckpt = tempfile.mkdtemp(), tempfile.mkdtemp()
    ST.ingest_corpus(spark, root, out, ckpt).awaitTermination(120)
    with open(os.path.join(root, "HOL/Main/proof1.json"), "w") as f:
        f.write(json.dumps(SKELETON))
    ST.ingest_corpus(spark, root, out, ckpt).awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 2 and got.select("path").distinct().count() == 2
    assert {r["num_steps"] for r in got.collect()} == {1}


def test_running_metrics_stream(spark):
    src = tempfile.mkdtemp()
    spark.createDataFrame([("r1", 1.0, 1, 2), ("r1", 3.0, 2, 2), ("r2", 5.0, 0, 1)],
                          "run string, loss double, correct long, total long").write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema("run string, loss double, correct long, total long").parquet(src)
    q = (ST.running_metrics(stream, "run", "loss", "correct", "total").writeStream
           .format("memory").queryName("running_metrics_t").outputMode("complete").start())
    q.processAllAvailable()
    q.stop()
    rows = {r["run"]: r for r in spark.table("running_metrics_t").collect()}
    assert rows["r1"]["steps"] == 2 and rows["r1"]["avg_loss"] == 2.0 and rows["r1"]["accuracy"] == 0.75
    assert rows["r2"]["accuracy"] == 0.0


def test_unit_timeouts_stream(spark):
    SF.state_store(spark)
    src = tempfile.mkdtemp()
    spark.createDataFrame([
        (1, "2024-01-01 00:00:00", "view"), (1, "2024-01-02 00:00:00", "purchase"),
        (2, "2024-01-01 00:00:00", "view"), (3, "2024-03-01 00:00:00", "view")],
        "user_id long, ts string, event_type string").select(
        "user_id", F.to_timestamp("ts").alias("ts"), "event_type").write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema("user_id long, ts timestamp, event_type string").parquet(src)
    out = SF.unit_timeouts(stream, "user_id", "ts", F.col("event_type") == "purchase", limit="30 days",
                           watermark="1 hour")
    q = out.writeStream.format("memory").queryName("timeouts_t").outputMode("append").start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    rows = {r["proof"]: r for r in spark.table("timeouts_t").collect()}
    assert rows[1]["finished"] and not rows[1]["timed_out"]
    assert rows[2]["timed_out"] and not rows[2]["finished"]
    assert 3 not in rows


def test_whole_text_json_validity(spark):
    cases = ['{"a":1}x', '[1] 2', '1, 2', '{"a":1}  ', '  [1, {"b": [2]}] ', '"x"', '{"k": "a\nb"}', '']
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [r["ok"] for r in df.select(C.json_text_valid(F.col("s")).alias("ok")).collect()]
    want = []
    for c in cases:
        try:
            json.loads(c)
            want.append(True)
        except ValueError:
            want.append(False)
    assert got == want


def test_resume_ledger_records_once(spark):
    ledger = os.path.join(tempfile.mkdtemp(), "ledger")
    units = spark.createDataFrame([("HOL", "A"), ("HOL", "B")], "logic string, theory string")
    C.record_done(units, ledger, ["logic", "theory"])
    C.record_done(units, ledger, ["logic", "theory"])          # a retry records nothing new
    done = spark.read.parquet(ledger)
    assert done.count() == 2
    todo = spark.createDataFrame([("HOL", "A"), ("HOL", "C")], "logic string, theory string")
    assert [r["theory"] for r in C.resume_todo(todo, done, ["logic", "theory"]).collect()] == ["C"]


def test_backlog_past_the_deadline(spark):
    """A unit that gets data after the watermark passed its deadline times out at once."""
    SF.state_store(spark)
    src = tempfile.mkdtemp()
    parts = [[(1, "2024-06-01 00:00:00", "view")], [(2, "2024-05-31 23:30:00", "view"), (9, "2024-06-02 00:00:00", "view")],
             [(3, "2024-06-01 23:59:00", "view")]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "user_id long, ts string, event_type string").select(
            "user_id", F.to_timestamp("ts").alias("ts"), "event_type").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("user_id long, ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(src)
    out = SF.unit_timeouts(stream, "user_id", "ts", F.col("event_type") == "purchase", limit="1 minute", watermark="2 hours")
    q = out.writeStream.format("memory").queryName("backlog_t").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert q.exception() is None
    assert all(r["timed_out"] for r in spark.table("backlog_t").collect())


def test_copy_subset_adds_and_keeps_paths(spark):
    df = spark.createDataFrame([("/r/a/x.json", 1), ("/r/a/b/y.json", 2), ("/r/c/z.json", 3)], "path string, v int")
    out = os.path.join(tempfile.mkdtemp(), "copy")
    C.copy_subset(df, df.where("v < 3"), out)
    C.copy_subset(df, df.where("v = 3"), out)
    got = {(r["rel"], r["folder"]) for r in spark.read.parquet(out).collect()}
    assert got == {("x.json", ""), ("b/y.json", "b"), ("z.json", "")} or got == {("x.json", None), ("b/y.json", "b"), ("z.json", None)}


def test_stream_and_scan_agree_on_bad_files(spark):
    root = _tree({"HOL/M/proof0.json": json.dumps(SKELETON), "HOL/M/proof1.json": '{"proof":[]}x', "HOL/M/proof2.json": "[1]"})
    out, ckpt = tempfile.mkdtemp(), tempfile.mkdtemp()
    ST.ingest_corpus(spark, root, out, ckpt).awaitTermination(120)
    stream = {r["proof_num"]: r["ok"] for r in spark.read.parquet(out).collect()}
    scan = {r["proof_num"]: r["ok"] for r in C.scan_corpus(spark, root).collect()}
    assert stream == scan == {0: True, 1: False, 2: False}
