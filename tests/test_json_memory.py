"""Rendering and reading JSON keeps little in Python workers."""

import json

import pyarrow as pa

from tactica.functions import pyjson
from tactica.operators import steps
from tactica.sources import corpus as C
from tactica.sources import proof_files

WORDS = ["plain", 'q"\\', "tab\t\n\r\b\f\x01\x7f", "é中\U0001f600", "", None]
ROWS = [(i, [(a, "0 subgoals") for a in WORDS[: i + 1]], {"k\"é": WORDS[i]}, i % 2 == 0) for i in range(len(WORDS))]
SCHEMA = "proof_id long, proof array<struct<action string, user_state string>>, `t\"é` map<string, string>, ok boolean"


def test_p10_pairs_without_python(spark, capsys):
    pairs = steps.input_target_pairs(spark.createDataFrame(ROWS, SCHEMA).where("proof_id < 5"))
    pairs.explain()
    plan = capsys.readouterr().out
    assert "ArrowEvalPython" not in plan
    got = {(r.proof_id, r.step): json.loads(r.input)["proof_so_far"] for r in pairs.collect()}
    assert got == {(i, k): "\n".join(WORDS[:k]) for i in range(5) for k in range(1, i + 1)}


def test_p13_records_without_python(spark, capsys):
    df = spark.createDataFrame(ROWS, SCHEMA)
    text = df.select("proof_id", steps.to_py_json_struct(df, ["proof_id", "proof", 't"é', "ok"]).alias("json"))
    text.explain()
    assert "ArrowEvalPython" not in capsys.readouterr().out
    for r in text.collect():
        i, proof, names, ok = ROWS[r.proof_id]
        assert r.json == json.dumps({"proof_id": i, "proof": [{"action": a, "user_state": s} for a, s in proof], 't"é': names, "ok": ok})


def test_p13_line_break_at_the_end_is_escaped(spark):
    """``$`` matches before a last line break too: such a text is not plain."""
    words = [a + b for a in ("", "plain", "caf\xe9") for b in ("\n", "\r", "\r\n", "\x0b", "\x85", "\u2028", "\u2029")]
    df = spark.createDataFrame([(i, [(w, "")], {w: w}) for i, w in enumerate(words)],
                               "proof_id long, proof array<struct<action string, user_state string>>, names map<string, string>")
    got = df.select("proof_id", steps.to_py_json_struct(df, ["proof", "names"]).alias("json")).collect()
    assert {r.proof_id: r.json for r in got} == {
        i: json.dumps({"proof": [{"action": w, "user_state": ""}], "names": {w: w}}) for i, w in enumerate(words)}


def test_p16_texts_a_few_at_a_time(spark, capsys):
    """The text is made once, and Python holds a slice of a batch."""
    assert [len(p) for p in pyjson.slices(pa.array(range(2 * pyjson.SLICE + 5)))] == [pyjson.SLICE, pyjson.SLICE, 5]
    df = spark.createDataFrame(ROWS, SCHEMA)
    raw = df.select("proof_id", steps.to_py_json_struct(df, ["proof"]).alias("raw"))
    paths = C.key_paths(raw)
    paths.explain()
    assert capsys.readouterr().out.count("regexp_extract_all") == 2  # an expression for each of two fields
    bad = spark.createDataFrame([(9, '{"a": 1}x'), (10, None), (11, '{"z": []}')], "proof_id long, raw string")
    got = {r.path: r["count"] for r in C.key_paths(raw.unionByName(bad)).collect()}
    assert got == {"proof": 6, "proof[]": 6, "proof[].action": 6, "proof[].user_state": 6, "z": 1, "z[]": 1}
    assert [r.path for r in C.json_atoms(bad, ["proof_id"]).collect()] == []


def test_doubles_are_written_as_python_does(spark):
    df = spark.createDataFrame([(i, 1e10 * i, [0.1 * i]) for i in range(2 * pyjson.SLICE + 3)] + [(-1, None, None)], "i long, x double, y array<double>")
    got = df.select("i", steps.to_py_json_struct(df, ["x", "y"]).alias("json")).collect()
    assert all(r.json == json.dumps({"x": 1e10 * r.i, "y": [0.1 * r.i]} if r.i >= 0 else {"x": None, "y": None}) for r in got)


def test_s06_files_are_written_from_slices(tmp_path, monkeypatch):
    n = 2 * pyjson.SLICE + 3
    rows = pa.RecordBatch.from_pydict({"logic": ["HOL"] * n, "theory": ["T"] * n, "proof_num": list(range(n)), "raw": [f"{{{i}}}" for i in range(n)]})

    class Whole:
        schema = rows.schema

        def __len__(self):
            return n

        def slice(self, *at):
            return rows.slice(*at)

        def column(self, i):
            raise AssertionError("the whole batch becomes Python objects")

    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = taskAttemptId = staticmethod(lambda: 0)

    monkeypatch.setattr(proof_files, "TaskContext", Task)
    writer = proof_files.ProofWriter(str(tmp_path))
    writer.commit([writer.write(iter([Whole()]))])
    assert {p.name: p.read_text() for p in (tmp_path / "HOL" / "T").iterdir()} == {f"proof{i}.json": f"{{{i}}}" for i in range(n)}
