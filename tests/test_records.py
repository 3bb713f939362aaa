"""Record-level operators on literal fixtures."""

import json

from pyspark.sql import functions as F

from tactica.operators import blocks as B
from tactica.operators import evaluation as ev
from tactica.operators import steps as P
from tactica.sources import corpus as C


def test_step_constants(spark):
    df = spark.createDataFrame([(1, 0, {"Type0": "x :: nat"}), (1, 1, {"Type0": "y :: nat", "Type1": "f :: 'a"})],
                               "proof_id long, step int, constants map<string,string>")
    got = sorted((r["step"], r["type_group"], r["names"]) for r in P.step_constants(df).collect())
    assert got == [(1, "Type0", "y :: nat"), (1, "Type1", "f :: 'a")]


def test_json_atoms(spark):
    df = spark.createDataFrame([(1, json.dumps({"a": {"b": 1}, "c": [{"d": 2}, 3], "e": []}))], "id long, raw string")
    got = sorted((r["path"], r["atom"]) for r in C.json_atoms(df, ["id"]).collect())
    assert got == [("$.a.b", "1"), ("$.c[0].d", "2"), ("$.c[1]", "3")]


def test_number_and_group_names(spark):
    df = spark.createDataFrame([("n", ["t1", "t2"])], "name string, theorems array<string>")
    assert [(r["index"], r["theorem"]) for r in P.number_facts(df).collect()] == [(1, "t1"), (2, "t2")]
    terms = spark.createDataFrame([(0, "nat", "a", 0), (0, "nat", "b", 1), (0, "bool", "p", 2), (0, "nat", "a", 3)],
                                  "step int, type string, name string, pos int")
    got = {r["type_group"]: r["names"] for r in P.group_names_by_type(terms, ["step"], "type", "name", "pos").collect()}
    assert got == {"Type0": "b, a :: nat", "Type1": "p :: bool"}


def test_blocks_theory_lemma(spark):
    cmds = ["theory", "lemma", "apply", "done", "end"]
    df = spark.createDataFrame([(0, i, c) for i, c in enumerate(cmds)], "thy long, pos long, cmd string")
    c = F.col("cmd")
    events = B.segment_blocks(df, ["thy"], "pos", [("THEORY", c == "theory"), ("PROOF", c == "lemma")],
                              [("THEORY", c == "end"), ("PROOF", c == "done")])
    rows = {r["block_id"]: r for r in B.blocks(events, ["thy"], "pos").collect()}
    assert rows[0]["tag"] == "THEORY" and rows[0]["closed"] and rows[0]["level"] == 1
    assert rows[1]["tag"] == "PROOF" and rows[1]["closed"] and rows[1]["n_events"] == 3
    assert events.where(F.col("error").isNotNull()).count() == 0
    top = B.top_level_blocks(events, B.blocks(events, ["thy"], "pos"), ["thy"], "pos", "PROOF").collect()
    assert [r["block_id"] for r in top] == [1]
    bad = spark.createDataFrame([(0, 0, "done")], "thy long, pos long, cmd string")
    ev_bad = B.segment_blocks(bad, ["thy"], "pos", [("PROOF", F.col("cmd") == "lemma")], F.col("cmd") == "done")
    assert ev_bad.first()["error"] == "unbalanced close"


def test_merge_metric_records(spark):
    rows = [("r", 1, "n", "int", "1"), ("r", 2, "n", "int", "2"), ("r", 1, "l", "list", "1"),
            ("r", 2, "l", "list", "2"), ("r", 1, "t", "other", "a"), ("r", 2, "t", "other", "b")]
    df = spark.createDataFrame(rows, "run string, seq long, key string, kind string, value string")
    m = {r["key"]: r for r in ev.merge_metric_records(df, ["run", "key"]).collect()}
    assert m["n"]["number"] == 3 and m["t"]["text"] == "b"
    lst = [r["value"] for r in ev.merge_metric_lists(df, ["run", "key"]).orderBy("position").collect()]
    assert lst == ["1", "2"]


def test_dedup_and_fastest(spark):
    df = spark.createDataFrame([("g", "a", False), ("g", "a", False), ("g", "b", True), ("h", "c", False)],
                               "goal string, acts string, proved boolean")
    got = sorted((r["goal"], r["acts"]) for r in ev.dedup_attempts(df, "goal", "acts", "proved").collect())
    assert got == [("g", "b"), ("h", "c")]
    s = spark.createDataFrame([("g", "x", 5.0, True, 1), ("g", "y", 2.0, False, 2), ("g", "z", 3.0, True, 3),
                               ("h", "w", 1.0, False, 4)], "goal string, s string, t double, ok boolean, seq long")
    best = {r["goal"]: r["suggestion"] for r in ev.fastest_suggestion(s, "goal", "s", "t", "ok", "seq").collect()}
    assert best == {"g": "z", "h": "No proof found"}


def test_flatten_trace_is_inverse(spark):
    cmds = ["theory", "lemma", "apply", "done", "end", "x"]
    df = spark.createDataFrame([(0, i, c) for i, c in enumerate(cmds)], "thy long, pos long, cmd string")
    c = F.col("cmd")
    events = B.segment_blocks(df, ["thy"], "pos", [("THEORY", c == "theory"), ("PROOF", c == "lemma")],
                              c.isin("done", "end"))
    back = B.flatten_trace(events, df, ["thy"], "pos", "cmd").orderBy("n").collect()
    assert [r["action"] for r in back] == cmds and [r["n"] for r in back] == list(range(len(cmds)))
    # the trailing command after the theory closed is a top-level (OTHER) command
    assert events.where("pos = 5").first()["block_id"] is None


def test_input_word_counts_with_context(spark):
    """Token counts of P10 inputs equal len(input.split()) for records that
    carry deps, methods and per-step terms (not only the adapter's shape)."""
    schema = ("proof_id long, proof array<struct<action:string,user_state:string,"
              "variables:map<string,string>,constants:map<string,string>,"
              "`type variables`:map<string,string>>>, deps array<struct<name:string,term:string>>, "
              "methods array<string>")
    rows = [(1, [("lemma x:  é True", "goal a", {"Type0": "x :: nat"}, None, {}),
                 (" by simp ", "", None, {"Type0": "f g :: 'a"}, None),
                 ("", "  two  spaces ", {}, None, None),
                 ("done", None, None, None, None)],
             [("a b", "t  u"), ("c", "")], ["simp", "auto  x"]),
            (2, [("only", "s", None, None, None)], None, None)]
    df = spark.createDataFrame(rows, schema)
    for fmt in ("state", "state_prems", "state_prems_kwrds", "state_prems_kwrds_terms"):
        pairs = P.input_target_pairs(df, fmt).select("proof_id", "step", "input", "target")
        counts = P.input_word_counts(df, fmt)
        got = {(r["proof_id"], r["step"]): (r["n_x"], r["n_y"]) for r in counts.collect()}
        want = {(r["proof_id"], r["step"]): (len(r["input"].split()), len(r["target"].split()))
                for r in pairs.collect()}
        assert got == want, fmt


def test_input_target_pairs_match_python_json(spark):
    import json as _json
    schema = ("proof_id long, proof array<struct<action:string,user_state:string,"
              "variables:map<string,string>>>, deps array<struct<name:string,term:string>>, methods array<string>")
    proof = [("lemma \"q\": é", "g0", {"Type0": "x :: nat"}), ("apply\tsimp", "g1", None), ("done", None, {})]
    deps = [("a b", "t")]
    methods = ["simp"]
    df = spark.createDataFrame([(7, proof, deps, methods)], schema)
    for fmt in ("state", "state_prems_kwrds_terms"):
        got = {r["step"]: (r["input"], r["target"]) for r in P.input_target_pairs(df, fmt).collect()}
        for i in range(1, len(proof)):
            x = {"proof_so_far": "\n".join([proof[0][0]] + [s[0] for s in proof[1:i]]),
                 "last_usr_state": proof[i][1] if proof[i][1] is not None else ""}
            if "state_prems" in fmt:
                x["deps"] = [{"name": n, "term": t} for n, t in deps]
            if "state_prems_kwrds" in fmt:
                x["methods"] = methods
            if "state_prems_kwrds_terms" in fmt:
                x["variables"] = proof[i][2] if proof[i][2] is not None else []
                x["constants"] = []
                x["type variables"] = []
            assert got[i] == (_json.dumps(x), proof[i][0]), (fmt, i)


def test_repair_balances_quotes_and_rejects_empty(spark):
    rows = [('{"q": "x\n\\"y"}',), ("[\n]x",), ('{"a": "1\n", "b": ["c\n\\"d"]}',)]
    out = {r["raw"]: r for r in C.repair_corrupt_json(spark.createDataFrame(rows, "raw string")).collect()}
    first = out[rows[0][0]]
    assert first["status"] == "repaired" and json.loads(first["fixed"]) == {"q": 'x\n"y"'}
    assert out[rows[1][0]]["status"] == "failed"
    third = json.loads(out[rows[2][0]]["fixed"])
    assert third == {"a": "1\n", "b": ['c\n"d"']}


def test_json_of_depth_40(spark):
    value = {"leaf": 1.50}
    for i in range(40):
        value = [value, i] if i % 3 == 0 else {f"k{i}": value}
    df = spark.createDataFrame([(1, json.dumps(value))], "id long, raw string")
    paths = {r["path"]: r["count"] for r in C.key_paths(df).collect()}
    assert len(paths) == 41 and max(p.count("[]") + p.count(".") for p in paths) >= 30 and set(paths.values()) == {1}
    atoms = [(r["path"], r["atom"]) for r in C.json_atoms(df, ["id"]).collect()]
    assert len(atoms) == 15 and sum(p.endswith(".leaf") and a == "1.5" for p, a in atoms) == 1
    raw = spark.createDataFrame([(1, '{"a": 1.50, "b": [true, null, "x\\u00e9"]}')], "id long, raw string")
    assert sorted((r["path"], r["atom"]) for r in C.json_atoms(raw, ["id"]).collect()) == [
        ("$.a", "1.50"), ("$.b[0]", "true"), ("$.b[1]", "null"), ("$.b[2]", '"xé"')]


def _read_in_order(commands, rules_start, rules_end):
    """Segmentation straight from its rules: (pos, delta, level, block, tag, error)."""
    out, open_ = [], []
    for pos, c in enumerate(commands):
        starts = [t for t, cs in rules_start if c in cs]
        ends = [t for t, cs in rules_end if c in cs]
        top = open_[-1] if open_ else None
        if starts:
            tags = [t for t, _ in open_]
            if ends and ends[0] in tags:
                while len(open_) > tags.index(ends[0]):
                    t, b = open_.pop()
                    out.append((pos, -1, len(open_) + 1, b, t, None))
            open_.append((starts[0], pos))
            out.append((pos, 1, len(open_), pos, starts[0], None))
        elif not ends:
            out.append((pos, 0, len(open_), top[1] if top else None, top[0] if top else "OTHER", None))
        elif top and top[0] in ends:
            out.append((pos, -1, len(open_), top[1], top[0], None))
            open_.pop()
        else:
            error = f"{top[0]} closed by {ends[0]}" if top else "unbalanced close"
            out.append((pos, 0, len(open_), top[1] if top else None, top[0] if top else "OTHER", error))
    return out


def test_blocks_on_random_sequences(spark):
    import random
    rng = random.Random(11)
    starts = [("A", "ax"), ("B", "by"), ("C", "c")]
    ends = [("A", "Axz"), ("B", "By"), ("C", "Cz")]
    groups = {g: [rng.choice("abcABCxyz.") for _ in range(n)] for g, n in enumerate([1, 2, 5, 40, 40, 400, 1500])}
    groups[99] = list(".o.") and list("A.a.AaA")
    rows = [(g, i, c) for g, cs in groups.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "g long, p long, c string").repartition(7)
    pred = lambda rules: [(t, F.col("c").isin(*cs)) for t, cs in rules]
    events = B.segment_blocks(df, ["g"], "p", pred(starts), pred(ends))
    got = {}
    for r in events.orderBy("g", "p", "sub").collect():
        got.setdefault(r["g"], []).append((r["p"], r["delta"], r["level"], r["block_id"], r["tag"], r["error"]))
    assert got == {g: _read_in_order(cs, starts, ends) for g, cs in groups.items()}
    # closings before any opening are errors and leave later blocks alone
    assert [e[1] for e in got[99] if e[1]] == [1, -1, 1, -1]


def test_kind_of_the_last_update_counts(spark):
    rows = [("r", i, "k", "int" if i < 3 else "other", str(i)) for i in range(5)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "run string, seq long, key string, kind string, value string")
        m = ev.merge_metric_records(df, ["run", "key"]).first()
        assert (m["kind"], m["text"], m["number"]) == ("other", "4", None)


def test_proved_attempt_equal_to_the_proof_so_far_stays(spark):
    df = spark.createDataFrame([("g", "a", True, "a"), ("g", "b", False, "a"), ("h", "a", False, "a"), ("h", "b", False, "a")],
                               "goal string, acts string, proved boolean, so_far string")
    got = sorted((r["goal"], r["acts"]) for r in ev.dedup_attempts(df, "goal", "acts", "proved", "so_far").collect())
    assert got == [("g", "a"), ("h", "b")]
