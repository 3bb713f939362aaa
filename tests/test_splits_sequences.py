"""Splits, ordering and sequence operators on literal fixtures."""

from pyspark.sql import functions as F

from tactica.operators import patterns
from tactica.operators import sequences as S
from tactica.operators import splits
from tactica.operators.ordering import number_rows, running_sum


def _files(spark, counts):
    rows = [(d, i) for d, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "dir string, num long")


def test_split_sizes(spark):
    df = _files(spark, {"a": 10, "b": 1, "c": 25})
    out = splits.assign_split(df, ["dir"], ["num"])
    got = {(r["dir"], r["split"]): r["n"] for r in out.groupBy("dir", "split").agg(F.count("*").alias("n")).collect()}
    assert (got.get(("a", "train"), 0), got.get(("a", "valid"), 0), got.get(("a", "test"), 0)) == (6, 1, 3)
    assert (got.get(("b", "train"), 0), got.get(("b", "valid"), 0), got.get(("b", "test"), 0)) == (0, 0, 1)
    assert (got.get(("c", "train"), 0), got.get(("c", "valid"), 0), got.get(("c", "test"), 0)) == (16, 4, 5)
    # splits are disjoint and complete
    assert out.count() == 36 and out.select("dir", "num").distinct().count() == 36


def test_split_respects_numeric_order(spark):
    df = spark.createDataFrame([("d", "proof10.json", 10), ("d", "proof2.json", 2), ("d", "proof1.json", 1)],
                               "dir string, name string, num long")
    keyed = splits.natural_order_key(df, ["dir"], "name", "num", "sort_num")
    ranked = number_rows(keyed, ["dir"], ["sort_num", "name"], "rank")
    assert [r["name"] for r in ranked.orderBy("rank").collect()] == ["proof1.json", "proof2.json", "proof10.json"]


def test_unknown_split_is_error(spark):
    import pytest
    with pytest.raises(ValueError):
        splits.dataset_split(_files(spark, {"a": 2}), "bogus", ["dir"], ["num"])


def test_number_rows_hot_group(spark):
    # one group holds most rows; numbering must still be exact
    rows = [("hot", i) for i in range(5000)] + [("cold", i) for i in range(7)]
    df = spark.createDataFrame(rows, "g string, k long")
    out = number_rows(df, ["g"], ["k"], "rn", count_name="n")
    bad = out.where(F.col("rn") != F.col("k")).count()
    assert bad == 0
    assert {r["g"]: r["n"] for r in out.select("g", "n").distinct().collect()} == {"hot": 5000, "cold": 7}


def test_running_sum(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(100)], "g string, p long, v long")
    out = running_sum(df, ["g"], ["p"], {"s": F.col("v")})
    assert all(r["s"] == r["p"] * (r["p"] + 1) // 2 for r in out.collect())


def test_seeded_traversal_is_reproducible(spark):
    df = spark.createDataFrame([(f"d{i}",) for i in range(20)], "dir string")
    a = [r["dir"] for r in splits.seeded_dir_order(df, ["dir"], 7).orderBy("dir_rank").collect()]
    b = [r["dir"] for r in splits.seeded_dir_order(df, ["dir"], 7).orderBy("dir_rank").collect()]
    assert a == b and sorted(a) == sorted(r["dir"] for r in df.collect())


def test_random_element(spark):
    df = spark.createDataFrame([("g", i) for i in range(50)] + [("h", 1)], "grp string, k long")
    a = splits.random_element(df, ["grp"], ["k"], seed=3).collect()
    b = splits.random_element(df, ["grp"], ["k"], seed=3).collect()
    assert sorted(a) == sorted(b)
    picked = {r["grp"]: r["k"] for r in a}
    assert picked["h"] == 1 and 0 <= picked["g"] < 50
    empty = splits.random_element(df.where("k < 0"), ["grp"], ["k"], seed=3)
    assert empty.count() == 0


def test_segment_by_pattern(spark):
    items = ["x", "a", "b", "y", "a", "b"]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(items)], "s long, pos long, item string")
    out = patterns.segment_by_pattern(df, ["s"], "pos", "item", ["a", "b"]).orderBy("start").collect()
    assert [(r["start"], r["end"], r["is_match"]) for r in out] == \
        [(0, 0, False), (1, 2, True), (3, 3, False), (4, 5, True)]


def test_runs_and_cuts(spark):
    flags = [True, True, False, True, False, False]
    df = spark.createDataFrame([(0, i, f) for i, f in enumerate(flags)], "s long, pos long, f boolean")
    runs = S.runs_by_predicate(df, ["s"], "pos", F.col("f")).orderBy("start").collect()
    assert [(r["flag"], r["start"], r["end"]) for r in runs] == \
        [(True, 0, 1), (False, 2, 2), (True, 3, 3), (False, 4, 5)]
    cuts = S.until_while_cuts(df, ["s"], "pos", ~F.col("f")).orderBy("pos").collect()
    assert [r["take_until"] for r in cuts] == [True, True, True, False, False, False]
    assert [r["take_while"] for r in cuts] == [False] * 6
    nh = S.neighbourhoods(df, ["s"], "pos", F.col("pos") == 0, 0)
    assert nh.count() == 0


def _greedy_segments(items, pattern):
    m, i, pieces, gap_start = len(pattern), 0, [], None
    while i < len(items):
        if items[i:i + m] == pattern:
            if gap_start is not None:
                pieces.append((gap_start, i - 1, False))
                gap_start = None
            pieces.append((i, i + m - 1, True))
            i += m
        else:
            if gap_start is None:
                gap_start = i
            i += 1
    if gap_start is not None:
        pieces.append((gap_start, len(items) - 1, False))
    return pieces


def test_segment_by_overlapping_pattern_brute_force(spark):
    import random
    rnd = random.Random(3)
    seqs = [list("aaabaaaa"), list("abababa")] + [[rnd.choice("ab") for _ in range(rnd.randrange(1, 30))]
                                                   for _ in range(6)]
    for pattern in (["a", "a"], ["a", "b", "a"], ["a", "a", "a"]):
        rows = [(k, i, t) for k, seq in enumerate(seqs) for i, t in enumerate(seq)]
        df = spark.createDataFrame(rows, "s long, pos long, item string")
        out = patterns.segment_by_pattern(df, ["s"], "pos", "item", pattern).collect()
        got = {}
        for r in out:
            got.setdefault(r["s"], []).append((r["start"], r["end"], r["is_match"]))
        for k, seq in enumerate(seqs):
            assert sorted(got.get(k, [])) == _greedy_segments(seq, pattern), (pattern, "".join(seq))


def test_segment_by_pattern_across_chunks(spark):
    import random
    rnd = random.Random(8)
    seqs = {"hot": rnd.choices(["a", "b"], k=3000), "runs": ["a"] * 700, "mixed": rnd.choices(["a", "b", "c", None], k=900),
            "short": ["a"], "none": ["c"] * 40}
    rows = [(k, i + 5, t) for k, seq in seqs.items() for i, t in enumerate(seq)]
    df = spark.createDataFrame(rows, "s string, pos int, item string").repartition(7)
    for pattern in (["a"], ["a", "b"], ["a", "a", "a"], ["a", "b", "a", "a", "b"], ["c"] * 7):
        got = {}
        for r in patterns.segment_by_pattern(df, ["s"], "pos", "item", pattern).collect():
            assert r["length"] == r["end"] - r["start"] + 1
            got.setdefault(r["s"], []).append((r["start"] - 5, r["end"] - 5, r["is_match"]))
        for k, seq in seqs.items():
            assert sorted(got.get(k, [])) == _greedy_segments(seq, pattern), (pattern, k)
    assert patterns.segment_by_pattern(df.limit(0), ["s"], "pos", "item", ["a", "b"]).count() == 0
    whole = patterns.segment_by_pattern(df, ["s"], "pos", "item", []).where("s = 'hot'").first()
    assert (whole["start"], whole["end"], whole["is_match"], whole["length"]) == (5, 3004, False, 3000)


def test_chunk_from_every_state(spark):
    import random

    import numpy as np
    rnd = random.Random(2)
    for pattern in ([0], [0, 1], [0, 0], [0, 1, 0], [0, 0, 1, 0, 0]):
        table = patterns.automaton(pattern)
        for _ in range(60):
            codes = np.array(rnd.choices([-1, 0, 0, max(pattern)], k=rnd.randrange(0, 25)), np.int64)
            chunk, cut = patterns.Chunk(table), rnd.randrange(0, len(codes) + 1)
            chunk.read(codes[:cut], np.arange(cut))
            chunk.read(codes[cut:], np.arange(cut, len(codes)))
            exits, ends = chunk.result()
            for entry in range(len(pattern)):
                state, found = entry, []
                for i, c in enumerate(codes.tolist()):
                    state = table[state][c] if c >= 0 else 0
                    if state == len(pattern):
                        state = 0
                        found.append(i)
                assert (exits[entry], ends[entry]) == (state, found), (pattern, codes, entry)


def test_number_rows_of_any_key(spark):
    import random

    from tactica.operators.ordering import bucket_of, exact_median
    rng = random.Random(3)
    words = [None if rng.random() < 0.1 else "".join(rng.choices("abc", k=rng.randint(0, 6))) for _ in range(3000)]
    rows = [("hot" if i % 20 else "cold", w, 10 ** 15 if i == 7 else i % 50, i) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "g string, w string, n long, i long")
    for order in (["w", "i"], ["n", "i"], ["i"]):
        got = {(r["g"], r["i"]): r["rn"] for r in number_rows(df, ["g"], order, "rn").collect()}
        key = lambda r: tuple((v is not None, v) for v in (r[{"g": 0, "w": 1, "n": 2, "i": 3}[c]] for c in order))
        want = {}
        for g in ("hot", "cold"):
            for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=key)):
                want[g, r[3]] = k
        assert got == want, order
        sizes = [r["count"] for r in df.groupBy(bucket_of(df, ["g"], order).alias("b")).count().collect()]
        assert max(sizes) <= 5 * sum(sizes) / len(sizes) and len(sizes) > 10
    med = {r["g"]: r["median"] for r in exact_median(df, ["g"], "n").collect()}
    import statistics
    assert med == {g: statistics.median(r[2] for r in rows if r[0] == g) for g in ("hot", "cold")}
    assert number_rows(df.limit(0), ["g"], ["w"], "rn").count() == 0


def test_proven_lists(spark):
    from tactica.operators import sequences as S
    steps = spark.createDataFrame([("s", i) for i in range(4)], "session string, pos long")
    added = spark.createDataFrame([("s", 1, 0, "a"), ("s", 3, 0, "c"), ("s", 3, 1, "b")], "session string, _at long, _i int, term string")
    got = {}
    for r in S.proven_lists(added, steps, ["session"], "pos").orderBy("pos", "k").collect():
        got.setdefault(r["pos"], []).append(r["term"])
    assert got == {1: ["a"], 2: ["a"], 3: ["c", "b", "a"]}
