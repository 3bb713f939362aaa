"""Operator 12: targets against exact fractions, what is taken against its bounds."""

import re
from collections import defaultdict
from fractions import Fraction

from helpers import ODD, SF, save
from pyspark.sql import functions as F

import __spark_entry__ as E
from tactica.llm import mixing


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(1, 2, 3), epochs=3):
    """source -> target, by clamping one turn after the other in exact fractions."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: Fraction(rest * weight[s], sum(weight[t] for t in free)) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: Fraction(epochs * sizes[s]) for s in over}


def check(rows, got, epochs=3):
    """``rows``: (doc_id, text, source); ``got``: result rows."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += n_words(text)
    want, taken, near = targets(sizes, epochs=epochs), defaultdict(int), defaultdict(int)
    assert sorted(((r.doc_id, r.size, r.source) for r in got), key=repr) == sorted(((i, n_words(t), s) for i, t, s in rows), key=repr)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-9 * max(1, want[r.source])
        assert 0 <= r.taken <= epochs * r.size and r.taken == r.repeats * r.size
        taken[r.source] += r.taken
        near[r.source] = max(near[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near[s] / 2 + 1e-6
    return taken, want


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], "doc_id long, text string, source string, taken string")


def test_water_filling_clamps_in_turns(spark):
    # small sources are clamped first, and their excess lifts others over their caps
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 1000), ("b", 10), ("c", 90), ("d", 300), (None, 5), ("é", 40), ("z", 1)])]
    got = mixing.mix(frame(spark, rows)).collect()
    taken, want = check(rows, got)
    assert want["b"] == 30 and want["z"] == 3 and want[None] == 15


def test_odd_texts_ties_and_repeated_rows(spark):
    rows = [(i, t, "s" if i % 3 else None) for i, t in enumerate(ODD)] + [(None, "a b", "s"), (None, None, "s"), (None, "a b", "s")]
    rows += [(7, "one two three", "hot")] * 500 + [(8, "x", "hot")] * 3
    df = frame(spark, rows)
    first = mixing.mix(df).collect()
    taken, want = check(rows, first)
    assert abs(taken["hot"] - want["hot"]) <= 1.5
    again = mixing.mix(df.repartition(13, "text", F.rand(4))).collect()
    key = lambda rs: sorted(((r.doc_id, r.size, r.target, r.taken) for r in rs), key=repr)
    assert key(first) == key(again)
    other = mixing.mix(df, seed=99).collect()
    check(rows, other)


def test_empty_and_sizeless(spark, tmp_path):
    df = frame(spark, []).withColumn("lang", F.lit("en"))
    out = E.queries()["op12_source_mix"](spark, save(spark, tmp_path, documents=df))
    assert out.count() == 0 and out.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    got = mixing.mix(frame(spark, [(1, None, "a"), (2, " ", "b")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_repeated_gives_the_corpus(spark):
    rows = [(i, f"word{i} " * (1 + i % 9), "abc"[i % 3]) for i in range(90)]
    mixed = mixing.mix(frame(spark, rows), prefix="m_")
    corpus = mixing.repeated(mixed, "m_").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("m_size").alias("w"))
    got = {r.doc_id: (r.n, r.w) for r in corpus.collect()}
    assert got == {r.doc_id: (r.m_repeats, r.m_taken) for r in mixed.collect() if r.m_repeats}
    assert "taken" in mixed.columns  # the input's own column stays beside m_taken


def test_op12_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check([(r.doc_id, r.text, r.source) for r in docs], E.queries()["op12_source_mix"](spark, SF).collect())
