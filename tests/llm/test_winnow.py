"""Operator 7 against a plain computation and its guarantee."""

import hashlib
import random
import re

import pytest
from helpers import ODD, SF, docs, save, texts_of

import __spark_entry__ as E
from tactica.llm import winnow
from pyspark.sql import functions as F


def selected(hashes):
    """Positions selected from gram hashes: of every W the rightmost smallest."""
    out = []
    n = len(hashes)
    for i in range(max(1, n - winnow.W + 1) if n else 0):
        window = hashes[i:i + winnow.W]
        out.append(i + max(j for j, h in enumerate(window) if h == min(window)))
    return sorted(set(out))


def grams(spark, texts):
    """Hashes of all grams of each text, from its tokens' hashes."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select(
        "i", F.transform(winnow._tokens(F.coalesce("t", F.lit(""))), lambda t: F.xxhash64(t)).alias("h")).collect()
    out = {}
    for r in rows:
        h = [(x & 0x7FFFFFFF) % winnow.PRIME for x in r.h]
        out[r.i] = []
        for i in range(max(len(h) - winnow.K + 1, min(1, len(h)))):
            g = h[i]
            for j in range(1, winnow.K):
                g = (g * winnow.BASE + (h[i + j] if i + j < len(h) else 0)) % winnow.PRIME
            out[r.i].append(g)
    return out


def test_selection_matches_plain_computation(spark):
    texts = [*ODD, *list(texts_of().values())[:40], "b a " * 50, "a " * 30, "p q r s", "p q r", "p q", "p"]
    df = winnow.add_fingerprint(docs(spark, enumerate(texts), extra="__fp_h"), "text", "fp")
    rows = {r.doc_id: (r.fp, r.p) for r in df.withColumn("p", winnow.positions_of("fp")).collect()}
    for i, hashes in grams(spark, texts).items():
        want = selected(hashes)
        assert list(rows[i][1]) == want
        assert [x >> 32 for x in rows[i][0]] == [hashes[p] for p in want]


def test_match_guarantee(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    cases = []
    for _ in range(60):
        shared = [word() for _ in range(winnow.GUARANTEE)]
        cases += [" ".join([word() for _ in range(rng.randint(0, 30))] + shared + [word() for _ in range(rng.randint(0, 30))]) for _ in range(2)]
    df = winnow.add_fingerprint(docs(spark, enumerate(cases)), "text", "fp").withColumn("h", winnow.hashes_of("fp"))
    h = {r.doc_id: set(r.h) for r in df.collect()}
    assert all(h[i] & h[i + 1] for i in range(0, len(cases), 2))


def edited(rows):
    """(doc_id, text, edited, next text) in the order of the ids."""
    rows = sorted(rows, key=lambda r: r[0])
    out = []
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out.append((i, t, t[:len(t) - half] + n[:half], n))
    return out


@pytest.mark.parametrize("per_bucket", [2000, 7])
def test_op7(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(winnow, "BUCKET_ROWS", per_bucket)
    got = {r.doc_id: r for r in E.queries()["op7_winnowing"](spark, SF).collect()}
    want = edited(texts_of().items())
    assert len(got) == len(want)
    prints, hashes = {}, grams(spark, [x for row in want for x in row[1:]])
    sets = [{h[p] for p in selected(h)} for _, h in sorted(hashes.items())]

    def likeness(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, (i, text, changed, following) in enumerate(want):
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and prints.setdefault(changed, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        own, other, after = sets[3 * k:3 * k + 3]
        assert abs(r.near_edited - likeness(own, other)) < 1e-12 and abs(r.near_next - likeness(own, after)) < 1e-12


def test_edge_cases(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(winnow, "BUCKET_ROWS", 3)
    rows = [(i * i % 97, t) for i, t in enumerate(ODD)]
    assert len({i for i, _ in rows}) == len(rows)
    got = {r.doc_id: r for r in winnow.fingerprint_pairs(docs(spark, rows, extra="bucket guest hashes")).collect()}
    for i, text, changed, _ in edited(rows):
        assert (got[i].text, got[i].edited, got[i].n_chars) == (text, changed, len(text))
    twice = winnow.fingerprint_pairs(docs(spark, [(1, "a b c d"), (1, "a b c d"), (2, "e f g h"), (None, "i j k l")])).collect()
    assert sorted((r.doc_id or 0, r.edited) for r in twice) == [(0, "i j a b"), (1, "a b a b"), (1, "a b e f"), (2, "e f i j")]
    alone = winnow.fingerprint_pairs(docs(spark, [(4, "abcdef")])).collect()
    assert [r.edited for r in alone] == ["abcabc"]
    folder = save(spark, tmp_path, documents=docs(spark, rows).limit(0))
    assert E.queries()["op7_winnowing"](spark, folder).count() == 0


def test_plan_is_native(spark):
    plan = E.queries()["op7_winnowing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
