"""Operator 5 against brute force over all pairs, with regions large and small."""

import random

import numpy as np
import pytest
from helpers import ODD, SF, components, docs, shingles, texts_of

import __spark_entry__ as E
from tactica.llm import jaccard
from tactica.llm.components import components as roots
from tactica.llm.shingles import shingle_sets


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def corpus(seed, groups, copies, words):
    """Groups of near copies that share passages, each copy changed in a few places."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(120)]
    passages = [rng.choices(vocabulary, k=40) for _ in range(4)]
    texts = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(*words)) + rng.choice(passages)
        for _ in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_shingle_sets():
    cases = [*ODD, "A b C d E f", "a B c D e F", "one two", "two one", "x\ty\nz\x0bw v\x0cu", "\x1fa b"]
    for text, got in zip(cases, shingle_sets(cases)):
        assert len(got) == len(shingles(text))
        assert (np.diff(got.astype(object)) > 0).all()
    a, b = shingle_sets(["A b C d E f", "a B c D e F"])
    assert (a == b).all()


def test_op5(spark):
    assert rows_of(E.queries()["op5_jaccard_join"](spark, SF)) == sorted(components(list(texts_of().items())), key=str)


@pytest.mark.parametrize("seed,limit", [(1, 48 << 20), (2, 6_000), (3, 20_000)])
def test_random_corpora(spark, seed, limit):
    rows = corpus(seed, 40, 6, (1, 90))
    assert rows_of(jaccard.join(docs(spark, rows), region_bytes=limit)) == sorted(components(rows), key=str)


def test_one_large_group_divided(spark):
    rows = corpus(5, 2, 90, (150, 160))
    assert rows_of(jaccard.join(docs(spark, rows), region_bytes=9_000)) == sorted(components(rows), key=str)


def test_edge_cases(spark):
    rows = [*enumerate(ODD), (100, "a b c d e f g"), (101, "A B C D E F G"), (102, "a b c d e f g"), (7, "z z z z z z z z"),
            (200, "one two"), (201, "one two"), (None, "a b c d e f g"), (None, None)]
    got = rows_of(jaccard.join(docs(spark, rows, extra="hi lo rep region key blob n")))
    want = {i: (n, c) for i, n, c in components([r for r in rows if r[0] != 7 and r[0] is not None])}
    assert {i: (n, c) for i, n, c in got if i != 7 and i is not None} == want
    assert [(n, c) for i, n, c in got if i is None] == [(0, None), (3, None)]
    assert jaccard.join(docs(spark, rows).limit(0)).count() == 0


def test_rows_that_share_an_id_are_one_document(spark):
    rows = [(1, "a b c d e f g"), (5, "a b c d e f g"), (5, "q r s t u v w"), (3, "q r s t u v w"), (9, "alone at last")]
    assert {(i, c) for i, _, c in rows_of(jaccard.join(docs(spark, rows)))} == {(1, 1), (5, 1), (3, 1), (9, 9)}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)] + [(7, 7)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in roots(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {x: find(x) for x in root}
    assert got == {x: c for x, c in want.items() if sum(v == c for v in want.values()) > 1}


def test_ids_with_several_texts(spark):
    rng = random.Random(6)

    def text(n):
        return [f"w{rng.randrange(5000)}" for _ in range(n)]

    a, b, c, d = (text(60) for _ in range(4))
    near = lambda t: " ".join([*t[:30], "changed", *t[31:]])
    whole = " ".join
    # the second id copies the first one's text and brings another, near which the third one lies
    rows = [(1, whole(a)), (2, whole(a)), (2, whole(b)), (3, near(b))]
    assert rows_of(jaccard.join(docs(spark, rows))) == sorted(components(rows), key=str)
    assert {x[2] for x in rows_of(jaccard.join(docs(spark, rows)))} == {1}
    # three texts of one id, one blank, repeated rows, rows without id
    rows = [(9, whole(a)), (9, whole(b)), (9, whole(c)), (9, whole(c)), (9, None), (20, near(c)), (8, near(a)), (30, whole(d)), (30, " "),
            (31, near(d)), (40, "one two"), (41, "one two"), (41, "three"), (50, "three"), (None, whole(a)), (None, whole(b)), (60, whole(text(50)))]
    assert rows_of(jaccard.join(docs(spark, rows))) == sorted(components(rows), key=str)


def test_regions_are_bounded_by_members_and_divided_again(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(4000)]
    texts = []
    # one long chain of documents, each near the next only, and others that share a passage with all
    words = rng.choices(vocabulary, k=120)
    for _ in range(400):
        words = words[4:] + rng.choices(vocabulary, k=4)
        texts.append(" ".join(words))
    passage = rng.choices(vocabulary, k=90)
    texts += [" ".join(passage + rng.choices(vocabulary, k=rng.randint(5, 60))) for _ in range(250)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    depths = []
    divide = jaccard.divide

    def watched(slim, blobs, exact, similar, limit, depth=jaccard.DEPTH):
        depths.append((exact, depth))
        return divide(slim, blobs, exact, similar, limit, depth)

    monkeypatch.setattr(jaccard, "divide", watched)
    monkeypatch.setattr(jaccard, "MEMBERS", 24)
    assert rows_of(jaccard.join(docs(spark, rows))) == sorted(components(rows), key=str)
    assert (True, jaccard.DEPTH) in depths and any(d < jaccard.DEPTH for _, d in depths)
