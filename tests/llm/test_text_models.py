"""Operators 2 and 9 on held-out rows, and their parts by hand."""

import itertools
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import ODD, docs, save

import __spark_entry__ as E
from tactica.llm import langid, quality

SF = "/root/testdata/sf0.01"


def column(table, *names):
    return zip(*(pq.read_table(f"{SF}/{table}.parquet")[n].to_pylist() for n in names))


def test_op2_held_out(spark):
    rows = {r.doc_id: r for r in E.queries()["op2_language_id"](spark, SF).collect()}
    truth = dict(column("documents", "doc_id", "lang"))
    assert set(rows) == set(truth)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in set(truth.values())
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.99 * len(held)
    assert not any(r.rejected for r in rows.values())


def test_language_edge_cases(spark, tmp_path):
    known = [(100 + i, t, l) for i, (t, l) in enumerate([("the house and the garden of the man", "en"), ("la maison et le jardin de la femme", "fr")] * 30)]
    model = langid.learn(spark.createDataFrame(known + [(None, "x", "en"), (9, None, "fr"), (10, "1234", "en"), (11, "text", None)],
                                               "doc_id long, text string, lang string"))
    assert set(model.languages) == {"en", "fr"}
    cases = ODD + ["the garden and the house", "le jardin et la maison", "Привет мир как дела"]
    out = {r.text: r for r in langid.classify(docs(spark, enumerate(cases), extra="score"), model).collect()}
    assert out["the garden and the house"].lang_pred == "en" and out["le jardin et la maison"].lang_pred == "fr"
    assert not out["the garden and the house"].rejected and out["Привет мир как дела"].rejected
    for text in (None, "", " ", "1234", "🙂🙂"):
        assert (out[text].lang_pred, out[text].score, out[text].rejected) == ("und", 0.0, True)
    none = langid.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.classify(docs(spark, enumerate(ODD)), none).collect()} == {"und"}
    folder = save(spark, tmp_path, documents=docs(spark, enumerate(ODD)).limit(0))
    assert E.queries()["op2_language_id"](spark, folder).count() == 0


def test_foreign_and_random_texts_are_rejected(spark):
    rng = np.random.default_rng(7)
    drawn = lambda letters, n: "".join(rng.choice(list(letters), n))
    planted = {
        "polish": "W ogrodzie przy domu było wiele kwiatów, a pani szła powoli w stronę bramy, podczas gdy dzieci bawiły się z psem. ",
        "finnish": "Talon puutarha oli täynnä kukkia ja rouva käveli hitaasti kohti porttia, kun lapset leikkivät koiran kanssa. ",
        "code": "static int foo(struct bar *p, size_t n) { for (int i = 0; i < n; i++) { if (p[i].len > MAX) return -EINVAL; } } ",
        "letters": drawn("abcdefghijklmnopqrstuvwxyz", 2000), "hex": drawn("0123456789abcdef", 2000),
        "base64": drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 2000)}
    given = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(langid.training_rows(given.select("doc_id", "text", "lang")))
    for name, text in planted.items():
        for n in (60, 200, 600, 2000):
            assert model.predict([(text * 20)[:n]])[2][0], (name, n)
    near = "Il giardino della casa era pieno di fiori e la signora camminava lentamente verso il cancello mentre i bambini giocavano. "
    assert model.predict([near * 15])[2][0]
    clean = [t for i, t in column("documents", "doc_id", "text") if zlib.crc32(str(i).encode()) % 4 == 2]
    assert not model.predict(clean)[2].any()


def test_one_odd_row_does_not_set_the_floor():
    rng = np.random.default_rng(3)
    lengths = np.repeat(langid.LENGTHS, 300)
    cosines = rng.uniform(0.8, 0.9, len(lengths))
    floors = langid.floors_of(["a", "b"], ["a"] * len(cosines), lengths, cosines)
    assert (floors > 0.25).all()
    cosines[::300] = 0.01
    assert np.allclose(langid.floors_of(["a", "b"], ["a"] * len(cosines), lengths, cosines), floors, atol=0.02)


def test_no_centroid_stands_for_a_single_row(spark):
    rng = np.random.default_rng(11)
    # two kinds of rows and three odd ones
    kinds = np.eye(langid.DIMS, dtype=np.float32)[:5]
    x = np.repeat(kinds[:2], 300, 0) + 0.02 * rng.random((600, langid.DIMS), dtype=np.float32)
    x = langid.unit(np.vstack([x, kinds[2:]]))
    c = langid.cluster(x, langid.CENTROIDS)
    own = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    assert len(c) >= 2 and own.min() >= langid.LEAST
    assert all((x[:600] @ c.T).argmax(1)[i] != (x[:600] @ c.T).argmax(1)[i + 300] for i in range(300))
    assert len(langid.cluster(x[:3], langid.CENTROIDS)) == 1


def test_every_language_is_learned(spark, monkeypatch):
    # each language has words of its own letters
    chars = [chr(0x4E00 + i) for i in range(1300)]
    df = spark.createDataFrame([(i, " ".join([c * 3] * 5), f"l{i}") for i, c in enumerate(chars)], "doc_id long, text string, lang string")
    model = langid.learn(df)
    assert set(model.languages) == {f"l{i}" for i in range(1300)}
    lang = model.predict([f"{c * 3} {c * 3}" for c in chars[::50]])[0]
    assert sum(l == f"l{50 * i}" for i, l in enumerate(lang)) >= 0.9 * len(lang)
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 1000)
    with pytest.raises(ValueError, match="1300 languages"):
        langid.learn(df)


def test_ngram_counts_of_long_and_joined_texts():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abé .日🙂"), 700)), "", None, "A", "x" * 100, "".join(rng.choice(list("ab c"), 1 << 20))]
    together, letters = langid.counts(texts)
    for i, t in enumerate(texts):
        alone, n = langid.counts([t])
        assert (alone[0] == together[i]).all() and n[0] == letters[i]
    assert letters.tolist()[1:5] == [0, 0, 1, 100]


def test_op9_held_out(spark):
    rows = {r.doc_id: r for r in E.queries()["op9_quality"](spark, SF).collect()}
    assert set(rows) == {i for i, in column("documents", "doc_id")}
    right = []
    for i, label in column("labels", "doc_id", "quality"):
        r = rows[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out:
            right.append(r.predicted == label)
    assert sum(right) >= 0.97 * len(right)


def test_quality_edge_cases(spark, tmp_path):
    df = docs(spark, [*enumerate(ODD), (1, "again"), (None, "no id")], extra="predicted __label")
    assert {r.score for r in quality.classify(df, None).collect()} == {0.5}
    labels = spark.createDataFrame([(4, 1, "x"), (4, 0, "x"), (5, 0, None), (None, 1, "x"), (6, None, "x"), (77, 1, "x"), (13, 1, "x")],
                                   "doc_id long, quality int, text string")
    out = quality.classify(df, quality.learn(df, labels)).collect()
    assert len(out) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not r.text}) == 1
    assert all(np.isfinite(quality.statistics(t)).all() and len(quality.statistics(t)) == quality.N_STATISTICS for t in ODD)
    empty = labels.limit(0)
    assert quality.learn(df, empty) is None and quality.learn(df.limit(0), labels) is None
    folder = save(spark, tmp_path, documents=df.limit(0), labels=empty)
    assert E.queries()["op9_quality"](spark, folder).count() == 0


def test_isotonic_is_the_nearest_rising_curve():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 6))
        w = rng.integers(1, 4, n).astype(float)
        y = rng.integers(0, 5, n) / 4
        at, curve = quality.isotonic(np.arange(n, dtype=float), y * w, w)
        fitted = np.empty(n)
        # the blocks, by their mean places
        ends, start = [], 0
        for a in at:
            for stop in range(start + 1, n + 1):
                if abs((np.arange(start, stop) * w[start:stop]).sum() / w[start:stop].sum() - a) < 1e-9:
                    ends.append((start, stop))
                    start = stop
                    break
        for (s, e), c in zip(ends, curve):
            fitted[s:e] = c
        loss = (w * (fitted - y) ** 2).sum()
        grid = np.arange(0, 1.01, 0.125)
        best = min((w * (np.array(c) - y) ** 2).sum() for c in itertools.combinations_with_replacement(grid, n))
        assert (np.diff(fitted) >= 0).all() and loss <= best + 1e-9
