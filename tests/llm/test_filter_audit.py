"""Operator 13 against a plain count over all documents and orders."""

import itertools
import random
import re
from collections import Counter

from helpers import ODD, save
from pyspark.sql import functions as F

import __spark_entry__ as E
from tactica.llm import filter_audit


def brute(rows, labels):
    """``rows``: (doc_id, text, lang); ``labels``: (doc_id, quality, toxic) -> sorted result rows."""
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    cells = Counter()
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(f for f, bad in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search(r"[#$%&*|]", t)), i is not None and smallest[t] < i)) if bad)
        mine = [x for x in labels if x[0] == i and i is not None]
        cells[lang or "", fails, any(q == 1 for _, q, _ in mine), any(x == 1 for _, _, x in mine)] += 1
    out = []
    for part in {c[0] for c in cells}:
        mine = {c[1:]: n for c, n in cells.items() if c[0] == part}
        table, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                num = lambda ok: sum(n for (b, q, x), n in mine.items() if ok(b, q, x))
                removed = lambda b: f in b and not before & set(b)
                line = (num(lambda b, q, x: f not in b and not before & set(b)), num(lambda b, q, x: removed(b)),
                        num(lambda b, q, x: f in b and bool(before & set(b))), num(lambda b, q, x: b == f),
                        num(lambda b, q, x: removed(b) and q), num(lambda b, q, x: removed(b) and x))
                table.append((part, "".join(order), k + 1, *line))
                shapley[f] += line[1]
        out += [(*t, shapley[t[1][t[2] - 1]]) for t in table]
    return sorted(out)


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, lang, "x") for i, t, lang in rows], "doc_id long, text string, lang string, flags string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def sample():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)] + ["Apple", "ÉTÉ", "日本", "x y", "a\u0085b", "UP"]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 1, 99, 100, 101, 130, 400]))) + r.choice(["", " ", "\n\t", "|", " $"]),
             r.choice(["en", "de", "", None])) for i in range(150)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(0, 60, 2)] + [rows[3]] * 4
    rows += [(400 + i, t, "en") for i, t in enumerate(ODD)] + [(None, rows[5][1], "de"), (None, None, None), (500, "X" * 11 + "y" * 99, "fr")]
    rows += [(501, "A" + "b" * 9, "fr"), (502, "AA" + "b" * 9, "fr"), (503, " ".join(["q"] * 20 + [f"v{i}" for i in range(79)]), "fr")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def test_audit_equals_plain_count(spark):
    rows, labels = sample()
    docs, marks = frames(spark, rows, labels)
    want = brute(rows, labels)
    assert len({w[0] for w in want}) == 4
    for size in (filter_audit.SHARD_BYTES, 500):
        got = sorted(tuple(r) for r in filter_audit.audit(docs, marks, size).select(
            "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())
        assert got == want


def test_matrix_is_globally_numbered(spark):
    rows, labels = sample()
    docs, _ = frames(spark, [r for r in rows if r[0] is not None], labels)
    shards = filter_audit.document_terms(docs, 700).persist()
    dictionary = filter_audit.global_dictionary(shards)
    number = {bytes(r.word).decode(): r.number for r in dictionary.collect()}
    assert len(set(number.values())) == len(number) == dictionary.count()
    assert set(number) == {w for _, t, _ in rows for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")}
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, t)
    word = {n: w for w, n in number.items()}
    for r in filter_audit.rows_of_matrix(shards).collect():
        assert r["columns"] == sorted(set(r["columns"]))
        got = Counter({word[c]: n for c, n in zip(r["columns"], r["counts"])})
        assert got == Counter(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        assert (r.n_words, r.n_distinct) == (sum(got.values()), len(got))
    shards.unpersist()


def test_very_long_and_empty(spark, tmp_path):
    long_text = " ".join(f"t{i % 5000}" for i in range(400_000))
    rows, labels = [(1, long_text, "en"), (2, long_text, "en"), (3, "", "en")], [(2, 1, 1)]
    docs, marks = frames(spark, rows, labels)
    got = filter_audit.audit(docs, marks)
    assert sorted(tuple(r) for r in got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                                               "toxic_lost", "shapley").collect()) == brute(rows, labels)
    folder = save(spark, tmp_path, documents=docs.where(F.lit(False)), labels=marks.where(F.lit(False)))
    out = E.queries()["op13_filter_audit"](spark, folder)
    assert out.count() == 0 and len(out.columns) == 10
