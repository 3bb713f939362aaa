"""The stages one by one, each against its own input, and the whole."""

from helpers import docs, save, vocabulary
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as P
from helpers import components
from tactica.llm import packing
from tactica.llm.common import documents, written

SF = "/root/testdata/sf0.01"


def test_stages_and_run(spark):
    given = documents(spark, SF)
    langs = {r.doc_id: r.rejected for r in E.queries()["op2_language_id"](spark, SF).collect()}
    first = written(P.keep_known_languages(spark, given, SF), "t")
    assert first.columns == given.columns
    assert sorted(r.doc_id for r in first.select("doc_id").collect()) == sorted(i for i, no in langs.items() if not no)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    second = written(P.keep_good_quality(spark, first, SF), "t")
    assert second.columns == given.columns
    kept = {r.doc_id for r in second.select("doc_id").collect()}
    seen = [i for i in labels if i in langs and not langs[i]]
    assert sum((i in kept) == (labels[i] == 1) for i in seen) >= 0.98 * len(seen)
    rows = [(r.doc_id, r.text) for r in second.select("doc_id", "text").collect()]
    third = written(P.keep_one_of_each_group(spark, second, SF), "t")
    assert third.columns == given.columns
    want = sorted(i for i, _, c in components(rows) if i == c)
    assert sorted(r.doc_id for r in third.select("doc_id").collect()) == want
    texts = dict(rows)
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    last = packing.pack(third, vocabulary("byte_bpe_50k.json")).collect()
    total = sum(len(library.encode(texts[i], add_special_tokens=False).ids) + 1 for i in want)
    assert sum(r.length for r in last) == total
    assert E.queries()["pipeline"](spark, SF).agg({"length": "sum"}).first()[0] == total


def test_names_and_order():
    assert [f for _, f in P.STAGES] == [P.keep_known_languages, P.keep_good_quality, P.keep_one_of_each_group, P.pack_sequences]


def test_repeated_and_odd_rows(spark, tmp_path):
    text = "the same words again and again in one line"
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None), (4, ""), (3, None), (5, "quite another text with many other words")]
    out = P.keep_one_of_each_group(spark, docs(spark, rows, extra="component_id"), "")
    assert sorted((r.doc_id or 0 for r in out.collect())) == [0, 1, 3, 4, 5]
    empty = docs(spark, rows).limit(0)
    folder = save(spark, tmp_path, documents=empty, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert P.run(spark, folder).count() == 0
