"""A corpus pipeline: language identification, quality, near duplicates, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame. Its result is written as Parquet and read again as the
next stage's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactica.llm import jaccard, langid, packing, quality
from tactica.llm.common import documents, written
from tactica.llm.queries import vocabulary

#: Prefix of columns that a stage adds and drops again.
OWN = "__stage_"


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language identification rejects.

    Null, empty and blank texts and texts without letters are rejected; a null
    lang teaches nothing and is no reason to go. Without any row that can teach
    there is no language, and all go. An empty table stays empty.
    """
    model = langid.learn(langid.training_rows(docs.select("doc_id", "text", "lang")))
    return langid.classify(docs, model, prefix=OWN).where(~F.col(OWN + "rejected")).select(docs.columns)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier predicts 0 for.

    A null text is scored as an empty one. Without a label for any document
    there is no model: every score is 0.5 and all stay. Labels without id or
    with values other than 0 and 1 teach nothing. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs, quality.training_rows(labels))
    return quality.classify(docs, model, prefix=OWN).where(F.col(OWN + "predicted") == 1).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by near-duplicate links the one with the smallest doc_id stays.

    Of rows that share a doc_id one stays, the first by its columns (those of a
    type that has an order); rows without doc_id and empty documents stay. An
    empty table stays empty.
    """
    found = written(jaccard.join(docs).select("doc_id", "component_id"), "groups")
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(jaccard.few(dropped), "doc_id", "left_anti").select(docs.columns)
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    again = jaccard.few(again)
    ordered = [f.name for f in docs.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    # a row of a repeated id: the first by its columns
    single = (kept.join(again, "doc_id", "left_semi").groupBy("doc_id")
              .agg(F.min_by(F.struct(*docs.columns), F.struct(*ordered)).alias(OWN + "row")).select(OWN + "row.*"))
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(single.select(docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens. A null text is an empty one, of the end id alone; a text of
    any length goes on in further sequences. An empty table gives no piece."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), length=1024, end_id=0)


STAGES = [
    ("language_id", keep_known_languages),
    ("quality_classifier", keep_good_quality),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("packing", pack_sequences),
]

#: The stages learn and tokenize, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
