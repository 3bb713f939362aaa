"""Lookups between tables (J01-J04) and keyword classification.

All are equi-/semi-/anti-joins; the planner and AQE choose broadcasts from
sizes they know.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def new_facts(later: DataFrame, earlier: DataFrame, name: str = "name") -> DataFrame:
    """Facts of the later snapshot whose name is absent from the earlier."""
    return later.join(earlier.select(name).distinct(), name, "left_anti")


UNNAMED = "<unnamed>"


def local_facts(local: DataFrame, global_: DataFrame, name: str = "name") -> DataFrame:
    """Local facts not among the global ones; facts without a name go to
    the ``<unnamed>`` bucket. ``all_facts`` = this, then the global ones."""
    keyed = local.withColumn(name, F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(UNNAMED))
                             .otherwise(F.col(name)))
    return keyed.join(global_.select(name).distinct(), name, "left_anti")


def all_facts(local: DataFrame, global_: DataFrame, name: str = "name") -> DataFrame:
    """Local-minus-global (source 'local') followed by the global facts."""
    lo = local_facts(local, global_, name).withColumn("source", F.lit("local"))
    return lo.unionByName(global_.withColumn("source", F.lit("global")), allowMissingColumns=True)


def keyword_kind_lookup(df: DataFrame, keywords: DataFrame, command: str = "command") -> DataFrame:
    """Attach the keyword ``kind`` of each command (left join on command)."""
    return df.join(keywords.select(command, "kind"), command, "left")


def commands_by_kind(keywords: DataFrame, pos: str) -> DataFrame:
    """(kind, n, command), the commands of each kind, the newest (by
    ``pos``) first; numbered skew-safely, as a kind may hold most commands."""
    from tactica.operators.ordering import number_rows
    newest = keywords.groupBy("kind", "command").agg((-F.max(pos)).alias("_age"))
    return number_rows(newest, ["kind"], ["_age", "command"], "n").select("kind", "n", "command")


def keyword_class_flags(command: Column, kind: Column) -> dict[str, Column]:
    """classes of a command from its keyword kind."""
    starts_proof = kind.contains("goal") & (command != "lemmas")
    ends_proof = kind.contains("qed")
    apply_step = (command != "qed") & (kind.contains("prf_script") | kind.contains("qed")
                                       | command.isin("unfolding", "using", "including"))
    isar_step = (kind.contains("prf") | (kind == "next_block")) & ~apply_step
    return {"starts_proof": starts_proof, "ends_proof": ends_proof, "apply_step": apply_step,
            "isar_step": isar_step, "document_step": kind.startswith("document")}


def meaningful_actions(df: DataFrame, key: Sequence[str], pos: str, kind: str, text: str) -> DataFrame:
    """drop ignored and document-markup commands, mark malformed ones
    (empty text) and ML ones, and prepend one empty action per group (pos -1)."""
    k = F.col(kind)
    kept = df.where((k != "<ignored>") & ~k.startswith("document"))
    kept = kept.withColumns({"malformed": F.trim(F.col(text)) == "", "is_ml": k.startswith("ML")})
    heads = df.select(*key).distinct().select(
        *key, F.lit(-1).cast(df.schema[pos].dataType).alias(pos), F.lit("").alias(kind), F.lit("").alias(text),
        F.lit(False).alias("malformed"), F.lit(False).alias("is_ml"))
    return heads.unionByName(kept.select(*key, pos, kind, text, "malformed", "is_ml"))
