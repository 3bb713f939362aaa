"""Registered queries: U01, T04, T05, X02, W02, P05, P09, P14, P15."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactica.functions import text as X
from tactica.operators import sequences as S
from tactica.operators import splits, steps
from tactica.plans.registry import query
from tactica.plans.sqltext import NOT_WS, jstr, user_state
from tactica.sources import adapters as ad


@query("u01_ordered_distinct", """
SELECT session, kind, min(pos) AS first_pos FROM sessions GROUP BY session, kind""", ("sessions",))
def u01_ordered_distinct(spark, sf_dir):
    return S.ordered_distinct(ad.sessions(spark, sf_dir), ["session"], "pos", "kind")


@query("t04_top_distinct_facts", """
, f AS (SELECT goal, name, min(rank) AS rank FROM facts GROUP BY goal, name)
SELECT goal, name, rank, row_number() OVER (PARTITION BY goal ORDER BY rank) - 1 AS position FROM f
QUALIFY position < 5""", ("facts",))
def t04_top_distinct_facts(spark, sf_dir):
    return S.top_distinct(ad.facts(spark, sf_dir), ["goal"], "name", "rank", 5).select(
        "goal", "name", "rank", "position")


@query("t05_random_element")
def t05_random_element(spark, sf_dir):
    """One reproducible uniformly chosen document per logic (no SQL twin:
    the seeded hash is Spark's xxhash64)."""
    p = ad.proofs(spark, sf_dir).select("logic", "proof_id")
    return splits.random_element(p, ["logic"], ["proof_id"], seed=42)


@query("t05_random_element_checks", """
SELECT logic, 1 AS picks, 1 AS of_its_logic, 1 AS same_again FROM proofs GROUP BY logic""", ("proofs",))
def t05_random_element_checks(spark, sf_dir):
    """What any choice has to keep: one pick per logic, of that logic, the same for the same seed."""
    p = ad.proofs(spark, sf_dir).select("logic", "proof_id")
    one = splits.random_element(p, ["logic"], ["proof_id"], seed=42)
    two = splits.random_element(p, ["logic"], ["proof_id"], seed=42).select("logic", F.col("proof_id").alias("again"))
    real = p.select("logic", F.col("proof_id").alias("mine"))
    x = one.join(two, "logic", "left").join(real, (one["logic"] == real["logic"]) & (one["proof_id"] == real["mine"]), "left").drop(real["logic"])
    return x.groupBy("logic").agg(F.count(F.lit(1)).alias("picks"), F.count("mine").alias("of_its_logic"),
                                  F.count(F.when(F.col("again") == F.col("proof_id"), 1)).alias("same_again"))


@query("x02_method_usage", f"""
, w AS (SELECT logic, replace(replace(action, '(', ''), ')', '') AS a FROM steps)
, l AS (SELECT logic, 'apply (' || a || ' (x))' AS apply_line FROM w
        UNION ALL SELECT logic, 'apply ' || unnest(regexp_extract_all(a, '{NOT_WS}+')) FROM w)
SELECT logic, apply_line, count(*) AS uses FROM l GROUP BY ALL""", ("steps",))
def x02_method_usage(spark, sf_dir):
    """Method-usage job: every step's whole text, as a group with a group inside
    and then as plain words, is a ``by`` statement; its apply lines (X02) are
    counted per logic."""
    st = ad.steps(ad.proofs(spark, sf_dir))
    a = F.translate("action", "()", "")
    by = F.concat(F.lit("by ("), a, F.lit(" (x)) "), a)
    lines = st.select("logic", F.explode(F.split(X.method_chain(by), "\n")).alias("apply_line"))
    return lines.groupBy("logic", "apply_line").agg(F.count(F.lit(1)).alias("uses"))


@query("w02_directory_order", """
SELECT DISTINCT logic, theory, logic || '/' || theory AS dir_rank FROM proofs""", ("proofs",))
def w02_directory_order(spark, sf_dir):
    p = ad.proofs(spark, sf_dir).select("logic", "theory").distinct()
    return splits.seeded_dir_order(p, ["logic", "theory"], None)


@query("p05_step_constants", """
SELECT proof_id, step, 'Type0' AS type_group, split_part(action, ' ', 1) AS names FROM steps WHERE step >= 1
UNION ALL SELECT proof_id, step, 'Type1', string_split(action, ' ')[-1] FROM steps WHERE step >= 1""", ("steps",))
def p05_step_constants(spark, sf_dir):
    st = ad.steps(ad.proofs(spark, sf_dir))
    words = F.split("action", " ")
    both = F.create_map(F.lit("Type0"), F.element_at(words, 1), F.lit("Type1"), F.element_at(words, -1))
    return steps.step_constants(st.withColumn("constants", both))


_WORD1, _WORDN = "split_part({0}, ' ', 1)", "string_split({0}, ' ')[-1]"
_DEPS = ("'[' || array_to_string(list_transform(actions, lambda a: '{{\"name\": ' || " + jstr(_WORD1.format("a")) + " || ', \"term\": ' || "
         + jstr(_WORDN.format("a")) + " || '}}'), ', ') || ']'").replace("{{", "{").replace("}}", "}")
_METHODS = "'[' || array_to_string(list_transform(actions, lambda a: " + jstr(_WORD1.format("a")) + "), ', ') || ']'"


@query("p09_context_of_records", f"""
, c AS (SELECT proof_id, actions, {_DEPS} AS deps, {_METHODS} AS methods FROM proofs)
SELECT proof_id, step, '{{"proof_so_far": ' || {jstr("array_to_string(actions[1:step], chr(10))")} || ', "last_usr_state": '
       || {jstr(user_state('len(actions)', 'step'))} || ', "deps": ' || deps || ', "methods": ' || methods
       || ', "variables": {{"Type0": ' || {jstr(_WORD1.format("actions[step + 1]"))} || '}}, "constants": {{"Type0": '
       || {jstr(_WORDN.format("actions[step + 1]"))} || '}}, "type variables": []}}' AS input
FROM (SELECT *, unnest(range(1, len(actions))) AS step FROM c)""", ("proofs",))
def p09_context_of_records(spark, sf_dir):
    """All context fields filled: deps, methods and maps of names are made of the steps' own words."""
    return steps.input_target_pairs(ad.rich_records(spark, sf_dir), "state_prems_kwrds_terms").select("proof_id", "step", "input")


@query("p14_task_context", f"""
SELECT proof_id, '{{"deps": ' || {_DEPS} || ', "methods": ' || {_METHODS} || '}}' AS context FROM proofs""", ("proofs",))
def p14_task_context(spark, sf_dir):
    return steps.task_table(ad.rich_records(spark, sf_dir), "state_prems_kwrds").select("proof_id", "context")


@query("p15_prompt_requests", f"""
, req AS (SELECT proof_id, step, array_to_string(actions[1:step], chr(10)) AS proof_so_far,
                 {user_state('len(actions)', 'step')} AS user_state
          FROM (SELECT proof_id, actions, unnest(range(1, len(actions))) AS step FROM proofs))
SELECT proof_id, step,
       {("'" + steps.CHAT_PROMPT.split("{context}")[0].replace(chr(10), "' || chr(10) || '") + "'")}
       || '{{"proof_so_far": ' || {jstr('proof_so_far')} || ', "last_usr_state": ' || {jstr('user_state')} || '}}'
       || chr(10) AS prompt
FROM req""", ("proofs",))
def p15_prompt_requests(spark, sf_dir):
    p = ad.proofs(spark, sf_dir)
    idx = F.when(F.size("actions") > 1, F.sequence(F.lit(1), F.size("actions") - 1))
    req = p.select("proof_id", "actions", F.explode(idx).alias("step")).select(
        "proof_id", "step", steps.proof_prefix(F.col("actions"), F.col("step")).alias("proof_so_far"),
        ad.user_state_col(F.size("actions"), F.col("step")).alias("user_state"))
    return steps.prompt_requests(req).select("proof_id", "step", "prompt")
