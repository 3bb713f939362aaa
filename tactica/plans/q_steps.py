"""Registered queries: step projections, samples and text functions
(P01-P04, P06-P08, P10-P14, P18, P19, X01-X03, X05, X06, F01, F02, F06, T01, T02)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactica.functions import text as X
from tactica.operators import splits, stats, steps
from tactica.plans.registry import query
from tactica.plans.sqltext import balance, jstr, pairs_cte, strip, user_state, words
from tactica.sources import adapters as ad


def _records(spark, sf_dir):
    return ad.proof_records(ad.proofs(spark, sf_dir))


def _pairs(spark, sf_dir, fmt="state", records=None):
    recs = records if records is not None else _records(spark, sf_dir)
    return steps.input_target_pairs(recs, fmt, keep=("proof_id", "logic", "theory"))


# ----------------------------------------------------------------- P01 - P08

@query("p01_explode_steps", "SELECT proof_id, step, action, user_state FROM steps",
       ("steps",))
def p01_explode_steps(spark, sf_dir):
    return steps.explode_steps(_records(spark, sf_dir)).select(
        "proof_id", "step", "action", "user_state")


@query("p02_objective", "SELECT proof_id, actions[1] AS objective FROM proofs", ("proofs",))
def p02_objective(spark, sf_dir):
    return _records(spark, sf_dir).select("proof_id", steps.objective(F.col("proof")).alias("objective"))


@query("p03_tactic_actions", """
SELECT proof_id, len(actions) - 1 AS n_tactics, array_to_string(actions[2:], chr(10)) AS tactics
FROM proofs""", ("proofs",))
def p03_tactic_actions(spark, sf_dir):
    t = steps.tactic_actions(F.col("proof"))
    return _records(spark, sf_dir).select(
        "proof_id", F.size(t).alias("n_tactics"), F.array_join(t, "\n").alias("tactics"))


@query("p04_user_states", f"""
SELECT proof_id, array_to_string(list_transform(actions[2:],
         lambda a, i: {user_state('len(actions)', 'i')}), chr(10)) AS user_states
FROM proofs""", ("proofs",))
def p04_user_states(spark, sf_dir):
    return _records(spark, sf_dir).select(
        "proof_id", F.array_join(steps.user_states(F.col("proof")), "\n").alias("user_states"))


@query("p06_proof_prefix", """
SELECT proof_id, step, array_to_string(actions[1:step], chr(10)) AS prefix
FROM (SELECT proof_id, actions, unnest(range(1, len(actions))) AS step FROM proofs)""",
       ("proofs",))
def p06_proof_prefix(spark, sf_dir):
    p = ad.proofs(spark, sf_dir)
    idx = F.when(F.size("actions") > 1, F.sequence(F.lit(1), F.size("actions") - 1))
    return p.select("proof_id", "actions", F.explode(idx).alias("step")) \
            .select("proof_id", "step", steps.proof_prefix(F.col("actions"), F.col("step")).alias("prefix"))


@query("p07_count_steps", "SELECT proof_id, len(actions) - 1 AS num_steps FROM proofs", ("proofs",))
def p07_count_steps(spark, sf_dir):
    return ad.proofs(spark, sf_dir).select("proof_id", stats.count_steps(F.col("actions")).alias("num_steps"))


@query("p08_render_proof_script", "SELECT proof_id, array_to_string(actions, chr(10)) AS script FROM proofs",
       ("proofs",))
def p08_render_proof_script(spark, sf_dir):
    return ad.proofs(spark, sf_dir).select(
        "proof_id", steps.render_proof_script(F.col("actions")).alias("script"))


# ----------------------------------------------------------------- P10 - P14

@query("p10_input_target_pairs", pairs_cte("state") + "SELECT proof_id, step, input, target FROM pairs",
       ("proofs",))
def p10_input_target_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, "state").select("proof_id", "step", "input", "target")


@query("p09_context_by_format_spkt", pairs_cte("state_prems_kwrds_terms")
       + "SELECT proof_id, step, input FROM pairs", ("proofs",))
def p09_context_by_format_spkt(spark, sf_dir):
    return _pairs(spark, sf_dir, "state_prems_kwrds_terms").select("proof_id", "step", "input")


_SPLIT = """
, sized AS (SELECT *, count(*) OVER (PARTITION BY logic, theory) AS n FROM proofs)
, split AS (
  SELECT *, CASE WHEN proof_num < floor(n * CAST(0.64 AS DOUBLE)) THEN 'train'
                 WHEN proof_num < floor(n * CAST(0.64 AS DOUBLE)) + floor(n * CAST(0.16 AS DOUBLE))
                   THEN 'valid' ELSE 'test' END AS split
  FROM sized)
, test_proofs AS (SELECT * FROM split WHERE split = 'test')
"""


def _split_records(spark, sf_dir, which):
    p = ad.proofs(spark, sf_dir)
    keys = splits.assign_split(p.select("proof_id", "logic", "theory"), ["logic", "theory"], ["proof_id"])
    chosen = keys.where(F.col("split") == which).select("proof_id")
    return ad.proof_records(p.join(chosen, "proof_id", "left_semi"))


@query("p11_seq2seq_samples_test", _SPLIT + pairs_cte("finetune_state", source="test_proofs") + """
SELECT proof_id, step, 'isabelle next step: ' || input AS input, target FROM pairs""", ("proofs",))
def p11_seq2seq_samples_test(spark, sf_dir):
    pairs = _pairs(spark, sf_dir, "finetune_state", _split_records(spark, sf_dir, "test"))
    return steps.seq2seq_samples(pairs, "finetune_state").select("proof_id", "step", "input", "target")


_PROMPT_BEFORE, _PROMPT_AFTER = steps.CHAT_PROMPT.split("{context}")


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("p12_chat_samples", pairs_cte("state") + f"""
, chat AS (SELECT proof_id, step, {_sql_lit(_PROMPT_BEFORE)} || input || {_sql_lit(_PROMPT_AFTER)} AS user_text,
                  '<SUGGESTION>' || target || '</SUGGESTION>' AS assistant_text FROM pairs)
SELECT proof_id, step, user_text, assistant_text,
       '<start_of_turn>user' || chr(10) || user_text || '<end_of_turn>' || chr(10)
       || '<start_of_turn>model' || chr(10) || assistant_text || '<end_of_turn>' || chr(10) AS text
FROM chat""", ("proofs",))
def p12_chat_samples(spark, sf_dir):
    return steps.chat_samples(_pairs(spark, sf_dir, "state")).select(
        "proof_id", "step", "user_text", "assistant_text", "text")


_STEP_JSON = ("'{\"action\": ' || " + jstr("a") + " || ', \"user_state\": ' || "
              + jstr(user_state("len(actions)", "i - 1")) + " || '}'")


@query("p13_tokenizer_corpus", f"""
SELECT proof_id, '{{"proof": [' || array_to_string(list_transform(actions, lambda a, i: {_STEP_JSON}), ', ')
       || ']}}' AS json FROM proofs""", ("proofs",))
def p13_tokenizer_corpus(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.select("proof_id", steps.to_py_json_struct(r, ["proof"]).alias("json"))


@query("p14_proof_task_table", f"""
SELECT proof_id, logic, theory, proof_num,
       logic || '/' || theory || '/proof' || CAST(proof_num AS VARCHAR) || '.json' AS path,
       {balance('actions[1]')} AS objective
FROM proofs""", ("proofs",))
def p14_proof_task_table(spark, sf_dir):
    p = ad.with_path(ad.with_proof_num(ad.proofs(spark, sf_dir)))
    return p.select("proof_id", "logic", "theory", "proof_num", "path",
                    X.balance_quotes(F.try_element_at("actions", F.lit(1))).alias("objective"))


# ----------------------------------------------------------------- P18, P19

@query("p18_number_facts", """
SELECT name, row_number() OVER (PARTITION BY name ORDER BY rank) AS index, theorem FROM facts""",
       ("facts",))
def p18_number_facts(spark, sf_dir):
    from tactica.operators.ordering import number_rows
    f = ad.facts(spark, sf_dir)
    return number_rows(f, ["name"], ["rank"], "index", base=1).select("name", "index", "theorem")


@query("p19_group_names_by_type", """
, firsts AS (SELECT goal, name, theorem, min(rank) AS p FROM facts GROUP BY ALL)
, per_type AS (SELECT goal, name, min(p) AS first,
                      string_agg(theorem, ', ' ORDER BY p DESC) AS names FROM firsts GROUP BY ALL)
SELECT goal, 'Type' || CAST(row_number() OVER (PARTITION BY goal ORDER BY first) - 1 AS VARCHAR)
         AS type_group, names || ' :: ' || name AS names
FROM per_type""", ("facts",))
def p19_group_names_by_type(spark, sf_dir):
    return steps.group_names_by_type(ad.facts(spark, sf_dir), ["goal"], "name", "theorem", "rank")


# ----------------------------------------------------------------- filters, order

@query("f01_skip_long_proofs", """
SELECT proof_id, logic, len(actions) - 1 AS num_steps FROM proofs WHERE len(actions) - 1 <= 5""",
       ("proofs",))
def f01_skip_long_proofs(spark, sf_dir):
    from tactica.operators.filters import skip_long_proofs
    p = ad.proofs(spark, sf_dir).withColumn("num_steps", stats.count_steps(F.col("actions")))
    return skip_long_proofs(p, F.col("num_steps") <= 5).select("proof_id", "logic", "num_steps")


@query("f02_context_length_filter", pairs_cte("state") + f"""
SELECT proof_id, step, {words('input')} AS n_x, {words('target')} AS n_y FROM pairs
WHERE {words('input')} + {words('target')} <= 1024""", ("proofs",))
def f02_context_length_filter(spark, sf_dir):
    from tactica.operators.filters import context_length_filter
    pairs = steps.input_word_counts(_records(spark, sf_dir), "state")
    return context_length_filter(pairs, "state", F.col("n_x") + F.col("n_y")).select(
        "proof_id", "step", "n_x", "n_y")


@query("f06_first_n_paths", """
SELECT proof_id, logic, theory, proof_num FROM proofs ORDER BY logic, theory, proof_num LIMIT 100""",
       ("proofs",))
def f06_first_n_paths(spark, sf_dir):
    p = ad.with_proof_num(ad.proofs(spark, sf_dir))
    return splits.first_n(p, 100, ["logic", "theory", "proof_num"]).select(
        "proof_id", "logic", "theory", "proof_num")


@query("t01_natural_file_order", """
, named AS (SELECT proof_id, logic, theory, 'proof' || CAST(proof_num AS VARCHAR) || '.json' AS name,
                   proof_num FROM proofs)
SELECT proof_id, name, row_number() OVER (PARTITION BY logic, theory ORDER BY proof_num, name) - 1
         AS file_rank
FROM named""", ("proofs",))
def t01_natural_file_order(spark, sf_dir):
    from tactica.operators.ordering import number_rows
    p = ad.with_proof_num(ad.proofs(spark, sf_dir)).withColumn(
        "name", F.concat(F.lit("proof"), F.col("proof_num").cast("string"), F.lit(".json")))
    p = p.withColumn("num", F.regexp_extract("name", r"proof(\d+)\.json", 1).cast("long"))
    keyed = splits.natural_order_key(p, ["logic", "theory"], "name", "num", "sort_num")
    return number_rows(keyed, ["logic", "theory"], ["sort_num", "name"], "file_rank").select(
        "proof_id", "name", "file_rank")


# ----------------------------------------------------------------- text functions

@query("x01_balance_quotes", f"""
SELECT proof_id, step, {balance('action')} AS fixed FROM steps""", ("steps",))
def x01_balance_quotes(spark, sf_dir):
    s = ad.steps(ad.proofs(spark, sf_dir))
    return s.select("proof_id", "step", X.balance_quotes(F.col("action")).alias("fixed"))


_RAW = """
, raw AS (
  SELECT proof_id, step,
         CASE proof_id % 5
           WHEN 0 THEN 'Answer: <SUGGESTION> ' || action || ' </SUGGESTION> tail'
           WHEN 1 THEN '<SUGGESTION>```isar' || chr(10) || action || '```'
           WHEN 2 THEN 'Here:' || chr(10) || '```isar' || chr(10) || action || '```'
           WHEN 3 THEN '  ' || action || '  '
           ELSE '' END AS out
  FROM steps)
"""


def _raw_outputs(spark, sf_dir):
    s = ad.steps(ad.proofs(spark, sf_dir))
    a = F.col("action")
    k = F.col("proof_id") % 5
    out = (F.when(k == 0, F.concat(F.lit("Answer: <SUGGESTION> "), a, F.lit(" </SUGGESTION> tail")))
             .when(k == 1, F.concat(F.lit("<SUGGESTION>```isar\n"), a, F.lit("```")))
             .when(k == 2, F.concat(F.lit("Here:\n```isar\n"), a, F.lit("```")))
             .when(k == 3, F.concat(F.lit("  "), a, F.lit("  ")))
             .otherwise(F.lit("")))
    return s.select("proof_id", "step", out.alias("out"))


_CLOSED = "(?s)<SUGGESTION>(.*?)</SUGGESTION>"
_OPEN = "(?s)<SUGGESTION>(.*)"
_FENCE = "(?s)```(?:isar)?\\n(.*?)```"


def _unfence_sql(s):
    return strip(f"replace(replace({s}, '```isar', ''), '```', '')")


@query("x03_extract_suggestion", _RAW + f"""
, tiered AS (SELECT proof_id, step, out,
   CASE WHEN out IS NULL OR out = '' THEN 'none'
        WHEN regexp_matches(out, '{_CLOSED}') THEN 'closed'
        WHEN regexp_matches(out, '{_OPEN}') THEN 'open'
        WHEN regexp_matches(out, '{_FENCE}') THEN 'fence'
        WHEN {strip('out')} <> '' THEN 'raw' ELSE 'none' END AS tier FROM raw)
SELECT proof_id, step, tier,
  CASE tier WHEN 'closed' THEN {_unfence_sql(f"regexp_extract(out, '{_CLOSED}', 1)")}
            WHEN 'open' THEN {_unfence_sql(f"regexp_extract(out, '{_OPEN}', 1)")}
            WHEN 'fence' THEN {strip(f"regexp_extract(out, '{_FENCE}', 1)")}
            WHEN 'raw' THEN {strip('out')} END AS suggestion
FROM tiered""", ("steps",))
def x03_extract_suggestion(spark, sf_dir):
    r = _raw_outputs(spark, sf_dir)
    tiered = r.withColumn("tier", X.suggestion_tier(F.col("out")))
    return tiered.select("proof_id", "step", "tier",
                         X.extract_suggestion(F.col("out"), F.col("tier")).alias("suggestion"))


@query("x05_join_candidates", f"""
, c AS (SELECT session, pos, list_transform(string_split(action, chr(10)),
          lambda l: CASE WHEN l = '' THEN NULL ELSE l END) AS cands FROM sessions)
, v AS (SELECT session, pos, list_transform(list_filter(cands, lambda x: x IS NOT NULL),
          lambda x: {balance('x')}) AS valid FROM c)
SELECT session, pos, CASE WHEN len(valid) = 0 THEN 'prompt_llm: No prediction generated.'
                          ELSE array_to_string(valid, '<SEPARATOR>') END AS joined,
       len(valid) AS n_candidates
FROM v""", ("sessions",))
def x05_join_candidates(spark, sf_dir):
    s = ad.sessions(spark, sf_dir)
    cands = F.transform(F.split("action", "\n"), lambda l: F.when(l != "", l))
    joined = X.join_candidates(cands)
    return s.select("session", "pos", joined.alias("joined"),
                    F.size(F.filter(cands, lambda c: c.isNotNull())).alias("n_candidates"))


@query("x06_overlapping_chunks", """
, base AS (SELECT batch, sample, labels AS toks, len(labels) AS n FROM predictions)
, starts AS (SELECT batch, sample, toks, n,
             unnest(range(0, CAST(ceil(greatest(0, n - 63) / 57.0) AS BIGINT) + 1)) AS chunk FROM base)
SELECT batch, sample, chunk, chunk * 57 AS start,
       least(63, n - chunk * 57) AS n_real,
       array_to_string(toks[chunk * 57 + 1: chunk * 57 + 63], ' ') AS chunk_text
FROM starts""", ("predictions",))
def x06_overlapping_chunks(spark, sf_dir):
    from tactica.operators.evaluation import overlapping_chunks
    pr = ad.predictions(spark, sf_dir)
    ch = overlapping_chunks(pr, "labels", max_length=64, pad="<pad>", special=["</s>"])
    return ch.select("batch", "sample", "chunk", "start", "n_real",
                     F.array_join(F.slice("input_ids", 1, F.col("n_real")), " ").alias("chunk_text"))


# ----------------------------------------------------------------- T02 / A01 / A02

def _serialized(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.select("proof_id", steps.to_py_json_struct(r, ["proof"]).alias("json"))


_TOKENS = f"""
, ser AS (SELECT proof_id, '{{"proof": [' || array_to_string(list_transform(actions, lambda a, i: {_STEP_JSON}), ', ')
          || ']}}' AS json FROM proofs)
, toks AS (SELECT unnest(regexp_extract_all(json, '[^{X.WS_CLASS[1:-1]}]+')) AS token FROM ser)
, counts AS (SELECT token, count(*) AS count FROM toks GROUP BY token)
"""


@query("a01_token_counts", _TOKENS + "SELECT token, count FROM counts", ("proofs",))
def a01_token_counts(spark, sf_dir):
    return stats.token_counts(_serialized(spark, sf_dir), "json")


@query("t02_top_tokens", _TOKENS + "SELECT token, count FROM counts ORDER BY count DESC, token LIMIT 50",
       ("proofs",))
def t02_top_tokens(spark, sf_dir):
    return stats.top_tokens(stats.token_counts(_serialized(spark, sf_dir), "json"), 50)


@query("a02_vocab_size_at_coverage", _TOKENS + """
, h AS (SELECT count AS freq, count(*) AS n_tok FROM counts GROUP BY count)
, c AS (SELECT freq, n_tok,
          coalesce(sum(freq * n_tok) OVER (ORDER BY freq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum_before,
          coalesce(sum(n_tok) OVER (ORDER BY freq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tok_before,
          sum(freq * n_tok) OVER () AS total FROM h)
, hit AS (SELECT tok_before + (19 * total - 20 * cum_before + 20 * freq - 1) // (20 * freq) AS k
          FROM c WHERE 20 * (cum_before + freq * n_tok) >= 19 * total ORDER BY freq DESC LIMIT 1)
SELECT CAST(coalesce((SELECT k FROM hit), 0) AS BIGINT) AS vocab_size""", ("proofs",))
def a02_vocab_size_at_coverage(spark, sf_dir):
    return stats.vocab_size_at_coverage(stats.token_counts(_serialized(spark, sf_dir), "json"), 0.95)


# ----------------------------------------------------------------- A03 / A04

_LENS = pairs_cte("state") + f"""
, lens AS (SELECT {words('input')} AS x, {words('target')} AS y FROM pairs)
"""


def _mode_sql(c):
    return f"(SELECT {c} FROM lens GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("a03_length_stats", _LENS + f"""
SELECT round(coalesce(avg(x), 0), 6) AS x_avg, round(coalesce(avg(y), 0), 6) AS y_avg,
       coalesce(max(x), 0) AS x_max, coalesce(max(y), 0) AS y_max,
       coalesce(min(x), 0) AS x_min, coalesce(min(y), 0) AS y_min,
       round(coalesce(median(x), 0), 6) AS x_median, round(coalesce(median(y), 0), 6) AS y_median,
       coalesce({_mode_sql('x')}, 0) AS x_mode, coalesce({_mode_sql('y')}, 0) AS y_mode,
       count(*) AS total_datapoints FROM lens""", ("proofs",))
def a03_length_stats(spark, sf_dir):
    lens = steps.input_word_counts(_records(spark, sf_dir), "state").select(
        F.col("n_x").alias("x"), F.col("n_y").alias("y"))
    return stats.length_stats(lens, "x", "y")


@query("a04_length_stats_with_thresholds", _LENS + """
SELECT CAST(coalesce(sum(x), 0) AS BIGINT) AS x_total_toks, CAST(coalesce(sum(y), 0) AS BIGINT) AS y_total_toks,
       round(coalesce(avg(x), 0), 6) AS x_avg, round(coalesce(avg(y), 0), 6) AS y_avg,
       round(coalesce(avg(CASE WHEN x + y >= 512 THEN 1 ELSE 0 END), 0), 6) AS geq_512,
       round(coalesce(avg(CASE WHEN x + y >= 1024 THEN 1 ELSE 0 END), 0), 6) AS geq_1024,
       round(coalesce(avg(CASE WHEN x + y >= 2048 THEN 1 ELSE 0 END), 0), 6) AS geq_2048,
       round(coalesce(avg(CASE WHEN x + y >= 4096 THEN 1 ELSE 0 END), 0), 6) AS geq_4096,
       round(coalesce(avg(CASE WHEN x + y >= 8192 THEN 1 ELSE 0 END), 0), 6) AS geq_8192,
       count(*) AS total_datapoints FROM lens""", ("proofs",))
def a04_length_stats_with_thresholds(spark, sf_dir):
    lens = steps.input_word_counts(_records(spark, sf_dir), "state").select(
        F.col("n_x").alias("x"), F.col("n_y").alias("y"))
    return stats.length_stats_with_thresholds(lens, "x", "y")
