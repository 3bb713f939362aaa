"""Projections over proof and step records.

Proof-level operators work on the nested ``proof`` array of one row, so
sample generation is a narrow (map-only) transformation: no shuffle, no
window, and a large logic costs nothing extra. Flat ``steps`` tables are
produced by ``posexplode`` keyed by (proof_id, step).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactica.functions.pyjson import escape_array, json_str, to_py_json, to_py_json_record

# Data formats of the reference (name -> format string).
FORMATS = {
    "S": "state",
    "SP": "state_prems",
    "SPK": "state_prems_kwrds",
    "SPKT": "state_prems_kwrds_terms",
    "FS": "finetune_state",
    "FSP": "finetune_state_prems",
    "FSPK": "finetune_state_prems_kwrds",
    "FSPKT": "finetune_state_prems_kwrds_terms",
}
# Prefix added to seq2seq inputs of the finetune formats.
FINETUNE_PREFIX = "isabelle next step: "
# User prompt of chat samples; {context} is the input JSON.
CHAT_PROMPT = (
    "Recommend the next Isabelle proof step given the context below. Enclose the suggestion "
    "in <SUGGESTION>-</SUGGESTION> tags. Only return the suggestion, do not include any "
    "other text.\n{context}\n")
# Chat template used to render a conversation into one training string
# (the public Gemma turn markers; the leading <bos> is dropped).
CHAT_TURN = "<start_of_turn>{role}\n{text}<end_of_turn>\n"


def _field(df: DataFrame, array_col: str, name: str) -> T.DataType | None:
    dt = df.schema[array_col].dataType
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StructType):
        for f in dt.elementType.fields:
            if f.name == name:
                return f.dataType
    return None


# ------------------------------------------------------------------ P01 - P08

def explode_steps(df: DataFrame, proof: str = "proof") -> DataFrame:
    """One row per step with all step fields; key (proof_id, step)."""
    keep = [c for c in df.columns if c != proof]
    # posexplode_outer + null filter: a plain posexplode makes Catalyst infer
    # size(array) > 0 and push it to the scan, evaluating the (possibly
    # computed) array twice
    return (df.select(*keep, F.posexplode_outer(proof).alias("step", "_s")).where(F.col("step").isNotNull())
              .select(*keep, "step", "_s.*"))


def objective(proof: Column) -> Column:
    """Action of step 0."""
    return F.try_element_at(proof, F.lit(1))["action"]


def tactic_actions(proof: Column) -> Column:
    """Actions of steps >= 1."""
    return F.transform(F.slice(proof, 2, F.greatest(F.size(proof) - 1, F.lit(0))),
                       lambda s: s["action"])


def user_states(proof: Column) -> Column:
    """User states of steps >= 1."""
    return F.transform(F.slice(proof, 2, F.greatest(F.size(proof) - 1, F.lit(0))),
                       lambda s: s["user_state"])


def step_constants(steps_df: DataFrame, constants: str = "constants") -> DataFrame:
    """One row per (proof, step >= 1, constant entry)."""
    return (steps_df.where(F.col("step") >= 1)
                    .select("proof_id", "step", F.explode(constants).alias("type_group", "names")))


def proof_prefix(actions: Column, i: Column) -> Column:
    """Objective and actions 1..i-1 joined by newline (step i excluded)."""
    return F.array_join(F.slice(actions, 1, i), "\n")


def render_proof_script(actions: Column) -> Column:
    """The actions in order, one per line."""
    return F.array_join(actions, "\n")


# ------------------------------------------------------------------ P09 - P12

def context_fields(data_format: str) -> list[str]:
    """Which record fields a format attaches to each input."""
    fields = []
    if FORMATS["SP"] in data_format:
        fields.append("deps")
    if FORMATS["SPK"] in data_format:
        fields.append("methods")
    if FORMATS["SPKT"] in data_format:
        fields += ["variables", "constants", "type variables"]
    return fields


def _json_or_empty(df: DataFrame, col: Column, dtype: T.DataType | None) -> Column:
    if dtype is None:
        return F.lit("[]")
    return F.when(col.isNull(), F.lit("[]")).otherwise(to_py_json(col, dtype))


def task_table(records: DataFrame, data_format: str, proof: str = "proof") -> DataFrame:
    """The work list for evaluation: the record's own columns, the
    objective with balanced quotes, and ``context``, the JSON text of the
    record fields that the format attaches (P09)."""
    from tactica.functions.text import balance_quotes
    names = [n for n in context_fields(data_format) if n in ("deps", "methods")]
    parts: list[Column] = []
    for i, name in enumerate(names):
        dt = records.schema[name].dataType if name in records.columns else None
        val = F.col(name) if dt is not None else F.lit(None)
        parts += [F.lit(("{" if i == 0 else ", ") + f'"{name}": '), _json_or_empty(records, val, dt)]
    context = F.concat(*parts, F.lit("}")) if parts else F.lit("{}")
    keep = [c for c in records.columns if c not in (proof, "deps", "methods")]
    return records.select(*keep, balance_quotes(objective(F.col(proof))).alias("objective"), context.alias("context"))


def input_target_pairs(df: DataFrame, data_format: str = "state", proof: str = "proof",
                       keep: Sequence[str] = ("proof_id",)) -> DataFrame:
    """P10: one (input, target) per step >= 1.

    input is the Python-JSON text of {proof_so_far, last_usr_state, [deps],
    [methods], [variables, constants, type variables]}; target is the action.
    Each action is escaped once; the prefix of step i is the join of the
    first i escaped actions with an escaped newline, so the work per proof is
    linear in its size plus the (inherent) size of the output.
    """
    cols = set(df.columns)
    esc = escape_array(F.transform(proof, lambda s: s["action"]))
    ctx = context_fields(data_format)
    # escaped and rendered once per proof (a projection below the generator), not per step
    of_record = {n: _json_or_empty(df, F.col(n), df.schema[n].dataType) for n in ("deps", "methods") if n in ctx and n in cols}
    escaped = df.select(*keep, *[c.alias(f"_j_{n}") for n, c in of_record.items()], proof, esc.alias("_esc"),
                        escape_array(F.transform(proof, lambda s: F.coalesce(s["user_state"], F.lit("")))).alias("_states"))
    out = escaped.select(*keep, *[f"_j_{n}" for n in of_record], "_esc", "_states",
                         F.posexplode_outer(proof).alias("step", "_s"))
    out = out.where(F.col("step") >= 1)
    parts = [F.lit('{"proof_so_far": "'),
             F.array_join(F.slice("_esc", 1, F.col("step")), "\\n"),
             F.lit('", "last_usr_state": "'), F.get("_states", F.col("step")), F.lit('"')]
    for name in ctx:
        if name in of_record:
            text = F.col(f"_j_{name}")
        else:
            dt = None if name in ("deps", "methods") else _field(df, proof, name)
            text = _json_or_empty(out, F.col("_s")[name] if dt is not None else F.lit(None), dt)
        parts += [F.lit(f', "{name}": '), text]
    parts.append(F.lit("}"))
    return out.select(*keep, "step", F.concat(*parts).alias("input"),
                      F.col("_s")["action"].alias("target"))


def seq2seq_samples(pairs: DataFrame, data_format: str) -> DataFrame:
    """Prefix inputs of the finetune formats."""
    if "finetune" in data_format:
        return pairs.withColumn("input", F.concat(F.lit(FINETUNE_PREFIX), F.col("input")))
    return pairs


def chat_samples(pairs: DataFrame, prompt: str = CHAT_PROMPT, turn: str = CHAT_TURN) -> DataFrame:
    """Two-message conversation plus its rendering with the chat template."""
    before, after = prompt.split("{context}")
    user = F.concat(F.lit(before), F.col("input"), F.lit(after))
    assistant = F.concat(F.lit("<SUGGESTION>"), F.col("target"), F.lit("</SUGGESTION>"))

    def render(role: str, text: Column) -> Column:
        b, rest = turn.split("{role}")
        mid, end = rest.split("{text}")
        return F.concat(F.lit(b + role + mid), text, F.lit(end))

    msg = lambda role, text: F.struct(F.lit(role).alias("role"), F.array(F.struct(
        F.lit("text").alias("type"), text.alias("text"))).alias("content"))
    return pairs.select(
        *[c for c in pairs.columns if c not in ("input", "target")],
        F.array(msg("user", user), msg("assistant", assistant)).alias("messages"),
        user.alias("user_text"), assistant.alias("assistant_text"),
        F.concat(render("user", user), render("model", assistant)).alias("text"))


def to_py_json_struct(df: DataFrame, cols: Sequence[str]) -> Column:
    """JSON text (Python spacing, ensure_ascii) of the record made of ``cols``."""
    st = F.struct(*[F.col(f"`{c}`") for c in cols])
    dt = df.select(st.alias("r")).schema["r"].dataType
    return to_py_json_record(st, dt)


def tokenizer_corpus(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One serialized JSON text per proof, for an outside tokenizer trainer."""
    return df.select(to_py_json_struct(df, cols).alias("json"))


# ------------------------------------------------------------------ P18, P19

def number_facts(df: DataFrame, name: str = "name", thms: str = "theorems") -> DataFrame:
    """(name, [thm]) -> ((name, 1..n), thm)."""
    return df.select(name, F.posexplode(thms).alias("_i", "theorem")).select(
        name, (F.col("_i") + 1).alias("index"), "theorem")


def group_names_by_type(df: DataFrame, key: Sequence[str], type_col: str,
                        name_col: str, pos_col: str) -> DataFrame:
    """Distinct names per (key, type), types numbered by first occurrence.

    Output per key: ``Type{i}`` -> ``"newest, ..., oldest :: type"``. Rows are
    first reduced to one per distinct (key, type, name) by a partial
    aggregate, so only distinct names (the output itself) are ever collected.
    """
    firsts = df.groupBy(*key, type_col, name_col).agg(F.min(pos_col).alias("_p"))
    per_type = firsts.groupBy(*key, type_col).agg(
        F.min("_p").alias("_first"),
        F.sort_array(F.collect_list(F.struct(F.col("_p"), F.col(name_col).alias("n"))),
                     asc=False).alias("_occ"))
    w = Window.partitionBy(*key).orderBy("_first")
    return per_type.select(
        *key, F.concat(F.lit("Type"), (F.row_number().over(w) - 1).cast("string")).alias("type_group"),
        F.concat(F.array_join(F.transform("_occ", lambda o: o["n"]), ", "), F.lit(" :: "),
                 F.col(type_col).cast("string")).alias("names"))


def prompt_requests(requests: DataFrame, data_format: str = "state", prompt: str = CHAT_PROMPT,
                    so_far: str = "proof_so_far", state: str = "user_state") -> DataFrame:
    """Request rows -> prompt text: missing fields default to "", the
    format's context fields are attached (``[]`` when absent), rendered as
    Python JSON and put into the prompt template."""
    cols = set(requests.columns)
    parts = [F.lit('{"proof_so_far": '), json_str(F.coalesce(F.col(so_far), F.lit(""))),
             F.lit(', "last_usr_state": '), json_str(F.coalesce(F.col(state), F.lit("")))]
    for name in context_fields(data_format):
        dt = requests.schema[name].dataType if name in cols else None
        val = F.col(f"`{name}`") if name in cols else F.lit(None)
        parts += [F.lit(f', "{name}": '), _json_or_empty(requests, val, dt)]
    parts.append(F.lit("}"))
    before, after = prompt.split("{context}")
    return requests.withColumn("prompt", F.concat(F.lit(before), F.concat(*parts), F.lit(after)))


# ------------------------------------------------------------------ P10 lengths

def _space_stats(s: Column) -> tuple[Column, Column, Column, Column]:
    """(runs of non-space characters, starts with non-space, ends with
    non-space, is empty) where only U+0020 counts as space."""
    return (F.coalesce(F.size(F.filter(F.split(s, " "), lambda t: t != "")), F.lit(0)),
            F.coalesce((F.length(s) > 0) & (F.substring(s, 1, 1) != " "), F.lit(False)),
            F.coalesce((F.length(s) > 0) & (F.substring(s, -1, 1) != " "), F.lit(False)),
            F.coalesce(F.length(s) == 0, F.lit(True)))


def _lit_stats(text: str) -> tuple[Column, Column, Column, Column]:
    runs = len(text.split(" ")) - text.split(" ").count("")
    return (F.lit(runs), F.lit(bool(text) and text[0] != " "), F.lit(bool(text) and text[-1] != " "),
            F.lit(text == ""))


def _join_stats(a, b):
    ra, sa, ea, za = a
    rb, sb, eb, zb = b
    merge = (~za & ~zb & ea & sb).cast("int")
    return (ra + rb - merge, F.when(za, sb).otherwise(sa), F.when(zb, ea).otherwise(eb), za & zb)


def input_word_counts(df: DataFrame, data_format: str = "state", proof: str = "proof",
                      keep: Sequence[str] = ("proof_id",)) -> DataFrame:
    """Whitespace-token counts of P10's (input, target) without building the
    input text: (keep, step, n_x, n_y).

    In Python-escaped JSON the only whitespace left is U+0020, so the tokens
    of the input are the runs of non-space characters. The input is
    ``P0 + join(line_1..line_i, '\\n') + Q + json(user_state) + ctx + '}'``;
    token counts of a concatenation follow from (runs, starts non-space, ends
    non-space, empty) of the parts, and the prefix part from running sums of
    per-line figures. Work per proof is linear in its size instead of the
    quadratic size of all its inputs. Equal to ``len(input.split())``.
    """
    from tactica.functions.text import py_word_count

    acts = F.transform(proof, lambda s: s["action"])
    runs = F.transform(acts, lambda a: F.coalesce(F.size(F.filter(F.split(a, " "), lambda t: t != "")),
                                                  F.lit(0)))
    st = F.transform(acts, lambda a: F.coalesce((F.length(a) > 0) & (F.substring(a, 1, 1) != " "),
                                                F.lit(False)).cast("int"))
    en = F.transform(acts, lambda a: F.coalesce((F.length(a) > 0) & (F.substring(a, -1, 1) != " "),
                                                F.lit(False)).cast("int"))
    em = F.transform(acts, lambda a: (F.coalesce(F.length(a), F.lit(0)) == 0).cast("int"))

    def prefix_sums(arr: Column) -> Column:
        # cum[k + 1] = sum of the first k elements (1-based element_at); one
        # pass per proof, so each step reads its sums in O(1)
        return F.aggregate(arr, F.array(F.lit(0).cast("long")),
                           lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + v))

    cols = set(df.columns)
    ctx_names = context_fields(data_format)
    # record-level context (deps, methods): rendered once per proof
    rec_json = {n: _json_or_empty(df, F.col(n), df.schema[n].dataType)
                for n in ("deps", "methods") if n in ctx_names and n in cols}
    per_line = df.select(*keep, proof, runs.alias("_r"), st.alias("_s"), en.alias("_e"), em.alias("_z"),
                         *[c.alias(f"_j_{n}") for n, c in rec_json.items()])
    base = per_line.select(
        *keep, proof, "_s", "_e", "_z", *[f"_j_{n}" for n in rec_json],
        prefix_sums(F.col("_r")).alias("_cr"),
        prefix_sums(F.zip_with("_e", "_z", lambda e, z: e * (1 - z))).alias("_cnz"),
        prefix_sums(F.zip_with("_s", "_z", lambda s, z: s * (1 - z))).alias("_csz"),
        prefix_sums(F.col("_z")).alias("_cz"))
    x = base.select(*keep, "_s", "_e", "_z", "_cr", "_cnz", "_csz", "_cz", *[f"_j_{n}" for n in rec_json],
                    F.posexplode_outer(proof).alias("step", "_st")).where("step >= 1")

    i = F.col("step")  # prefix holds lines 1..i (1-based), i.e. actions[0..i-1]

    def cum(arr: str, k: Column) -> Column:
        return F.element_at(arr, k + 1)

    # W(J_i) = sum r + (i-1) - sum_{k<i, nonempty} e_k - sum_{2<=k<=i, nonempty} s_k - #{1<k<i empty}
    sum_r = cum("_cr", i)
    sum_e = cum("_cnz", i - 1)
    sum_s = cum("_csz", i) - cum("_csz", F.lit(1))
    mid_empty = F.when(i > 2, cum("_cz", i - 1) - cum("_cz", F.lit(1))).otherwise(F.lit(0))
    runs_j = sum_r + (i - 1) - sum_e - sum_s - mid_empty
    z1 = F.try_element_at("_z", F.lit(1)) == 1
    zi = F.try_element_at("_z", i) == 1
    starts_j = F.when(~z1, F.try_element_at("_s", F.lit(1)) == 1).otherwise(i > 1)
    ends_j = F.when(~zi, F.try_element_at("_e", i) == 1).otherwise(i > 1)
    empty_j = z1 & (i == 1)
    us = F.coalesce(F.col("_st")["user_state"], F.lit(""))
    pieces = [_lit_stats('{"proof_so_far": "'), (runs_j, starts_j, ends_j, empty_j),
              _lit_stats('", "last_usr_state": "'), _space_stats(us), _lit_stats('"')]
    for name in ctx_names:
        pieces.append(_lit_stats(f', "{name}": '))
        if name in rec_json:
            pieces.append(_space_stats(F.col(f"_j_{name}")))
        else:
            dt = _field(df, proof, name)
            if dt is None:
                pieces.append(_lit_stats("[]"))
            else:
                pieces.append(_space_stats(_json_or_empty(x, F.col("_st")[name], dt)))
    pieces.append(_lit_stats("}"))
    acc = pieces[0]
    for p in pieces[1:]:
        acc = _join_stats(acc, p)
    # emitted through a one-element generator: a later filter on n_x/n_y
    # cannot be pushed below it, so the counts are computed once (a pushed
    # filter would inline and re-evaluate the whole expression)
    counts = F.struct(acc[0].alias("n_x"), py_word_count(F.col("_st")["action"]).alias("n_y"))
    return x.select(*keep, "step", F.inline(F.array(counts)))
