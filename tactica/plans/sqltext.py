"""DuckDB SQL fragments shared by the oracle queries."""

from __future__ import annotations

from tactica.functions.pyjson import duck_escape_inner, duck_json_str
from tactica.functions.text import WS_CLASS

WS = WS_CLASS
NOT_WS = f"[^{WS_CLASS[1:-1]}]"


def words(s: str) -> str:
    return f"len(regexp_extract_all({s}, '{NOT_WS}+'))"


def strip(s: str) -> str:
    return f"regexp_replace({s}, '^{WS}+|{WS}+$', '', 'g')"


def esc(s: str) -> str:
    return duck_escape_inner(s)


def jstr(s: str) -> str:
    return duck_json_str(s)


def quotes_odd(s: str) -> str:
    return f"((length({s}) - length(replace({s}, '\"', ''))) % 2 = 1)"


def balance(s: str) -> str:
    return f"(CASE WHEN {quotes_odd(s)} THEN {s} || '\"' ELSE {s} END)"


def user_state(n: str, step: str) -> str:
    return f"(CAST(({n}) - ({step}) - 1 AS VARCHAR) || ' subgoals')"


def pairs_cte(fmt: str = "state", name: str = "pairs", source: str = "proofs") -> str:
    """(proof_id, logic, theory, proof_num, step, input, target) as in P10."""
    ctx = ""
    if "state_prems" in fmt:
        ctx += " || ', \"deps\": []'"
    if "state_prems_kwrds" in fmt:
        ctx += " || ', \"methods\": []'"
    if "state_prems_kwrds_terms" in fmt:
        ctx += " || ', \"variables\": [], \"constants\": [], \"type variables\": []'"
    return f"""
, {name}_esc AS (SELECT proof_id, logic, theory, proof_num, actions,
                 list_transform(actions, lambda a: {esc('a')}) AS e FROM {source})
, {name} AS (
  SELECT proof_id, logic, theory, proof_num, step,
         '{{"proof_so_far": "' || array_to_string(e[1:step], '\\n') || '", "last_usr_state": '
           || {jstr(user_state('len(actions)', 'step'))}{ctx} || '}}' AS input,
         actions[step + 1] AS target
  FROM (SELECT *, unnest(range(1, len(actions))) AS step FROM {name}_esc))
"""
