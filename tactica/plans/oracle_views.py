"""DuckDB twins of ``tactica.sources.adapters`` for the SQL oracle.

Each entry is one CTE. ``with_views(body, *names)`` prefixes a query body
with the CTEs it needs (dependencies first). The definitions mirror the
Spark adapters line by line; keep the two in step.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "proofs": ((), """proofs AS (
  SELECT doc_id AS proof_id, source AS logic, lang AS theory,
         row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS proof_num,
         string_split(text, chr(10)) AS actions
  FROM documents)"""),
    "steps": (("proofs",), """steps AS (
  SELECT proof_id, logic, theory, proof_num, step, action,
         CAST(n_lines - step - 1 AS VARCHAR) || ' subgoals' AS user_state
  FROM (SELECT proof_id, logic, theory, proof_num, len(actions) AS n_lines,
               unnest(range(len(actions))) AS step, unnest(actions) AS action
        FROM proofs))"""),
    "sessions": ((), """sessions AS (
  SELECT conv_id AS session, turn AS pos, role AS kind, text AS action FROM conversations)"""),
    "attempts": ((), """attempts AS (
  SELECT event_id AS seq, ts, user_id AS proof, event_type AS kind,
         value AS duration, props AS detail FROM events)"""),
    "predictions": ((), """predictions AS (
  SELECT a.conv_id AS batch, a.turn AS sample,
         string_split(a.text, ' ') AS labels, string_split(b.text, ' ') AS predicted,
         CAST(abs(len(string_split(a.text, ' ')) - len(string_split(b.text, ' '))) AS DOUBLE)
           / CAST(len(string_split(a.text, ' ')) AS DOUBLE) AS loss
  FROM conversations a JOIN conversations b
    ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.text IS NOT NULL)"""),
    "facts": ((), """facts AS (
  SELECT p_brand AS name, p_name AS theorem, p_partkey AS rank, p_size AS goal FROM part)"""),
    "dag_nodes": ((), """dag_nodes AS (SELECT p_partkey AS key, p_name AS info FROM part)"""),
    "dag_edges": ((), """dag_edges AS (
  SELECT DISTINCT src, dst FROM (
    SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part
    UNION ALL SELECT p_partkey, p_partkey // 3 FROM part)
  WHERE dst >= 1 AND dst <> src)"""),
    "cyclic_edges": ((), """cyclic_edges AS (
  SELECT DISTINCT src, dst FROM (
    SELECT p_partkey AS src, 5 * (p_partkey // 5) + (p_partkey + 1) % 5 AS dst
      FROM part WHERE (p_partkey // 5) % 2 = 0
    UNION ALL SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey // 2 >= 1)
  WHERE dst <> src)"""),
    "bad_json": ((), """bad_json AS (
  SELECT event_id AS seq, 'events/proof' || CAST(event_id AS VARCHAR) || '.json' AS path,
         CASE WHEN event_id % 7 = 0 THEN substring(props, 1, length(props) - 1)
              ELSE props END AS raw
  FROM events)"""),
}


def with_views(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(VIEWS[n][1] for n in order) + "\n" + body
