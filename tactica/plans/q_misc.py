"""Registered queries: lookups, predicates, keyword classes, corpus layout and
corpus health (J01, J03, J04, A11-A13, A22, F03-F05, S03, S05, S11, P16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactica.operators import filters as FL
from tactica.operators import joins as J
from tactica.operators import stats
from tactica.plans.registry import query
from tactica.sources import adapters as ad
from tactica.sources import corpus as C

_KIND_BY_ROLE = ("CASE role WHEN 'system' THEN 'thy_decl' WHEN 'user' THEN 'thy_goal' "
                 "ELSE 'prf_script' END")


def _kind_of(role):
    return (F.when(role == "system", "thy_decl").when(role == "user", "thy_goal")
             .otherwise("prf_script"))


def _commands(spark, sf_dir):
    """(session, pos, command, role, kind): command = first word of a turn."""
    c = ad.table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"),
                    F.try_element_at(F.split("text", " "), F.lit(1)).alias("command"), "role",
                    _kind_of(F.col("role")).alias("kind"))


def _keywords(spark, sf_dir):
    """Keyword table derived from the sessions: one kind per command."""
    c = _commands(spark, sf_dir)
    return c.groupBy("command").agg(F.min("kind").alias("kind"),
                                    F.max(F.col("session") * 1000 + F.col("pos")).alias("last_seen"))


_KEYWORDS_SQL = f"""
, cmds AS (SELECT conv_id AS session, turn AS pos, split_part(text, ' ', 1) AS command, role,
                  {_KIND_BY_ROLE} AS kind FROM conversations)
, keywords AS (SELECT command, min(kind) AS kind, max(session * 1000 + pos) AS last_seen
               FROM cmds GROUP BY command)
"""


@query("j04_keyword_kind_lookup", "WITH dummy AS (SELECT 1)" + _KEYWORDS_SQL + """
SELECT c.session, c.pos, c.command, k.kind FROM cmds c LEFT JOIN keywords k USING (command)""")
def j04_keyword_kind_lookup(spark, sf_dir):
    c = _commands(spark, sf_dir).select("session", "pos", "command")
    return J.keyword_kind_lookup(c, _keywords(spark, sf_dir)).select("session", "pos", "command", "kind")


@query("a12_commands_by_kind", "WITH dummy AS (SELECT 1)" + _KEYWORDS_SQL + """
SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY last_seen DESC, command) - 1 AS n, command
FROM keywords""")
def a12_commands_by_kind(spark, sf_dir):
    return J.commands_by_kind(_keywords(spark, sf_dir), "last_seen")


@query("f05_keyword_class_flags", "WITH dummy AS (SELECT 1)" + _KEYWORDS_SQL + """
SELECT command, kind,
       contains(kind, 'goal') AND command <> 'lemmas' AS starts_proof,
       contains(kind, 'qed') AS ends_proof,
       command <> 'qed' AND (contains(kind, 'prf_script') OR contains(kind, 'qed')
                             OR command IN ('unfolding', 'using', 'including')) AS apply_step,
       (contains(kind, 'prf') OR kind = 'next_block') AND NOT (command <> 'qed' AND (contains(kind, 'prf_script')
          OR contains(kind, 'qed') OR command IN ('unfolding', 'using', 'including'))) AS isar_step,
       starts_with(kind, 'document') AS document_step
FROM keywords""")
def f05_keyword_class_flags(spark, sf_dir):
    k = _keywords(spark, sf_dir)
    flags = J.keyword_class_flags(F.col("command"), F.col("kind"))
    return k.select("command", "kind", *[c.alias(n) for n, c in flags.items()])


@query("f04_meaningful_actions", """
WITH s AS (SELECT conv_id AS session, turn AS pos,
               CASE WHEN role = 'system' THEN '<ignored>' ELSE role END AS kind, text FROM conversations)
SELECT session, pos, kind, text, trim(text) = '' AS malformed, starts_with(kind, 'ML') AS is_ml
FROM s WHERE kind <> '<ignored>' AND NOT starts_with(kind, 'document')
UNION ALL SELECT DISTINCT conv_id, -1, '', '', false, false FROM conversations""")
def f04_meaningful_actions(spark, sf_dir):
    c = ad.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("pos"),
        F.when(F.col("role") == "system", "<ignored>").otherwise(F.col("role")).alias("kind"), "text")
    return J.meaningful_actions(c, ["session"], "pos", "kind", "text")


@query("f03_predicate_combinators", """
SELECT name, theorem, rank, goal FROM facts
WHERE (ends_with(name, '1') OR contains(theorem, 'red')) AND NOT (goal > 40)""", ("facts",))
def f03_predicate_combinators(spark, sf_dir):
    f = ad.facts(spark, sf_dir)
    pred = FL.all_of([FL.any_of([F.col("name").endswith("1"), F.col("theorem").contains("red")]),
                      FL.negate(F.col("goal") > 40)])
    return f.where(pred)


@query("j01_new_facts", """
, named AS (SELECT name || ' ' || theorem AS name, rank, goal FROM facts)
SELECT name, rank FROM named WHERE name NOT IN (SELECT name FROM named WHERE goal <= 25)""", ("facts",))
def j01_new_facts(spark, sf_dir):
    f = ad.facts(spark, sf_dir).select(F.concat_ws(" ", "name", "theorem").alias("name"), "rank", "goal")
    return J.new_facts(f, f.where(F.col("goal") <= 25)).select("name", "rank")


@query("j03_local_facts", """
, loc AS (SELECT theorem AS name, rank FROM facts WHERE goal > 25)
, glob_facts AS (SELECT theorem AS name, rank FROM facts WHERE goal <= 25)
SELECT name, rank, 'local' AS source FROM loc WHERE name NOT IN (SELECT name FROM glob_facts)
UNION ALL SELECT name, rank, 'global' FROM glob_facts""", ("facts",))
def j03_local_facts(spark, sf_dir):
    f = ad.facts(spark, sf_dir).select(F.col("theorem").alias("name"), "rank", "goal")
    out = J.all_facts(f.where(F.col("goal") > 25).drop("goal"), f.where(F.col("goal") <= 25).drop("goal"))
    return out.select("name", "rank", "source")


@query("a11_group_by_logic_theory", """
SELECT logic, theory || '.thy' AS theory, proof_num,
       logic || '/' || theory || '/proof' || CAST(proof_num AS VARCHAR) || '.json' AS path FROM proofs""", ("proofs",))
def a11_group_by_logic_theory(spark, sf_dir):
    p = ad.with_path(ad.with_proof_num(ad.proofs(spark, sf_dir)))
    return stats.group_by_logic_theory(p.withColumn("rel", F.col("path")))


@query("a11_theory_summary", """
, g AS (SELECT logic, theory || '.thy' AS theory, proof_num,
               logic || '/' || theory || '/proof' || CAST(proof_num AS VARCHAR) || '.json' AS path FROM proofs)
SELECT logic, theory, count(*) AS n_proofs, min(proof_num) AS first_num, max(proof_num) AS last_num,
       arg_min(path, proof_num) AS first_path FROM g GROUP BY logic, theory""", ("proofs",))
def a11_theory_summary(spark, sf_dir):
    p = ad.with_path(ad.with_proof_num(ad.proofs(spark, sf_dir)))
    return stats.theory_summary(stats.group_by_logic_theory(p.withColumn("rel", F.col("path"))))


@query("a13_distinct_terms", """
SELECT DISTINCT goal, unnest(string_split(theorem, ' ')) AS term FROM facts""", ("facts",))
def a13_distinct_terms(spark, sf_dir):
    f = ad.facts(spark, sf_dir)
    return stats.distinct_terms(f, ["goal"], F.split("theorem", " "))


@query("a22_generic_fold", """
SELECT source AS logic, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS folded
FROM documents WHERE text IS NOT NULL GROUP BY source""")
def a22_generic_fold(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents").select(F.col("source").alias("logic"), "text")
    folded, _errors = stats.generic_fold(d, ["logic"], F.size(F.split("text", "\n")).cast("long"), "sum",
                                         source=F.col("text"))
    return folded


@query("s03_find_erroneous", """
SELECT seq, path, 'invalid json' AS reason FROM bad_json WHERE NOT json_valid(raw)""", ("bad_json",))
def s03_find_erroneous(spark, sf_dir):
    return C.find_erroneous(ad.bad_json(spark, sf_dir)).select("seq", "path", "reason")


@query("s05_quarantine_clean", "SELECT seq, path FROM bad_json WHERE json_valid(raw)", ("bad_json",))
def s05_quarantine_clean(spark, sf_dir):
    clean, _bad = C.quarantine(ad.bad_json(spark, sf_dir))
    return clean.select("seq", "path")


@query("s11_resume_ledger", """
SELECT proof_id FROM proofs WHERE proof_id NOT IN (SELECT proof_id FROM proofs WHERE len(actions) - 1 <= 5)""",
       ("proofs",))
def s11_resume_ledger(spark, sf_dir):
    p = ad.proofs(spark, sf_dir).withColumn("num_steps", stats.count_steps(F.col("actions")))
    done = p.where(F.col("num_steps") <= 5)
    return C.resume_todo(p, done, ["proof_id"]).select("proof_id")


@query("p16_schema_key_paths", """
SELECT k AS path, count(*) AS count FROM (SELECT unnest(json_keys(raw)) AS k FROM bad_json WHERE json_valid(raw))
GROUP BY k""", ("bad_json",))
def p16_schema_key_paths(spark, sf_dir):
    return C.key_paths(ad.bad_json(spark, sf_dir))


@query("p17_json_atom_paths", """
SELECT seq, '$.' || k AS path, CAST(json_extract(raw, '$.' || k) AS VARCHAR) AS atom
FROM (SELECT seq, raw, unnest(json_keys(raw)) AS k FROM bad_json WHERE json_valid(raw))""", ("bad_json",))
def p17_json_atom_paths(spark, sf_dir):
    return C.json_atoms(ad.bad_json(spark, sf_dir), ["seq"]).select("seq", "path", "atom")


@query("s02_corpus_is_valid", "SELECT DISTINCT logic, true AS valid FROM proofs WHERE proof_num >= 0", ("proofs",))
def s02_corpus_is_valid(spark, sf_dir):
    p = ad.with_path(ad.with_proof_num(ad.proofs(spark, sf_dir).select("proof_id", "logic", "theory")))
    return C.valid_per_logic(p.withColumn("rel", F.col("path")))


_DEEP_SQL = """
, deep AS (SELECT proof_id, len(actions) AS n, unnest(range(1, len(actions) + 1)) AS i, unnest(actions) AS a FROM proofs)
"""


def _deep_json(spark, sf_dir):
    from tactica.operators import steps as P
    r = ad.proof_records(ad.proofs(spark, sf_dir))
    return r.select("proof_id", P.to_py_json_struct(r, ["proof"]).alias("raw"))


@query("p16_schema_key_paths_nested", _DEEP_SQL + """
SELECT unnest(['proof', 'proof[]', 'proof[].action', 'proof[].user_state']) AS path, count(DISTINCT proof_id) AS count
FROM deep""", ("proofs",))
def p16_schema_key_paths_nested(spark, sf_dir):
    return C.key_paths(_deep_json(spark, sf_dir))


@query("p17_json_atom_paths_nested", _DEEP_SQL + f"""
SELECT proof_id, '$.proof[' || CAST(i - 1 AS VARCHAR) || '].user_state' AS path,
       '"' || CAST(n - i AS VARCHAR) || ' subgoals"' AS atom FROM deep
UNION ALL SELECT proof_id, '$.proof[' || CAST(i - 1 AS VARCHAR) || '].action', CAST(to_json(a) AS VARCHAR) FROM deep""", ("proofs",))
def p17_json_atom_paths_nested(spark, sf_dir):
    return C.json_atoms(_deep_json(spark, sf_dir), ["proof_id"]).select("proof_id", "path", "atom")


@query("s04_repair_line_breaks", """
WITH t AS (SELECT doc_id, replace(replace(text, '"', ''), chr(92), '') AS text FROM documents)
, j AS (SELECT doc_id, '{"id": ' || doc_id || ', "note": "' || CASE WHEN doc_id % 3 = 0 THEN chr(92) || '"' ELSE '' END
               || '", "text": "' || text || CASE WHEN doc_id % 5 = 0 THEN '"' ELSE '"}' END AS raw FROM t)
, c AS (SELECT *, replace(raw, chr(10), chr(92) || 'n') AS clean FROM j)
SELECT doc_id, CASE WHEN json_valid(raw) THEN 'valid' WHEN json_valid(clean) THEN 'repaired' ELSE 'failed' END AS status,
       CASE WHEN json_valid(raw) THEN raw WHEN json_valid(clean)
            THEN replace(clean, '"note": "' || chr(92) || '"', '"note": "' || chr(92) || '"' || chr(92) || '"') END AS fixed
FROM c""")
def s04_repair_line_breaks(spark, sf_dir):
    """Records with raw line breaks and odd quotes: repaired; cut ones fail."""
    d = ad.table(spark, sf_dir, "documents")
    text = F.translate("text", '"\\', "")
    raw = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "note": "'),
                   F.when(F.col("doc_id") % 3 == 0, F.lit('\\"')).otherwise(F.lit("")), F.lit('", "text": "'), text,
                   F.when(F.col("doc_id") % 5 == 0, F.lit('"')).otherwise(F.lit('"}')))
    return C.repair_corrupt_json(d.select("doc_id", raw.alias("raw"))).select("doc_id", "status", "fixed")


@query("st1_ingest_records", """
SELECT proof_id, logic, theory, proof_num, proof_id % 4 <> 0 AS ok,
       CASE WHEN proof_id % 4 <> 0 THEN len(actions) - 1 ELSE -1 END AS num_steps FROM proofs""", ("proofs",))
def st1_ingest_records(spark, sf_dir):
    """ST1's parser over every proof as a file: each fourth has text after its
    JSON value and is an empty record (the stream itself runs in the tests)."""
    from tactica.operators import steps as P
    r = ad.proof_records(ad.with_path(ad.with_proof_num(ad.proofs(spark, sf_dir))))
    text = F.concat(P.to_py_json_struct(r, ["proof"]), F.when(F.col("proof_id") % 4 == 0, F.lit("x")).otherwise(F.lit("")))
    files = r.select(F.concat(F.lit("/corpus/"), "path").alias("path"), "proof_id", text.alias("raw"))
    rec = C.with_record(C.with_place(files, "/corpus"))
    return rec.select("proof_id", "logic", "theory", "proof_num", "ok",
                      (F.coalesce(F.size("record.proof"), F.lit(0)) - 1).alias("num_steps"))


@query("s06_proof_json_sink_plan", """
, existing AS (SELECT logic, theory, proof_num FROM proofs WHERE len(actions) - 1 <= 5)
SELECT p.proof_id, p.logic, p.theory, p.proof_num FROM proofs p
WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.logic = p.logic AND e.theory = p.theory
                  AND e.proof_num = p.proof_num)""", ("proofs",))
def s06_proof_json_sink_plan(spark, sf_dir):
    """Rows a numbered append would write when the short proofs already exist."""
    p = ad.with_proof_num(ad.proofs(spark, sf_dir)).withColumn("num_steps", stats.count_steps(F.col("actions")))
    existing = p.where(F.col("num_steps") <= 5)
    return C.proofs_to_append(p, existing).select("proof_id", "logic", "theory", "proof_num")


@query("s06_proof_files_round_trip", """
SELECT proof_id, logic, theory, proof_num, len(actions) - 1 AS num_steps, actions[1] AS objective,
       CASE WHEN len(actions) - 1 <= 5 THEN 'first' ELSE 'second' END AS job FROM proofs""", ("proofs",))
def s06_proof_files_round_trip(spark, sf_dir):
    """Every proof as a file of its own: the short ones by a first job, then all
    of them by a second one, which leaves what is there; read back and parsed."""
    import uuid

    from tactica.operators import steps as P
    from tactica.session import ensure_checkpoint_dir
    from tactica.sources import proof_files

    proof_files.register(spark)
    root = f"{ensure_checkpoint_dir(spark)}/proofs-{uuid.uuid4().hex}"
    r = ad.proof_records(ad.with_proof_num(ad.proofs(spark, sf_dir)))
    files = r.select("logic", "theory", F.col("proof_num").cast("int").alias("proof_num"), F.size("proof").alias("n"),
                     P.to_py_json_struct(r, ["proof"]).alias("raw"), "proof_id")
    for job, part in (("first", files.where("n <= 6")), ("second", files)):
        mark = F.concat(F.expr("substring(raw, 1, length(raw) - 1)"), F.lit(f', "methods": ["{job}", "'), F.col("proof_id"), F.lit('"]}'))
        part.withColumn("raw", mark).write.format("prooffiles").mode("append").save(root)
    back = C.with_record(spark.read.format("prooffiles").load(root))
    return back.select(F.element_at("record.methods", 2).cast("long").alias("proof_id"), "logic", "theory", "proof_num",
                       (F.size("record.proof") - 1).alias("num_steps"), F.element_at("record.proof", 1)["action"].alias("objective"),
                       F.element_at("record.methods", 1).alias("job"))


@query("s07_copy_subset_layout", """
, chosen AS (SELECT proof_id, logic || '/' || theory || '/proof' || CAST(proof_num AS VARCHAR) || '.json' AS path
             FROM proofs WHERE logic = 'src1')
, b AS (SELECT min(path) AS lo, max(path) AS hi FROM chosen)
, n AS (SELECT coalesce(max(i), 0) AS n FROM b, range(1, 1000) t(i)
        WHERE i <= least(length(lo), length(hi)) AND substring(lo, 1, i) = substring(hi, 1, i))
, root AS (SELECT substring(lo, 1, n) AS prefix FROM b, n)
, r AS (SELECT CASE WHEN strpos(prefix, '/') = 0 THEN ''
                    ELSE substring(prefix, 1, length(prefix) - strpos(reverse(prefix), '/') + 1) END AS root
        FROM root)
SELECT proof_id, path, substring(path, length(root) + 1) AS rel FROM chosen, r""", ("proofs",))
def s07_copy_subset_layout(spark, sf_dir):
    p = ad.with_path(ad.with_proof_num(ad.proofs(spark, sf_dir).select("proof_id", "logic", "theory")))
    chosen = p.where(F.col("logic") == "src1").select("proof_id", "path")
    return C.relative_layout(chosen).select("proof_id", "path", "rel")


@query("s01_parse_corpus_records", """
SELECT proof_id, len(actions) - 1 AS num_steps, actions[1] AS objective FROM proofs""", ("proofs",))
def s01_parse_corpus_records(spark, sf_dir):
    """S01's parsing half at full scale: every proof rendered as its JSON file
    text (P13) and parsed back with the fixed PROOF_SCHEMA (never inferred)."""
    from tactica.operators import steps as P
    r = ad.proof_records(ad.proofs(spark, sf_dir))
    text = r.select("proof_id", P.to_py_json_struct(r, ["proof"]).alias("raw"))
    parsed = C.with_record(text)
    return parsed.select("proof_id", (F.coalesce(F.size("record.proof"), F.lit(0)) - 1).alias("num_steps"),
                         F.try_element_at("record.proof", F.lit(1))["action"].alias("objective"))


@query("s04_repair_corrupt_json", """
SELECT seq, CASE WHEN json_valid(raw) THEN 'valid' ELSE 'failed' END AS status FROM bad_json""",
       ("bad_json",))
def s04_repair_corrupt_json(spark, sf_dir):
    """Repair pass over the damaged records: cut records cannot be repaired
    (status failed), intact ones are left alone (valid)."""
    return C.repair_corrupt_json(ad.bad_json(spark, sf_dir)).select("seq", "status")
