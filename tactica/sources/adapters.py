"""Bindings from the driver's parquet tables to the proof-corpus data model.

The driver's data holds no proof files, so these views stand in for them
(FIXTURES.md section 4). Each one is a pure projection/explode of a given
table, so its work grows with the table; each has a DuckDB twin in
``tactica.plans.oracle_views`` with exactly the same definition.

``proofs``       documents: logic = source, theory = lang, one step per line
``sessions``     conversations: session = conv_id, pos = turn, kind = role
``attempts``     events: seq = event_id, proof = user_id, kind = event_type
``predictions``  user turn words (labels) vs next turn words (predicted)
``facts``        part: name = p_brand, theorem = p_name, rank = p_partkey
``dag``          part keys, edges k -> k div 2 and k -> k div 3
``cyclic``       part keys, 5-cycles on even blocks plus k -> k div 2
``bad_json``     events.props, every 7th event cut before its last char
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactica.operators.ordering import neighbour, number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------
# proofs
# --------------------------------------------------------------------------

def proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per proof: proof_id, logic, theory, actions (array, 0 = objective)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("proof_id"),
        F.col("source").alias("logic"),
        F.col("lang").alias("theory"),
        F.split(F.col("text"), "\n").alias("actions"))


def with_proof_num(proofs_df: DataFrame) -> DataFrame:
    """proof_num = 0-based rank of proof_id inside (logic, theory), skew-safe."""
    return number_rows(proofs_df, ["logic", "theory"], ["proof_id"], "proof_num")


def with_path(proofs_df: DataFrame) -> DataFrame:
    return proofs_df.withColumn("path", F.concat_ws(
        "/", "logic", "theory", F.concat(F.lit("proof"), F.col("proof_num").cast("string"), F.lit(".json"))))


def user_state_col(n_steps: F.Column, step: F.Column) -> F.Column:
    """Stand-in prover state: the number of steps still to come."""
    return F.concat((n_steps - step - F.lit(1)).cast("string"), F.lit(" subgoals"))


def proof_records(proofs_df: DataFrame) -> DataFrame:
    """Proofs in the canonical nested form: ``proof`` = array of step structs."""
    n = F.size("actions")
    return proofs_df.withColumn("proof", F.transform(
        "actions", lambda a, i: F.struct(a.alias("action"),
                                         user_state_col(n, i).alias("user_state"))))


def rich_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof records with every context field: deps (first and last word of
    each step), methods (first words), and per step the maps of names."""
    p = proofs(spark, sf_dir)
    n = F.size("actions")
    word = lambda a, i: F.element_at(F.split(a, " "), i)
    step = lambda a, i: F.struct(
        a.alias("action"), user_state_col(n, i).alias("user_state"),
        F.create_map(F.lit("Type0"), word(a, 1)).alias("variables"),
        F.create_map(F.lit("Type0"), word(a, -1)).alias("constants"))
    return p.select("proof_id", "logic", "theory", F.transform("actions", step).alias("proof"),
                    F.transform("actions", lambda a: F.struct(word(a, 1).alias("name"), word(a, -1).alias("term"))).alias("deps"),
                    F.transform("actions", lambda a: word(a, 1)).alias("methods"))


def steps(proofs_df: DataFrame) -> DataFrame:
    """Flat step table: one row per (proof_id, step); step 0 is the objective."""
    keep = [c for c in proofs_df.columns if c != "actions"]
    return (proofs_df
            .select(*keep, F.size("actions").alias("n_lines"),
                    F.posexplode_outer("actions").alias("step", "action"))
            .where(F.col("step").isNotNull())
            .withColumn("user_state", user_state_col(F.col("n_lines"), F.col("step")))
            .drop("n_lines"))


# --------------------------------------------------------------------------
# sessions, attempts, predictions
# --------------------------------------------------------------------------

def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("pos"),
        F.col("role").alias("kind"), F.col("text").alias("action"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("proof"),
        F.col("event_type").alias("kind"), F.col("value").alias("duration"),
        F.col("props").alias("detail"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, sample, labels, predicted, loss) from user turn -> next turn.

    labels = words of a user turn, predicted = words of the turn right after
    it in the same conversation (joined on the unique (conv_id, turn + 1), not
    a window, so a huge conversation is spread over many tasks). loss is the
    relative length difference of the two word lists.
    """
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pairs = neighbour(conv, ["conv_id"], "turn", 1, ["role", "text"], "_next")
    pairs = pairs.where((F.col("role") == "user") & F.col("text_next").isNotNull())
    labels = F.split("text", " ")
    predicted = F.split("text_next", " ")
    return pairs.select(
        F.col("conv_id").alias("batch"), F.col("turn").alias("sample"),
        labels.alias("labels"), predicted.alias("predicted"),
        (F.abs(F.size(labels) - F.size(predicted)).cast("double")
         / F.size(labels).cast("double")).alias("loss"))


# --------------------------------------------------------------------------
# facts and graphs over part
# --------------------------------------------------------------------------

def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("name"), F.col("p_name").alias("theorem"),
        F.col("p_partkey").alias("rank"), F.col("p_size").alias("goal"))


def dag_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"), F.col("p_name").alias("info"))


def dag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges k -> k div 2 and k -> k div 3 where the target is >= 1 and != k."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(k)
    e = part.select(k.alias("src"), F.explode(F.array(
        F.floor(k / 2).cast("long"), F.floor(k / 3).cast("long"))).alias("dst"))
    return e.where((F.col("dst") >= 1) & (F.col("dst") != F.col("src"))).distinct()


def cyclic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5-cycles inside each even block of 5 keys, plus k -> k div 2 (>= 1)."""
    k = F.col("p_partkey")
    blk = F.floor(k / 5).cast("long")
    ring = F.when(blk % 2 == 0, blk * 5 + (k + 1) % 5)
    half = F.floor(k / 2).cast("long")
    part = table(spark, sf_dir, "part").select(k)
    e = part.select(k.alias("src"), F.explode(F.array(
        ring, F.when(half >= 1, half))).alias("dst"))
    return e.where(F.col("dst").isNotNull() & (F.col("dst") != F.col("src"))).distinct()


# --------------------------------------------------------------------------
# damaged JSON
# --------------------------------------------------------------------------

def bad_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, path, raw): event props, every 7th event truncated by one char."""
    ev = table(spark, sf_dir, "events")
    cut = F.expr("substring(props, 1, length(props) - 1)")
    return ev.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("events/proof"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"),
        F.when(F.col("event_id") % 7 == 0, cut).otherwise(F.col("props")).alias("raw"))


# --------------------------------------------------------------------------
# imports: pages as theory folders, ROOT texts and import lists
# --------------------------------------------------------------------------

def _page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pg = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[^?#]*)?", 1)
    return pg.select("page_id", host.alias("host"), F.regexp_extract(host, r"^([^.]+)", 1).alias("label"),
                     F.regexp_extract(path, r"^/([^/]+)", 1).alias("lang"),
                     F.regexp_extract(path, r"([^/]+)$", 1).alias("leaf"),
                     F.regexp_extract_all("html", F.lit(r'href="/([^"]*)"'), F.lit(1)).alias("links"))


def root_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, lang, label, text): a ROOT text per page with two sessions."""
    p = _page_parts(spark, sf_dir)
    text = F.concat(F.lit("session "), F.col("label"), F.lit(" ("), F.col("lang"), F.lit(') in "'),
                    F.col("lang"), F.lit("/"), F.col("leaf"), F.lit('" = HOL +\n  theories '), F.col("leaf"),
                    F.lit('\nsession "'), F.col("label"), F.lit("-"), F.col("leaf"), F.lit('" = '),
                    F.col("label"), F.lit("\n"))
    return p.select("page_id", "lang", "label", text.alias("text"))


def theory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dir, name, path): the link words of a page are theory files in the
    folder named by its host."""
    p = _page_parts(spark, sf_dir)
    return (p.select(F.col("host").alias("dir"), F.explode("links").alias("w")).distinct()
             .select("dir", F.concat("w", F.lit(".thy")).alias("name"),
                     F.concat_ws("/", "dir", F.concat("w", F.lit(".thy"))).alias("path")))


def theory_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(importer_dir, import_name): a page imports the link words of the next
    page (joined on the unique page_id + 1) and its own leaf name, qualified
    by its language (the leaf names are not theory files: unresolved)."""
    p = _page_parts(spark, sf_dir)
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("links").alias("next_links"))
    j = p.join(nxt, "page_id")
    linked = j.select(F.col("host").alias("importer_dir"), "lang", F.explode("next_links").alias("w"))
    own = p.select(F.col("host").alias("importer_dir"), "lang", F.col("leaf").alias("w"))
    return (linked.unionByName(own)
                  .select("importer_dir", F.concat_ws(".", "lang", "w").alias("import_name")).distinct())
