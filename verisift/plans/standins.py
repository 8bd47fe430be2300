"""The engine's tables, made from the driver's: as DataFrames and as the SQL of the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, kind = F.col("k"), F.col("event_type")
    message = F.when(k % 4 == 0, F.concat(F.lit("HTTP 429: quota, reset in "), k.cast("string"), F.lit(" seconds"))).when(k % 4 == 1, F.concat(F.lit("Rate limit, reset in  "), k.cast("string"), F.lit(" seconds"))).when(k % 4 == 2, "Deadline exceeded").otherwise("Could not parse JSON")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.when(k % 2 == 0, "assessment").otherwise("question").alias("stage"), F.when(k % 10 == 0, "fallback").otherwise("primary").alias("call_type"),
        F.concat(F.lit("p"), (k % 3).cast("string")).alias("provider"), F.concat(F.lit("m"), (k % 2).cast("string")).alias("model"),
        F.when(kind == "error", "error").when(kind == "view", "timeout").otherwise("success").alias("status"),
        F.when(kind == "view", "timeout").when(kind == "error", F.when(k % 3 == 0, "schema_validation").when(k % 3 == 1, "provider_error").otherwise("parse_error")).alias("failure_type"),
        F.col("value").alias("duration_ms"), F.col("ts").alias("created_at"), F.when(kind == "error", message).alias("error_message"), "props", "k",
    )


CALLS = """e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
calls AS (SELECT event_id AS id, user_id AS session_id, CASE WHEN k % 2 = 0 THEN 'assessment' ELSE 'question' END AS stage, CASE WHEN k % 10 = 0 THEN 'fallback' ELSE 'primary' END AS call_type,
 'p' || (k % 3) AS provider, 'm' || (k % 2) AS model, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'timeout' ELSE 'success' END AS status,
 CASE event_type WHEN 'view' THEN 'timeout' WHEN 'error' THEN CASE k % 3 WHEN 0 THEN 'schema_validation' WHEN 1 THEN 'provider_error' ELSE 'parse_error' END END AS failure_type,
 value AS duration_ms, ts AS created_at,
 CASE WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN 'HTTP 429: quota, reset in ' || k || ' seconds' WHEN 1 THEN 'Rate limit, reset in  ' || k || ' seconds' WHEN 2 THEN 'Deadline exceeded' ELSE 'Could not parse JSON' END END AS error_message, props, k FROM e)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("created_at"),
        F.when(status == "O", "initial_assessment").otherwise("post_questions_assessment").alias("stage"), F.when(status == "F", "story_plus_answers").otherwise("story_only").alias("scope"),
    )


RUNS = "runs AS (SELECT o_orderkey AS run_id, o_custkey AS session_id, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'O' THEN 'initial_assessment' ELSE 'post_questions_assessment' END AS stage, CASE WHEN o_orderstatus = 'F' THEN 'story_plus_answers' ELSE 'story_only' END AS scope FROM orders)"


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id and one hypothesis each."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_discount")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"), F.col("p_type").alias("bias_name"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_linenumber") % 3).alias("n_excerpts"))


HYPOTHESES = "hypotheses AS (SELECT l_orderkey AS run_id, l_linenumber AS line, p_type AS bias_name, l_discount * 10 AS confidence, l_linenumber % 3 AS n_excerpts FROM lineitem JOIN part ON l_partkey = p_partkey)"


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run with its hypotheses as an array, empty for runs without lines."""
    found = hypotheses(spark, sf_dir).groupBy("run_id").agg(F.collect_list(F.struct("bias_name", "confidence", F.expr("array_repeat(bias_name, CAST(n_excerpts AS INT))").alias("excerpts"))).alias("hypotheses"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id")).join(found, "run_id", "left").withColumn("hypotheses", F.coalesce("hypotheses", F.expr("CAST(array() AS array<struct<bias_name:string,confidence:double,excerpts:array<string>>>)")))


def stored_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run with its trace as the JSON that a store holds; hypotheses without excerpts lack the field, runs without lines have none."""
    found = hypotheses(spark, sf_dir).groupBy("run_id").agg(F.collect_list(F.struct("bias_name", "confidence", F.when(F.col("n_excerpts") > 0, F.expr("array_repeat(bias_name, CAST(n_excerpts AS INT))")).alias("supporting_excerpts"))).alias("bias_hypotheses"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id")).join(found, "run_id", "left").select("run_id", F.coalesce(F.when(F.size("bias_hypotheses") > 0, F.to_json(F.struct("bias_hypotheses"))), F.lit("{}")).alias("trace"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation results; rows without a label have no verdict."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, sf_dir, "labels")
    ident = F.col("doc_id")
    return docs.join(labels, "doc_id", "left").select(
        ident.alias("id"), F.col("source").alias("eval_run_id"), F.when(ident % 7 != 0, ident.cast("string")).alias("scenario_id"), F.col("lang").alias("dataset"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passed"),
        (F.col("n_chars") % 97).cast("string").alias("input_hash"), F.concat(F.lit("v"), (ident % 3).cast("string")).alias("prompt_version"),
        F.timestamp_add("MINUTE", ident.cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("run_at"), F.when(F.col("quality").isNotNull(), F.concat(F.lit('{"evidenceGroundedRate":'), (F.col("quality") * 0.5).cast("string"), F.lit(',"falsePositiveRate":null}'))).alias("evaluation_metrics"),
    )


RESULTS = """results AS (SELECT d.doc_id AS id, source AS eval_run_id, CASE WHEN d.doc_id % 7 <> 0 THEN d.doc_id::VARCHAR END AS scenario_id, lang AS dataset, quality = 1 AND toxic = 0 AS passed,
 (n_chars % 97)::VARCHAR AS input_hash, 'v' || (d.doc_id % 3) AS prompt_version, TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS run_at, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, questions (user turns) and answers (assistant turns) in order of turn."""
    turns = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda t: t["text"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns("user").alias("questions"), turns("assistant").alias("answers"))


DIALOGUES = """dialogues AS (SELECT conv_id, coalesce(list(text ORDER BY turn, text) FILTER (role = 'user'), []) AS questions, coalesce(list(text ORDER BY turn, text) FILTER (role = 'assistant'), []) AS answers FROM conversations GROUP BY conv_id)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names as entries: pos by name, category the last word, definition from the name."""
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("pos"))
    return names.select("pos", F.translate("p_name", " ", "-").alias("id"), F.col("p_name").alias("name"), F.element_at(F.split("p_name", " "), -1).alias("category"), F.concat(F.lit("A "), F.col("p_name"), F.lit(".")).alias("definition"))


CATALOG = "catalog AS (SELECT min(p_partkey) AS pos, replace(p_name, ' ', '-') AS id, p_name AS name, string_split(p_name, ' ')[-1] AS category, 'A ' || p_name || '.' AS definition FROM part GROUP BY p_name)"


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories (benchmark passages) with findings whose excerpts are the story's start, its reverse, nothing or blank."""
    text, ident = F.col("text"), F.col("item_id")
    entry = lambda e: F.struct(F.lit("story").alias("source"), e.alias("excerpt"), F.lit("x").alias("relevance"))
    none = F.expr("CAST(array() AS array<struct<source:string,excerpt:string,relevance:string>>)")
    bias = lambda name, confidence, evidence: F.struct(F.lit(name).alias("name"), confidence.cast("double").alias("confidence"), evidence.alias("evidence"))
    biases = F.array(bias("start", ident % 10 / 10, F.array(entry(F.concat(F.lit("  "), F.substring(text, 1, 20))))), bias("reversed", F.lit(None), F.array(entry(F.substring(text, 1, 10)), entry(F.reverse(F.substring(text, 1, 20))))), bias("none", F.lit(0.3), none), bias("blank", F.lit(0.5), F.array(entry(F.lit("  ")))))
    kept = F.slice(biases, F.lit(1), (ident % 5).cast("int"))
    return table(spark, sf_dir, "benchmark").select(ident.alias("id"), text.alias("story"), F.array(F.lit("an answer")).alias("answers"), kept.alias("biases"), (ident % 2 == 0).alias("is_neutral"), F.when(ident % 4 == 0, F.lit(0.35)).alias("threshold"), F.when(ident % 3 == 0, "story_only").otherwise("full").alias("mode"), F.when(ident % 6 < 4, ident % 6 < 2).alias("flag"), F.lit("trace").alias("reasoning_trace"))


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded calls of assessments: every seventh is cut off, and of those only the even ones have a valid fallback."""
    named = F.transform("biases", lambda b: F.struct(F.when(b["name"] == "start", "start bias!").otherwise(b["name"]).alias("name"), F.lit("An explanation.").alias("explanation"), F.lit("A connection.").alias("storyConnection"), F.lit("Another view.").alias("alternativePerspective"), b["evidence"].alias("evidence")))
    body = lambda flag: F.to_json(F.struct(named.alias("biases"), F.lit("Think about it again.").alias("reflectionPrompt"), flag.alias("noBiasDetected")))
    rows = assessments(spark, sf_dir).withColumn("body", body(F.col("flag"))).withColumn("second", body(F.lit(True)))
    cut = F.col("id") % 7 == 0
    return rows.select("id", "story", "answers", F.when(F.col("id") % 3 == 0, "story_only").otherwise("story_plus_answers").alias("scope"), F.lit("v1").alias("prompt_version"), F.lit("m").alias("model_name"), F.when(cut, F.expr("left(body, length(body) - 1)")).otherwise(F.concat(F.lit("So: "), "body", F.lit(" }"))).alias("raw_response"), F.when(cut & (F.col("id") % 2 == 0), F.col("second")).otherwise("{}").alias("fallback_response"))


def eval_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    neutral = F.col("item_id") % 2 == 0
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("A title").alias("title"), F.col("text").alias("story"), F.when(neutral, "no_bias").otherwise("golden").alias("dataset"), F.when(F.col("item_id") % 4 == 0, 0.7).otherwise(0.25).alias("threshold"))


def eval_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded outputs of the stories: some are missing, some are errors."""
    ident = F.col("id")
    return assessments(spark, sf_dir).where(ident % 13 > 0).select("id", "answers", "biases", F.when(ident % 11 == 0, "timeout").alias("error"), (ident % 5 == 0).alias("required_repair"), (ident % 10 == 0).alias("repair_succeeded"))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluated stories for the gate: one per event."""
    c = calls(spark, sf_dir)
    k = F.col("k")
    return c.select(
        F.when(k % 4 == 0, "no_bias").otherwise("golden").alias("dataset"), F.when(F.col("status") == "success", k / 100).alias("grounded_rate"), ((k % 8 == 0) & (F.col("status") == "success")).alias("false_positive"),
        F.when(F.col("status") == "error", F.col("error_message")).alias("error"), (k % 5 == 0).alias("required_repair"), F.when(k % 5 == 0, F.when(k % 15 != 0, k % 2 == 0)).alias("repair_succeeded"),
    )


EVALUATED = CALLS + """,
evaluated AS (SELECT CASE WHEN k % 4 = 0 THEN 'no_bias' ELSE 'golden' END AS dataset, CASE WHEN status = 'success' THEN k / 100.0::DOUBLE END AS grounded_rate, k % 8 = 0 AND status = 'success' AS false_positive,
 CASE WHEN status = 'error' THEN error_message END AS error, k % 5 = 0 AS required_repair, CASE WHEN k % 15 <> 0 AND k % 5 = 0 THEN k % 2 = 0 END AS repair_succeeded FROM calls)"""
