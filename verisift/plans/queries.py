"""One query for each operator over the driver's tables, with its oracle in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import flows
from ..functions import classify, evidence, jsontext, text
from ..operators import contracts, hygiene, lookup, metrics, store
from ..operators import evidence as grounding
from ..sources import stories
from . import standins as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
START, END = datetime(2024, 1, 5), datetime(2024, 1, 20, 12)
BETWEEN = "created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def simple(name: str, f: Query, sql: str | None = None) -> None:
    query(name, sql)(f)


# --- calls -----------------------------------------------------------------

CALL = ["id", "session_id", "stage", "provider", "status", "duration_ms"]
_CALL = ", ".join(CALL)
MEASURES = """count(*) AS total, CAST(coalesce(count_if(call_type = 'primary'), 0) AS BIGINT) AS "primary", round(coalesce(avg(duration_ms), 0), 6) AS avg_ms,
 round(coalesce(quantile_cont(duration_ms, 0.5), 0), 6) AS p50_ms, round(coalesce(quantile_cont(duration_ms, 0.95), 0), 6) AS p95_ms, round(coalesce(quantile_cont(duration_ms, 0.99), 0), 6) AS p99_ms,
 round(coalesce(count_if(status = 'success') / nullif(count(*), 0)::DOUBLE, 0), 6) AS success_rate, round(coalesce(count_if(status = 'timeout') / nullif(count(*), 0)::DOUBLE, 0), 6) AS timeout_rate,
 round(coalesce(count_if(call_type = 'fallback') / nullif(count_if(call_type = 'primary'), 0)::DOUBLE, 0), 6) AS fallback_rate,
 round(coalesce(count_if(failure_type = 'schema_validation') / nullif(count(*), 0)::DOUBLE, 0), 6) AS schema_rate, round(coalesce(count_if(failure_type = 'provider_error') / nullif(count(*), 0)::DOUBLE, 0), 6) AS provider_rate,
 round(coalesce(count_if(failure_type = 'parse_error') / nullif(count(*), 0)::DOUBLE, 0), 6) AS parse_rate"""

simple("calls_by_session", lambda s, d: store.in_order(store.where_equal(S.calls(s, d), session_id=8), "created_at", "id").select(*CALL), f"WITH {S.CALLS} SELECT {_CALL} FROM calls WHERE session_id = 8 ORDER BY created_at, id")
simple("calls_by_stage", lambda s, d: store.in_order(store.where_equal(S.calls(s, d), stage="assessment"), "created_at", "id").select(*CALL), f"WITH {S.CALLS} SELECT {_CALL} FROM calls WHERE stage = 'assessment' ORDER BY created_at, id")
simple("calls_by_provider", lambda s, d: store.in_order(store.where_equal(S.calls(s, d), provider="p1"), "created_at", "id").select(*CALL), f"WITH {S.CALLS} SELECT {_CALL} FROM calls WHERE provider = 'p1' ORDER BY created_at, id")
simple("calls_by_session_stage", lambda s, d: store.in_order(store.where_equal(S.calls(s, d), session_id=8, stage="question", provider=""), "created_at", "id").select(*CALL), f"WITH {S.CALLS} SELECT {_CALL} FROM calls WHERE session_id = 8 AND stage = 'question' ORDER BY created_at, id")
simple("calls_for_metrics", lambda s, d: store.calls_between(S.calls(s, d), None, None, model="m1").select(*CALL), f"WITH {S.CALLS} SELECT {_CALL} FROM calls WHERE model = 'm1' AND created_at BETWEEN (SELECT max(ts) - INTERVAL 30 DAY FROM events) AND (SELECT max(ts) FROM events)")
simple("calls_for_metrics_oldest", lambda s, d: store.calls_between(S.calls(s, d), START, END, oldest=1000, stage="question").select(*CALL), f"WITH {S.CALLS} SELECT {_CALL} FROM calls WHERE stage = 'question' AND {BETWEEN} ORDER BY created_at, id LIMIT 1000")
simple("reliability_overall", lambda s, d: metrics.reliability(store.calls_between(S.calls(s, d), START, END)), f"WITH {S.CALLS} SELECT {MEASURES} FROM calls WHERE {BETWEEN}")
simple("reliability_by_selection", lambda s, d: metrics.exact_percentiles(store.calls_between(S.calls(s, d), START, END), "duration_ms", [0.5, 0.95, 0.99], "provider", "stage").select("provider", "stage", *[F.round(F.get("percentiles", F.lit(k)), 6).alias(n) for k, n in enumerate(("p50_ms", "p95_ms", "p99_ms"))]), f"WITH {S.CALLS} SELECT provider, stage, round(quantile_cont(duration_ms, 0.5), 6) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms, round(quantile_cont(duration_ms, 0.99), 6) AS p99_ms FROM calls WHERE {BETWEEN} GROUP BY ALL")
simple("reliability_by_dims", lambda s, d: metrics.reliability(store.calls_between(S.calls(s, d), START, END), "provider", "model", "stage"), f"WITH {S.CALLS} SELECT provider, model, stage, {MEASURES} FROM calls WHERE {BETWEEN} GROUP BY ALL")
simple("reliability_empty", lambda s, d: metrics.reliability(store.where_equal(S.calls(s, d), stage="absent")), f"WITH {S.CALLS} SELECT {MEASURES} FROM calls WHERE stage = 'absent'")
simple("classify_failure", lambda s, d: S.calls(s, d).where("error_message IS NOT NULL").select("id", classify.repair_failure(F.col("error_message")).alias("failure"), classify.call_status(F.when(F.col("k") % 2 == 0, "TimeoutError").otherwise("Error"))["failure_type"].alias("status_type")), f"WITH {S.CALLS} SELECT id, CASE WHEN regexp_matches(lower(error_message), 'parse|json') THEN 'parse_error' ELSE 'schema_validation' END AS failure, CASE WHEN k % 2 = 0 THEN 'timeout' ELSE 'provider_error' END AS status_type FROM calls WHERE error_message IS NOT NULL")
simple("classify_provider_error", lambda s, d: S.calls(s, d).where("error_message IS NOT NULL").select("id", classify.provider_error(F.col("error_message"), F.when(F.col("k") % 8 == 2, 429), F.col("created_at")).alias("e")).select("id", "e.*"), f"WITH {S.CALLS} SELECT id, CASE WHEN k % 4 < 2 OR k % 8 = 2 THEN 'rate_limit' WHEN k % 4 = 2 THEN 'timeout' ELSE 'other' END AS kind, CASE WHEN k % 4 = 0 THEN 'daily' WHEN k % 4 = 1 OR k % 8 = 2 THEN 'per-minute' END AS limit_type, CASE WHEN k % 4 < 2 THEN k::BIGINT END AS reset_seconds, CASE WHEN k % 4 < 2 THEN created_at + to_seconds(k) END AS reset_at FROM calls WHERE error_message IS NOT NULL")
simple("call_duration", lambda s, d: S.calls(s, d).select("id", classify.duration_ms(F.col("created_at"), F.timestamp_add("MILLISECOND", (F.col("duration_ms") * 100).cast("int"), F.col("created_at"))).alias("ms")), f"WITH {S.CALLS} SELECT id, CAST(trunc(duration_ms * 100) AS BIGINT) AS ms FROM calls")
simple("backoff_schedule", lambda s, d: S.calls(s, d).select((F.col("k") % 4 + 1).alias("attempt")).distinct().select("attempt", classify.backoff_ms(F.col("attempt")).alias("delay_ms")), f"WITH {S.CALLS} SELECT DISTINCT k % 4 + 1 AS attempt, CAST(2000 * 2 ** (k % 4) AS BIGINT) AS delay_ms FROM calls")
simple("props_json_roundtrip", lambda s, d: S.calls(s, d).select("id", F.to_json(F.from_json("props", "k int")).alias("json")), "SELECT event_id AS id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS json FROM events")


@query("apply_parsed_updates", f"WITH {S.CALLS} SELECT id, CASE WHEN id % 5 = 0 THEN '{{\"fixed\":' || k || '}}' ELSE props END AS props FROM calls")
def apply_parsed_updates(s: SparkSession, d: str) -> DataFrame:
    base = S.calls(s, d)
    updates = base.where("id % 5 = 0").select("id", F.concat(F.lit('{"fixed":'), F.col("k").cast("string"), F.lit("}")).alias("props"))
    return store.overlay(base.select("id", "props"), updates, "id", ["props"])


@query("apply_failure_updates", f"WITH {S.CALLS} SELECT id, CASE WHEN id % 9 = 0 THEN 'error' ELSE status END AS status, CASE WHEN id % 9 = 0 THEN 'parse_error' ELSE failure_type END AS failure_type, CASE WHEN id % 9 <> 0 THEN error_message END AS error_message FROM calls")
def apply_failure_updates(s: SparkSession, d: str) -> DataFrame:
    base = S.calls(s, d).select("id", "status", "failure_type", "error_message")
    updates = base.where("id % 9 = 0").select("id", F.lit("error").alias("status"), F.lit("parse_error").alias("failure_type"), F.lit(None).cast("string").alias("error_message"))
    return store.overlay(base, updates, "id", ["status", "failure_type", "error_message"])


# --- runs, traces, results -------------------------------------------------

simple("append_runs", lambda s, d: store.with_defaults(S.runs(s, d).select("session_id", "stage", "created_at"), "id", "created_at"))
simple("runs_with_traces", lambda s, d: S.runs(s, d).join(S.traces(s, d), "run_id").select("run_id", "stage", F.size("hypotheses").cast("long").alias("n")), f"WITH {S.RUNS}, {S.HYPOTHESES} SELECT run_id, stage, count(bias_name) AS n FROM runs LEFT JOIN hypotheses USING (run_id) GROUP BY ALL")
simple("trace_by_run", lambda s, d: store.first_or_none(S.hypotheses(s, d).where("run_id = 7"), "line", "bias_name", "confidence").select("run_id", "line", "bias_name"), f"WITH {S.HYPOTHESES} SELECT run_id, line, bias_name FROM hypotheses WHERE run_id = 7 ORDER BY line, bias_name, confidence LIMIT 1")
simple("fk_cascade", lambda s, d: store.cascade(S.hypotheses(s, d), S.runs(s, d).where("stage = 'initial_assessment'"), "run_id").groupBy("run_id").agg(F.count("*").alias("n")), f"WITH {S.RUNS}, {S.HYPOTHESES} SELECT run_id, count(*) AS n FROM hypotheses WHERE run_id IN (SELECT run_id FROM runs WHERE stage = 'initial_assessment') GROUP BY run_id")
simple("eval_run_aggregates", lambda s, d: store.run_aggregates(S.results(s, d)), f"WITH {S.RESULTS} SELECT eval_run_id, count(*) AS n, CAST(coalesce(count_if(passed), 0) AS BIGINT) AS n_passed, min(run_at) AS first_run_at FROM results WHERE eval_run_id IS NOT NULL GROUP BY eval_run_id")
simple("latest_results", lambda s, d: store.latest(S.results(s, d).where("prompt_version = 'v1'"), 20).select("id", "run_at", "passed"), f"WITH {S.RESULTS} SELECT id, run_at, passed FROM results WHERE prompt_version = 'v1' ORDER BY run_at DESC, id DESC LIMIT 20")
simple("result_by_hash", lambda s, d: store.first_or_none(store.where_equal(S.results(s, d), input_hash="5", prompt_version="v1"), "run_at", "id").select("id", "eval_run_id", "passed"), f"WITH {S.RESULTS} SELECT id, eval_run_id, passed FROM results WHERE input_hash = '5' AND prompt_version = 'v1' ORDER BY run_at, id LIMIT 1")
simple("determinism_conflicts", lambda s, d: store.conflicts(S.results(s, d)), f"WITH {S.RESULTS} SELECT input_hash, prompt_version, CAST(coalesce(count_if(passed), 0) AS BIGINT) AS n_passed, CAST(coalesce(count_if(NOT passed), 0) AS BIGINT) AS n_failed FROM results WHERE passed IS NOT NULL GROUP BY ALL HAVING count_if(passed) > 0 AND count_if(NOT passed) > 0")
simple("backfill_scenario", lambda s, d: S.results(s, d).select("id", F.coalesce("scenario_id", F.lit("legacy")).alias("scenario_id")), f"WITH {S.RESULTS} SELECT id, coalesce(scenario_id, 'legacy') AS scenario_id FROM results")
simple("eval_metrics_validated", lambda s, d: S.results(s, d).select("id", F.from_json("evaluation_metrics", "evidenceGroundedRate double, falsePositiveRate double", {"mode": "FAILFAST"}).alias("m")).select("id", F.col("m.evidenceGroundedRate").alias("grounded"), F.coalesce(F.col("m.evidenceGroundedRate").between(0, 1), F.lit(True)).alias("valid")), f"WITH {S.RESULTS} SELECT id, quality * 0.5::DOUBLE AS grounded, true AS valid FROM results")
simple("trace_analytics", lambda s, d: metrics.trace_analytics(S.traces(s, d)), f"""WITH {S.HYPOTHESES}, t AS (SELECT o_orderkey AS run_id, count(bias_name) AS n, coalesce(sum(confidence), 0) AS c, coalesce(sum(n_excerpts), 0) AS e, coalesce(count_if(n_excerpts > 0), 0) AS v FROM orders LEFT JOIN hypotheses ON run_id = o_orderkey GROUP BY 1)
SELECT count(*) AS traces, CAST(coalesce(count_if(n > 0), 0) AS BIGINT) AS with_bias, round(sum(n) / count(*), 6) AS avg_hypotheses, round(sum(c) / sum(n), 6) AS avg_confidence, round(sum(e) / sum(n), 6) AS avg_excerpts, round(sum(v) / sum(n), 6) AS coverage FROM t""")
simple("trace_analytics_stored", lambda s, d: metrics.trace_analytics(metrics.read_traces(S.stored_traces(s, d))), ORACLES["trace_analytics"])
simple("bias_distribution", lambda s, d: metrics.bias_distribution(S.traces(s, d)), f"WITH {S.HYPOTHESES} SELECT bias_name, count(*) AS n FROM hypotheses WHERE run_id IN (SELECT o_orderkey FROM orders) GROUP BY bias_name")
simple("distinct_biases", lambda s, d: metrics.distinct_biases(S.traces(s, d)), f"WITH {S.HYPOTHESES} SELECT count(DISTINCT bias_name) AS distinct_biases FROM hypotheses WHERE run_id IN (SELECT o_orderkey FROM orders)")
simple("validate_run_stage_scope", lambda s, d: S.runs(s, d).select("run_id", F.array_join(contracts.run(F.col("stage"), F.col("scope")), ",").alias("violations")), f"WITH {S.RUNS} SELECT run_id, CASE WHEN (stage = 'initial_assessment') = (scope = 'story_only') THEN '' ELSE 'scope_inconsistent' END AS violations FROM runs")
simple("validate_hypothesis", lambda s, d: S.hypotheses(s, d).select("run_id", "line", "confidence", F.array_join(contracts.hypothesis(F.col("bias_name"), F.col("confidence"), F.col("n_excerpts")), ",").alias("violations")), f"WITH {S.HYPOTHESES} SELECT run_id, line, confidence, concat_ws(',', CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence_out_of_range' END, CASE WHEN confidence < 0.8 AND n_excerpts = 0 THEN 'reasons_required' END) AS violations FROM hypotheses")
simple("eval_gate", lambda s, d: metrics.evaluation_gate(S.evaluated(s, d)), f"""WITH {S.EVALUATED}, r AS (SELECT count(*) AS n_stories, count(error) AS n_errors, avg(grounded_rate) FILTER (error IS NULL) AS grounded, count_if(dataset = 'no_bias' AND false_positive) / nullif(count_if(dataset = 'no_bias'), 0)::DOUBLE AS false_positive,
 count_if(NOT required_repair) / count(*)::DOUBLE AS schema_parse, count_if(required_repair AND coalesce(repair_succeeded, false)) / nullif(count_if(required_repair), 0)::DOUBLE AS repair FROM evaluated)
SELECT n_stories, n_errors, round(grounded, 6) AS grounded, round(false_positive, 6) AS false_positive, round(schema_parse, 6) AS schema_parse, round(repair, 6) AS repair,
 coalesce(grounded >= 0.9, true) AND coalesce(false_positive <= 0.1, true) AND coalesce(schema_parse >= 0.95, true) AND coalesce(repair <= 0.05, true) AS passed FROM r""")
simple("system_metrics", lambda s, d: metrics.system_metrics(S.evaluated(s, d)), f"""WITH {S.EVALUATED} SELECT count(*) AS total, CAST(coalesce(count_if(NOT required_repair), 0) AS BIGINT) AS parse_passes, round(count_if(NOT required_repair) / count(*)::DOUBLE, 6) AS parse_rate, CAST(coalesce(count_if(required_repair), 0) AS BIGINT) AS repair_attempts,
 CAST(coalesce(count_if(required_repair AND coalesce(repair_succeeded, false)), 0) AS BIGINT) AS repair_successes, round(count_if(required_repair AND coalesce(repair_succeeded, false)) / nullif(count_if(required_repair), 0)::DOUBLE, 6) AS repair_rate FROM evaluated""")
simple("dataset_run_counts", lambda s, d: metrics.run_counts(S.evaluated(s, d)), f"WITH {S.EVALUATED} SELECT dataset, count(*) AS total, CAST(coalesce(count_if(error IS NULL), 0) AS BIGINT) AS succeeded, count(error) AS failed FROM evaluated GROUP BY dataset")

# --- stories, evidence -----------------------------------------------------


def story_texts(s: SparkSession, d: str, neutral: bool) -> DataFrame:
    """Story files' texts: benchmark passages of even ids are neutral stories, with the fields of their kind alone."""
    rows = S.table(s, d, "benchmark").where(F.col("item_id") % 2 == (0 if neutral else 1))
    common = [F.concat(F.lit("s"), F.col("item_id").cast("string")).alias("id"), F.lit("A title").alias("title"), F.col("text").alias("story"), F.array(F.lit("x")).alias("tags")]
    own = [F.lit(True).alias("isNoBias"), F.when(F.col("item_id") % 4 == 0, 0.7).alias("confidenceThreshold")] if neutral else [F.lit(2).alias("expectedMinBiases"), F.array(F.lit(2), F.lit(5)).alias("expectedQuestionsCountRange")]
    return rows.select(F.to_json(F.struct(*common, *own)).alias("json"))




def _stories(s: SparkSession, d: str, neutral: bool) -> DataFrame:
    found = stories.parse_stories(story_texts(s, d, neutral))
    return found.select("id", "story", "isNoBias", "expectedMinBiases", F.coalesce("confidenceThreshold", F.lit(evidence.THRESHOLD)).alias("threshold"))


_STORY_SQL = "SELECT 's' || item_id AS id, text AS story, CASE WHEN item_id % 2 = 0 THEN true END AS \"isNoBias\", CASE WHEN item_id % 2 = 1 THEN 2 END AS \"expectedMinBiases\", CASE WHEN item_id % 4 = 0 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS threshold FROM benchmark"
simple("scan_stories", lambda s, d: _stories(s, d, True), f"{_STORY_SQL} WHERE item_id % 2 = 0")
simple("union_datasets", lambda s, d: _stories(s, d, True).withColumn("dataset", F.lit("no_bias")).unionByName(_stories(s, d, False).withColumn("dataset", F.lit("golden")), allowMissingColumns=True), f"SELECT *, CASE WHEN \"isNoBias\" THEN 'no_bias' ELSE 'golden' END AS dataset FROM ({_STORY_SQL})")
simple("sample_story", lambda s, d: stories.sample_story(_stories(s, d, False), 7).select("id"))
simple("validate_story_length", lambda s, d: S.table(s, d, "documents").select("doc_id", F.array_join(contracts.story(F.col("text")), ",").alias("violations")), "SELECT doc_id, CASE WHEN text IS NULL THEN 'story_missing' WHEN length(text) < 50 THEN 'story_too_short' WHEN length(text) > 3000 THEN 'story_too_long' ELSE '' END AS violations FROM documents")
simple("evidence_grounded_rate", lambda s, d: S.assessments(s, d).select("id", F.round(evidence.grounded_rate(F.col("biases"), F.col("story"), F.col("answers")), 6).alias("rate")), "SELECT item_id AS id, CASE WHEN item_id % 5 > 0 THEN round((1 + CASE WHEN item_id % 5 > 1 AND contains(text, trim(reverse(text[1:20]))) THEN 1 ELSE 0 END) / (item_id % 5)::DOUBLE, 6) END AS rate FROM benchmark")
simple("false_positive_flag", lambda s, d: S.assessments(s, d).select("id", evidence.false_positive(F.col("biases"), F.col("is_neutral"), F.col("threshold")).alias("f")).select("id", evidence.flag_code(F.col("f")).alias("flag"), evidence.flag_code(F.when(F.col("id") % 3 > 0, F.col("f")), null_as_zero=True).alias("flag_or_zero")), "SELECT *, CASE WHEN id % 3 > 0 THEN flag ELSE 0 END AS flag_or_zero FROM (SELECT item_id AS id, CASE WHEN item_id % 2 = 1 THEN 0 WHEN item_id % 5 = 0 THEN 0 WHEN item_id % 5 > 1 THEN 1 WHEN item_id % 10 / 10.0::DOUBLE > CASE WHEN item_id % 4 = 0 THEN 0.35 ELSE 0.5 END THEN 1 ELSE 0 END AS flag FROM benchmark)")
simple("evidence_violations", lambda s, d: grounding.violations(S.assessments(s, d)).select("id", "bias_name", "excerpt", "violation"), """SELECT id, bias_name, excerpt, violation FROM (
 SELECT item_id AS id, 'reversed' AS bias_name, reverse(text[1:20]) AS excerpt, 'excerpt_not_in_input' AS violation FROM benchmark WHERE item_id % 5 > 1 AND NOT contains(text, trim(reverse(text[1:20])))
 UNION ALL SELECT item_id, 'none', '', 'no_evidence_entries' FROM benchmark WHERE item_id % 5 > 2
 UNION ALL SELECT item_id, 'blank', '  ', 'empty_excerpt' FROM benchmark WHERE item_id % 5 > 3)""")
simple("no_bias_flag", lambda s, d: S.assessments(s, d).select("id", grounding.no_bias_flag(F.col("flag"), F.size("biases")).alias("flag")), "SELECT item_id AS id, CASE WHEN item_id % 5 = 0 THEN true WHEN item_id % 6 < 4 THEN item_id % 6 < 2 ELSE false END AS flag FROM benchmark")
simple("assessment_public_view", lambda s, d: grounding.public_view(S.assessments(s, d).select("id", "mode", "reasoning_trace"), "v1", "m1"), "SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN 'story_only' ELSE 'full' END AS mode, 'v1' AS prompt_version, 'm1' AS model_name, CASE WHEN item_id % 3 = 0 THEN 'story-only' ELSE 'full' END AS input_context FROM benchmark")
@query("reasoning_context", """SELECT item_id AS id, CASE WHEN c = '' THEN 'STORY: ' || text ELSE 'REASONING CONTEXT:' || chr(10) || c || chr(10) || chr(10) || 'STORY: ' || text END AS prompt FROM (
 SELECT item_id, text, CASE WHEN item_id % 3 > 0 THEN 'Themes: one, two' || chr(10) || 'Emotional tone: calm' || chr(10) || 'Key events: x' || chr(10) ELSE '' END || CASE item_id % 5 WHEN 0 THEN ''
 WHEN 1 THEN chr(10) || 'Plausible interpretations:' || chr(10) || '1. start (plausibility: 0)' ELSE chr(10) || 'Plausible interpretations:' || chr(10) || '1. start (plausibility: 0)' || chr(10) || '2. reversed (plausibility: 1)' END AS c FROM benchmark)""")
def reasoning_context(s: SparkSession, d: str) -> DataFrame:
    analysis = F.when(F.col("id") % 3 > 0, F.struct(F.array(F.lit("one"), F.lit("two")).alias("themes"), F.lit("calm").alias("emotional_tone"), F.array(F.lit("x")).alias("key_events")))
    read = F.transform("biases", lambda b, k: F.struct(b["name"].alias("interpretation"), k.alias("plausibility")))
    return S.assessments(s, d).select("id", grounding.question_prompt(F.col("story"), grounding.context(analysis, read)).alias("prompt"))


simple("render_prompt", lambda s, d: S.table(s, d, "benchmark").select("item_id", text.render(F.lit("Read {{story}} and {{story}} by {{who}}."), {"story": F.col("text"), "who": F.col("item_id").cast("string"), "none": F.lit("x")}).alias("prompt")), "SELECT item_id, 'Read ' || text || ' and {{story}} by ' || item_id || '.' AS prompt FROM benchmark")
simple("qa_pairs", lambda s, d: S.dialogues(s, d).select("conv_id", grounding.paired(F.col("questions"), F.col("answers")).alias("qa")), f"WITH {S.DIALOGUES} SELECT conv_id, array_to_string(list_transform(questions, lambda q, i: 'Q: ' || q || chr(10) || 'A: ' || coalesce(answers[i], 'undefined')), chr(10) || chr(10)) AS qa FROM dialogues")
simple("qa_length_mismatch", lambda s, d: S.dialogues(s, d).select("conv_id", F.array_join(contracts.full_mode(F.size("questions"), F.size("answers")), ",").alias("violations")), f"WITH {S.DIALOGUES} SELECT conv_id, concat_ws(',', CASE WHEN len(questions) = 0 THEN 'no_questions' END, CASE WHEN len(answers) = 0 THEN 'no_answers' END, CASE WHEN len(questions) <> len(answers) THEN 'length_mismatch' END) AS violations FROM dialogues")
simple("input_hash", lambda s, d: S.dialogues(s, d).select("conv_id", text.input_hash(F.lit("v1"), F.lit("m"), F.get("questions", F.lit(0)), F.col("answers")).alias("hash")), f"WITH {S.DIALOGUES} SELECT conv_id, sha256(array_to_string(list_concat(['v1', 'm', coalesce(questions[1], '')], answers), chr(10) || chr(10))) AS hash FROM dialogues")
simple("pii_scan_lines", lambda s, d: hygiene.scan(S.table(s, d, "documents"), "doc_id", "text"), r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS t FROM l),
f AS (SELECT doc_id, line, 'longDigitSequence' AS pattern, unnest(regexp_extract_all(t, '\d{10,}')) AS match FROM x UNION ALL SELECT doc_id, line, 'email', unnest(regexp_extract_all(t, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) FROM x)
SELECT doc_id, CAST(line AS INTEGER) AS line, pattern, match FROM f""")
simple("grounded_docs", lambda s, d: lookup.keep_if(S.table(s, d, "documents").select("doc_id"), lookup.containing(S.table(s, d, "documents"), S.table(s, d, "benchmark")), "doc_id", True), "SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM benchmark b WHERE b.text <> '' AND contains(documents.text, b.text))")
simple("ungrounded_docs", lambda s, d: lookup.keep_if(S.table(s, d, "documents").select("doc_id"), lookup.containing(S.table(s, d, "documents"), S.table(s, d, "benchmark")), "doc_id", False), "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text <> '' AND contains(documents.text, b.text))")

# --- catalog and labels ----------------------------------------------------


def labels(s: SparkSession, d: str) -> DataFrame:
    """Part names, as they are or perturbed: upper case, a letter doubled, the last word alone."""
    name, k = F.col("p_name"), F.col("p_partkey") % 4
    return S.table(s, d, "part").select(F.when(k == 0, name).when(k == 1, F.concat(F.upper(name), F.lit("!"))).when(k == 2, F.concat(name, F.lit("s of all"))).otherwise(F.element_at(F.split(name, " "), -1)).alias("label"))


LABELS = "labels_ AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || '!' WHEN 2 THEN p_name || 's of all' ELSE string_split(p_name, ' ')[-1] END AS label FROM part)"
PLAIN = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
OVERLAP = r"len(list_filter(string_split_regex({1}, '\s+'), lambda t: list_contains(string_split_regex({0}, '\s+'), t))) / len(list_distinct(list_concat(string_split_regex({0}, '\s+'), string_split_regex({1}, '\s+'))))::DOUBLE"
EDIT = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 0 ELSE levenshtein({0}, {1}) / greatest(length({0}), length({1}))::DOUBLE END"
PAIRS = f"""{LABELS}, {S.CATALOG}, pairs AS (SELECT label, {PLAIN.format("label")} AS p, pos, id, name, {PLAIN.format("name")} AS q FROM labels_, catalog)"""

simple("normalize_label", lambda s, d: labels(s, d).select("label").distinct().select("label", text.normalize_label(F.col("label")).alias("plain")), f"WITH {LABELS} SELECT label, {PLAIN.format('label')} AS plain FROM labels_")
simple("token_overlap", lambda s, d: _scored(s, d, text.token_overlap), f"WITH n AS (SELECT DISTINCT p_name, p_type FROM part) SELECT p_name, p_type, round({OVERLAP.format('lower(p_name)', 'lower(p_type)')}, 6) AS score FROM n")
simple("jaccard", lambda s, d: _scored(s, d, lambda a, b: text.jaccard(text.tokens(a), text.tokens(b))), f"WITH n AS (SELECT DISTINCT p_name, p_type FROM part) SELECT p_name, p_type, round({OVERLAP.format('lower(p_type)', 'lower(p_name)')}, 6) AS score FROM n")
simple("edit_distance", lambda s, d: _scored(s, d, text.edit_distance), f"WITH n AS (SELECT DISTINCT p_name, p_type FROM part) SELECT p_name, p_type, round({EDIT.format('p_name', 'p_type')}, 6) AS score FROM n")


def _scored(s: SparkSession, d: str, score: Callable) -> DataFrame:
    return S.table(s, d, "part").select("p_name", "p_type").distinct().select("p_name", "p_type", F.round(score(F.col("p_name"), F.col("p_type")), 6).alias("score"))


simple("fuzzy_best_match", lambda s, d: lookup.best_matches(labels(s, d), S.catalog(s, d)), f"""WITH {PAIRS}, c AS (SELECT *, round(0.6::DOUBLE * ({OVERLAP.format('p', 'q')}) + 0.4::DOUBLE * (1 - ({EDIT.format('p', 'q')})), 9) AS confidence FROM pairs WHERE p <> ''),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY confidence DESC, pos) = 1)
SELECT label, name AS matched, confidence, CASE WHEN confidence > 0.5 THEN id END AS catalog_id, CASE WHEN confidence > 0.5 THEN name ELSE label END AS normalized FROM b""")
simple("catalog_by_category", lambda s, d: lookup.grouped(S.catalog(s, d)).select("category", F.array_join("names", "|").alias("names")), f"WITH {S.CATALOG} SELECT category, string_agg(name, '|' ORDER BY pos) AS names FROM catalog GROUP BY category")
simple("catalog_categories", lambda s, d: lookup.categories(S.catalog(s, d)), f"WITH {S.CATALOG} SELECT category, min(pos) AS first_pos FROM catalog GROUP BY category")
simple("catalog_shortlist", lambda s, d: lookup.shortlist(S.catalog(s, d)), f"WITH {S.CATALOG} SELECT string_agg('- ' || name || ': ' || definition, chr(10) ORDER BY pos) AS shortlist FROM catalog")

# --- recovered JSON --------------------------------------------------------


def responses(s: SparkSession, d: str) -> DataFrame:
    """Call payloads as models wrap them (prose with a stray brace, a code fence, an array, a cut-off object), with numbers for strings, faults within lists, explicit nulls."""
    k = F.col("k")
    name = F.when(k % 6 == 5, "5").otherwise('"a } \\" b"')
    value = F.when(k % 7 == 0, '"none"').otherwise(k.cast("string"))
    items = F.concat(F.lit('[{"n":"x","w":'), k.cast("string"), F.lit("}"), F.when(k % 3 == 0, ',{"n":2}').otherwise(""), F.lit("]"))
    trace = F.when(k % 4 == 0, ',"reasoning_trace":"old"').when(k % 4 == 1, ',"reasoningTrace":null,"reasoning_trace":"old"').otherwise("")
    c = S.calls(s, d).withColumn("body", F.concat(F.lit('{"name":'), name, F.lit(',"value":'), value, F.lit(',"items":'), items, trace, F.lit("}")))
    k = k % 5
    wrapped = F.when(k == 0, F.concat(F.lit("Sure } here: "), F.col("body"), F.lit(" Hope it helps }"))).when(k == 1, F.concat(F.lit("```json\n"), F.col("body"), F.lit("\n```"))).when(k == 2, F.concat(F.lit("List ["), F.col("body"), F.lit("] and more ]"))).when(k == 3, F.concat(F.lit("So "), F.expr("left(body, length(body) - 1)"))).otherwise(F.lit("  no structure "))
    return c.select("id", "k", wrapped.alias("raw"))


BODY = r"""body AS (SELECT id, k, '{"name":' || CASE WHEN k % 6 = 5 THEN '5' ELSE '"a } \" b"' END || ',"value":' || CASE WHEN k % 7 = 0 THEN '"none"' ELSE k::VARCHAR END
 || ',"items":[{"n":"x","w":' || k || '}' || CASE WHEN k % 3 = 0 THEN ',{"n":2}' ELSE '' END || ']' || CASE k % 4 WHEN 0 THEN ',"reasoning_trace":"old"' WHEN 1 THEN ',"reasoningTrace":null,"reasoning_trace":"old"' ELSE '' END || '}' AS body FROM calls)"""
ITEM = T.StructType([T.StructField("n", T.StringType(), False), T.StructField("w", T.DoubleType())])
RECORD = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.IntegerType()), T.StructField("items", T.ArrayType(ITEM)), T.StructField("reasoningTrace", T.StringType())])
RULES = {"name": lambda c: F.length(c) >= 1}
simple("extract_json", lambda s, d: jsontext.with_json(responses(s, d), "raw").select("id", "json"), f"WITH {S.CALLS}, {BODY} SELECT id, CASE k % 5 WHEN 2 THEN '[' || body || ']' WHEN 3 THEN left(body, length(body) - 1) WHEN 4 THEN 'no structure' ELSE body END AS json FROM body")
simple("repair_json", lambda s, d: jsontext.with_record(responses(s, d), "raw", RECORD, RULES).select("id", F.col("record").isNotNull().alias("repaired"), "record.name", "record.value", F.size("record.items").alias("n_items"), F.col("record.reasoningTrace").alias("trace")), f"""WITH {S.CALLS}, {BODY} SELECT id, k % 5 < 3 AS repaired, CASE WHEN k % 5 < 2 AND k % 6 <> 5 THEN 'a }} " b' END AS name, CASE WHEN k % 5 < 2 AND k % 7 <> 0 THEN k END AS value, CASE WHEN k % 5 < 2 AND k % 3 <> 0 THEN 1 END AS n_items, CASE WHEN k % 5 < 2 AND k % 4 = 0 THEN 'old' END AS trace FROM body""")
@query("repair_fallback", f"""WITH {S.CALLS}, {BODY} SELECT id, CASE WHEN k % 5 < 3 THEN 'primary' WHEN k % 4 = 0 THEN 'fallback' ELSE 'failed' END AS source, CASE WHEN k % 5 < 2 AND k % 6 <> 5 THEN 'a }} " b' WHEN k % 5 > 2 AND k % 4 = 0 THEN 'second' END AS name FROM body""")
def repair_fallback(s: SparkSession, d: str) -> DataFrame:
    """A fallback must be valid as it stands: not in prose, no field of another type or missing."""
    k = F.col("k") % 4
    second = F.when(k == 0, '{"name":"second","value":1}').when(k == 1, '{"name":"second"}').when(k == 2, '{"name":"second","value":"1"}').otherwise('Here: {"name":"second","value":1}')
    found = jsontext.with_fallback(responses(s, d).withColumn("second", second), "raw", "second", RECORD, ["name", "value"], RULES)
    return found.select("id", "source", "record.name")


# --- composed flows --------------------------------------------------------

simple("normalize_bias_names", lambda s, d: lookup.normalize_names(labels(s, d), S.catalog(s, d)), f"""WITH {PAIRS}, c AS (SELECT *, round(0.6::DOUBLE * ({OVERLAP.format('p', 'q')}) + 0.4::DOUBLE * (1 - ({EDIT.format('p', 'q')})), 9) AS confidence FROM pairs),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY confidence DESC, pos) = 1)
SELECT label, CASE WHEN p <> '' AND confidence > 0.5 THEN name ELSE label END AS normalized, CASE WHEN p <> '' AND confidence > 0.5 THEN id END AS catalog_id, CASE WHEN p <> '' AND confidence > 0.5 THEN confidence END AS confidence FROM b""")
REVERSED = "NOT contains(text, trim(reverse(text[1:20])))"
STUB = '{"story_analysis":{"themes":[],"emotional_tone":"","key_events":[]},"interpretations":[],"bias_hypotheses":[],"evidence_mapping":[],"prompt_version":"v1"}'


@query("assess_calls", f"""SELECT id, source, input_context, CASE WHEN source <> 'failed' THEN n END AS n_biases, CASE WHEN source <> 'failed' AND n > 0 THEN 'Start Bias' END AS first_name, CASE WHEN source <> 'failed' AND n > 0 THEN 'start-bias' END AS first_id,
 CASE source WHEN 'failed' THEN NULL WHEN 'fallback' THEN true ELSE CASE WHEN n = 0 THEN true WHEN id % 6 < 4 THEN id % 6 < 2 ELSE false END END AS no_bias_detected,
 CASE WHEN source <> 'failed' THEN v END AS n_violations, CASE WHEN source <> 'failed' THEN '{STUB}' END AS trace, CASE WHEN source <> 'failed' THEN h END AS input_hash, CASE WHEN source = 'failed' THEN 'schema_validation' END AS failure_type
FROM (SELECT item_id AS id, CASE WHEN item_id % 7 <> 0 THEN 'primary' WHEN item_id % 2 = 0 THEN 'fallback' ELSE 'failed' END AS source, item_id % 5 AS n, CASE WHEN item_id % 7 = 0 AND item_id % 2 = 1 THEN NULL WHEN item_id % 3 = 0 THEN 'story-only' ELSE 'full' END AS input_context,
 CAST((item_id % 5 > 1 AND {REVERSED})::INT + (item_id % 5 > 2)::INT + (item_id % 5 > 3)::INT AS INTEGER) AS v, sha256('v1' || chr(10) || chr(10) || 'm' || chr(10) || chr(10) || text || CASE WHEN item_id % 3 = 0 THEN '' ELSE chr(10) || chr(10) || 'an answer' END) AS h FROM benchmark)""")
def assess_calls(s: SparkSession, d: str) -> DataFrame:
    catalog = s.createDataFrame([(0, "start-bias", "Start Bias"), (1, "halo", "Halo Effect")], "pos int, id string, name string")
    found = flows.assess(S.recorded(s, d), catalog)
    size, first = F.size("biases"), F.get("biases", F.lit(0))
    return found.select("id", "source", "input_context", "n_violations", "trace", "input_hash", "failure_type", "no_bias_detected", size.alias("n_biases"), first["name"].alias("first_name"), first["biasCatalogId"].alias("first_id"))


EVAL = f"""o AS (SELECT *, item_id % 5 AS n, item_id % 2 = 0 AS neutral, item_id % 13 > 0 AND item_id % 11 > 0 AS fine, CASE WHEN item_id % 4 = 0 THEN 0.7::DOUBLE ELSE 0.25::DOUBLE END AS t FROM benchmark),
r AS (SELECT item_id AS id, CASE WHEN neutral THEN 'no_bias' ELSE 'golden' END AS dataset, fine AS parse_success, CASE WHEN fine THEN n ELSE 0 END AS bias_count, CASE WHEN fine AND NOT neutral THEN 1 ELSE 0 END AS question_count,
 CASE WHEN fine AND n > 0 THEN (1 + CASE WHEN n > 1 AND contains(text, trim(reverse(text[1:20]))) THEN 1 ELSE 0 END) / n::DOUBLE END AS grounded_rate,
 CASE WHEN fine THEN neutral AND ((n > 0 AND item_id % 10 / 10.0::DOUBLE > t) OR n > 1) END AS false_positive,
 CASE WHEN item_id % 13 = 0 THEN 'Exception: no output recorded' WHEN item_id % 11 = 0 THEN 'Exception: timeout' WHEN NOT neutral THEN '' ELSE concat_ws('; ', CASE WHEN n > 0 AND item_id % 10 / 10.0::DOUBLE > t THEN 'start — confidence ' || format('{{:.2f}}', item_id % 10 / 10.0::DOUBLE) || ' > ' || t END,
  CASE WHEN n > 1 THEN 'reversed — confidence 1.00 > ' || t END, CASE WHEN n > 2 AND t < 0.3 THEN 'none — confidence 0.30 > ' || t END, CASE WHEN n > 3 AND t < 0.5 THEN 'blank — confidence 0.50 > ' || t END) END AS reasons,
 item_id % 13 > 0 AND item_id % 5 = 0 AS required_repair, item_id % 10 = 0 AS repair_succeeded FROM o)"""


def evaluation(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return flows.run_eval(S.eval_stories(s, d), S.eval_outputs(s, d), "v1", {"grounded": 0.2})


simple("eval_story_results", lambda s, d: evaluation(s, d)[0].select("id", "dataset", "parse_success", "bias_count", "question_count", F.round("grounded_rate", 6).alias("grounded_rate"), "false_positive", F.array_join("failure_reasons", "; ").alias("reasons"), "failed"), f"WITH {EVAL} SELECT id, dataset, parse_success, CAST(bias_count AS INTEGER) AS bias_count, question_count, round(grounded_rate, 6) AS grounded_rate, false_positive, reasons, reasons <> '' AS failed FROM r")
simple("eval_run_gate", lambda s, d: evaluation(s, d)[1], f"""WITH {EVAL}, g AS (SELECT count(*) AS n_stories, CAST(coalesce(count_if(NOT parse_success), 0) AS BIGINT) AS n_errors, avg(grounded_rate) FILTER (parse_success) AS grounded, count_if(dataset = 'no_bias' AND coalesce(false_positive, false)) / nullif(count_if(dataset = 'no_bias'), 0)::DOUBLE AS false_positive,
 count_if(NOT required_repair) / count(*)::DOUBLE AS schema_parse, count_if(required_repair AND repair_succeeded) / nullif(count_if(required_repair), 0)::DOUBLE AS repair FROM r)
SELECT n_stories, n_errors, round(grounded, 6) AS grounded, round(false_positive, 6) AS false_positive, round(schema_parse, 6) AS schema_parse, round(repair, 6) AS repair, passed, CASE WHEN passed THEN 0 ELSE 1 END AS exit_code
FROM (SELECT *, coalesce(grounded >= 0.2, true) AND coalesce(false_positive <= 0.1, true) AND coalesce(schema_parse >= 0.95, true) AND coalesce(repair <= 0.05, true) AS passed FROM g)""")
simple("eval_report", lambda s, d: flows.report(evaluation(s, d)[0], {"grounded": 0.2}), f"""WITH {EVAL} SELECT dataset, count(*) AS stories, CASE WHEN avg(grounded_rate) IS NULL THEN 'N/A' ELSE format('{{:.3f}}', avg(grounded_rate)) END AS grounded_rate, avg(grounded_rate) >= 0.2 AS grounded_ok,
 CASE WHEN dataset = 'golden' THEN 'N/A' ELSE format('{{:.3f}}', count_if(coalesce(false_positive, false)) / count(*)::DOUBLE) END AS false_positive_rate, CASE WHEN dataset = 'no_bias' THEN count_if(coalesce(false_positive, false)) / count(*)::DOUBLE <= 0.1 END AS false_positive_ok, CAST(coalesce(count_if(reasons <> ''), 0) AS BIGINT) AS failed FROM r GROUP BY dataset""")
simple("validate_outputs", lambda s, d: S.assessments(s, d).select("id", F.array_join(F.array_distinct(F.flatten(F.transform("biases", lambda b: F.flatten(F.transform(b["evidence"], contracts.evidence_entry))))), ",").alias("entries"), F.array_join(contracts.evidence_mapping(F.struct(F.lit("b").alias("bias_id"), F.get("biases", F.lit(2))["evidence"].alias("evidence"))), ",").alias("mapping"), F.array_join(contracts.interpretation(F.struct(F.lit("").alias("interpretation"), (F.col("id") % 4 / 2).alias("plausibility"), F.array(F.lit("x")).alias("supporting_evidence"))), ",").alias("interpretation"), F.array_join(contracts.questions(F.expr("array_repeat('q', CAST(id % 7 AS INT))")), ",").alias("questions"), F.array_join(contracts.metrics(F.col("id") % 3 / 2, F.lit(None).cast("double")), ",").alias("metrics")), """SELECT item_id AS id, '' AS entries, 'no_evidence' AS mapping, 'text_empty' || CASE WHEN item_id % 4 > 2 THEN ',plausibility_out_of_range' ELSE '' END AS interpretation,
 CASE WHEN item_id % 7 < 2 THEN 'too_few' WHEN item_id % 7 > 5 THEN 'too_many' ELSE '' END AS questions, '' AS metrics FROM benchmark""")
