"""The engine's two composed flows: recorded calls to checked assessments, and recorded outputs to a gated evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import schemas
from .functions import classify, evidence, jsontext, text
from .operators import evidence as grounding
from .operators import lookup, metrics

#: What a call is said to have failed with when neither it nor its fallback gives a record.
FAILED = "Failed to produce valid output after repair and fallback"
#: The model that an evaluation's input hash names.
EVAL_MODEL = "eval-model"


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def assess(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Recorded calls (id, story, answers, scope, prompt_version, model_name, raw_response, fallback_response) to one assessment each.

    catalog: (pos, id, name).  Text is extracted, repaired field by field, else the fallback's strictly valid record is taken (`source`);
    a missing list of findings counts as empty, the no-bias flag is made consistent, names are normalised by the catalog, evidence is held against
    the input (`n_violations`; nothing is dropped), the trace is stamped, a stub where there is none.  What fails both ways keeps its
    row with `failure_type` and nulls.  Answers count only where the scope has them.  `id` is taken as unique.
    """
    shape = schemas.schema(schemas.ASSESSMENT)
    found = jsontext.with_fallback(calls, "raw_response", "fallback_response", shape, rules=schemas.ASSESSMENT_RULES)
    there = F.col("source") != "failed"
    bias = "array<struct<name:string,biasCatalogId:string,explanation:string,storyConnection:string,alternativePerspective:string,evidence:array<struct<source:string,excerpt:string,relevance:string>>>>"
    kept = found.withColumn("biases", F.when(there, F.coalesce(F.col("record.biases").cast(bias), _empty(bias)))).withColumn("seen", F.when(F.col("scope") == "story_plus_answers", F.coalesce("answers", _empty("array<string>"))).otherwise(_empty("array<string>")))
    # Names travel without their findings; each record gets back a map of its own.
    names = kept.select("id", F.explode(F.array_distinct(F.transform("biases", lambda b: b["name"]))).alias("label"))
    known = lookup.normalize_names(names.select("label"), catalog).where(F.col("catalog_id").isNotNull())
    own = names.join(known, "label").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("normalized", "catalog_id")))).alias("names"))
    rows = kept.join(own, "id", "left").withColumn("names", F.coalesce("names", F.expr("CAST(map() AS map<string,struct<normalized:string,catalog_id:string>>)")))
    normal = F.transform("biases", lambda b: b.withField("name", F.coalesce(F.try_element_at("names", b["name"])["normalized"], b["name"])).withField("biasCatalogId", F.coalesce(F.try_element_at("names", b["name"])["catalog_id"], b["biasCatalogId"])))
    rows = rows.withColumn("biases", normal)
    trace = F.col("record.reasoningTrace")
    analysis = F.coalesce(trace["story_analysis"].cast("struct<themes:array<string>,emotional_tone:string,key_events:array<string>>"), F.struct(_empty("array<string>").alias("themes"), F.lit("").alias("emotional_tone"), _empty("array<string>").alias("key_events")))
    lists = [F.coalesce(F.to_json(trace[c]), F.lit("[]")) for c in ("interpretations", "bias_hypotheses", "evidence_mapping")]
    named = [x for c, part in zip(("interpretations", "bias_hypotheses", "evidence_mapping"), lists, strict=True) for x in (F.lit(f',"{c}":'), part)]
    version = F.regexp_extract(F.to_json(F.struct(F.col("prompt_version").alias("v"))), r'^\{"v":(.*)\}$', 1)
    stamped = F.concat(F.lit('{"story_analysis":'), F.to_json(analysis), *named, F.lit(',"prompt_version":'), version, F.lit("}"))
    return rows.select(
        "id", "source", F.when(~there, classify.repair_failure(F.lit(FAILED))).alias("failure_type"), "biases",
        F.when(there, grounding.no_bias_flag(F.col("record.noBiasDetected"), F.size("biases"))).alias("no_bias_detected"),
        F.col("record.reflectionPrompt").alias("reflection_prompt"), F.when(there, evidence.n_violations(F.col("biases"), F.col("story"), F.col("seen"))).alias("n_violations"),
        F.when(there, stamped).alias("trace"), F.when(there, F.col("prompt_version")).alias("prompt_version"), F.when(there, F.lit(schemas.SCHEMA_VERSION)).alias("schema_version"),
        F.when(there, F.col("model_name")).alias("model_name"), F.when(there, F.when(F.col("scope") == "story_only", "story-only").otherwise("full")).alias("input_context"),
        F.when(there, text.input_hash(F.col("prompt_version"), F.col("model_name"), F.col("story"), F.col("seen"))).alias("input_hash"),
    )


def story_results(stories: DataFrame, outputs: DataFrame, prompt_version: str) -> DataFrame:
    """Stories (id, title, story, dataset, threshold) and their recorded outputs (id, answers, biases, error, required_repair,
    repair_succeeded) to one result each; a story without an output is an error.

    dataset: `golden` or `no_bias`.  Golden findings have no confidence; a neutral story fails by each finding above its own threshold.
    """
    missing = outputs.withColumn("_there", F.lit(True))
    rows = stories.join(missing, "id", "left").withColumn("error", F.when(F.col("_there").isNull(), "no output recorded").otherwise(F.col("error")))
    fine, neutral = F.col("error").isNull(), F.col("dataset") == "no_bias"
    answers = F.when(neutral, _empty("array<string>")).otherwise(F.coalesce("answers", _empty("array<string>")))
    confidence = lambda b: F.coalesce(b["confidence"], F.lit(evidence.UNSTATED))
    above = F.filter("biases", lambda b: F.coalesce(confidence(b) > F.col("threshold"), F.lit(False)))
    limit = F.regexp_replace(F.col("threshold").cast("string"), r"\.0$", "")
    said = F.transform(above, lambda b: F.concat(b["name"], F.lit(" — confidence "), F.format_string("%.2f", confidence(b)), F.lit(" > "), limit))
    reasons = F.when(~fine, F.array(F.concat(F.lit("Exception: "), F.col("error")))).when(neutral, F.coalesce(said, _empty("array<string>"))).otherwise(_empty("array<string>"))
    out = rows.select(
        "id", "title", "dataset", fine.alias("parse_success"), F.when(fine, F.size(answers)).otherwise(0).alias("question_count"), F.when(fine, F.coalesce(F.size("biases"), F.lit(0))).otherwise(0).alias("bias_count"),
        F.when(fine, evidence.grounded_rate(F.col("biases"), F.col("story"), answers)).alias("grounded_rate"), F.when(fine, evidence.false_positive(F.col("biases"), neutral, F.col("threshold"))).alias("false_positive"),
        F.when(fine, text.input_hash(F.lit(prompt_version), F.lit(EVAL_MODEL), F.col("story"), answers)).otherwise("").alias("input_hash"), reasons.alias("failure_reasons"), "error",
        F.coalesce("required_repair", F.lit(False)).alias("required_repair"), "repair_succeeded",
    )
    return out.withColumn("failed", F.size("failure_reasons") > 0)


def run_eval(stories: DataFrame, outputs: DataFrame, prompt_version: str, limits: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """The results of all stories, and the one row of the gate with its exit code."""
    results = story_results(stories, outputs, prompt_version)
    gate = metrics.evaluation_gate(results, limits)
    return results, gate.withColumn("exit_code", F.when(F.col("passed"), 0).otherwise(1))


def report(results: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """A row for each dataset as people read it: rates with three digits (N/A where there is none), whether they keep the limits, and what failed."""
    limit = metrics.GATE | (limits or {})
    neutral = F.col("dataset") == "no_bias"
    sums = results.groupBy("dataset").agg(
        F.count("*").alias("stories"), F.avg(F.when(F.col("error").isNull(), F.col("grounded_rate"))).alias("grounded"),
        F.try_divide(F.count_if(neutral & F.col("false_positive")).cast("double"), F.count_if(neutral).cast("double")).alias("fp"), F.count_if("failed").alias("failed"),
    )
    fixed = lambda c: F.when(c.isNull(), "N/A").otherwise(F.format_string("%.3f", c))
    return sums.select("dataset", "stories", fixed(F.col("grounded")).alias("grounded_rate"), (F.col("grounded") >= limit["grounded"]).alias("grounded_ok"), fixed(F.col("fp")).alias("false_positive_rate"), (F.col("fp") <= limit["false_positive"]).alias("false_positive_ok"), "failed")
