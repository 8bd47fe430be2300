"""Schemas of the four stores, of requests, outputs and nested records with their rules, and their export as JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.jsontext import Rules

# The contracts' limits and versions.
SCHEMA_VERSION, FIELD_MIN, CERTAIN = "1.0.0", 10, 0.8
STORY_MIN, STORY_MAX, QUESTIONS_MIN, QUESTIONS_MAX = 50, 3000, 2, 5

#: A field that is NOT NULL must be there; others may be absent.
EVIDENCE = "source string NOT NULL, excerpt string NOT NULL, relevance string NOT NULL"
_EVIDENCE = "array<struct<source:string NOT NULL,excerpt:string NOT NULL,relevance:string NOT NULL>>"
TRACE = (
    "story_analysis struct<themes:array<string> NOT NULL,emotional_tone:string NOT NULL,key_events:array<string> NOT NULL> NOT NULL, "
    "interpretations array<struct<interpretation:string NOT NULL,plausibility:double NOT NULL,supporting_evidence:array<string> NOT NULL,rejected:boolean>>, "
    "bias_hypotheses array<struct<bias_name:string NOT NULL,confidence:double NOT NULL,supporting_excerpts:array<string> NOT NULL,uncertainty_reasons:array<string> NOT NULL>>, "
    f"evidence_mapping array<struct<bias_id:string NOT NULL,evidence:{_EVIDENCE} NOT NULL>>, prompt_version string"
)
BIAS_ITEM = f"name string NOT NULL, biasCatalogId string, explanation string NOT NULL, storyConnection string NOT NULL, alternativePerspective string NOT NULL, evidence {_EVIDENCE}"
QUESTION_OUTPUT = "questions array<string> NOT NULL, isComplete boolean NOT NULL, prompt_version string, schema_version string"
QUESTION_REQUEST = "sessionId string NOT NULL, story string NOT NULL"
ASSESSMENT_REQUEST = "sessionId string NOT NULL, story string NOT NULL, questions array<string>, answers array<string>, mode string"


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


ASSESSMENT = f"biases array<struct<{BIAS_ITEM}>> NOT NULL, reflectionPrompt string NOT NULL, prompt_version string, schema_version string, noBiasDetected boolean NOT NULL, reasoningTrace struct<{TRACE}>, inputContext string, modelName string"


def _some(c: Column) -> Column:
    return F.length(c) >= 1


def _long(c: Column) -> Column:
    return F.length(c) >= FIELD_MIN


def _share(c: Column) -> Column:
    return c.between(0, 1)


def _under(prefix: str, rules: Rules) -> Rules:
    return {f"{prefix}{path}": rule for path, rule in rules.items()}


EVIDENCE_RULES: Rules = {"source": lambda c: c.isin("story", "answer"), "excerpt": _some, "relevance": _some}
TRACE_RULES: Rules = {
    "interpretations[].interpretation": _some, "interpretations[].plausibility": _share,
    "bias_hypotheses[].bias_name": _some, "bias_hypotheses[].confidence": _share, "bias_hypotheses[].uncertainty_reasons[]": _some,
    "bias_hypotheses[]": lambda h: (h["confidence"] >= CERTAIN) | (F.size(h["uncertainty_reasons"]) > 0),
    "evidence_mapping[].bias_id": _some, "evidence_mapping[].evidence": lambda e: F.size(e) >= 1, **_under("evidence_mapping[].evidence[].", EVIDENCE_RULES),
}
BIAS_ITEM_RULES: Rules = {"name": _some, "explanation": _long, "storyConnection": _long, "alternativePerspective": _long, **_under("evidence[].", EVIDENCE_RULES)}
QUESTION_OUTPUT_RULES: Rules = {"questions": lambda q: F.size(q).between(QUESTIONS_MIN, QUESTIONS_MAX), "questions[]": _some, "schema_version": lambda c: c == SCHEMA_VERSION}
ASSESSMENT_RULES: Rules = {
    **_under("biases[].", BIAS_ITEM_RULES), "reflectionPrompt": _long, "schema_version": lambda c: c == SCHEMA_VERSION, **_under("reasoningTrace.", TRACE_RULES),
    "inputContext": lambda c: c.isin("story-only", "full"), "modelName": _some,
}
METRICS = "evidenceGroundedRate double, falsePositiveRate double"
SYSTEM_METRICS = "schemaParseRate double, repairRate double"
SCHEMAS = {
    "runs": "id string, session_id string, model_name string, stage string, scope string, prompt_version string, input_hash string, created_at timestamp",
    "traces": "id string, run_id string, trace string, created_at timestamp",
    "results": "id string, run_id string, provider string, model_name string, prompt_version string, dataset string, evaluation_metrics string, system_metrics string, input_hash string, passed boolean, run_at timestamp, eval_run_id string, scenario_id string, raw_output string",
    "calls": "id string, session_id string, stage string, call_type string, provider string, model string, prompt_version string, raw_response string, parsed_output string, status string, failure_type string, input_tokens int, output_tokens int, total_tokens int, started_at timestamp, ended_at timestamp, duration_ms int, error_message string, created_at timestamp",
}


#: The contracts of requests, outputs and nested records.
CONTRACTS = {
    "trace": TRACE, "evidence": EVIDENCE, "bias_item": BIAS_ITEM, "question_output": QUESTION_OUTPUT, "assessment_output": ASSESSMENT,
    "question_request": QUESTION_REQUEST, "assessment_request": ASSESSMENT_REQUEST, "evaluation_metrics": METRICS, "system_metrics": SYSTEM_METRICS,
}


def export() -> str:
    """All schemas as one JSON text."""
    return json.dumps({name: schema(ddl).jsonValue() for name, ddl in {**SCHEMAS, **CONTRACTS}.items()}, indent=1, sort_keys=True)
