"""Strict and partial records, stored traces, prompts, percentiles, plans, and the composed flows at their edges."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from verisift import flows, schemas, stores
from verisift.functions import jsontext
from verisift.operators import contracts, lookup, metrics, store
from verisift.plans import standins
from verisift.sources import prompts

ITEM = "name string, n double, o struct<a:string NOT NULL,b:boolean>, xs array<struct<k:string NOT NULL>>, reasoningTrace string"


def records(spark, texts, rules=None, strict=False, required=None):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, t string")
    shape = schemas.schema(ITEM)
    found = jsontext.with_strict(rows, "t", shape, required, rules) if strict else jsontext.with_record(rows, "t", shape, rules)
    return [r.record and r.record.asDict(True) for r in found.orderBy("i").collect()]


def test_nothing_is_coerced_and_faults_void_the_whole_field(spark):
    got = records(spark, ['{"name":5}', '{"name":{"a":1}}', '{"name":true,"n":2}', '{"n":"2"}', '{"o":{"a":"x","b":"no"}}', '{"o":{"b":true}}', '{"o":{"a":"x"}}', '{"xs":[{"k":"a"},{"k":1}]}', '{"xs":[{"k":"a"}]}', '{"xs":{"k":"a"}}', '{"name":null,"n":1}'])
    none = dict.fromkeys(["name", "n", "o", "xs", "reasoningTrace"])
    assert got == [none, none, none | {"n": 2.0}, none, none, none, none | {"o": {"a": "x", "b": None}}, none, none | {"xs": [{"k": "a"}]}, none, none | {"n": 1.0}]


def test_an_old_name_counts_only_where_the_new_one_is_absent(spark):
    got = records(spark, ['{"reasoning_trace":"old"}', '{"reasoningTrace":null,"reasoning_trace":"old"}', '{"reasoningTrace":"new","reasoning_trace":"old"}', '{"reasoningTrace":5,"reasoning_trace":"old"}'])
    assert [r["reasoningTrace"] for r in got] == ["old", None, "new", None]


def test_strict_records_are_valid_as_they_stand(spark):
    texts = ['{"name":"x","n":1}', 'Here: {"name":"x"}', '{"name":"x","n":"1"}', '{"n":1}', '{"name":"x"} {}', '{"name":""}', "[]", None, '{"name":"x","more":1}']
    got = records(spark, texts, {"name": lambda c: F.length(c) > 0}, strict=True, required=["name"])
    assert [r and r["name"] for r in got] == ["x", None, None, None, None, None, None, None, "x"]


def test_rules_reach_every_depth(spark):
    item = {"name": "n", "explanation": "e" * 10, "storyConnection": "s" * 10, "alternativePerspective": "a" * 10, "evidence": [{"source": "story", "excerpt": "x", "relevance": "r"}]}
    good = {"biases": [item], "reflectionPrompt": "p" * 10, "noBiasDetected": False, "reasoningTrace": {"story_analysis": {"themes": [], "emotional_tone": "", "key_events": []}, "bias_hypotheses": [{"bias_name": "b", "confidence": 0.9, "supporting_excerpts": [], "uncertainty_reasons": []}]}}
    hypothesis = good["reasoningTrace"]["bias_hypotheses"][0]
    cases = [
        (good, True), ({**good, "reflectionPrompt": "short"}, False), ({**good, "biases": [{**item, "explanation": "short"}]}, False), ({**good, "biases": [{**item, "evidence": [{"source": "web", "excerpt": "x", "relevance": "r"}]}]}, False),
        ({**good, "reasoningTrace": {**good["reasoningTrace"], "bias_hypotheses": [{**hypothesis, "confidence": 0.7}]}}, False), ({**good, "reasoningTrace": {**good["reasoningTrace"], "bias_hypotheses": [{**hypothesis, "confidence": 0.7, "uncertainty_reasons": ["w"]}]}}, True),
        ({**good, "reasoningTrace": {**good["reasoningTrace"], "bias_hypotheses": [{**hypothesis, "confidence": 1.1}]}}, False), ({**good, "schema_version": "2"}, False), ({k: v for k, v in good.items() if k != "noBiasDetected"}, False),
    ]
    rows = spark.createDataFrame([(k, json.dumps(c)) for k, (c, _) in enumerate(cases)], "i int, t string")
    found = jsontext.with_strict(rows, "t", schemas.schema(schemas.ASSESSMENT), rules=schemas.ASSESSMENT_RULES).orderBy("i").collect()
    assert [r.record is not None for r in found] == [ok for _, ok in cases]


def test_long_strings_and_escapes_are_searched(spark):
    inner = json.dumps({"name": "a\\" + '"}' * 20_000 + "\n"})
    rows = spark.createDataFrame([("so: " + inner + " }",), ('x {"a":"' + "y" * 50_000,), ("t [1,[2]] ] {",)], "t string")
    assert [r.json for r in jsontext.with_json(rows, "t").collect()] == [inner, '{"a":"' + "y" * 50_000, "[1,[2]]"]


def test_trace_analytics_take_nulls_as_nothing(spark):
    kind = "run_id int, hypotheses array<struct<bias_name:string,confidence:double,excerpts:array<string>>>"
    rows = spark.createDataFrame([(1, [("a", 0.5, None), ("b", None, ["x", "y"]), ("a", 1.0, ["z"])]), (2, None), (3, [])], kind)
    got = metrics.trace_analytics(rows).first()
    assert (got.traces, got.with_bias, got.avg_hypotheses, got.avg_confidence, got.avg_excerpts, got.coverage) == (3, 1, 1.0, 0.5, 1.0, 0.666667)
    stored = spark.createDataFrame([('{"bias_hypotheses":[{"bias_name":"a","confidence":0.5},{"bias_name":"b","confidence":0.5,"supporting_excerpts":["x"]}]}',), ("{}",), ("no json",), (None,)], "trace string")
    assert metrics.trace_analytics(metrics.read_traces(stored)).first()[:3] == (4, 1, 0.5)


def test_stored_results_are_checked_when_read(spark, tmp_path):
    own = stores.ResultStore(spark, str(tmp_path))
    own.add(spark.createDataFrame([("1", '{"evidenceGroundedRate":0.5,"falsePositiveRate":null}', '{"schemaParseRate":1}')], "id string, evaluation_metrics string, system_metrics string"))
    row = own.records().first()
    assert row.evaluation_metrics.evidenceGroundedRate == 0.5 and row.system_metrics.schemaParseRate == 1
    own.add(spark.createDataFrame([("2", '{"evidenceGroundedRate":1.5}', None)], "id string, evaluation_metrics string, system_metrics string"))
    with pytest.raises(Exception, match="rate outside"):
        own.records().collect()
    traces = stores.TraceStore(spark, str(tmp_path))
    traces.add(spark.createDataFrame([("r", '{"bias_hypotheses":[{"bias_name":"a","confidence":0.5}]}')], "run_id string, trace string"))
    assert traces.hypotheses().first().hypotheses[0].bias_name == "a"


def test_prompts(spark, tmp_path):
    for name, body in (("g", {"content": "Be kind."}), ("a", {"content": "{{guardrails}} Assess {{story}}. {{guardrails}}", "version": "1.1.0"}), ("q", {"content": "Ask.", "version": "9"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    own = prompts.read_prompts(spark, f"{tmp_path}/g.json", assessment=f"{tmp_path}/a.json", questions=f"{tmp_path}/q.json")
    assert own.version == "1.1.0"
    rows = spark.createDataFrame([("one",), (None,)], "s string").select(own.render("assessment", {"story": F.col("s")}).alias("p"))
    assert [r.p for r in rows.collect()] == ["Be kind. Assess one. {{guardrails}}", "Be kind. Assess . {{guardrails}}"]
    with pytest.raises(ValueError):
        own.render("none")


def test_exact_percentiles_equal_the_built_in(spark, monkeypatch):
    r = random.Random(1)
    rows = [(g, v) for g in ("a", "b", None) for v in [r.choice([1.0, 1.0, 2.5, r.gauss(0, 100)]) for _ in range(r.randint(1, 900))]] + [("one", 7.0), ("nothing", None), ("ties", 3.0), ("ties", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    for ranges in (256, 4):
        monkeypatch.setattr(metrics, "RANGES", ranges)
        for dims in ((), ("g",)):
            want = df.groupBy(*dims).agg(F.percentile("v", shares).alias("p")).where("p IS NOT NULL").collect()
            got = metrics.exact_percentiles(df, "v", shares, *dims).collect()
            assert {r[:-1]: [round(x, 9) for x in r[-1]] for r in got} == {r[:-1]: [round(x, 9) for x in r[-1]] for r in want}


def test_plans(spark, sf_dir, capsys):
    def plan(df):
        df.explain("formatted")
        return capsys.readouterr().out

    docs, passages = (standins.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    assert "NestedLoop" not in plan(lookup.containing(docs, passages)) and "Cartesian" not in plan(lookup.containing(docs, passages))
    assert "NestedLoop" not in plan(lookup.normalize_names(standins.catalog(spark, sf_dir).withColumnRenamed("name", "label"), standins.catalog(spark, sf_dir)))
    found = plan(store.calls_between(standins.calls(spark, sf_dir), None, None))
    assert "GreaterThanOrEqual(ts" in found and "LessThanOrEqual(ts" in found


def test_containment_equals_brute_force(spark):
    r = random.Random(3)
    vocabulary = ["a", "bb", "ccc", "d,", "E"]
    docs = [(k, r.choice([" ", "\n", "  "]).join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for k in range(80)] + [(100, None), (101, "")]
    excerpts = [docs[k][1][r.randint(0, 8) :][: r.randint(1, 40)] for k in range(0, 80, 4)] + ["", "never there at all in any of them", "a bb", None]
    df, ex = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(e,) for e in excerpts], "text string")
    assert {x.doc_id for x in lookup.containing(df, ex).collect()} == {i for i, t in docs if t and any(e and e in t for e in excerpts)}


def test_contracts_of_outputs(spark):
    rows = spark.createDataFrame([(("b", [("story", "x", "r")]),), (("", []),), (("b", [("web", "", None)]),)], schemas.schema("m struct<bias_id:string,evidence:array<struct<source:string,excerpt:string,relevance:string>>>"))
    assert [list(r[0]) for r in rows.select(contracts.evidence_mapping(F.col("m"))).collect()] == [[], ["bias_empty", "no_evidence"], ["entry_invalid"]]
    assert spark.range(1).select(contracts.hypothesis(F.lit("b"), F.lit(0.5), F.lit(1), F.array(F.lit("")))).first()[0] == ["empty_reason"]
    out = spark.read.schema(schemas.ASSESSMENT).json(spark.sparkContext.parallelize(['{"biases":[{"name":"x"}],"reflectionPrompt":"p","schema_version":"2","inputContext":"y"}']))
    assert out.select(contracts.assessment(F.struct(*out.columns))).first()[0] == ["bias_invalid", "prompt_short", "flag_missing", "version_unknown", "context_unknown"]
    assert set(json.loads(schemas.export())) >= {"assessment_output", "question_output", "question_request", "trace", "runs"}


def test_flows_of_nothing(spark):
    calls = spark.createDataFrame([], "id int, story string, answers array<string>, scope string, prompt_version string, model_name string, raw_response string, fallback_response string")
    catalog = spark.createDataFrame([(0, "a", "A")], "pos int, id string, name string")
    assert flows.assess(calls, catalog).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None, None, None, None), (2, "story", None, "story_only", "v", "m", "{}", None)], calls.schema)
    rows = {r.id: r for r in flows.assess(one, catalog).collect()}
    assert rows[1].failure_type == "schema_validation" and rows[1].biases is None and rows[2].biases == [] and rows[2].no_bias_detected is True
    stories = spark.createDataFrame([], "id int, title string, story string, dataset string, threshold double")
    outputs = spark.createDataFrame([], "id int, answers array<string>, biases array<struct<name:string,confidence:double,evidence:array<struct<source:string,excerpt:string,relevance:string>>>>, error string, required_repair boolean, repair_succeeded boolean")
    results, gate = flows.run_eval(stories, outputs, "v1")
    assert results.count() == 0 and gate.first().exit_code == 0 and flows.report(results).count() == 0
