"""Fixture values of the column functions."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.functions import classify, evidence, jsontext, text
from verisift.operators import contracts, hygiene, lookup
from verisift.operators import evidence as grounding
from verisift.sources import stories


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("given,plain", [("Confirmation-Bias", "confirmationbias"), ("  The\t Halo  Effect! ", "the halo effect"), ("", ""), ("É2", "2")])
def test_normalize_label(spark, given, plain):
    assert value(spark, text.normalize_label(F.lit(given))) == plain


def test_similarities(spark):
    lit = F.lit
    assert value(spark, text.token_overlap(lit("a b"), lit("b b c"))) == pytest.approx(2 / 3)
    assert value(spark, text.jaccard(F.array(lit("a"), lit("a")), F.array(lit("a")))) == 2
    none = F.array().cast("array<string>")
    assert value(spark, text.jaccard(none, none)) is None
    assert value(spark, text.edit_distance(lit(""), lit(""))) == 0
    assert value(spark, text.edit_distance(lit("kitten"), lit("sitting"))) == pytest.approx(3 / 7)


CATALOG = [(0, "confirmation-bias", "Confirmation Bias"), (1, "anchoring", "Anchoring Bias"), (2, "sunk-cost-fallacy", "Sunk Cost Fallacy"), (3, "halo-effect", "Halo Effect")]


def test_best_matches(spark):
    labels = spark.createDataFrame([(x,) for x in ("confirmation bias", "Confirmation of Bias", "Sunk Cost", "Confirmation Biass", "anchoring", "Halo", "confirmation-bias", "", "!")], "label string")
    found = {r.label: r for r in lookup.best_matches(labels, spark.createDataFrame(CATALOG, "pos int, id string, name string")).collect()}
    assert set(found) == {"confirmation bias", "Confirmation of Bias", "Sunk Cost", "Confirmation Biass", "anchoring", "Halo", "confirmation-bias"}
    assert found["confirmation bias"].confidence == 1 and found["Confirmation of Bias"].confidence == pytest.approx(0.74)
    assert found["Sunk Cost"].catalog_id == "sunk-cost-fallacy" and found["Sunk Cost"].confidence == pytest.approx(0.611764706)
    assert found["Confirmation Biass"].confidence == pytest.approx(0.577777778) and found["anchoring"].normalized == "Anchoring Bias"
    assert found["Halo"].catalog_id is None and found["Halo"].normalized == "Halo" and found["confirmation-bias"].confidence == pytest.approx(0.376470588)


def test_lookup_beyond_the_broadcast_bound_gives_the_same(spark, monkeypatch):
    labels = spark.createDataFrame([("Sunk Cost",), ("halo effects",)], "label string")
    catalog = spark.createDataFrame(CATALOG, "pos int, id string, name string")
    small = sorted(map(tuple, lookup.best_matches(labels, catalog).collect()))
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lookup, "BLOCK", 2)
    assert sorted(map(tuple, lookup.best_matches(labels, catalog).collect())) == small


ASSESSMENT = "id int, story string, answers array<string>, biases array<struct<name:string,confidence:double,evidence:array<struct<source:string,excerpt:string,relevance:string>>>>"


def e(*excerpts):
    return [("story", x, "r") for x in excerpts]


def test_evidence(spark):
    rows = spark.createDataFrame(
        [
            (1, "I felt humiliated. The team went quiet.", ["I left"], [("a", 0.9, e(" felt humiliated ")), ("b", 0.3, e("I left"))]),
            (2, "The team went quiet.", None, [("a", 0.5, e("the team")), ("b", None, []), ("c", 0.5, e("team", "made up")), ("d", 0.1, e("  "))]),
            (3, "x", [], []),
            (4, "x", [], None),
        ],
        ASSESSMENT,
    )
    rates = {r.id: r.x for r in rows.select("id", evidence.grounded_rate(F.col("biases"), F.col("story"), F.col("answers")).alias("x")).collect()}
    assert rates == {1: 1.0, 2: 0.0, 3: None, 4: None}
    found = [(r.id, r.bias_name, r.violation) for r in grounding.violations(rows).orderBy("id", "bias_pos", "evidence_pos").collect()]
    assert found == [(2, "a", "excerpt_not_in_input"), (2, "b", "no_evidence_entries"), (2, "c", "excerpt_not_in_input"), (2, "d", "empty_excerpt")]
    flags = rows.select("id", evidence.false_positive(F.col("biases"), F.lit(True)).alias("y"), evidence.false_positive(F.col("biases"), F.lit(False)).alias("n"), evidence.false_positive(F.col("biases"), F.lit(None).cast("boolean")).alias("u")).collect()
    assert {r.id: (r.y, r.n, r.u) for r in flags} == {1: (True, False, None), 2: (True, False, None), 3: (False, False, None), 4: (False, False, None)}
    equal = spark.createDataFrame([(1, "x", [], [("a", 0.5, [])])], ASSESSMENT)
    assert equal.select(evidence.false_positive(F.col("biases"), F.lit(True)).alias("x")).first().x is False


@pytest.mark.parametrize(
    "given,found",
    [
        ('{"a":1}', '{"a":1}'), ('```json\n{"a":1}\n```', '{"a":1}'), ("```\n[1]\n```", "[1]"), ('see [1, {"a":2}] ok', '[1, {"a":2}]'), ('x } {"a":"}"} y }', '{"a":"}"}'),
        ('{"a":"\\"}"} tail', '{"a":"\\"}"}'), ('go {"a": [1', '{"a": [1'), ("none here", "none here"), ("", ""), ("  \n ", ""), ('{"a":{"b":1}} {"c":2}', '{"a":{"b":1}}'),
    ],
)
def test_with_json(spark, given, found):
    assert jsontext.with_json(spark.createDataFrame([(given,)], "t string"), "t").first().json == found


RECORD = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.IntegerType()), T.StructField("noBiasDetected", T.BooleanType())])


def test_repair(spark):
    rows = spark.createDataFrame([('{"name":"test","value":"not-a-number"}',), ('{"name":"test"}',), ('{"name":"t","value":1,"extra":2,"no_bias_detected":true}',), ("nothing",), ("",), ("[1]",), (None,)], "t string")
    found = [tuple(r.record) if r.record else None for r in jsontext.with_record(rows, "t", RECORD).collect()]
    assert found == [("test", None, None), ("test", None, None), ("t", 1, True), None, None, (None, None, None), None]
    short = jsontext.with_record(rows, "t", RECORD, {"name": lambda c: F.length(c) > 1}).collect()
    assert [r.record.name if r.record else None for r in short] == ["test", "test", None, None, None, None, None]


def test_fallback(spark):
    rows = spark.createDataFrame([('{"name":"a"}', "x"), ("x", '{"name":"b","value":1,"noBiasDetected":false}'), ("x", '{"name":"b"}')], "p string, f string")
    assert [r.source for r in jsontext.with_fallback(rows, "p", "f", RECORD, ["name", "value", "noBiasDetected"]).collect()] == ["primary", "fallback", "failed"]


def test_input_hash(spark):
    answers = F.array(F.lit("x"), F.lit("y"))
    assert value(spark, text.input_hash(F.lit("v"), F.lit("m"), F.lit("s"), answers)) == hashlib.sha256(b"v\n\nm\n\ns\n\nx\n\ny").hexdigest()
    assert value(spark, text.input_hash(F.lit("v"), F.lit("m"), F.lit("s"), F.lit(None).cast("array<string>"))) == hashlib.sha256(b"v\n\nm\n\ns").hexdigest()


def test_render(spark):
    assert value(spark, text.render(F.lit("{{a}} {{a}} {{b}}"), {"a": F.lit("$1"), "b": F.lit("y")})) == "$1 {{a}} y"


def test_classification(spark):
    got = value(spark, classify.provider_error(F.lit("429: daily quota, reset  in 30 seconds")))
    assert tuple(got) == ("rate_limit", "daily", 30)
    assert tuple(value(spark, classify.provider_error(F.lit("Deadline Exceeded")))) == ("timeout", None, None)
    assert tuple(value(spark, classify.call_status(F.lit(None).cast("string")))) == ("success", None)
    assert value(spark, classify.repair_failure(F.lit("bad JSON"))) == "parse_error"
    assert [value(spark, classify.backoff_ms(F.lit(k))) for k in (1, 2, 3)] == [2000, 4000, 8000]


def test_contracts(spark):
    assert value(spark, contracts.story(F.lit("x" * 49))) == ["story_too_short"] and value(spark, contracts.story(F.lit("x" * 3000))) == []
    assert value(spark, contracts.run(F.lit("initial_assessment"), F.lit("story_plus_answers"))) == ["scope_inconsistent"]
    assert value(spark, contracts.run(F.lit("post_questions_assessment"), F.lit("story_plus_answers"))) == []
    assert value(spark, contracts.hypothesis(F.lit("a"), F.lit(0.79), F.lit(0))) == ["reasons_required"] and value(spark, contracts.hypothesis(F.lit("a"), F.lit(0.8), F.lit(0))) == []
    assert value(spark, contracts.questions(F.array(F.lit("a"), F.lit("")))) == ["empty_question"] and value(spark, contracts.questions(F.array(F.lit("a")))) == ["too_few"]
    assert value(spark, contracts.full_mode(F.lit(1), F.lit(0))) == ["no_answers", "length_mismatch"]


def test_no_bias_flag(spark):
    flag = lambda f, n: value(spark, grounding.no_bias_flag(F.lit(f).cast("boolean"), F.lit(n)))
    assert (flag(None, 0), flag(False, 0), flag(None, 2), flag(True, 2), flag(False, 2)) == (True, True, False, True, False)


def test_pairs_and_context(spark):
    assert value(spark, grounding.paired(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("x")))) == "Q: a\nA: x\n\nQ: b\nA: undefined"


def test_story_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "story": "s", "tags": ["t"], "expectedMinBiases": 2}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"id": "b", "story": "s", "isNoBias": True, "confidenceThreshold": 0.7}))
    (tmp_path / "note.txt").write_text("no story")
    rows = {r.id: r for r in stories.read_stories(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].confidenceThreshold is None and rows["b"].confidenceThreshold == 0.7
    assert stories.sample_story(stories.read_stories(spark, str(tmp_path)), 1).count() == 1
    (tmp_path / "c.json").write_text("{broken")
    with pytest.raises(Exception):  # noqa: B017
        stories.read_stories(spark, str(tmp_path)).collect()


def test_line_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.json").write_text("one\ncall 12345678901 or a.b@c.org and d@e.io\n123456789")
    rows = stories.read_lines(spark, str(tmp_path))
    assert rows.count() == 3
    found = hygiene.scan(spark.createDataFrame([(1, "one\ncall 12345678901 or a.b@c.org and d@e.io\n123456789"), (2, None), (3, "")], "id int, t string"), "id", "t").collect()
    assert sorted((r.id, r.line, r.pattern, r.match) for r in found) == [(1, 2, "email", "a.b@c.org"), (1, 2, "email", "d@e.io"), (1, 2, "longDigitSequence", "12345678901")]


def test_catalog_file(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"version": "1", "biases": [{"id": "a", "name": "A", "category": "x", "definition": "d", "detectionSignals": []}, {"id": "b", "name": "B", "category": "x", "definition": "e", "detectionSignals": []}]}))
    catalog = stories.read_catalog(spark, str(tmp_path / "c.json"))
    assert lookup.shortlist(catalog).first().shortlist == "- A: d\n- B: e"
    assert lookup.grouped(catalog).first().names == ["A", "B"] and lookup.categories(catalog).first().first_pos == 0
