"""Stores: adding, reading in order, updates merged on read."""

from __future__ import annotations

import datetime as dt
import json

from verisift import schemas, stores

DAY = dt.datetime(2024, 1, 1, 10)


def test_calls(spark, tmp_path):
    calls = stores.CallStore(spark, str(tmp_path))
    assert calls.read().count() == 0
    rows = [("a", "s1", "question", "primary", "p", "m", "success", 100, DAY + dt.timedelta(days=1)), ("b", "s1", "assessment", "primary", "p", "m", "success", 200, DAY), ("c", "s2", "question", "fallback", "q", "m", "success", None, DAY)]
    calls.add(spark.createDataFrame(rows, "id string, session_id string, stage string, call_type string, provider string, model string, status string, duration_ms int, created_at timestamp"))
    assert [r.id for r in calls.by_session("s1").collect()] == ["b", "a"]
    assert [r.id for r in calls.by_stage("question").collect()] == ["c", "a"] and [r.id for r in calls.by_provider("q").collect()] == ["c"]
    assert [r.id for r in calls.by_session_and_stage("s1", "question").collect()] == ["a"]
    assert calls.for_metrics(provider="p", stage="").count() == 2 and calls.for_metrics(oldest=1).count() == 1
    calls.update_parsed_output(spark.createDataFrame([("a", '{"x":1}'), ("z", "{}")], "id string, parsed_output string"))
    calls.update_parsed_output(spark.createDataFrame([("a", '{"x":2}')], "id string, parsed_output string"))
    calls.update_failure(spark.createDataFrame([("b", "parse_error", None)], "id string, failure_type string, error_message string"))
    found = {r.id: (r.status, r.failure_type, r.parsed_output, r.error_message) for r in calls.read().collect()}
    assert found == {"a": ("success", None, '{"x":2}', None), "b": ("error", "parse_error", None, None), "c": ("success", None, None, None)}


def test_results_runs_and_traces(spark, tmp_path):
    results = stores.ResultStore(spark, str(tmp_path))
    results.add(spark.createDataFrame([(str(k), "v1", "h", "run-a" if k < 3 else "run-b", k == 0, DAY + dt.timedelta(hours=k)) for k in range(4)], "id string, prompt_version string, input_hash string, eval_run_id string, passed boolean, run_at timestamp"))
    assert [r.id for r in results.latest("v1", 3).collect()] == ["3", "2", "1"] and results.by_hash("h", "v1").first().id == "0" and results.by_hash("h", "v2").count() == 0
    assert [(r.eval_run_id, r.n, r.n_passed) for r in results.aggregates().collect()] == [("run-b", 1, 0), ("run-a", 3, 1)] and results.by_eval_run("run-a").count() == 3
    runs, traces = stores.RunStore(spark, str(tmp_path)), stores.TraceStore(spark, str(tmp_path))
    runs.add(spark.createDataFrame([("s1", "initial_assessment")], "session_id string, stage string"))
    run = runs.by_session("s1").first()
    assert run.id and run.created_at
    traces.add(spark.createDataFrame([(run.id, "{}"), ("gone", "{}")], "run_id string, trace string"))
    assert traces.by_run(run.id).count() == 1 and traces.without_orphans(runs).count() == 1


def test_schemas_are_exported():
    found = json.loads(schemas.export())
    assert {"runs", "traces", "results", "calls", "trace"} <= set(found) and len(found["calls"]["fields"]) == 19
