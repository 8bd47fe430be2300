"""Fixture numbers of the metrics, empty and null inputs, plan shapes."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from verisift.operators import metrics, store

CALL = "id string, call_type string, status string, failure_type string, duration_ms double, provider string, created_at timestamp"


def calls(spark, *rows):
    day = dt.datetime(2024, 1, 1, 10)
    return spark.createDataFrame([(str(k), r[0], r[1], r[2], r[3], r[4] if len(r) > 4 else "p", day + dt.timedelta(days=k)) for k, r in enumerate(rows)], CALL)


def test_no_calls_are_zeros(spark):
    row = metrics.reliability(calls(spark)).first()
    assert all(v == 0 for v in row)


def test_mixed_calls(spark):
    row = metrics.reliability(calls(spark, ("primary", "success", None, 100.0), ("primary", "success", None, 200.0), ("primary", "timeout", "timeout", 5000.0), ("primary", "error", "schema_validation", 50.0), ("fallback", "success", None, 150.0))).first()
    assert (row.total, row.primary, row.success_rate, row.timeout_rate, row.fallback_rate, row.schema_rate, row.provider_rate, row.parse_rate) == (5, 4, 0.6, 0.2, 0.25, 0.2, 0, 0)


def test_percentiles_interpolate(spark):
    row = metrics.reliability(calls(spark, *[("primary", "success", None, 100.0 * k) for k in range(1, 11)])).first()
    assert (row.avg_ms, row.p50_ms, row.p95_ms, row.p99_ms) == (550, 550, 955, 991)


def test_null_durations_do_not_count(spark):
    row = metrics.reliability(calls(spark, ("primary", "success", None, 100.0), ("primary", "success", None, None), ("primary", "success", None, 300.0))).first()
    assert (row.total, row.avg_ms, row.p50_ms) == (3, 200, 200)


def test_time_range_is_closed_and_empty_filters_are_not_applied(spark):
    rows = calls(spark, ("primary", "success", None, 100.0, "a"), ("primary", "success", None, 200.0, "b"), ("primary", "success", None, 300.0, "a"))
    at = dt.datetime(2024, 1, 2, 10)
    assert [r.duration_ms for r in store.calls_between(rows, at, at, provider="").collect()] == [200]
    assert store.calls_between(rows, None, None, provider="a").count() == 2
    assert store.calls_between(rows, None, None, oldest=1).first().duration_ms == 100


STORY = "dataset string, grounded_rate double, false_positive boolean, error string, required_repair boolean, repair_succeeded boolean"


@pytest.mark.parametrize(
    "rows,passed",
    [
        ([("golden", 0.9, None, None, False, None), ("no_bias", None, False, None, False, None)], True),
        ([("golden", 0.89, None, None, False, None)], False),
        ([("no_bias", None, True, None, False, None), ("no_bias", None, False, None, False, None)], False),
        ([("golden", None, None, "boom", False, None)], True),
        ([("golden", 1.0, None, None, True, True)], False),
        ([], True),
    ],
)
def test_gate(spark, rows, passed):
    assert metrics.evaluation_gate(spark.createDataFrame(rows, STORY)).first().passed is passed


def test_gate_limits_can_be_overridden(spark):
    rows = spark.createDataFrame([("golden", 0.5, None, None, False, None)], STORY)
    assert metrics.evaluation_gate(rows, {"grounded": 0.5}).first().passed


def test_system_metrics(spark):
    empty = metrics.system_metrics(spark.createDataFrame([], "required_repair boolean, repair_succeeded boolean")).first()
    assert (empty.total, empty.parse_rate, empty.repair_rate) == (0, None, None)
    row = metrics.system_metrics(spark.createDataFrame([(False, None), (True, True), (True, None), (True, False)], "required_repair boolean, repair_succeeded boolean")).first()
    assert (row.parse_rate, row.repair_attempts, row.repair_successes, row.repair_rate) == (0.25, 3, 1, round(1 / 3, 6))


TRACE = "hypotheses array<struct<bias_name:string,confidence:double,excerpts:array<string>>>"


def test_trace_analytics(spark):
    empty = metrics.trace_analytics(spark.createDataFrame([], TRACE)).first()
    assert all(v == 0 for v in empty)
    rows = spark.createDataFrame([([("a", 0.9, ["x"]), ("b", 0.7, [])],), ([],), (None,), ([("a", 0.8, ["x", "y"])],)], TRACE)
    row = metrics.trace_analytics(rows).first()
    assert (row.traces, row.with_bias, row.avg_hypotheses, row.avg_confidence, row.avg_excerpts, row.coverage) == (4, 2, 0.75, 0.8, 1.0, round(2 / 3, 6))
    assert {r.bias_name: r.n for r in metrics.bias_distribution(rows).collect()} == {"a": 2, "b": 1}


def test_updates_overlay_nulls_and_ignore_unknown_keys(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, status string, message string")
    updates = spark.createDataFrame([(2, "error", None), (9, "error", "z")], "id int, status string, message string")
    assert sorted(map(tuple, store.overlay(base, updates, "id", ["status", "message"]).collect())) == [(1, "a", "x"), (2, "error", None)]


def test_run_aggregates_and_conflicts(spark):
    rows = spark.createDataFrame([("a", True, "h", "v", 1), ("a", False, "h", "v", 2), ("b", None, "h", "w", 3), (None, True, "i", "v", 4)], "eval_run_id string, passed boolean, input_hash string, prompt_version string, run_at int")
    assert [tuple(r) for r in store.run_aggregates(rows).collect()] == [("b", 1, 0, 3), ("a", 2, 1, 1)]
    assert [tuple(r) for r in store.conflicts(rows).collect()] == [("h", "v", 1, 1)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from verisift.plans import queries, standins

    text = plan(metrics.reliability(store.calls_between(standins.calls(spark, sf_dir), queries.START, queries.END)))
    assert "GreaterThanOrEqual(ts" in text and "user_id" not in text.split("ReadSchema")[1]
    assert "TakeOrderedAndProject" in plan(store.latest(standins.results(spark, sf_dir), 5))


def test_streaming_rates(spark, tmp_path):
    from verisift.streaming.reliability import windowed

    rows = calls(spark, ("primary", "success", None, 100.0), ("primary", "timeout", "timeout", 300.0))
    rows.withColumn("created_at", F.lit(dt.datetime(2024, 1, 1))).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CALL).parquet(str(tmp_path / "in"))
    q = windowed(stream).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    row = spark.table("rates").first()
    assert (row.total, row.success_rate, row.timeout_rate, row.avg_ms) == (2, 0.5, 0.5, 200)
