"""Aggregations: reliability of calls, evaluation gate, system metrics, trace analytics.

Reliability and trace analytics give 0 where there is nothing to count; evaluation and system metrics give null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import TRACE

# The gate's default limits.
GATE = {"grounded": 0.9, "false_positive": 0.1, "schema_parse": 0.95, "repair": 0.05}


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _reliability() -> list[Column]:
    n, primary = F.count("*"), F.count_if(F.col("call_type") == "primary")
    percentiles = F.percentile("duration_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    failed = lambda kind: F.count_if(F.col("failure_type") == kind)
    return [
        n.alias("total"), primary.alias("primary"), F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 6).alias("avg_ms"),
        *[F.round(F.coalesce(F.get(percentiles, F.lit(k)), F.lit(0.0)), 6).alias(name) for k, name in enumerate(("p50_ms", "p95_ms", "p99_ms"))],
        F.round(share(F.count_if(F.col("status") == "success"), n), 6).alias("success_rate"), F.round(share(F.count_if(F.col("status") == "timeout"), n), 6).alias("timeout_rate"),
        F.round(share(F.count_if(F.col("call_type") == "fallback"), primary), 6).alias("fallback_rate"),
        F.round(share(failed("schema_validation"), n), 6).alias("schema_rate"), F.round(share(failed("provider_error"), n), 6).alias("provider_rate"), F.round(share(failed("parse_error"), n), 6).alias("parse_rate"),
    ]


def reliability(calls: DataFrame, *dims: str) -> DataFrame:
    """Totals, rates and exact percentiles, over all calls (one row, even of none) or by dimensions."""
    return calls.groupBy(*dims).agg(*_reliability()) if dims else calls.agg(*_reliability())


#: Ranges that the values of a group are parted into by exact_percentiles.
RANGES = 256


def exact_percentiles(rows: DataFrame, column: str, shares: list[float], *dims: str) -> DataFrame:
    """dims and `percentiles`, an array, interpolated as the built-in does, for groups of any number of distinct values.

    A sketch gives cut points, one pass counts the values between them, and only the ranges that hold a wanted rank are sorted, each by
    itself.  Groups without a value have no row.
    """
    one_row = (lambda df: df) if dims else F.broadcast  # without groups a few rows are all there is
    some = rows.where(F.col(column).isNotNull()).select(*dims, F.col(column).cast("double").alias("v"))
    cuts = some.groupBy(*dims).agg(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], 20 * RANGES).alias("cuts"), F.count("*").alias("total"))
    cuts = cuts.select(*[F.col(d).alias(f"_{d}") for d in dims], "cuts", "total")
    same = reduce(Column.__and__, [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in dims], F.lit(True))
    both = some.join(one_row(cuts), same).select(*dims, "v", "total", F.size(F.filter(F.array_distinct("cuts"), lambda c: c <= F.col("v"))).alias("range"))
    counted = both.groupBy(*dims, "range").agg(F.count("*").alias("held"), F.first("total").alias("total"))
    before = F.sum("held").over(Window.partitionBy(*dims).orderBy("range")) - F.col("held")
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p * (F.col("total") - 1)), F.ceil(p * (F.col("total") - 1))) for p in map(F.lit, shares)])))
    here = counted.withColumn("before", before).withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("held")))).where(F.size("ranks") > 0)
    wanted = here.select(*[F.col(d).alias(f"_{d}") for d in dims], F.col("range").alias("_range"), "before", "ranks")
    values = both.join(one_row(wanted), same & (F.col("range") == F.col("_range"))).groupBy(*dims, "range", "v").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("ranks").alias("ranks"), F.first("total").alias("total"))
    end = F.col("before") + F.sum("n").over(Window.partitionBy(*dims, "range").orderBy("v"))
    found = values.withColumn("end", end).withColumn("rank", F.explode(F.filter("ranks", lambda r: (r < F.col("end")) & (r >= F.col("end") - F.col("n")))))
    picked = found.groupBy(*dims).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"), F.first("total").alias("total"))

    def one(p: float) -> Column:
        place = F.lit(p) * (F.col("total") - 1)
        low, high = F.col("at")[F.floor(place)], F.col("at")[F.ceil(place)]
        return low + (high - low) * (place - F.floor(place))

    return picked.select(*dims, F.array(*map(one, shares)).alias("percentiles"))


def evaluation_gate(stories: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """One row: rates of (dataset, grounded_rate, false_positive, error, required_repair, repair_succeeded) and whether they pass.

    The grounded rate is the mean over stories without an error; false positives count against all neutral stories; a null rate passes.
    """
    limit = GATE | (limits or {})
    neutral = F.col("dataset") == "no_bias"
    sums = stories.agg(
        F.count("*").alias("n_stories"), F.count_if(F.col("error").isNotNull()).alias("n_errors"),
        F.avg(F.when(F.col("error").isNull(), F.col("grounded_rate"))).alias("grounded"),
        F.try_divide(F.count_if(neutral & F.col("false_positive")).cast("double"), F.count_if(neutral).cast("double")).alias("false_positive"),
        F.try_divide(F.count_if(~F.col("required_repair")).cast("double"), F.count("*").cast("double")).alias("schema_parse"),
        F.try_divide(F.count_if(F.col("required_repair") & F.coalesce("repair_succeeded", F.lit(False))).cast("double"), F.count_if("required_repair").cast("double")).alias("repair"),
    )
    passes = [F.coalesce(F.col("grounded") >= limit["grounded"], F.lit(True)), F.coalesce(F.col("false_positive") <= limit["false_positive"], F.lit(True)), F.coalesce(F.col("schema_parse") >= limit["schema_parse"], F.lit(True)), F.coalesce(F.col("repair") <= limit["repair"], F.lit(True))]
    rounded = [F.round(c, 6).alias(c) for c in ("grounded", "false_positive", "schema_parse", "repair")]
    return sums.select("n_stories", "n_errors", *rounded, (passes[0] & passes[1] & passes[2] & passes[3]).alias("passed"))


def system_metrics(responses: DataFrame) -> DataFrame:
    """Parse and repair rates of (required_repair, repair_succeeded)."""
    n, attempts, done = F.count("*"), F.count_if("required_repair"), F.count_if(F.col("required_repair") & F.coalesce("repair_succeeded", F.lit(False)))
    passed = F.count_if(~F.col("required_repair"))
    rate = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    return responses.agg(n.alias("total"), passed.alias("parse_passes"), rate(passed, n).alias("parse_rate"), attempts.alias("repair_attempts"), done.alias("repair_successes"), rate(done, attempts).alias("repair_rate"))


def trace_analytics(traces: DataFrame) -> DataFrame:
    """One row over traces with `hypotheses` (bias_name, confidence, excerpts); each trace is folded before the one aggregation.

    Null arrays count as empty, null confidences as 0.
    """
    found = F.coalesce("hypotheses", F.expr("CAST(array() AS array<struct<bias_name:string,confidence:double,excerpts:array<string>>>)"))
    n_excerpts = lambda h: F.coalesce(F.size(h["excerpts"]), F.lit(0))
    folded = traces.select(
        F.size(found).alias("n"),
        F.aggregate(found, F.lit(0.0), lambda s, h: s + F.coalesce(h["confidence"], F.lit(0.0))).alias("confidence"),
        F.aggregate(found, F.lit(0), lambda s, h: s + n_excerpts(h)).alias("excerpts"),
        F.size(F.filter(found, lambda h: n_excerpts(h) > 0)).alias("covered"),
    )
    total, n = F.count("*"), F.coalesce(F.sum("n"), F.lit(0))
    return folded.agg(
        total.alias("traces"), F.count_if(F.col("n") > 0).alias("with_bias"), F.round(share(n, total), 6).alias("avg_hypotheses"),
        F.round(share(F.coalesce(F.sum("confidence"), F.lit(0.0)), n), 6).alias("avg_confidence"), F.round(share(F.coalesce(F.sum("excerpts"), F.lit(0)), n), 6).alias("avg_excerpts"), F.round(share(F.coalesce(F.sum("covered"), F.lit(0)), n), 6).alias("coverage"),
    )


def read_traces(rows: DataFrame, column: str = "trace") -> DataFrame:
    """Stored traces, JSON of the trace contract, to rows with `hypotheses`; other columns stay, a text that is no trace has none."""
    found = F.from_json(column, TRACE)["bias_hypotheses"]
    return rows.withColumn("hypotheses", F.transform(found, lambda h: F.struct(h["bias_name"].alias("bias_name"), h["confidence"].alias("confidence"), h["supporting_excerpts"].alias("excerpts"))))


def bias_distribution(traces: DataFrame) -> DataFrame:
    return traces.select(F.explode("hypotheses").alias("h")).groupBy(F.col("h.bias_name").alias("bias_name")).agg(F.count("*").alias("n"))


def distinct_biases(traces: DataFrame) -> DataFrame:
    return traces.select(F.explode("hypotheses").alias("h")).agg(F.count_distinct("h.bias_name").alias("distinct_biases"))


def run_counts(stories: DataFrame) -> DataFrame:
    """Stories, successes and errors of each dataset."""
    return stories.groupBy("dataset").agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
