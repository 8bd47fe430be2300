"""Reliability of a stream of calls: an addition to the batch metrics.

Exact percentiles would keep every value in state; a stream uses sketches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import share


def windowed(calls: DataFrame, window: str = "1 day", late: str = "1 day", *dims: str) -> DataFrame:
    """Totals, rates and approximate percentiles of each window (and dimension); later calls than `late` are dropped."""
    n, primary = F.count("*"), F.count_if(F.col("call_type") == "primary")
    grouped = calls.withWatermark("created_at", late).groupBy(F.window("created_at", window), *dims)
    out = grouped.agg(
        n.alias("total"), F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 6).alias("avg_ms"), F.approx_percentile("duration_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("percentiles"),
        F.round(share(F.count_if(F.col("status") == "success"), n), 6).alias("success_rate"), F.round(share(F.count_if(F.col("status") == "timeout"), n), 6).alias("timeout_rate"), F.round(share(F.count_if(F.col("call_type") == "fallback"), primary), 6).alias("fallback_rate"),
    )
    return out.select(F.col("window.start").alias("window_start"), *dims, "total", "avg_ms", F.get("percentiles", F.lit(0)).alias("p50_ms"), F.get("percentiles", F.lit(1)).alias("p95_ms"), F.get("percentiles", F.lit(2)).alias("p99_ms"), "success_rate", "timeout_rate", "fallback_rate")
