"""Column functions that classify errors and time calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First delay of a retry and its growth.
BASE_DELAY_MS, GROWTH = 2000, 2


def repair_failure(message: Column) -> Column:
    """What a failed repair counts as."""
    return F.when(F.lower(message).rlike("parse|json"), "parse_error").otherwise("schema_validation")


def call_status(error: Column) -> Column:
    """Status and failure type of a call by the kind of its exception; null: none."""
    timed_out = error == "TimeoutError"
    return F.struct(
        F.when(error.isNull(), "success").when(timed_out, "timeout").otherwise("error").alias("status"),
        F.when(timed_out, "timeout").when(error.isNotNull(), "provider_error").alias("failure_type"),
    )


def provider_error(message: Column, status: Column | None = None, at: Column | None = None) -> Column:
    """Kind (rate_limit, timeout, other), limit type and seconds to the reset, from the status code and the message's words.

    at: the time of the error; then reset_at, the time of the reset, is given too.
    """
    low = F.lower(message)
    limited = F.contains(message, F.lit("429")) | F.contains(low, F.lit("rate limit"))
    if status is not None:
        limited = F.coalesce(status == 429, F.lit(False)) | F.coalesce(limited, F.lit(False))
    seconds = F.regexp_extract(message, r"(?i)reset\s+in\s+(\d+)\s+seconds", 1)
    return F.struct(
        F.when(limited, "rate_limit").when(low.rlike("timeout|timed out|deadline exceeded"), "timeout").otherwise("other").alias("kind"),
        F.when(limited, F.when(low.rlike("quota|daily"), "daily").otherwise("per-minute")).alias("limit_type"),
        F.when(limited & (seconds != ""), seconds.cast("long")).alias("reset_seconds"),
        *([] if at is None else [F.when(limited & (seconds != ""), F.timestamp_add("SECOND", seconds.cast("int"), at)).alias("reset_at")]),
    )


def duration_ms(started: Column, ended: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", started, ended)


def backoff_ms(attempt: Column) -> Column:
    """Delay before the retry after an attempt (from 1), without jitter."""
    return (F.lit(BASE_DELAY_MS) * F.pow(F.lit(GROWTH), attempt - 1)).cast("long")
