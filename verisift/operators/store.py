"""Queries and updates of the four stores: runs, traces, results, calls."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(table: DataFrame, path: str, id_column: str = "id", time_column: str = "created_at") -> None:
    """Appends rows; missing ids and times are filled in."""
    rows = with_defaults(table, id_column, time_column)
    rows.write.mode("append").parquet(path)


def with_defaults(table: DataFrame, id_column: str = "id", time_column: str = "created_at") -> DataFrame:
    ident = F.coalesce(F.col(id_column), F.uuid()) if id_column in table.columns else F.uuid()
    time = F.coalesce(F.col(time_column), F.current_timestamp()) if time_column in table.columns else F.current_timestamp()
    return table.withColumn(id_column, ident).withColumn(time_column, time)


def where_equal(table: DataFrame, **values: object) -> DataFrame:
    """Rows that equal all given values; a value that is empty or None is not applied."""
    conditions = [F.col(c) == v for c, v in values.items() if v not in (None, "")]
    return table.where(reduce(Column.__and__, conditions)) if conditions else table


def in_order(table: DataFrame, *keys: str) -> DataFrame:
    return table.orderBy(*keys)


def latest(table: DataFrame, n: int, time: str = "run_at", ident: str = "id") -> DataFrame:
    """The n newest rows, ties by the greater id."""
    return table.orderBy(F.desc(time), F.desc(ident)).limit(n)


def first_or_none(table: DataFrame, *keys: str) -> DataFrame:
    """The first row in order of the keys, if there is any."""
    return table.orderBy(*keys).limit(1)


def calls_between(calls: DataFrame, start: datetime | None, end: datetime | None, oldest: int | None = None, **equal: object) -> DataFrame:
    """Calls of a closed time range; a missing end is the newest call's time, a missing start 30 days before it (one row is read first).

    `oldest` keeps that many of the oldest rows, as the recorded service does; None keeps all.
    """
    rows = where_equal(calls, **equal)
    if start is None or end is None:
        newest = calls.agg(F.max("created_at")).first()[0]
        if newest is None:
            return rows.limit(0)
        start, end = start or newest - timedelta(days=30), end or newest
    # Literals of the column's own type reach the scan.
    kind = calls.schema["created_at"].dataType
    rows = rows.where(F.col("created_at").between(F.lit(start).cast(kind), F.lit(end).cast(kind)))
    return rows if oldest is None else rows.orderBy("created_at", "id").limit(oldest)


def overlay(base: DataFrame, updates: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """Base rows with the given columns taken from the update of equal key, nulls too; updates of unknown keys do nothing."""
    names = list(columns)
    fresh = updates.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in names])
    joined = base.join(fresh, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.when(F.col("_key").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in base.columns])


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent exists."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def run_aggregates(results: DataFrame) -> DataFrame:
    """Rows, passes and first time of each evaluation run, newest first; rows without a run are left out."""
    return results.where(F.col("eval_run_id").isNotNull()).groupBy("eval_run_id").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.min("run_at").alias("first_run_at")).orderBy(F.desc("first_run_at"), "eval_run_id")


def conflicts(results: DataFrame) -> DataFrame:
    """Inputs (hash, version) that some results pass and others fail."""
    sides = results.where(F.col("passed").isNotNull()).groupBy("input_hash", "prompt_version").agg(F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"))
    return sides.where((F.col("n_passed") > 0) & (F.col("n_failed") > 0))
