"""Stores on append-only Parquet folders: rows are added, updates too, and both are merged when read.

Every method gives a DataFrame; nothing is collected.  Of several updates of one row the last written counts; those of unknown
rows do nothing.  A store that was never written is empty.
"""

from __future__ import annotations

from datetime import datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import metrics, store


class Runs(Protocol):
    """What an engine needs of a store of runs; any table format can give it."""

    def add(self, rows: DataFrame) -> None: ...
    def read(self) -> DataFrame: ...
    def by_session(self, session_id: str) -> DataFrame: ...


class Traces(Protocol):
    def add(self, rows: DataFrame) -> None: ...
    def read(self) -> DataFrame: ...
    def by_run(self, run_id: str) -> DataFrame: ...
    def hypotheses(self) -> DataFrame: ...


class Results(Protocol):
    def add(self, rows: DataFrame) -> None: ...
    def read(self) -> DataFrame: ...
    def by_hash(self, input_hash: str, prompt_version: str) -> DataFrame: ...
    def latest(self, prompt_version: str, n: int) -> DataFrame: ...
    def by_eval_run(self, eval_run_id: str) -> DataFrame: ...
    def aggregates(self) -> DataFrame: ...


class Calls(Protocol):
    def add(self, rows: DataFrame) -> None: ...
    def read(self) -> DataFrame: ...
    def update_parsed_output(self, rows: DataFrame) -> None: ...
    def update_failure(self, rows: DataFrame) -> None: ...
    def for_metrics(self, start: datetime | None, end: datetime | None, provider: str | None, model: str | None, stage: str | None, oldest: int | None) -> DataFrame: ...


class _Store:
    name: str
    time = "created_at"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.schema = spark, f"{path.rstrip('/')}/{self.name}", schemas.schema(schemas.SCHEMAS[self.name])

    def _exists(self, part: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def add(self, rows: DataFrame) -> None:
        """Appends rows; ids and times that are missing are made, other missing columns are null."""
        full = store.with_defaults(rows, "id", self.time)
        full.select(*[(F.col(f.name) if f.name in full.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]).write.mode("append").parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        if not self._exists("rows"):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")


class RunStore(_Store):
    name = "runs"

    def by_session(self, session_id: str) -> DataFrame:
        return store.in_order(self.read().where(F.col("session_id") == session_id), "created_at", "id")


class TraceStore(_Store):
    name = "traces"

    def by_run(self, run_id: str) -> DataFrame:
        return store.first_or_none(self.read().where(F.col("run_id") == run_id), "created_at", "id")

    def hypotheses(self) -> DataFrame:
        """All traces with their hypotheses as metrics.trace_analytics takes them."""
        return metrics.read_traces(self.read())

    def without_orphans(self, runs: RunStore) -> DataFrame:
        return store.cascade(self.read(), runs.read().select(F.col("id").alias("run_id")), "run_id")


def checked(json: Column, ddl: str) -> Column:
    """A record of rates; a malformed text or a rate outside 0 to 1 fails the read."""
    record = F.from_json(json, ddl, {"mode": "FAILFAST"})
    wrong = [~record[f.name].between(0, 1) for f in schemas.schema(ddl)]
    bad = F.coalesce(wrong[0], F.lit(False))
    for w in wrong[1:]:
        bad = bad | F.coalesce(w, F.lit(False))
    return F.when(bad, F.raise_error(F.concat(F.lit("a rate outside 0 to 1: "), json)).cast(schemas.schema(ddl))).otherwise(record)


class ResultStore(_Store):
    name, time = "results", "run_at"

    def records(self) -> DataFrame:
        """All results with both metrics as records, checked."""
        rows = self.read()
        return rows.withColumns({"evaluation_metrics": checked(F.col("evaluation_metrics"), schemas.METRICS), "system_metrics": checked(F.col("system_metrics"), schemas.SYSTEM_METRICS)})

    def by_hash(self, input_hash: str, prompt_version: str) -> DataFrame:
        return store.first_or_none(self.read().where((F.col("input_hash") == input_hash) & (F.col("prompt_version") == prompt_version)), "run_at", "id")

    def latest(self, prompt_version: str, n: int) -> DataFrame:
        return store.latest(self.read().where(F.col("prompt_version") == prompt_version), n)

    def by_eval_run(self, eval_run_id: str) -> DataFrame:
        return store.in_order(self.read().where(F.col("eval_run_id") == eval_run_id), "run_at", "id")

    def aggregates(self) -> DataFrame:
        return store.run_aggregates(self.read())


class CallStore(_Store):
    name = "calls"
    #: Folders of updates and the columns that each replaces.
    updates = {"parsed": ("parsed_output",), "failures": ("status", "failure_type", "error_message")}

    def _put(self, part: str, rows: DataFrame) -> None:
        columns = ["id", *self.updates[part]]
        rows.select(*[F.col(c).cast("string").alias(c) for c in columns]).withColumn("at", F.struct(F.current_timestamp().alias("time"), F.monotonically_increasing_id().alias("row"))).write.mode("append").parquet(f"{self.path}/{part}")

    def update_parsed_output(self, rows: DataFrame) -> None:
        """(id, parsed_output)"""
        self._put("parsed", rows)

    def update_failure(self, rows: DataFrame) -> None:
        """(id, failure_type, error_message): the calls become errors, a null message too replaces."""
        self._put("failures", rows.withColumn("status", F.lit("error")))

    def read(self) -> DataFrame:
        rows = super().read()
        for part, columns in self.updates.items():
            if self._exists(part):
                last = self.spark.read.parquet(f"{self.path}/{part}").groupBy("id").agg(F.max_by(F.struct(*columns), "at").alias("u")).select("id", "u.*")
                rows = store.overlay(rows, last, "id", columns)
        return rows

    def by_session(self, session_id: str) -> DataFrame:
        return store.in_order(self.read().where(F.col("session_id") == session_id), "created_at", "id")

    def by_stage(self, stage: str) -> DataFrame:
        return store.in_order(self.read().where(F.col("stage") == stage), "created_at", "id")

    def by_provider(self, provider: str) -> DataFrame:
        return store.in_order(self.read().where(F.col("provider") == provider), "created_at", "id")

    def by_session_and_stage(self, session_id: str, stage: str) -> DataFrame:
        return store.in_order(self.read().where((F.col("session_id") == session_id) & (F.col("stage") == stage)), "created_at", "id")

    def for_metrics(self, start: datetime | None = None, end: datetime | None = None, provider: str | None = None, model: str | None = None, stage: str | None = None, oldest: int | None = None) -> DataFrame:
        return store.calls_between(self.read(), start, end, oldest, provider=provider, model=model, stage=stage)
