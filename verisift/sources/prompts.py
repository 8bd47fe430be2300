"""Prompt templates with their version and the guardrails that all of them hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.text import render

#: The template whose version stands for all.
VERSIONED = "assessment"


@dataclass(frozen=True)
class Prompts:
    guardrails: str
    #: content and version by name
    templates: dict[str, tuple[str, str]]

    @property
    def version(self) -> str:
        return self.templates[VERSIONED][1]

    def render(self, name: str, values: dict[str, Column] | None = None) -> Column:
        """A template with the guardrails and the first place of each value filled in, for every row."""
        if name not in self.templates:
            raise ValueError(f"Unknown template: {name}")
        return render(F.lit(self.templates[name][0]), {"guardrails": F.lit(self.guardrails), **(values or {})})


def read_prompts(spark: SparkSession, guardrails: str, **paths: str) -> Prompts:
    """From JSON files of content and version, one for each template; a malformed file fails the read."""

    def one(path: str) -> tuple[str, str]:
        row = spark.read.schema("content string, version string").option("multiLine", True).option("mode", "FAILFAST").json(path).first()
        return row.content, row.version

    return Prompts(one(guardrails)[0], {name: one(path) for name, path in paths.items()})
