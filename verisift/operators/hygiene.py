"""Line scans for personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stories import lines

# What counts as a find.
PATTERNS = {"longDigitSequence": r"\d{10,}", "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"}


def scan(texts: DataFrame, key: str, column: str) -> DataFrame:
    """key, line (from 1), pattern and match of every find; texts without any are not cut into lines."""
    candidates = texts.where(F.col(column).rlike("|".join(PATTERNS.values())))
    each = lines(candidates, key, column)
    found = F.concat(*[_all(name, p) for name, p in PATTERNS.items()])
    return each.select(key, "line", F.explode(found).alias("f")).select(key, "line", "f.pattern", "f.match")


def _all(name: str, pattern: str):
    return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda match: F.struct(F.lit(name).alias("pattern"), match.alias("match")))
