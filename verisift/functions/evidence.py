"""Column functions that hold excerpts against the input they claim to come from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_trim

#: Confidence over which a finding on a neutral story counts as false, where a story sets none.
THRESHOLD = 0.5
#: Confidence of a finding that states none.
UNSTATED = 1.0


def excerpt_in_input(excerpt: Column, story: Column, answers: Column) -> Column:
    """Whether the trimmed excerpt is non-empty and stands verbatim in the story or any answer."""
    trimmed = text_trim(F.coalesce(excerpt, F.lit("")))
    in_answers = F.exists(F.coalesce(answers, F.array().cast("array<string>")), lambda a: F.contains(a, trimmed))
    return (trimmed != "") & F.coalesce(F.contains(story, trimmed) | in_answers, F.contains(story, trimmed), in_answers, F.lit(False))


def grounded_rate(biases: Column, story: Column, answers: Column) -> Column:
    """Share of findings that have evidence, all of it grounded; null without findings."""
    good = F.filter(biases, lambda b: (F.coalesce(F.size(b["evidence"]), F.lit(0)) > 0) & F.forall(b["evidence"], lambda e: excerpt_in_input(e["excerpt"], story, answers)))
    return F.when(F.coalesce(F.size(biases), F.lit(0)) > 0, F.size(good) / F.size(biases))


def false_positive(biases: Column, is_neutral: Column, threshold: Column | None = None) -> Column:
    """Null without the flag, false on ordinary stories, else whether any finding is more confident than the threshold."""
    limit = F.lit(THRESHOLD) if threshold is None else F.coalesce(threshold, F.lit(THRESHOLD))
    found = F.exists(biases, lambda b: F.coalesce(b["confidence"], F.lit(UNSTATED)) > limit)
    return F.when(is_neutral, F.coalesce(found, F.lit(False))).when(~is_neutral, F.lit(False))


def flag_code(flag: Column, null_as_zero: bool = False) -> Column:
    """1 for true, 0 for false; null stays, or counts as 0, as the two kinds of stored results have it."""
    code = flag.cast("int")
    return F.coalesce(code, F.lit(0)) if null_as_zero else code


def n_violations(biases: Column, story: Column, answers: Column) -> Column:
    """Faults of all findings: one for a finding without evidence, one for each entry that is empty or not in the input."""
    bad = lambda b: F.size(F.filter(b["evidence"], lambda e: ~excerpt_in_input(e["excerpt"], story, answers)))
    each = F.transform(biases, lambda b: F.when(F.coalesce(F.size(b["evidence"]), F.lit(0)) == 0, F.lit(1)).otherwise(bad(b)))
    return F.coalesce(F.aggregate(each, F.lit(0), lambda s, x: s + x), F.lit(0))
