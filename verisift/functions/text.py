"""Column functions on labels and templates: normalising, similarity, hashing, rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of token overlap and edit similarity, and the confidence that a match must pass.
OVERLAP_WEIGHT, EDIT_WEIGHT, ACCEPT = 0.6, 0.4, 0.5


def text_trim(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_label(label: Column) -> Column:
    """Lower case; all but letters a-z, digits and white space deleted; white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(label), r"[^a-z0-9\s]", ""), r"\s+", " "))


def tokens(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def token_overlap(a: Column, b: Column) -> Column:
    """Tokens of b, repeats counted, that a has, by the distinct tokens of either; may pass 1."""
    left, right = tokens(a), tokens(b)
    return F.size(F.filter(right, lambda t: F.array_contains(left, t))) / F.size(F.array_union(left, right))


def jaccard(a: Column, b: Column) -> Column:
    """Elements of array a, repeats counted, that b has, by the distinct elements of either; null for two empty arrays."""
    return F.try_divide(F.size(F.filter(a, lambda t: F.array_contains(b, t))).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance by the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def similarity(label: Column, name: Column) -> Column:
    """Weighted token overlap and edit similarity of two normalised labels."""
    return F.lit(OVERLAP_WEIGHT) * token_overlap(label, name) + F.lit(EDIT_WEIGHT) * (F.lit(1.0) - edit_distance(label, name))


def input_hash(version: Column, model: Column, story: Column, answers: Column) -> Column:
    """SHA-256 of the parts and all answers, joined by a blank line; null parts count as empty."""
    empty = F.lit("")
    parts = F.concat(F.array(*[F.coalesce(c, empty) for c in (version, model, story)]), F.coalesce(answers, F.array().cast("array<string>")))
    return F.sha2(F.array_join(parts, "\n\n", ""), 256)


def render(template: Column, values: dict[str, Column]) -> Column:
    """The first {{key}} of each key replaced by its value; a null one counts as empty."""

    def put(text: Column, item: tuple[str, Column]) -> Column:
        mark = "{{" + item[0] + "}}"
        at = F.instr(text, mark)
        return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.coalesce(item[1], F.lit("")), F.substr(text, at + len(mark)))).otherwise(text)

    return reduce(put, values.items(), template)
