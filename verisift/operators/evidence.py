"""Evidence violations as a table, positional question-answer pairs, and context texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import excerpt_in_input
from ..functions.text import text_trim


def violations(assessments: DataFrame, key: str = "id") -> DataFrame:
    """A row for each fault of (key, story, answers, biases): no_evidence_entries, empty_excerpt, excerpt_not_in_input, in order."""
    each = assessments.select(key, "story", "answers", F.posexplode("biases").alias("bias_pos", "bias"))
    lines = each.select(key, "story", "answers", "bias_pos", F.col("bias.name").alias("bias_name"), F.posexplode_outer("bias.evidence").alias("evidence_pos", "evidence"))
    excerpt = F.col("evidence.excerpt")
    kind = (
        F.when(F.col("evidence_pos").isNull(), "no_evidence_entries")
        .when(text_trim(F.coalesce(excerpt, F.lit(""))) == "", "empty_excerpt")
        .when(~excerpt_in_input(excerpt, F.col("story"), F.col("answers")), "excerpt_not_in_input")
    )
    return lines.withColumn("violation", kind).where(F.col("violation").isNotNull()).select(key, "bias_pos", "bias_name", F.coalesce("evidence_pos", F.lit(0)).alias("evidence_pos"), F.coalesce(excerpt, F.lit("")).alias("excerpt"), "violation")


def paired(questions: Column, answers: Column) -> Column:
    """`Q: ...` and `A: ...` of equal places, pairs parted by a blank line; a missing answer reads `undefined`."""
    lines = F.transform(questions, lambda q, k: F.concat(F.lit("Q: "), q, F.lit("\nA: "), F.coalesce(F.get(answers, k), F.lit("undefined"))))
    return F.array_join(lines, "\n\n")


def top_interpretations(interpretations: Column, n: int = 2) -> Column:
    """The first n of (interpretation, plausibility) as numbered lines, in the order given."""
    lines = F.transform(F.slice(interpretations, 1, n), lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x["interpretation"], F.lit(" (plausibility: "), x["plausibility"].cast("string"), F.lit(")")))
    return F.array_join(lines, "\n")


def context(analysis: Column, interpretations: Column) -> Column:
    """What the questions' prompt says of a story: themes, tone and events where they are known, then the first interpretations."""
    empty = F.lit("")
    of = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, empty), F.lit("\n"))
    known = F.when(analysis.isNotNull(), F.concat(of("Themes", F.array_join(analysis["themes"], ", ")), of("Emotional tone", analysis["emotional_tone"]), of("Key events", F.array_join(analysis["key_events"], ", "))))
    some = F.when(F.size(interpretations) > 0, F.concat(F.lit("\nPlausible interpretations:\n"), top_interpretations(interpretations)))
    return F.concat(F.coalesce(known, empty), F.coalesce(some, empty))


def question_prompt(story: Column, context_text: Column) -> Column:
    """The user's part of the questions' prompt."""
    return F.when(F.length(context_text) > 0, F.concat(F.lit("REASONING CONTEXT:\n"), context_text, F.lit("\n\nSTORY: "), story)).otherwise(F.concat(F.lit("STORY: "), story))


def public_view(assessments: DataFrame, prompt_version: str, model: str, with_trace: bool = False) -> DataFrame:
    """Stamped with versions and the input's kind, without the trace unless asked for."""
    stamped = assessments.withColumns({"prompt_version": F.lit(prompt_version), "model_name": F.lit(model), "input_context": F.when(F.col("mode") == "story_only", "story-only").otherwise("full")})
    return stamped if with_trace else stamped.drop("reasoning_trace")


def no_bias_flag(flag: Column, n_biases: Column) -> Column:
    """A missing or false flag becomes true without findings, a missing one false with some; a stated true stays."""
    return F.when((n_biases == 0) & ~F.coalesce(flag, F.lit(False)), True).when(flag.isNull(), False).otherwise(flag)
