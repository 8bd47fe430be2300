"""Contract rules as arrays of violation codes: an empty array is a valid record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CERTAIN, FIELD_MIN, QUESTIONS_MAX, QUESTIONS_MIN, SCHEMA_VERSION, STORY_MAX, STORY_MIN

# The allowed pairs of stage and scope.
SCOPES = {"initial_assessment": "story_only", "post_questions_assessment": "story_plus_answers"}


def codes(**rules: Column) -> Column:
    """The names of the rules that hold, in the order given; a null rule does not."""
    return F.array_compact(F.array(*[F.when(condition, name) for name, condition in rules.items()]))


def story(text: Column) -> Column:
    n = F.length(text)
    return codes(story_missing=text.isNull(), story_too_short=n < STORY_MIN, story_too_long=n > STORY_MAX)


def run(stage: Column, scope: Column) -> Column:
    right = F.coalesce(*[F.when(stage == s, scope == c) for s, c in SCOPES.items()], F.lit(False))
    return codes(stage_unknown=~F.coalesce(stage.isin(*SCOPES), F.lit(False)), scope_inconsistent=~F.coalesce(right, F.lit(False)))


def _empty(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)) == 0


def _no_share(value: Column) -> Column:
    return value.isNull() | (value < 0) | (value > 1)


def hypothesis(name: Column, confidence: Column, n_reasons: Column, reasons: Column | None = None) -> Column:
    """reasons: the texts themselves, where their own rule is to be held too."""
    more = {} if reasons is None else {"empty_reason": F.exists(reasons, _empty)}
    return codes(name_empty=_empty(name), confidence_out_of_range=_no_share(confidence), reasons_required=(confidence < CERTAIN) & (F.coalesce(n_reasons, F.lit(0)) == 0), **more)


def evidence_entry(entry: Column) -> Column:
    return codes(source_unknown=~F.coalesce(entry["source"].isin("story", "answer"), F.lit(False)), excerpt_empty=_empty(entry["excerpt"]), relevance_empty=_empty(entry["relevance"]))


def interpretation(item: Column) -> Column:
    return codes(text_empty=_empty(item["interpretation"]), plausibility_out_of_range=_no_share(item["plausibility"]), evidence_missing=item["supporting_evidence"].isNull())


def evidence_mapping(item: Column) -> Column:
    return codes(bias_empty=_empty(item["bias_id"]), no_evidence=F.coalesce(F.size(item["evidence"]), F.lit(0)) == 0, entry_invalid=F.exists(item["evidence"], lambda e: F.size(evidence_entry(e)) > 0))


def assessment(output: Column) -> Column:
    return codes(
        biases_missing=output["biases"].isNull(), bias_invalid=F.exists(output["biases"], lambda b: F.size(bias(b)) > 0), prompt_short=F.coalesce(F.length(output["reflectionPrompt"]), F.lit(0)) < FIELD_MIN,
        flag_missing=output["noBiasDetected"].isNull(), version_unknown=output["schema_version"] != SCHEMA_VERSION, context_unknown=~output["inputContext"].isin("story-only", "full"), model_empty=F.length(output["modelName"]) == 0,
    )


def metrics(*rates: Column) -> Column:
    """Rates that are known lie between 0 and 1."""
    return codes(**{f"rate_{k}_out_of_range": (r < 0) | (r > 1) for k, r in enumerate(rates)})


def questions(items: Column) -> Column:
    return codes(too_few=F.size(items) < QUESTIONS_MIN, too_many=F.size(items) > QUESTIONS_MAX, empty_question=F.exists(items, lambda q: F.length(q) == 0))


def bias(item: Column) -> Column:
    short = lambda c: F.coalesce(F.length(item[c]), F.lit(0)) < FIELD_MIN
    return codes(name_empty=F.coalesce(F.length(item["name"]), F.lit(0)) == 0, explanation_short=short("explanation"), connection_short=short("storyConnection"), perspective_short=short("alternativePerspective"))


def full_mode(n_questions: Column, n_answers: Column) -> Column:
    return codes(no_questions=F.coalesce(n_questions, F.lit(0)) == 0, no_answers=F.coalesce(n_answers, F.lit(0)) == 0, length_mismatch=~n_questions.eqNullSafe(n_answers))
