"""Column functions that recover JSON records from model output."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import text_trim

#: snake_case names that models use, and the contract's.
RENAMED = {"reasoning_trace": "reasoningTrace", "no_bias_detected": "noBiasDetected"}
#: String literals (an unclosed one runs to the end), brackets, and all between them: together they tile a text.
TOKENS = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"?|[{}\[\]]|[^"{}\[\]]++'

#: Stands behind a text to show that it was parsed to its end: the parser itself stops after the first value.
LAST = "\u2404last"

#: A condition on a field's value, by its path: "biases" an array, "biases[]" each element, "biases[].name" a field of each.
Rules = Mapping[str, Callable[[Column], Column]]


def unfenced(text: Column) -> Column:
    """Trimmed, without a Markdown code fence around it."""
    trimmed = text_trim(text)
    inner = F.regexp_replace(F.regexp_replace(trimmed, r"(?i)^```(?:json)?\s*\n?", ""), r"\n?\s*```$", "")
    return F.when(F.startswith(trimmed, F.lit("```")), text_trim(inner)).otherwise(trimmed)


def parsed(text: Column) -> Column:
    """The value of a JSON text, null if it is none or something follows."""
    whole = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit(f',"{LAST}":0}}')))
    return F.when(F.try_variant_get(whole, f"$['{LAST}']", "int") == 0, F.try_variant_get(whole, "$.value", "variant"))


def _recovered(rows: DataFrame, column: str) -> DataFrame:
    """Adds _json, the text of the JSON value, and _value, the value parsed (null if it does not parse).

    A text that parses as it is needs no search.  Else tokens are folded up to the bracket that closes the first one.
    Each step is a column of its own, computed once.
    """
    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(state: Column, token: Column) -> Column:
        at = state["at"] + F.length(token)
        depth = state["depth"] + F.when(token == F.col("_opens"), 1).when(token == F.col("_closes"), -1).otherwise(0)
        ends = (state["end"] == 0) & (token == F.col("_closes")) & (depth == 0)
        return F.struct(at.alias("at"), depth.alias("depth"), F.when(ends, at).otherwise(state["end"]).alias("end"))

    brace, bracket = F.instr("_clean", "{"), F.instr("_clean", "[")
    is_object = (brace > 0) & ((bracket == 0) | (brace <= bracket))
    found = rows.withColumn("_clean", unfenced(F.col(column))).withColumn("_start", F.when(is_object, brace).otherwise(bracket)).withColumn("_direct", parsed(F.col("_clean")))
    found = found.withColumn("_search", (F.col("_start") > 0) & ~(F.col("_direct").isNotNull() & (F.col("_start") == 1)))
    found = found.withColumn("_tail", F.when(F.col("_search"), F.substr("_clean", F.col("_start"))))
    found = found.withColumn("_opens", F.substring("_tail", 1, 1)).withColumn("_closes", F.when(F.col("_opens") == "{", "}").otherwise("]"))
    found = found.withColumn("_end", F.when(F.col("_search"), F.aggregate(F.regexp_extract_all("_tail", F.lit(TOKENS), F.lit(0)), none, step)["end"]))
    found = found.withColumn("_json", F.when(~F.col("_search"), F.col("_clean")).when(F.col("_end") > 0, F.substr("_tail", F.lit(1), F.col("_end"))).otherwise(F.col("_tail")))
    found = found.withColumn("_value", F.when(F.col("_search"), parsed(F.col("_json"))).otherwise(F.col("_direct")))
    return found.select(*rows.columns, "_json", "_value")


def with_json(rows: DataFrame, column: str, out: str = "json") -> DataFrame:
    """Adds the text from the first brace or bracket to the one that closes it, strings and escapes minded.

    What never closes is given to its end, text without either as it is.
    """
    kept = [c for c in rows.columns if c != out]
    return _recovered(rows, column).select(*kept, F.col("_json").alias(out))


def _typed(value: Column, kind: T.DataType, rules: Rules, path: str) -> tuple[Column, Column]:
    """Whether a variant is a value of the type and keeps the rules, and the value.  Nothing is coerced: 5 is no string.

    A struct's field that may be null may be absent, but not null.
    """
    shape = F.schema_of_variant(value)
    if isinstance(kind, T.ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        good = F.startswith(shape, F.lit("ARRAY<")) & F.forall(items, lambda x: F.coalesce(_typed(x, kind.elementType, rules, f"{path}[]")[0], F.lit(False)))
        out = F.transform(items, lambda x: _typed(x, kind.elementType, rules, f"{path}[]")[1])
    elif isinstance(kind, T.StructType):
        good, fields = F.startswith(shape, F.lit("OBJECT<")), []
        for f in kind.fields:
            inner = F.try_variant_get(value, f"$.{f.name}", "variant")
            fits, own = _typed(inner, f.dataType, rules, f"{path}.{f.name}" if path else f.name)
            good = good & F.when(inner.isNull(), F.lit(f.nullable)).otherwise(F.coalesce(fits, F.lit(False)))
            fields.append(own.alias(f.name))
        out = F.struct(*fields)
    else:
        names = {T.StringType: "^STRING$", T.BooleanType: "^BOOLEAN$"}
        good, out = shape.rlike(names.get(type(kind), r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")), F.try_variant_get(value, "$", kind.simpleString())
        if isinstance(kind, T.IntegralType):
            good = good & (F.try_variant_get(value, "$", "double") == out)
    if path in rules:
        good = good & F.coalesce(rules[path](out), F.lit(False))
    return F.coalesce(good, F.lit(False)), out


def _fields(value: Column, schema: T.StructType, rules: Rules) -> list[tuple[T.StructField, Column, Column, Column]]:
    """Each top-level field with whether it is there, whether it is valid, and its value.  A snake_case name counts where the contract's is absent."""
    old = {new: old for old, new in RENAMED.items()}
    out = []
    for f in schema.fields:
        inner = F.try_variant_get(value, f"$.{f.name}", "variant")
        if f.name in old:
            inner = F.coalesce(inner, F.try_variant_get(value, f"$.{old[f.name]}", "variant"))
        out.append((f, inner.isNotNull(), *_typed(inner, f.dataType, rules, f.name)))
    return out


def _record(value: Column, schema: T.StructType, rules: Rules) -> Column:
    return F.struct(*[F.when(there & good, own).alias(f.name) for f, there, good, own in _fields(value, schema, rules)])


def with_record(rows: DataFrame, column: str, schema: T.StructType, rules: Rules | None = None, out: str = "record") -> DataFrame:
    """Adds a record of the schema's top-level fields from any text; a field that is missing, of another type at any depth, or
    against its rules is null as a whole.

    The record is null where the text holds no JSON object or array (an array has none of the fields).
    """
    kept = [c for c in rows.columns if c != out]
    found = _recovered(rows, column)
    whole = F.schema_of_variant("_value").rlike("^(OBJECT|ARRAY)<")
    return found.select(*kept, F.when(F.coalesce(whole, F.lit(False)), _record(F.col("_value"), schema, rules or {})).alias(out))


def with_strict(rows: DataFrame, column: str, schema: T.StructType, required: list[str] | None = None, rules: Rules | None = None, out: str = "record") -> DataFrame:
    """Adds the record of a JSON text that is valid as it stands, else null: no search, no field lost; fields that may not be null, or
    are `required`, must be there."""
    kept = [c for c in rows.columns if c != out]
    found = rows.withColumn("_value", parsed(F.col(column)))
    valid = F.startswith(F.schema_of_variant("_value"), F.lit("OBJECT<"))
    for f, there, good, _ in _fields(F.col("_value"), schema, rules or {}):
        needed = not f.nullable or f.name in (required or ())
        valid = valid & F.when(there, good).otherwise(F.lit(not needed))
    return found.select(*kept, F.when(F.coalesce(valid, F.lit(False)), _record(F.col("_value"), schema, rules or {})).alias(out))


def with_fallback(rows: DataFrame, primary: str, fallback: str, schema: T.StructType, required: list[str] | None = None, rules: Rules | None = None) -> DataFrame:
    """Adds `record`, what is recovered from the primary text, else the fallback's if it is strictly valid, and `source`, which it was."""
    both = with_strict(with_record(rows, primary, schema, rules, "_first"), fallback, schema, required, rules, "_second")
    first, second = F.col("_first").isNotNull(), F.col("_second").isNotNull()
    kept = [c for c in rows.columns if c not in ("record", "source")]
    return both.select(*kept, F.when(first, F.col("_first")).otherwise(F.col("_second")).alias("record"), F.when(first, "primary").when(second, "fallback").otherwise("failed").alias("source"))
