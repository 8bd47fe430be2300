"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source (or the rest, key REST) that is to make up the share w of an output of `size` rows has the mean
repetition rate m = w * size / rows of the source.  Each document draws a uniform number from the hash of
(seed, doc_id) and repeats as often as the inverse Poisson distribution of mean m says: rows whose
rate is 0.3 come out about 0.3 times on the average, whole and independently of all others.  Copies are dealt out and
sorted by the hash of (seed, doc_id, replica): a global random order that any rerun gives again.

Weights need not sum to 1; they are scaled over the keys that have rows.  The keys are a parameter, so the counts
gathered are bounded by its length, whatever the number of sources.  A null source belongs to the rest; a key
of weight 0 or a rest without a weight is dropped.  A row without a doc_id hashes by its text instead, whatever its length, and such
rows are dealt among all tasks.  Rows that share a doc_id repeat alike.  Texts are carried unread, null and empty ones too.  An
empty table gives no rows.  All other columns are carried; `replica` and `shuffle_key` replace columns of these names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

REST = "*"
#: A uniform number is the first 52 bits of a hash.
BITS = 52


def key_of(weights: dict[str, float], source: Column | None = None) -> Column:
    source = (F.col("source") if source is None else source).cast("string")
    return F.when(source.isin(sorted(k for k in weights if k != REST)), source).otherwise(F.lit(REST))


def rates(counts: dict[str, int], weights: dict[str, float], size: int) -> dict[str, float]:
    """Mean repetition rate of each key that has rows."""
    live = {k: weights[k] for k in sorted(counts) if weights.get(k, 0) > 0 and counts[k]}
    total = math.fsum(live.values())
    return {k: w / total * size / counts[k] for k, w in live.items()}


def steps(mean: float) -> list[float]:
    """The Poisson distribution function at 0, 1, ... until it no longer grows."""
    out, term, total, k = [], math.exp(-mean), 0.0, 0
    while term > 0 or k <= mean:
        new = total + term
        if new == total and k > mean:
            break
        out.append(min(new, 1.0))
        total, k = new, k + 1
        term *= mean / k
    return out


def identity(docs: DataFrame) -> Column:
    """What a row is hashed by: its doc_id, or its text's hash."""
    text = F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text"), F.lit("")))) if "text" in docs.columns else F.lit("")
    return F.coalesce(F.col("doc_id").cast("string"), text)


def uniform(seed: int, ident: Column) -> Column:
    """A number in [0, 1) from the hash of seed and identity."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), ident)), 1, BITS // 4), 16, 10).cast("double") / F.lit(float(1 << BITS))


def inverse(distribution: list[float], u: Column) -> Column:
    """The number of steps that u has passed."""
    return F.size(F.filter(F.array(*map(F.lit, distribution)), lambda step: step <= u))


def mix(docs: DataFrame, weights: dict[str, float], size: int | None = None, seed: int = 17) -> DataFrame:
    """The documents repeated to the weights and shuffled; `size` (the number of rows by default) is the expected number of rows."""
    if any(w < 0 for w in weights.values()):
        raise ValueError("a weight is negative")
    docs = docs.drop("replica", "shuffle_key")
    key = key_of(weights)
    counts = {r.key: r.n for r in docs.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n")).collect()}
    means = rates(counts, weights, sum(counts.values()) if size is None else size)
    ident = identity(docs)
    draws = F.lit(0)
    for name, mean in means.items():
        parts = math.ceil(mean / 500)  # e**-mean must not vanish: a sum of equal parts has the same distribution
        draw = sum((inverse(steps(mean / parts), uniform(seed + 7919 * p, ident)) for p in range(parts)), F.lit(0))
        draws = F.when(key == name, draw).otherwise(draws)
    times = docs.withColumn("_times", draws).where(F.col("_times") > 0)
    copies = times.withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("_times") - 1))).drop("_times")
    shuffled = copies.withColumn("shuffle_key", F.md5(F.concat_ws("/", F.lit(f"{seed}/order"), ident, F.col("replica").cast("string"))))
    n = partitions(docs.sparkSession)
    # Copies without an id may be many: where they go does not show in the result.
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return shuffled.repartition(n, "shuffle_key", spread).sortWithinPartitions("shuffle_key")


def oracle_sql(weights: dict[str, float], columns: str, table: str = "documents", seed: int = 17) -> str:
    """DuckDB SQL for mix() with the default size, for mean rates up to 500 (above, mix() adds up parts)."""
    listed = ", ".join(f"('{k}', {w!r}::DOUBLE)" for k, w in sorted(weights.items()))
    named = ", ".join(f"'{k}'" for k in sorted(weights) if k != REST)
    return f"""
WITH RECURSIVE w(key, weight) AS (VALUES {listed}),
d AS (SELECT *, CASE WHEN source IN ({named}) THEN source ELSE '{REST}' END AS key FROM {table}),
n AS (SELECT key, count(*) AS n FROM d GROUP BY key),
m AS (SELECT key, weight / (SELECT sum(weight) FROM w JOIN n USING (key) WHERE weight > 0) * (SELECT sum(n) FROM n) / n AS mean FROM w JOIN n USING (key) WHERE weight > 0),
p AS (SELECT key, mean, 0 AS k, exp(-mean) AS term, exp(-mean) AS step FROM m
      UNION ALL SELECT key, mean, k + 1, term * mean / (k + 1), step + term * mean / (k + 1) FROM p WHERE k < mean OR step + term * mean / (k + 1) > step),
u AS (SELECT *, ('0x' || substr(md5('{seed}/' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, {BITS // 4}))::BIGINT::DOUBLE / {1 << BITS}::DOUBLE AS u FROM d)
SELECT {columns} FROM (
  SELECT u.*, CAST(p.k AS INTEGER) AS replica, md5('{seed}/order/' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) || '/' || p.k) AS shuffle_key
  FROM u JOIN p ON p.key = u.key AND p.step <= u.u)
"""
