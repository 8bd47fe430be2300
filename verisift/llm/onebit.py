"""Nearest neighbours by randomly rotated one-bit codes.

A vector o becomes the signs of its residual from a centre c after a random rotation P: D bits, packed,
with two scalars, the residual's norm r and f = <x, Pu>, where u is the unit residual and x the
code's unit vector with components +-1/sqrt(D).  For a query with unit residual v,
<x, Pv> / f estimates <u, v> without bias, off by at most e = SPREAD * sqrt((1 - f*f) / (f*f)) / sqrt(D - 1)
with a high probability that does not depend on the data.  So each squared distance
r*r + s*s - 2*r*s*<u, v> gets a lower and an upper bound from bits and scalars alone.  A vector is
reranked on the original values unless its lower bound passes the largest distance of the k that look nearest in its block.

The centre is the mean of at most FIT vectors (those of smallest hash of their id); any centre
gives right results, a good one tight bounds.  Every valid vector is coded.  Queries meet all vectors, block by block:
a task holds one block of either, whatever the table's size, and what is shuffled is each vector once for each QUERY_BLOCK queries.
Vectors travel as they are stored, with their codes: in few dimensions too many pass the bounds to send codes alone first.

Vectors that are null, zero, of another length than the first valid vectors' most common one, or that hold a null or
non-finite component take no part, as query or as candidate.  A null vec_id takes no part.  Ties go to the smaller
vec_id.  Rows that share a vec_id are candidates of their own, but for a query of that id; as queries, each gets
its own ranks from 1.  Distances that pass the largest double are infinite and rank last.  Fewer candidates
than k give fewer rows; an empty table gives none.  Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Standard deviations of the estimate's error that the bounds allow for.
SPREAD = 4.0
#: Vectors that the centre is fitted on, at most.
FIT = 4096
#: Vectors of a block and queries of a block, about.
BLOCK, QUERY_BLOCK = 16384, 8192
SEED = 20250101


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding, as stored, of the vectors that take part."""
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(good)


@functools.cache
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for the same dimension."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def code(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, norms r and factors f."""
    rest = (vectors - centre) @ turn.T
    norm = np.sqrt((rest * rest).sum(1))
    bits = np.packbits(rest >= 0, axis=1)
    factor = np.abs(rest).sum(1) / (np.sqrt(rest.shape[1]) * np.where(norm > 0, norm, 1.0))
    return bits, norm, np.where(norm > 0, factor, 1.0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim).astype(np.float64)


def encode(vectors: DataFrame, centre: list[float], n_blocks: int) -> DataFrame:
    """The index: each vector with its code, its scalars and its block."""
    kind = vectors.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, turn = np.array(centre), rotation(len(centre))
        for batch in batches:
            if not batch.num_rows:
                continue
            bits, norm, factor = code(matrix(batch.column("embedding"), len(at)), at, turn)
            yield pa.record_batch([batch.column("block"), batch.column("vec_id"), batch.column("embedding"), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(norm), pa.array(factor)], ["block", "vec_id", "embedding", "bits", "norm", "factor"])

    return vectors.select(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(n_blocks)).alias("block"), "vec_id", "embedding").mapInArrow(run, f"block long, vec_id long, embedding {kind}, bits binary, norm double, factor double")


def distances(vectors: np.ndarray, at: np.ndarray, queries: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Euclidean distances of column at[k] of `vectors` and column of[k] of `queries`, summed in order of the components."""
    out = np.zeros(len(at))
    for own, asked in zip(vectors, queries, strict=True):
        out += (own[at] - asked[of]) ** 2
    return np.sqrt(out)


def search_block(ids: np.ndarray, vectors: np.ndarray, bits: np.ndarray, norm: np.ndarray, factor: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of one block to each query, by bounds and reranking: (query, its place among the queries, vec_id, score)."""
    dim, turn = len(centre), rotation(len(centre))
    signs = (np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    error = SPREAD * np.sqrt(np.maximum(0.0, 1 - factor**2)) / (factor * np.sqrt(max(dim - 1, 1))) + 1e-5
    over = (1 / factor).astype(np.float32)
    columns, asked = np.ascontiguousarray(vectors.T), np.ascontiguousarray(queries.T)
    found = [pd.DataFrame({"query": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, len(queries), 64):
            part, part_ids = queries[at : at + 64], query_ids[at : at + 64]
            rest = (part - centre) @ turn.T
            size = np.sqrt((rest * rest).sum(1))
            # Unit vectors' products are in single precision, which the bounds allow for; what cancels is in double.
            inner = ((rest / np.where(size > 0, size, 1.0)[:, None]).astype(np.float32) @ signs.T * over).astype(np.float64)
            own = ids[None] == part_ids[:, None]
            squared, reach = norm**2 + size[:, None] ** 2, 2 * norm * size[:, None]
            # The k vectors that look nearest give a distance that the k nearest do not pass.
            likely = squared - reach * inner
            likely[own] = np.inf
            if likely.shape[1] > k:
                column = np.argpartition(likely, k - 1, axis=1)[:, :k]
                row = np.repeat(np.arange(len(part)), k)
                first = np.where(np.take_along_axis(own, column, 1), np.inf, distances(columns, column.ravel(), asked, row + at).reshape(column.shape))
                limit = first.max(1) * (1 + 1e-9)
            else:
                limit = np.full(len(part), np.inf)
            lower = squared - reach * np.minimum(1, inner + error) - 1e-12 * squared
            row, column = np.nonzero(~(lower > (limit**2)[:, None]) & ~own)  # what is no number passes
            for a in range(0, len(row), 1 << 18):  # bounded memory however many rows tie
                r, c = row[a : a + (1 << 18)], column[a : a + (1 << 18)]
                score = distances(columns, c, asked, r + at)
                near = score <= limit[r]
                found.append(pd.DataFrame({"query": r[near] + at, "vec_id": ids[c][near], "score": score[near]}))
                if len(row) > 1 << 18:
                    found = [nearest(pd.concat(found, ignore_index=True), k)]
    return nearest(pd.concat(found, ignore_index=True), k)


def nearest(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.sort_values(["query", "score", "vec_id"], kind="stable")
    return found[found.groupby("query").cumcount() < k]


def search(embeddings: DataFrame, is_query, k: int = 10) -> DataFrame:
    """The k nearest of all valid vectors to each valid vector for which the column `is_query` holds."""
    base = valid(embeddings)
    sizes = base.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("queries")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, n_queries = sizes[0]
    vectors = base.where(F.size("embedding") == dim)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT)
    mean = sample.select(F.posexplode("embedding").alias("d", "x")).groupBy("d").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("d").collect()
    centre = [r.x for r in mean]
    n_blocks, n_query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    index = encode(vectors, centre, n_blocks)
    # Each block of queries meets each block of vectors.
    index = index.withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query_blocks - 1).cast("long"))))
    # Rows that are equal ask once.
    queries = vectors.where(is_query).groupBy("vec_id", "embedding").agg(F.count("*").alias("times")).withColumn("query_key", F.xxhash64("vec_id", "embedding"))
    queries = queries.select("vec_id", "embedding", "times", "query_key", F.pmod("query_key", F.lit(n_query_blocks)).cast("long").alias("query_block"))
    queries = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), "query_block", "vec_id", "embedding", "times", "query_key")

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "query_key", "times", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.float64() if x == "score" else pa.int64()) for x in names], names)
        at = np.array(centre)
        bits = np.frombuffer(b"".join(left["bits"].to_pylist()), np.uint8).reshape(left.num_rows, -1)
        own, asked = (matrix(t["embedding"].combine_chunks(), len(at)) for t in (left, right))
        out = search_block(left["vec_id"].to_numpy(), own, bits, left["norm"].to_numpy(), left["factor"].to_numpy(), right["vec_id"].to_numpy(), asked, at, k)
        place = out["query"].to_numpy(np.int64)
        return pa.table([*[pa.array(right[x].to_numpy()[place]) for x in ("vec_id", "query_key", "times")], pa.array(out["vec_id"].to_numpy(np.int64)), pa.array(out["score"].to_numpy(np.float64))], names)

    found = index.groupBy("block", "query_block").cogroup(queries.groupBy("block", "query_block")).applyInArrow(one, "query_id long, query_key long, times long, vec_id long, score double")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return best.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
