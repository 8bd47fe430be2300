"""Near duplicates by circulant MinHash, banding and exact verification.

A document's set is its distinct shingles of `width` words (fewer words: the whole as one; none: the empty set, linked
with nothing).  Two permutations of D cells make the whole signature: a first one scatters the shingles
over the cells, coordinate k is the least value that the second, shifted circularly by k, gives a cell of the set.
As shifts of one cell lie side by side, a signature is the column-wise least of contiguous rows.  Bands of `rows`
coordinates are the buckets.  Pairs are linked if 100 * intersection >= percent * union on their full sets.

No group is expanded into its pairs.
  1. Documents of equal sets form one class, known by its smallest doc_id; only representatives go on.
  2. Each bucket is a star: every member is verified against its smallest.
  3. The candidates of buckets that then still hold several components meet by rare shingles.  Each orders its shingles by
     the number of candidates that have them, rarest first.  Two linked sets share one of the first n - ceil(t * n) + 1, so a
     document whose first ones are all its own is linked with nothing else and goes; the counts are then taken again.
  4. Where candidates of several components share such a shingle, all are verified against the one that has the fewest
     rarer ones, the most central; then the rest, pair by pair, where sizes and places let the overlap reach the threshold.
  5. Components of the verified links come from alternating large-star and small-star rounds.

The chance to miss a link of exactly the threshold t is (1 - t**rows)**bands, below 1e-5 for the numbers here.

Null texts count as empty.  Rows that share a doc_id are one document for links (a link of one is a link of both).
A row without a doc_id is linked with nothing: its component is null and it is kept.  An empty table gives no
rows; other columns are ignored.  A text is held whole by one task at a time, whatever its length; equal ids and sizes are ties
that the smaller id wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, keep, scratch, slices
from .kernels import U64, WORD_BASE, mix, powers, shingles, utf8, word_hashes

#: Cells of the permutations, and the seed of the second.
CELLS, SEED = 1 << 20, 71
#: Cells of a document that are gathered at once.
GATHER = 2048
#: Bits for each document of the filter that spares a shuffle the texts of documents in no pair, and bits of all at most: 8 MB are broadcast.
FILTER_SHARE, FILTER_BITS = 16, 1 << 26
#: Times that the shingles' counts are taken while the candidates become fewer.
RECOUNTS = 3


def bands_for(percent: float) -> tuple[int, int]:
    """Bands and rows: as many rows as still find a link of the threshold but for 1 in 100,000 in at most 25 bands."""
    t = percent / 100
    for rows in range(8, 0, -1):
        bands = int(np.ceil(np.log(1e-5) / np.log1p(-min(t**rows, 1 - 1e-12))))
        if bands <= 25:
            return bands, rows
    return 64, 1


def circulant(n: int) -> np.ndarray:
    """Row i: the values of cell i under the second permutation and its shifts by 1 .. n - 1."""
    values = np.random.default_rng(SEED).permutation(CELLS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[: n - 1]]), n)


def signature(cells: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = table[cells[:GATHER]].min(0)
    for at in range(GATHER, len(cells), GATHER):
        np.minimum(out, table[cells[at : at + GATHER]].min(0), out=out)
    return out


SIGNED = "doc_id long, n long, h1 long, h2 long, keys array<long>"


def signatures(docs: DataFrame, width: int, percent: float, lower: bool) -> DataFrame:
    """(doc_id, text) to set sizes, two hashes of the whole set and the band keys."""
    bands, rows = bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        table = circulant(bands * rows)
        scale = powers(WORD_BASE, rows)
        for batch in slices(batches):
            values, offs = shingles(*word_hashes(*utf8(batch.column(1)), lower), width)
            n = np.diff(offs)
            some = np.flatnonzero(n)
            signed = np.zeros((len(n), bands * rows), np.uint32)
            for k in some.tolist():
                signed[k] = signature((values[offs[k] : offs[k + 1]] >> U64(44)).astype(np.int64), table)
            keys = mix((signed.reshape(len(n), bands, rows).astype(U64) * scale).sum(2) * U64(bands) + np.arange(bands, dtype=U64)).view(np.int64)
            h1, h2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            if len(some):
                h1[some] = np.add.reduceat(values, offs[:-1][some]).view(np.int64)
                h2[some] = np.add.reduceat(mix(values), offs[:-1][some]).view(np.int64)
            sizes = np.where(n > 0, bands, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys[some].ravel(), pa.int64()))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), lists], [x.split()[0] for x in SIGNED.split(", ")])

    return docs.mapInArrow(run, SIGNED)


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of the wanted documents.  A bit map by their number drops most others before the join; where it would be too large to broadcast, the join does all."""
    bits = FILTER_SHARE << max(16, wanted.count()).bit_length()
    if bits > FILTER_BITS:
        return docs.select("doc_id", "text").join(wanted, "doc_id")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits"))
    near = docs.withColumn("_slot", slot).join(F.broadcast(words), F.shiftright("_slot", 6) == F.col("word")).where("(bits >> CAST(_slot & 63 AS INT)) & 1 = 1").select("doc_id", "text")
    return near.join(wanted, "doc_id")


def verified(pairs: DataFrame, held: DataFrame, width: int, percent: float, lower: bool) -> DataFrame:
    """Those of the pairs (a, b) that are linked on their full sets; held: (doc_id, text) of all documents in pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left, left_at = shingles(*word_hashes(*utf8(batch.column(2)), lower), width)
            right, right_at = shingles(*word_hashes(*utf8(batch.column(3)), lower), width)
            good = []
            for k in range(batch.num_rows):
                x, y = left[left_at[k] : left_at[k + 1]], right[right_at[k] : right_at[k + 1]]
                both = np.sort(np.concatenate([x, y]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = held.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = held.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def rare_shingles(candidates: DataFrame, held: DataFrame, width: int, percent: float, lower: bool) -> DataFrame:
    """(rep, n, value, place): the shared ones among the first n - ceil(t * n) + 1 shingles of each candidate (rep, n), rarest first, places from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, offs = shingles(*word_hashes(*utf8(batch.column(1)), lower), width)
            n, total = np.diff(offs), np.concatenate([[0], np.cumsum(values.view(np.int64))])
            yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), n), pa.int64()), pa.array(np.repeat(n, n)), pa.array(np.repeat(total[offs[1:]] - total[offs[:-1]], n)), pa.array(values.view(np.int64))], ["rep", "n", "own", "value"])

    own = ["rep", "n", "own"]  # a document of several rows has several sets
    first = F.col("n") - F.ceil(F.col("n") * F.lit(float(percent)) / 100) + 1
    rows = held.join(candidates.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").select("doc_id", "text").mapInArrow(run, "rep long, n long, own long, value long")
    for _ in range(RECOUNTS):
        shared = keep(rows.select(*own, "value").join(rows.groupBy("value").agg(F.count("*").alias("had_by")).where("had_by > 1"), "value"), "shared-shingles")
        # Those that no other has come first: a set goes if they are all of its first ones.
        live = shared.groupBy(*own).agg(F.count("*").alias("n_shared")).where(F.col("n") - F.col("n_shared") < first)
        rows = keep(shared.join(live, own), "live-shingles")
    place = F.col("n") - F.col("n_shared") + F.row_number().over(Window.partitionBy(*own).orderBy("had_by", "value")) - 1
    return rows.withColumn("place", place).where(F.col("place") < first).select("rep", "n", "value", "place")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b); component: the smallest node reachable.

    Large-star and small-star rounds until nothing changes; each round is written to the shared folder.
    """
    now = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = keep(small, "small-star")
        marks = [x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first() for x in (now, new)]
        now = new
        if marks[0] == marks[1]:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members (rep, ...) with their components."""
    return members.join(found, members.rep == found.node, "left").drop("node").withColumn("component", F.coalesce("component", "rep"))


def unresolved(members: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Members with their components, of the keys that hold several."""
    now = keep(placed(members, found), "placed")
    several = now.groupBy(key).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select(key)
    return keep(now.join(several, key), "unresolved")


def extended(edges: DataFrame, found: DataFrame, pairs: DataFrame, held: DataFrame, width: int, percent: float, lower: bool) -> tuple[DataFrame, DataFrame]:
    """Links and components with those that the pairs add."""
    pairs = keep(pairs, "more-pairs")
    if pairs.isEmpty():
        return edges, found
    edges = keep(edges.union(verified(pairs, held, width, percent, lower)), "links")
    return edges, keep(components(edges), "components")


def near_duplicates(docs: DataFrame, width: int = 5, percent: float = 80, lower: bool = True) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, component_id, kept), one row for each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = keep(signatures(docs, width, percent, lower), "signatures", for_result=True)
    with scratch(docs.sparkSession):
        of_class = class_components(docs, signed, width, percent, lower)
    out = signed.join(of_class.select("n", "h1", "h2", F.col("component").alias("c")), ["n", "h1", "h2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def class_components(docs: DataFrame, signed: DataFrame, width: int, percent: float, lower: bool) -> DataFrame:
    """(n, h1, h2, component) of all classes of equal sets."""
    linked = signed.where("n > 0 AND doc_id IS NOT NULL")
    # Classes of equal sets.
    classes = keep(linked.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "classes")
    chosen = linked.select("doc_id", "n", "h1", "h2", "keys").join(classes.select(F.col("rep").alias("doc_id"), F.col("n").alias("n0"), F.col("h1").alias("k1"), F.col("h2").alias("k2")), "doc_id").where("n = n0 AND h1 = k1 AND h2 = k2")
    chosen = keep(chosen.select("doc_id", "n", "keys"), "representatives")
    buckets = chosen.select("doc_id", "n", F.explode("keys").alias("key")).withColumnRenamed("doc_id", "rep")
    shared = keep(buckets.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre < last").drop("last"), "buckets")
    members = keep(buckets.join(shared, "key").select("key", "centre", "rep", "n").distinct(), "members")
    # Stars.
    pairs = keep(members.where("centre < rep").groupBy(F.col("centre").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("buckets")).select("a", "b"), "star-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    held = keep(texts_of(docs, wanted), "texts")
    edges = verified(pairs, held, width, percent, lower)
    # A document of several rows may stand in several classes, and links them.
    several = linked.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").select("doc_id")
    bridges = linked.join(several, "doc_id").join(classes, ["n", "h1", "h2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    edges = keep(edges.union(bridges), "star-links")
    found = keep(components(edges), "components")
    # Buckets with several components; in one of two members the pair has been verified.
    crowded = members.join(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 2").select("key"), "key")
    rest = unresolved(crowded, found, "key").select("rep", "n").distinct()
    if not rest.isEmpty():
        rare = keep(rare_shingles(rest, held, width, percent, lower), "rare-shingles")
        reach = unresolved(rare, found, "value")
        middle = keep(reach.groupBy("value").agg(F.min(F.struct("place", "n", "rep", "component")).alias("c")).select("value", "c.*").toDF("value", "place_b", "n_b", "rep_b", "component_b"), "middles")
        names = ["rep", "n", "place", "component"]
        side = lambda df, s: df.select("value", *[F.col(c).alias(c + s) for c in names])
        # Sizes and what follows the shared shingle bound the overlap.
        needed = F.lit(float(percent)) * (F.col("n_a") + F.col("n_b"))
        fits = (F.col("component_a") != F.col("component_b")) & (F.lit(100.0 + percent) * F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= needed)
        star = side(reach, "_a").join(middle, "value").where(fits)
        edges, found = extended(edges, found, star.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct(), held, width, percent, lower)
        reach = unresolved(rare, found, "value").join(middle.select("value", F.col("rep_b").alias("middle")), "value").where("rep <> middle")
        pairs = side(reach, "_a").join(side(reach, "_b"), "value").where(fits & (F.col("rep_a") < F.col("rep_b")))
        edges, found = extended(edges, found, pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct(), held, width, percent, lower)
    return keep(classes.join(found, classes.rep == found.node, "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("component")), "class-components", for_result=True)
