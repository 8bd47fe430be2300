"""Rows held against a small table, in blocks: best match in a catalog, containment of excerpts."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Entries of a block; bytes of all blocks up to which they are broadcast; deals of a row's key beyond that.
BLOCK, BROADCAST_BYTES, SALTS = 1024, 8 << 20, 64


def against(rows: DataFrame, table: DataFrame, entry: Column, size: Column, keys: list[str]) -> DataFrame:
    """Each row with each block of the table's entries, as the array `entries`.

    Blocks are arrays of BLOCK entries.  If their measured size allows, they are broadcast; else rows and
    blocks meet by (block, salt) in a shuffle.
    """
    numbered = table.select(entry.alias("entry"), size.cast("long").alias("bytes"))
    n, total = numbered.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    n_blocks = max(1, -(-n // BLOCK))
    blocks = numbered.groupBy(F.pmod(F.xxhash64("entry"), F.lit(n_blocks)).alias("block")).agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    spread = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    if total <= BROADCAST_BYTES:
        return spread.join(F.broadcast(blocks), "block").drop("block")
    salted = spread.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)))
    dealt = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(dealt, ["block", "salt"]).drop("block", "salt")


def best_matches(labels: DataFrame, catalog: DataFrame) -> DataFrame:
    """label, best entry's id and name, confidence and whether it is accepted, for each distinct label.

    catalog: (pos, id, name).  Of equal confidences (9 digits) the first entry wins.  A label that is empty when normalised has no match.
    """
    wanted = labels.select("label").distinct().withColumn("plain", text.normalize_label(F.col("label"))).where("plain <> ''")
    entry = F.struct("pos", "id", "name", text.normalize_label(F.col("name")).alias("plain"))
    met = against(wanted, catalog, entry, F.length("name") * 2 + 32, ["label"])
    scored = F.transform("entries", lambda e: F.struct(F.round(text.similarity(F.col("plain"), e["plain"]), 9).alias("confidence"), (-e["pos"]).alias("order"), e["id"].alias("id"), e["name"].alias("name")))
    best = met.select("label", F.array_max(scored).alias("best")).groupBy("label").agg(F.max("best").alias("best"))
    accepted = F.col("best.confidence") > text.ACCEPT
    return best.select("label", F.col("best.name").alias("matched"), F.col("best.confidence").alias("confidence"), F.when(accepted, F.col("best.id")).alias("catalog_id"), F.when(accepted, F.col("best.name")).otherwise(F.col("label")).alias("normalized"))


def normalize_names(labels: DataFrame, catalog: DataFrame) -> DataFrame:
    """label, normalized, catalog_id and confidence for each distinct label: an accepted entry's name and id, else the label itself.

    An accepted match has a token in common, so only such pairs meet; nothing is held against the whole catalog.
    """
    wanted = labels.select("label").where(F.col("label").isNotNull()).distinct().withColumn("plain", text.normalize_label(F.col("label")))
    entries = catalog.select("pos", "id", "name", text.normalize_label(F.col("name")).alias("entry"))
    token = lambda c: F.explode(F.array_distinct(text.tokens(F.col(c)))).alias("token")
    met = wanted.where("plain <> ''").select("label", "plain", token("plain")).join(entries.select("pos", "id", "name", "entry", token("entry")), "token").drop("token").distinct()
    scored = met.select("label", F.struct(F.round(text.similarity(F.col("plain"), F.col("entry")), 9).alias("confidence"), (-F.col("pos")).alias("order"), "id", "name").alias("s"))
    best = scored.groupBy("label").agg(F.max("s").alias("best")).where(F.col("best.confidence") > text.ACCEPT)
    return wanted.select("label").join(best, "label", "left").select("label", F.coalesce("best.name", "label").alias("normalized"), F.col("best.id").alias("catalog_id"), F.col("best.confidence").alias("confidence"))


#: Words of a shingle by which texts and excerpts meet.
SHINGLE = 4


def _shingles(words: Column) -> Column:
    """Hashes of each SHINGLE words in a row."""
    n = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0))
    # Zipped slices: the words are made once for a row, not once for a shingle.
    return F.transform(F.arrays_zip(*[F.slice(words, F.lit(k + 1), n) for k in range(SHINGLE)]), lambda z: F.xxhash64(z))


def containing(documents: DataFrame, excerpts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of the documents whose text holds any non-empty excerpt verbatim.

    An excerpt's words but its first and last stand whole in any text that holds it.  It is known by the shingle of them that fewest
    excerpts share; documents with that shingle are tested.  Excerpts of too few words are held against all rows, in blocks.
    """
    wanted = excerpts.where(F.length("text") > 0).select(F.col("text").alias("excerpt")).distinct()
    words = lambda c: F.split(c, r"\s+")
    inner = wanted.withColumn("inner", F.slice(words(F.col("excerpt")), F.lit(2), F.greatest(F.size(words(F.col("excerpt"))) - 2, F.lit(0))))
    each = inner.where(F.size("inner") >= SHINGLE).select("excerpt", F.explode(F.array_distinct(_shingles(F.col("inner")))).alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count("*").alias("n"))
    anchors = each.join(shared, "shingle").groupBy("excerpt").agg(F.min(F.struct("n", "shingle")).alias("a")).select("excerpt", "a.shingle")
    texts = documents.select(key, "text").where(F.col("text").isNotNull())
    near = texts.select(key, F.explode(_shingles(words(F.col("text")))).alias("shingle")).join(anchors, "shingle").select(key, "excerpt").distinct()
    found = near.join(texts, key).where(F.contains("text", F.col("excerpt"))).select(key)
    short = inner.where(F.size("inner") < SHINGLE).select(F.col("excerpt").alias("text"))
    if not short.isEmpty():
        met = against(texts, short, F.col("text"), F.octet_length("text"), [key])
        found = found.union(met.where(F.exists("entries", lambda e: F.contains(F.col("text"), e))).select(key))
    return found.distinct()


def keep_if(documents: DataFrame, found: DataFrame, key: str, inside: bool) -> DataFrame:
    return documents.join(found, key, "left_semi" if inside else "left_anti")


def grouped(catalog: DataFrame) -> DataFrame:
    """Category and its entries' names in catalog order."""
    return catalog.groupBy("category").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda e: e["name"]).alias("names"))


def categories(catalog: DataFrame) -> DataFrame:
    """Distinct categories with the place where each is first seen."""
    return catalog.groupBy("category").agg(F.min("pos").alias("first_pos"))


def shortlist(catalog: DataFrame) -> DataFrame:
    """One row: a line for each entry, in order.  It is a prompt's text, so the catalog is small."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", "name", "definition"))), lambda e: F.concat(F.lit("- "), e["name"], F.lit(": "), e["definition"]))
    return catalog.agg(F.array_join(lines, "\n").alias("shortlist"))


