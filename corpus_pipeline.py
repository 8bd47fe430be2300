"""From raw documents to token ids: five stages, each an operator of verisift.llm.

Each stage takes all that its predecessor kept; its result is written as Parquet and read again.  The first four
return the columns of documents, the last one the ids.  In every stage extra columns are dropped first, whatever their names; an empty
table gives an empty one; a very long text is held whole by one task at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.llm import language, mixing, neardup, substrings, unigram
from verisift.llm.common import drop_at_end, drop_dir, shared_dir
from verisift.llm.queries import WEIGHTS, tokenizer_path

#: A document without a letter goes, and one of which no language makes up this share.
LEAST_SHARE = 0.4
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows; `lang` becomes the predicted language of what stays.

    Null and empty texts and those without a letter go; without any labelled row all do.  Rows that repeat are judged alike, a tie goes to
    the language that sorts first; null ids, labels and sources stay as they are but for `lang`.
    """
    docs = docs.select(*COLUMNS)
    model = language.fit(language.training_rows(docs, F.lit(True)))
    found = language.detect(docs, model, COLUMNS).where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SHARE))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 on shingles of five words stays, that of smallest doc_id; of repeated rows one.

    Null and empty texts are like nothing and stay; rows without a doc_id stay, of those with equal texts one.
    """
    docs = docs.select(*COLUMNS)
    gone = neardup.near_duplicates(docs, width=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that stand elsewhere too go; the documents stay, those that lose all with an empty text.

    Null texts stay null; n_chars is counted anew where words went.  Rows without an id and rows that repeat are documents of their own.
    """
    cleaned = substrings.remove(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by the sources' weights, in a random order.

    A null source belongs to the rest; a row without a doc_id draws by its text; rows that share a doc_id repeat alike.  Texts are not read otherwise.
    """
    return mixing.mix(docs.select(*COLUMNS), WEIGHTS).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it; a null text has none, as an empty one, and rows that repeat are kept apart."""
    return unigram.digest(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("token ids", encode),
]
#: Mixture inference and the tokenizer have no SQL form: tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for name, stage in STAGES:
        before, at = at, shared_dir(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            drop_dir(spark, before)
    drop_at_end(spark, at)
    return docs
