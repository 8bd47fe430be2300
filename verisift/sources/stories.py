"""Reading stories, catalogs, prompts and text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of either kind of story; those that a kind lacks are null.
STORY = "id string, title string, story string, tags array<string>, expectedMinBiases int, expectedQuestionsCountRange array<int>, isNoBias boolean, confidenceThreshold double, notes string"
CATALOG = "version string, biases array<struct<id:string,name:string,category:string,definition:string,detectionSignals:array<string>>>"


def read_stories(spark: SparkSession, path: str) -> DataFrame:
    """All *.json files of a folder, one story each; a malformed file fails the read."""
    return spark.read.schema(STORY).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(path)


def parse_stories(texts: DataFrame, column: str = "json") -> DataFrame:
    """The same from a column of JSON texts."""
    return texts.select(F.from_json(column, STORY, {"mode": "FAILFAST"}).alias("s")).select("s.*")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a catalog file with their position."""
    return spark.read.schema(CATALOG).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.posexplode("biases").alias("pos", "b")).select("pos", "b.*")


def read_lines(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """file, line (from 1), text of all lines of a folder's files, sub-folders too."""
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path).select(F.input_file_name().alias("file"), "value")
    return lines(whole, "file", "value")


def lines(texts: DataFrame, key: str, column: str) -> DataFrame:
    return texts.select(key, F.posexplode(F.split(column, "\n")).alias("pos", "text")).select(key, (F.col("pos") + 1).alias("line"), "text")


def sample_story(stories: DataFrame, seed: int) -> DataFrame:
    """One story, each as likely, the same for the same seed and ids."""
    return stories.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(1)


def read_table(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    """A table from any of Spark's sources (parquet, orc, csv, json, jdbc)."""
    reader = spark.read.format(kind).options(**options)
    return reader.load() if kind == "jdbc" else reader.load(path)
