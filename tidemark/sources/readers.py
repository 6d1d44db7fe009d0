"""Readers of rows, reports and event files.  All lazy, all through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rows(spark: SparkSession, path: str, fmt: str, schema: str | None = None) -> DataFrame:
    """JSON lines (a malformed line is an error), CSV (all cells strings) or Parquet."""
    if fmt == "jsonl":
        reader = spark.read.option("mode", "FAILFAST")
        return (reader.schema(schema) if schema else reader).json(path)
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown format {fmt!r}")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text with their place: (file, block of the file, place), for readers that reject bad lines one by one."""
    text = spark.read.text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")).withColumn("chunk", F.struct("file", "block"))


def payload_objects(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one per file, compressed or not: (storage_uri, payload_json)."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("storage_uri"), F.col("value").alias("payload_json"))


def payload(objects: DataFrame, storage_uri: str) -> str:
    """One payload by name; KeyError where there is none."""
    found = objects.where(F.col("storage_uri") == storage_uri).select("payload_json").head()
    if found is None:
        raise KeyError(f"no payload {storage_uri!r}")
    return found[0]


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of JSON-line event files as raw text; nothing is dropped for being late."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def named(spark: SparkSession, queries: dict[str, DataFrame], name: str) -> DataFrame:
    """A warehouse query by name; an unknown name is a KeyError."""
    return queries[name]


def extract(df: DataFrame, entity_key: dict[str, str], event_ts: str, payload: str, available_at: str | None = None) -> DataFrame:
    """Warehouse rows as lines of report JSON, the form `operators.imports.parse_reports` reads."""
    parts = F.struct(*(F.col(c).cast("string").alias(n) for n, c in entity_key.items()))
    body = [parts.alias("entity_key"), F.col(event_ts).cast("string").alias("event_ts"), F.try_parse_json(F.col(payload)).alias("payload")]
    if available_at:
        body.append(F.col(available_at).cast("string").alias("available_at"))
    return df.withColumn("value", F.to_json(F.struct(*body)))
