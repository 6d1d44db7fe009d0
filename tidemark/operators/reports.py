"""Raw reports: resolving references to payloads, overlays, and the projection of metadata with corrections."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Two rows of one report must agree on these.
IDENTITY = ("report_type", "entity_type", "entity_key", "report_ts", "payload_size_bytes", "content_hash", "storage_uri", "format", "compression")


def resolve(items: DataFrame, metas: DataFrame, payloads: DataFrame, expected: Mapping[str, str] | None = None) -> DataFrame:
    """Items (source_name, report_ref) with metadata and payload, or one of four errors: no reference given, unknown
    report, unexpected type, missing payload."""
    m = metas.select("report_ref", "report_type", "storage_uri", "report_ts", "content_hash", "available_at", "availability_source", F.lit(True).alias("_meta"))
    p = payloads.select("storage_uri", "payload_json", F.lit(True).alias("_payload"))
    out = items.join(m, "report_ref", "left").join(p, "storage_uri", "left")
    wrong = F.lit(False)
    for source, kind in (expected or {}).items():
        wrong = wrong | ((F.col("source_name") == source) & (F.col("report_type") != kind))
    error = F.when(F.col("report_ref").isNull(), F.concat(F.lit("no report for source "), "source_name")).when(F.col("_meta").isNull(), F.concat(F.lit("unknown report "), "report_ref"))
    error = error.when(wrong, F.concat(F.lit("unexpected report type "), "report_type")).when(F.col("_payload").isNull(), F.concat(F.lit("missing payload "), "storage_uri"))
    return out.withColumn("error", error).drop("_meta", "_payload")


def overlay(base: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """`top` shadows `base` by key; neither is changed."""
    return top.select(base.columns).unionByName(base.join(top.select(key), key, "left_anti"))


def classify(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming metadata with `outcome`: insert, noop, conflict (identity differs) or correction (same report, another
    trusted availability); `old_available_at` is what a correction replaces.

    Trusted availability before the report's own time is impossible and rejected as `invalid`."""
    # null columns are equal when both are null
    old = existing.select("report_ref", F.struct(*IDENTITY).alias("_old"), F.col("available_at").alias("old_available_at"), F.lit(True).alias("_there"))
    both = incoming.withColumn("_new", F.struct(*IDENTITY)).join(old, "report_ref", "left")
    trusted = (F.col("availability_source") == "source_provided") & F.col("available_at").isNotNull()
    outcome = (
        F.when(F.coalesce(trusted & (F.col("available_at") < F.col("report_ts")), F.lit(False)), "invalid")
        .when(F.col("_there").isNull(), "insert")
        .when(~F.col("_new").eqNullSafe(F.col("_old")), "conflict")
        .when(F.coalesce(trusted, F.lit(False)) & ~F.col("available_at").eqNullSafe(F.col("old_available_at")), "correction")
        .otherwise("noop")
    )
    return both.withColumn("outcome", outcome).drop("_old", "_new", "_there")


def project(incoming: DataFrame, existing: DataFrame, origin: str, manifest_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metadata after the upsert, audit rows of corrections, conflicts and invalid rows)."""
    judged = classify(incoming, existing)
    new = judged.where("outcome = 'insert'").select(existing.columns)
    fixed = judged.where("outcome = 'correction'")
    changes = fixed.select("report_ref", F.col("available_at").alias("_at"), F.col("availability_source").alias("_source"))
    kept = existing.join(changes, "report_ref", "left").withColumn("available_at", F.coalesce("_at", "available_at")).withColumn("availability_source", F.coalesce("_source", "availability_source")).select(existing.columns)
    audit = fixed.select("report_ref", "old_available_at", F.col("available_at").alias("new_available_at"), F.lit(origin).alias("change_origin"), F.lit(manifest_id).alias("manifest_id"))
    return kept.unionByName(new), audit, judged.where("outcome in ('conflict', 'invalid')")


def with_availability(items: DataFrame, metas: DataFrame) -> DataFrame:
    """Items with their report's trusted availability; where there is none, the time its metadata was created stands in
    and says so, so that no row is used before it could be known."""
    m = metas.select("report_ref", F.coalesce("available_at", "created_at").alias("available_at"), F.coalesce("availability_source", F.lit("ingestion_time")).alias("availability_source"))
    return items.join(m, "report_ref", "left")


def put_payloads(payloads: DataFrame, path: str) -> None:
    """Write (storage_uri, payload_json) as gzip text of canonical JSON, one folder of lines a bucket of names; what is
    no JSON is refused."""
    from ..functions import digests

    canonical = digests.canonical_text(F.col("payload_json"))
    checked = F.coalesce(canonical, F.raise_error(F.concat(F.lit("not JSON: "), "storage_uri")).cast("string"))
    lines = payloads.select(F.pmod(F.xxhash64("storage_uri"), F.lit(64)).alias("bucket"), F.to_json(F.struct("storage_uri", checked.alias("payload_json"))).alias("value"))
    lines.write.partitionBy("bucket").option("compression", "gzip").text(path)


def get_payloads(spark, path: str) -> DataFrame:
    """What `put_payloads` wrote, as (storage_uri, payload_json)."""
    return spark.read.schema("storage_uri string, payload_json string").json(path)
