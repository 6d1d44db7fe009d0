"""Consistency of history and latest values, comparison of shadow features, and lineage with explicit gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_data(history: DataFrame, keys: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """The row of the greatest data_ts; of ties the last appended."""
    rest = [c for c in history.columns if c not in keys]
    return history.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("data_ts", row_id)).alias("_r")).select(*keys, "_r.*")


def latest_by_calc(history: DataFrame, keys: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """The row of the greatest calc_ts; of ties the first appended."""
    rest = [c for c in history.columns if c not in keys]
    return history.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col("calc_ts"), -F.col(row_id))).alias("_r")).select(*keys, "_r.*")


def consistency(history: DataFrame, online: DataFrame, keys: Sequence[str], value: str = "value", wanted: DataFrame | None = None) -> DataFrame:
    """Per key: the newest of history against the latest-value table, and which of seven states they are in."""
    off = latest_by_data(history, keys).select(*keys, F.col("data_ts").alias("offline_data_ts"), F.col(value).alias("offline_value"), F.lit(True).alias("_off"))
    on = online.select(*keys, F.col("data_ts").alias("online_data_ts"), F.col(value).alias("online_value"), F.lit(True).alias("_on"))
    both = off.join(on, list(keys), "full_outer")
    if wanted is not None:
        both = wanted.select(*keys).join(both, list(keys), "left")
    a, b = F.col("online_data_ts"), F.col("offline_data_ts")
    status = (
        F.when(F.col("_off").isNull() & F.col("_on").isNull(), "missing_both").when(F.col("_on").isNull(), "missing_online").when(F.col("_off").isNull(), "missing_offline")
        .when(a < b, "stale_online").when(a > b, "online_newer_than_offline").when(~F.col("offline_value").eqNullSafe(F.col("online_value")), "value_mismatch").otherwise("ok")
    )
    return both.select(*keys, status.alias("status"), "offline_value", "online_value", "offline_data_ts", "online_data_ts")


def overall(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return items.groupBy(*by).agg(F.when(F.coalesce(F.bool_and(F.col("status") == "ok"), F.lit(True)), "ok").otherwise("inconsistent").alias("status"), F.count("*").alias("n_items"))


def shadow_diff(history: DataFrame, live: tuple[str, int], shadow: tuple[str, int], samples: int = 10) -> DataFrame:
    """One row of counts: per entity the newest computed hash of a live feature against a shadow one's.

    Samples hold the first entities in key order; the cap is part of the report."""
    of = lambda f: history.where((F.col("feature_name") == f[0]) & (F.col("feature_version") == f[1]))
    a = latest_by_calc(of(live), ["entity_key"]).select("entity_key", F.col("value_hash").alias("live"))
    b = latest_by_calc(of(shadow), ["entity_key"]).select("entity_key", F.col("value_hash").alias("shadow"))
    both = a.join(b, "entity_key", "full_outer")
    l, s = F.col("live"), F.col("shadow")
    kinds = {"same_hash": l == s, "different_hash": l != s, "missing_live": l.isNull() & s.isNotNull(), "missing_shadow": s.isNull() & l.isNotNull()}
    kind = F.lit(None).cast("string")
    for name, test in kinds.items():
        kind = F.when(test, name).otherwise(kind)
    both = both.select("entity_key", kind.alias("kind")).where("kind is not null")
    counts = both.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
    first = both
    for k in ("different_hash", "missing_live", "missing_shadow"):
        own = first.where(F.col("kind") == k).orderBy("entity_key").limit(samples).agg(F.array_sort(F.collect_list("entity_key")).alias(f"sample_{k}"))
        counts = counts.unionByName(own, allowMissingColumns=True)
    counts = counts.agg(*(F.first(c, ignorenulls=True).alias(c) for c in counts.columns))
    return counts.withColumn("total_compared", F.col("same_hash") + F.col("different_hash"))


def lineage(wanted: DataFrame, history: DataFrame, keys: Sequence[str], metas: DataFrame | None = None, refs: str | None = None, items: DataFrame | None = None) -> DataFrame:
    """Where values come from: the newest computed row of each wanted key, its reports (an array column `refs` of `wanted`,
    looked up in `metas`) and manifest items of the same entity; what is missing is a gap with a name."""
    record = latest_by_calc(history, keys).withColumn("_found", F.lit(True))
    out = wanted.join(record, list(keys), "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")
    unknown, known = F.expr("cast(array() as array<string>)"), F.lit(0)
    if refs is not None and metas is not None:
        each = wanted.select(*keys, F.explode(F.array_distinct(F.col(refs))).alias("report_ref"))
        looked = each.join(metas.select("report_ref", F.lit(True).alias("_known")).distinct(), "report_ref", "left")
        by = looked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_known").isNull(), F.concat(F.lit("unknown_report_ref:"), F.col("report_ref"))))).alias("_unknown"), F.count("_known").alias("_n_known"))
        out = out.join(by, list(keys), "left")
        unknown, known = F.coalesce("_unknown", unknown), F.coalesce("_n_known", F.lit(0))
    if items is not None:
        own = items.where(F.col("report_ref").isNotNull()).groupBy("entity_key").agg(F.count("*").alias("_n_items"))
        out = out.join(own, "entity_key", "left")
        known = known + F.coalesce("_n_items", F.lit(0))
    bundle = F.col("bundle_digest") if "bundle_digest" in history.columns else F.lit(None)
    extra = F.array_compact(F.array(F.when(known == 0, "source_report_refs_not_available"), F.when(bundle.isNull(), "bundle_digest_not_available")))
    gaps = F.when(F.col("found"), F.concat(unknown, extra)).otherwise(F.array(F.lit("feature_value_not_found")))
    return out.withColumn("n_reports", F.when(F.col("found"), known).otherwise(0).cast("long")).withColumn("gaps", gaps).drop("_unknown", "_n_known", "_n_items")
