"""Leakage-safe training sets: observations x features by point-in-time join, with cell metadata and a summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import as_of, future_rows


class MissingFeature(ValueError):
    """A cell is missing and the policy is `error`."""


def training_set(observations: DataFrame, history: DataFrame, keys: Sequence[str], versions: Mapping[str, int], *, policy: str = "keep_null", **more) -> DataFrame:
    """Each observation with a struct per feature: value columns, status (`ok` or `missing`), version, data_ts.

    Only rows of the registered version of a feature count; older versions are never used silently."""
    if policy not in ("keep_null", "error"):
        raise ValueError(f"unknown policy {policy!r}")
    if not versions:
        raise ValueError("no features")
    if more.get("gap_seconds", 0) < 0:
        raise ValueError("the safety gap must not be negative")
    feature, version = more.get("feature", "feature_name"), more.pop("version", "feature_version")
    pinned = F.lit(False)
    for name, v in versions.items():
        pinned = pinned | ((F.col(feature) == name) & (F.col(version) == v))
    names = list(versions)
    wide = as_of(observations, history.where(pinned), keys, names, **more)
    values = list(more.get("value", ("value",)))
    cells = {n: F.struct(*(F.col(n)[v].alias(v) for v in values), F.when(F.col(n).isNull(), "missing").otherwise("ok").alias("status"), F.lit(versions[n]).alias("feature_version"), F.col(n)["data_ts"].alias("data_ts")) for n in names}
    wide = wide.withColumns(cells)
    if policy == "error":
        missing = F.array_compact(F.array(*(F.when(F.col(n)["status"] == "missing", F.lit(n)) for n in names)))
        message = F.concat(F.lit("missing features: "), F.array_join(missing, ", "))
        wide = wide.withColumn(names[0], F.when(F.size(missing) > 0, F.raise_error(message).cast(wide.schema[names[0]].dataType)).otherwise(F.col(names[0])))
    return wide


def training_summary(wide: DataFrame, observations: DataFrame, history: DataFrame, keys: Sequence[str], features: Sequence[str], *, gap_seconds: int = 0, obs_ts: str = "observation_ts", feature: str = "feature_name") -> DataFrame:
    """One row: rows, features, missing cells, future rows ignored, gap."""
    missing = sum((F.when(F.col(n)["status"] == "missing", 1).otherwise(0) for n in features), F.lit(0))
    cells = wide.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells"))
    late = future_rows(observations, history, keys, features, obs_ts=obs_ts, feature=feature).agg(F.coalesce(F.sum("future_rows"), F.lit(0)).alias("future_rows_ignored"))
    both = cells.unionByName(late, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in ("n_rows", "missing_cells", "future_rows_ignored")))
    return both.select("n_rows", F.lit(len(features)).alias("n_features"), "missing_cells", "future_rows_ignored", F.lit(gap_seconds).alias("safety_gap_seconds"))


def nested_rows(wide: DataFrame, keys: Sequence[str], features: Sequence[str], obs_ts: str = "observation_ts", context: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Rows for JSON lines: entity, observation_ts, context, features, feature_metadata."""
    meta = F.struct(*(F.struct(F.col(n)["status"].alias("status"), F.col(n)["feature_version"].alias("feature_version"), F.col(n)["data_ts"].alias("data_ts")).alias(n) for n in features))
    return wide.select(F.struct(*keys).alias("entity"), F.col(obs_ts).alias("observation_ts"), F.struct(*sorted(context)).alias("context") if context else F.lit(None).cast("string").alias("context"), F.struct(*(F.col(n)[value].alias(n) for n in features)).alias("features"), meta.alias("feature_metadata"))


def flat_rows(wide: DataFrame, keys: Sequence[str], features: Sequence[str], obs_ts: str = "observation_ts", context: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Rows for CSV and Parquet: entity.*, observation_ts, context.*, feature.*, meta.<feature>.*, in that order."""
    cols = [F.col(k).alias(f"entity.{k}") for k in keys] + [F.col(obs_ts).alias("observation_ts")]
    cols += [F.col(k).alias(f"context.{k}") for k in sorted(context)]
    cols += [F.col(n)[value].alias(f"feature.{n}") for n in features]
    for n in features:
        cols += [F.col(n)[x].alias(f"meta.{n}.{x}") for x in ("status", "feature_version", "data_ts")]
    return wide.select(cols)


def export(wide: DataFrame, path: str, fmt: str, keys: Sequence[str], features: Sequence[str], **more) -> None:
    """Write a training set as `jsonl`, `csv` or `parquet`."""
    if fmt == "jsonl":
        nested_rows(wide, keys, features, **more).write.json(path)
    elif fmt == "csv":
        flat_rows(wide, keys, features, **more).write.option("header", True).csv(path)
    elif fmt == "parquet":
        flat_rows(wide, keys, features, **more).write.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
