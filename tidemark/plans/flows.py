"""Whole flows made of the operators: compute and store, imports, backfills, event handlers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digests
from ..operators import dedup, guard, imports, propagate
from ..sources.history import Log
from . import dag
from .registry import Plan, View, plan

IDENTITY = ("entity_key", "view", "view_version", "feature_name", "feature_version", "data_ts", "value_json")
KEYS = ("entity_key", "view", "view_version", "feature_name", "feature_version")


def descriptors(events: DataFrame, payloads: DataFrame, reports: str = "reports") -> DataFrame:
    """Events that describe their own reports, joined to the payloads by object key; no metadata is looked up."""
    each = events.withColumn("_r", F.explode(reports)).select(*[c for c in events.columns if c != reports], "_r.*")
    found = payloads.select(F.col("storage_uri").alias("object_key"), "payload_json", F.lit(True).alias("_there"))
    out = each.join(found, "object_key", "left")
    return out.withColumn("error", F.when(F.col("_there").isNull(), F.concat(F.lit("missing payload "), "object_key"))).drop("_there")


def store(results: DataFrame, log: Log, order: Sequence[str], edges: DataFrame | None = None) -> tuple[int, DataFrame | None]:
    """Append what history does not hold yet; returns (rows appended, change feed of all results, new or not)."""
    fresh = dedup.first_in_run(dedup.new_rows(results, log.read(), IDENTITY), order, (*IDENTITY, *dedup.TOLERANT)) if log.commits() else dedup.first_in_run(results, order, (*IDENTITY, *dedup.TOLERANT))
    appended = log.append(fresh, order)
    return appended, None if edges is None else propagate.updates(results, edges)


def compute_and_store(entities: DataFrame, request: Plan, functions: Mapping[str, Callable], calc_ts: Column, log: Log, online: DataFrame | None = None) -> tuple[int, DataFrame | None]:
    """Compute a plan for all entities (with an `entity_key`), append new rows to history, and refresh latest values from the
    rows that were new; without a latest-value table that part is left out (outcome `disabled`)."""
    rows = dag.results(dag.compute(entities, request, functions, calc_ts), request, ["entity_key"])
    before = log.commits()[-1][1] if log.commits() else 0
    appended, _ = store(rows, log, ["entity_key", "feature_name"])
    if online is None or not appended:
        return appended, online
    new = log.read().where(F.col("row_id") >= before).withColumn("seq", F.col("row_id"))
    folded = guard.fold_batch(online, new.select(online.columns), KEYS)
    return appended, guard.refresh(online, folded, KEYS)


def import_feature_rows(rows: DataFrame, view: View, history: DataFrame | None, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Tall feature rows from a warehouse: (items with status and error, rows to append).

    The name must be the view's and the version exactly the registered one; replays are duplicates."""
    version = F.lit(None).cast("int")
    for name, f in view.features.items():
        version = F.when(F.col("feature_name") == name, f.feature_version).otherwise(version)
    marked = rows.withColumn("_v", version).withColumn("view", F.lit(view.name)).withColumn("view_version", F.lit(view.view_version))
    error = F.when(F.col("entity_key").isNull(), "bad entity key").when(F.col("_v").isNull(), F.concat(F.lit("unknown feature "), F.coalesce("feature_name", F.lit("null")))).when(F.col("_v") != F.col("feature_version"), F.concat(F.lit("unexpected version of "), "feature_name")).when(F.col("data_ts").isNull() | F.col("calc_ts").isNull(), "missing time")
    marked = marked.withColumn("error", error).drop("_v").withColumn("value_hash", digests.value_hash(F.col("value_json")))
    for c in dedup.TOLERANT:
        if c not in marked.columns:
            marked = marked.withColumn(c, F.lit(None).cast("string" if c == "input_fingerprint" else "timestamp_ntz"))
    good = marked.where(F.col("error").isNull())
    fresh = dedup.first_in_run(dedup.new_rows(good, history, IDENTITY) if history is not None else good, order, (*IDENTITY, *dedup.TOLERANT))
    written = fresh.select(*order, F.lit(True).alias("_new"))
    items = marked.join(written, list(order), "left").withColumn("status", F.when(F.col("error").isNotNull(), "rejected").when(F.col("_new"), "written").otherwise("duplicate")).drop("_new")
    return items, fresh.drop("error")


def import_wide(wide: DataFrame, features: Mapping[str, tuple[str, str]], ids: Sequence[str], data_ts: Column, calc_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Wide rows as (tall history rows, one row of accounting); blank cells are skipped and counted."""
    tall = imports.tall_rows(wide.withColumn("data_ts", data_ts).withColumn("calc_ts", calc_ts), features, [*ids, "data_ts", "calc_ts"])
    good = tall.where(~F.col("missing") & ~F.col("error"))
    return good.select(*ids, "feature_name", F.col("value").alias("value_json"), "data_ts", "calc_ts"), imports.import_summary(tall)


def backfill(lines: DataFrame, view: View, features: Sequence[str], functions: Mapping[str, Callable], attach: Callable[[DataFrame, DataFrame, list[str]], DataFrame], calc_ts: Column, source: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines of reports to (items, computed tall rows): land, compute each entity from its newest report, skip bad lines."""
    items = imports.land(imports.parse_reports(imports.number_lines(lines), view.key_fields, source, kind))
    request = plan(view, features)
    good = items.where("status <> 'rejected'")
    entities = attach(good.select("entity_key").distinct(), good.withColumnRenamed("event_ts", "report_ts"), request.sources)
    return items, dag.results(dag.compute(entities, request, functions, calc_ts), request, ["entity_key"])


def load_cases(path: str) -> list[dict]:
    """Golden cases from YAML: name, feature, sources, deps, expected."""
    import yaml
    from pathlib import Path

    cases = yaml.safe_load(Path(path).read_text())
    for case in cases:
        if not {"name", "feature", "expected"} <= set(case):
            raise ValueError(f"a case lacks name, feature or expected: {case}")
    return cases
