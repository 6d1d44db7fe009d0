"""Reactive propagation: change feed, candidates over reactive edges, coalescing, and recompute waves."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import MAX_DEPTH, Plan, View
from . import dedup

#: Columns that say which recomputation an update asks for.
UNIT = ("entity_key", "view", "view_version", "dependent", "dependent_version")


def edge_table(spark: SparkSession, view: View) -> DataFrame:
    """(feature_name, feature_version, dependent, dependent_version) of reactive edges; a registry's size, not the data's."""
    rows = [(n, f.feature_version, d, v) for n, f in view.features.items() for d, v in view.reactive(n, f.feature_version)]
    return spark.createDataFrame(rows, "feature_name string, feature_version int, dependent string, dependent_version int")


def updates(results: DataFrame, edges: DataFrame) -> DataFrame:
    """One values-free event per written feature that something reacts to."""
    triggers = F.broadcast(edges.select("feature_name", "feature_version").distinct())
    return results.join(triggers, ["feature_name", "feature_version"], "left_semi").select("entity_key", "view", "view_version", "feature_name", "feature_version", "data_ts", "calc_ts")


def candidates(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Events joined to the dependents that they trigger; the version must be the pinned one."""
    return events.join(F.broadcast(edges), ["feature_name", "feature_version"])


def ordered(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates with their `place` among those of their keys, by dependent and version."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("dependent", "dependent_version")))


def deferred(units: DataFrame, view: View, runnable: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(units that can be recomputed, units that wait): a model feature needs a runner, a feature outside the view or of
    another version has none.  Those that wait count as skipped."""
    ready = [(n, f.feature_version) for n, f in view.features.items() if f.kind == "udf" or n in runnable]
    can = F.lit(False)
    for name, version in ready:
        can = can | ((F.col("dependent") == name) & (F.col("dependent_version") == version))
    return units.where(can), units.where(~can)


def coalesce_updates(found: DataFrame, seq: str = "seq", seen_at: str = "seen_at", trigger: str = "event_id") -> DataFrame:
    """One row per recomputation: first sight, count, triggers in order, and the watermark of the newest data (of ties the
    latest arrival)."""
    newest = F.max_by(F.struct("feature_name", "data_ts", F.col(trigger).alias("trigger")), F.struct("data_ts", seq))
    triggers = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(trigger).alias("t")))), lambda x: x["t"])
    return found.groupBy(*UNIT).agg(F.min(seen_at).alias("first_seen"), F.count("*").alias("n_updates"), triggers.alias("triggers"), newest.alias("latest"))


def wave(units: DataFrame, history: DataFrame, view: View, functions: Mapping[str, Callable], calc_ts) -> DataFrame:
    """New history rows of one wave: each unit's feature recomputed from history as of `calc_ts`, duplicates left out.
    The latest-value table is not touched."""
    from ..plans.dag import from_history

    out = None
    for name, f in view.features.items():
        if f.kind != "udf" or f.inputs or not any(e.propagation == "reactive" for e in f.deps):
            continue
        wanted = units.where((F.col("dependent") == name) & (F.col("dependent_version") == f.feature_version)).select("entity_key").distinct().withColumn("calc_ts", calc_ts)
        rows = from_history(wanted, history, Plan(view, (name,), {}, ()), functions, ["entity_key"])
        out = rows if out is None else out.unionByName(rows)
    identity = ("entity_key", "view", "view_version", "feature_name", "feature_version", "data_ts", "value_json")
    return dedup.new_rows(out, history, identity) if out is not None else None


def waves(events: DataFrame, history: DataFrame, view: View, functions: Mapping[str, Callable], calc_ts, append: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Waves until nothing more reacts, one level each; `append(history, rows)` stores rows and returns the new history.
    Returns the number of rows of each wave.  The depth cap bounds their number."""
    spark, sizes = history.sparkSession, []
    edges = edge_table(spark, view)
    for _ in range(MAX_DEPTH):
        units = candidates(events, edges).select(*UNIT).distinct()
        rows = wave(units, history, view, functions, calc_ts)
        if rows is None or rows.isEmpty():
            break
        before, history = history, append(history, rows)
        new = history.join(before.select("row_id"), "row_id", "left_anti")
        sizes.append(new.count())
        events = updates(new, edges)
    return sizes


def accounting(planned: DataFrame, computed: DataFrame, keys: Sequence[str] = UNIT[:1]) -> DataFrame:
    """One row: planned units, computed rows, skipped, distinct entities, greatest lag in seconds."""
    lag = F.greatest(F.lit(0.0), (F.unix_micros(F.col("calc_ts").cast("timestamp")) - F.unix_micros(F.col("data_ts").cast("timestamp"))) / 1e6)
    a = planned.agg(F.count("*").alias("planned"), F.count_distinct("entity_key").alias("entities"))
    b = computed.agg(F.count("*").alias("computed"), F.max(lag).alias("max_lag_seconds"))
    both = a.unionByName(b, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in ("planned", "entities", "computed", "max_lag_seconds")))
    return both.withColumn("skipped", F.col("planned") - F.col("computed"))
