"""Replay deduplication against history (null-tolerant) and within a run (exact)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ("entity_key", "view", "view_version", "feature_name", "feature_version", "data_ts", "value_json")
TOLERANT = ("input_fingerprint", "available_at")


def _agree(a: Column, b: Column) -> Column:
    """Equal, or one side has nothing to say."""
    return a.isNull() | b.isNull() | (a == b)


def new_rows(rows: DataFrame, history: DataFrame, identity: Sequence[str] = IDENTITY, tolerant: Sequence[str] = TOLERANT) -> DataFrame:
    """Rows without an exact duplicate in history: equal identity, and fingerprint and trusted availability equal where both
    sides carry one.  When it was computed does not matter.  A hash anti-join on the identity, the rest as residual."""
    on = F.lit(True)
    for c in identity:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}"))
    for c in tolerant:
        on = on & _agree(F.col(f"r.{c}"), F.col(f"h.{c}"))
    return rows.alias("r").join(history.select(*identity, *tolerant).distinct().alias("h"), on, "left_anti")


def first_in_run(rows: DataFrame, order: Sequence[str], signature: Sequence[str] = (*IDENTITY, *TOLERANT)) -> DataFrame:
    """The first row of each exact signature, in the run's order; here null equals null and nothing else."""
    w = Window.partitionBy(*signature).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def partition(rows: DataFrame, history: DataFrame, order: Sequence[str], identity: Sequence[str] = IDENTITY, tolerant: Sequence[str] = TOLERANT) -> tuple[DataFrame, DataFrame]:
    """(new rows, one row with n_rows, n_new, n_duplicates)."""
    fresh = first_in_run(new_rows(rows, history, identity, tolerant), order, (*identity, *tolerant))
    counts = rows.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(fresh.select(F.lit(0), F.lit(1)))
    counts = counts.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_new"))
    return fresh, counts.withColumn("n_duplicates", F.col("n_rows") - F.col("n_new"))


def drop_seen_events(events: DataFrame, seen: DataFrame | None, payload: str = "value", order: Sequence[str] = ()) -> DataFrame:
    """Events by the digest of their raw bytes, each kept once, none that was seen before."""
    hashed = events.withColumn("event_hash", F.sha2(F.col(payload).cast("binary"), 256))
    if seen is not None:
        hashed = hashed.join(seen.select("event_hash"), "event_hash", "left_anti")
    w = Window.partitionBy("event_hash").orderBy(*(order or [payload]))
    return hashed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
