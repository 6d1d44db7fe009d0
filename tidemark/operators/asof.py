"""Point-in-time (as-of) joins on two clocks.

A history row may be used at time `obs` if its data is old enough and was known: data_ts <= obs - gap, and
coalesce(trusted available_at, calc_ts) <= obs.  Both are lower bounds on `obs`, so each row has one moment from which
it is eligible, greatest(data_ts + gap, known).  That turns the as-of join into one running maximum over observations
and history sorted by time: no pairs of rows are ever formed, however long an entity's history is.

Sorting is per entity and time bucket; each bucket starts from the maximum of the buckets before it, which a window
over per-bucket aggregates hands on.  An entity with a third of all rows is thus spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_at(available_at: Column, source: Column, calc_ts: Column) -> Column:
    """The trusted availability where there is one, else when it was computed."""
    return F.coalesce(F.when(source == "source_provided", available_at), calc_ts)


def eligible(data_ts: Column, known: Column, obs: Column, gap_seconds: int = 0) -> Column:
    """Both cut-offs include equality."""
    return (data_ts <= obs - F.make_interval(secs=F.lit(gap_seconds))) & (known <= obs)


def _bucket(col: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(col.cast("timestamp")) / (seconds * 1_000_000))


def _running(observations: DataFrame, rows: DataFrame, keys: Sequence[str], values: dict[str, Column], bucket_seconds: int) -> DataFrame:
    """To each observation (time `_t`) the running aggregate of `values` over rows of its keys with `_t` at or before.

    `values` are aggregates of the rows' columns that merge by the same function (max, or sum as the name says)."""
    merge = {name: (F.sum if name.startswith("n_") else F.max) for name in values}
    rows = rows.withColumn("_b", _bucket(F.col("_t"), bucket_seconds))
    observations = observations.withColumn("_b", _bucket(F.col("_t"), bucket_seconds))
    # rows of a key, bucket and time first; the bucket's sums come from them without another pass over the history
    fed = {n: f"_fed_{n}" for n in values}
    left = rows.groupBy(*keys, "_b", "_t").agg(*(c.alias(fed[n]) for n, c in values.items())).withColumn("_kind", F.lit(0))
    sums = left.groupBy(*keys, "_b").agg(*(merge[n](fed[n]).alias(n) for n in values))
    marks = sums.unionByName(observations.select(*keys, "_b").distinct(), allowMissingColumns=True)
    marks = marks.groupBy(*keys, "_b").agg(*(merge[n](n).alias(n) for n in values))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(*keys, "_b", *(merge[n](n).over(earlier).alias(f"_carried_{n}") for n in values))
    both = left.unionByName(observations.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy(*keys, "_b").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.select("*", *(merge[n](fed[n]).over(upto).alias(f"_own_{n}") for n in values)).where("_kind = 1")
    # equal keys, null-safe: a null key is a key like others
    near, far = both.alias("o"), carried.alias("c")
    on = F.lit(True)
    for k in [*keys, "_b"]:
        on = on & F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}"))
    joined = near.join(far, on, "left")
    def final(n):
        a, b = F.col(f"_own_{n}"), F.col(f"_carried_{n}")
        return (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if n.startswith("n_") else F.when(b.isNull() | (a > b), a).otherwise(b)

    names = [c for c in observations.columns if c not in ("_t", "_b")]
    return joined.select(*(F.col(f"o.{c}") for c in names), *(final(n).alias(n) for n in values))


def as_of(observations: DataFrame, history: DataFrame, keys: Sequence[str], features: Sequence[str], *, obs_ts: str = "observation_ts", feature: str = "feature_name", value: Sequence[str] = ("value",), gap_seconds: int = 0, known: Column | None = None, row_id: str = "row_id", bucket_seconds: int = 30 * 86400) -> DataFrame:
    """One row per observation, a struct column per feature (or null): data_ts, calc_ts, row_id and the `value` columns
    of the eligible row with the greatest (data_ts, calc_ts, row_id); of rows equal in these, that with the greatest values.
    A row without a data_ts or without a known time is never eligible."""
    known = known if known is not None else F.col("calc_ts")
    rows = history.where(F.col(feature).isin(*features) & F.col("data_ts").isNotNull() & known.isNotNull())  # greatest() skips nulls
    start = F.greatest(F.col("data_ts") + F.make_interval(secs=F.lit(gap_seconds)), known)
    best = F.struct("data_ts", "calc_ts", F.col(row_id).alias("row_id"), *value)
    rows = rows.select(*keys, F.col(feature).alias("_feature"), start.alias("_t"), best.alias("_row"))
    values = {name: F.max(F.when(F.col("_feature") == name, F.col("_row"))) for name in features}
    return _running(observations.withColumn("_t", F.col(obs_ts)), rows, keys, values, bucket_seconds)


def future_rows(observations: DataFrame, history: DataFrame, keys: Sequence[str], features: Sequence[str], *, obs_ts: str = "observation_ts", feature: str = "feature_name", bucket_seconds: int = 30 * 86400) -> DataFrame:
    """One row per observation with `future_rows`: history rows of its entity and the features with data_ts after it."""
    rows = history.where(F.col(feature).isin(*features)).select(*keys, F.col("data_ts").alias("_t"))
    past = _running(observations.withColumn("_t", F.col(obs_ts)), rows.where(F.col("_t").isNotNull()), keys, {"n_past": F.count("*")}, bucket_seconds)
    all_rows = rows.where(F.col("_t").isNotNull()).groupBy(*keys).agg(F.count("*").alias("_all"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"p.{k}").eqNullSafe(F.col(f"a.{k}"))
    joined = past.alias("p").join(all_rows.alias("a"), on, "left")
    names = [c for c in observations.columns]
    return joined.select(*(F.col(f"p.{c}") for c in names), (F.coalesce("_all", F.lit(0)) - F.col("n_past")).alias("future_rows"))
