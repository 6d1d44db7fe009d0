"""The freshness guard of the latest-value table: a keyed fold over arrivals, written with windows.

An arrival's freshness is (data_ts, coalesce(max_input_data_ts, data_ts)).  Fresher than the stored row: `written`;
staler: `skipped_stale`; equal: `written_recompute` if the fingerprints differ (null counts as ''), or if both carry
a trusted availability and those differ; else `noop`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WRITES = ("written", "written_recompute")


def freshness(data_ts: Column, max_input: Column) -> Column:
    return F.struct(data_ts.alias("d"), F.coalesce(max_input, data_ts).alias("m"))


def decide(new: dict[str, Column], old: dict[str, Column], exists: Column) -> Column:
    """One step: `new` and `old` map data_ts, max_input_data_ts, fingerprint and available (trusted) to columns."""
    a, b = (freshness(x["data_ts"], x["max_input_data_ts"]) for x in (new, old))
    other = F.coalesce(new["fingerprint"], F.lit("")) != F.coalesce(old["fingerprint"], F.lit(""))
    moved = F.coalesce(new["available"] != old["available"], F.lit(False))
    return F.when(~exists, "written").when(a > b, "written").when(a < b, "skipped_stale").when(other | moved, "written_recompute").otherwise("noop")


def fold(arrivals: DataFrame, keys: Sequence[str], seq: str = "seq", data_ts: str = "data_ts", max_input: str = "max_input_data_ts", fingerprint: str = "input_fingerprint", available: str = "available_at", bucket: Column | None = None) -> DataFrame:
    """All arrivals with their `outcome`, as if processed one by one in order of `seq`.

    Within a key only the running maximum of the freshness, then runs of equal fingerprint, decide; so three passes of
    windows say what a sequential fold would.  `bucket`, a function of `seq` that never falls as `seq` grows, cuts keys
    into stretches whose maxima are handed on, so that a hot key is many tasks; the later windows are by key and
    freshness."""
    cols = arrivals.columns
    rows = arrivals.withColumn("_f", freshness(F.col(data_ts), F.col(max_input))).withColumn("_p", F.coalesce(F.col(fingerprint), F.lit("")))
    before = (Window.unboundedPreceding, -1)
    if bucket is None:
        rows = rows.withColumn("_top", F.max("_f").over(Window.partitionBy(*keys).orderBy(seq).rowsBetween(*before)))
    else:
        rows = rows.withColumn("_b", bucket)
        carried = rows.groupBy(*keys, "_b").agg(F.max("_f").alias("_m"))
        carried = carried.select(*keys, "_b", F.max("_m").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(*before)).alias("_m"))
        on = F.lit(True)
        for k in [*keys, "_b"]:
            on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}"))
        rows = rows.withColumn("_own", F.max("_f").over(Window.partitionBy(*keys, "_b").orderBy(seq).rowsBetween(*before)))
        top = F.when(F.col("c._m").isNull() | (F.col("r._own") > F.col("c._m")), F.col("r._own")).otherwise(F.col("c._m"))
        rows = rows.alias("r").join(carried.alias("c"), on, "left").select("r.*", top.alias("_top"))
    rows = rows.withColumn("_c", F.when(F.col("_top").isNull() | (F.col("_f") > F.col("_top")), "new").when(F.col("_f") < F.col("_top"), "stale").otherwise("equal"))
    live = (F.col("_c") != "stale").cast("int")
    same = Window.partitionBy(*keys, "_f", live).orderBy(seq)
    rows = rows.withColumn("_edge", (F.col("_c") == "new") | F.coalesce(F.col("_p") != F.lag("_p").over(same), F.lit(True)))
    rows = rows.withColumn("_run", F.sum(F.col("_edge").cast("int")).over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = Window.partitionBy(*keys, "_f", live, "_run").orderBy(seq)
    first = F.first(available).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.last(available, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_first", first).withColumn("_last", last)
    moved = F.coalesce(F.col("_first").isNotNull() & (F.col(available) != F.col("_last")), F.lit(False))
    outcome = F.when(F.col("_c") == "stale", "skipped_stale").when(F.col("_c") == "new", "written").when(F.col("_edge"), "written_recompute").when(moved, "written_recompute").otherwise("noop")
    return rows.withColumn("outcome", outcome).select(*cols, "outcome")


def latest(folded: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """What the latest-value table holds after a fold: each key's last written row."""
    rest = [c for c in folded.columns if c not in keys]
    best = folded.where(F.col("outcome").isin(*WRITES)).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def fold_batch(stored: DataFrame | None, batch: DataFrame, keys: Sequence[str], seq: str = "seq", **more) -> DataFrame:
    """A fold that goes on from `stored` (a former `latest`): the stored row comes first, so batches of any size agree."""
    if stored is None:
        return fold(batch, keys, seq, **more)
    before = stored.select(batch.columns).withColumn(seq, F.lit(None).cast(batch.schema[seq].dataType)).withColumn("_stored", F.lit(True))
    both = before.unionByName(batch.withColumn("_stored", F.lit(False)))
    return fold(both, keys, seq, **more).where("not _stored").drop("_stored")


def refresh(stored: DataFrame, folded: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """`stored` after a folded batch."""
    new = latest(folded, keys, seq).drop("outcome")
    kept = stored.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new)


def overall(outcomes: Column) -> Column:
    """An aggregate: `written` if anything was, else `skipped_stale` if anything was stale, else `noop`."""
    wrote, stale = F.bool_or(outcomes.isin(*WRITES)), F.bool_or(outcomes == "skipped_stale")
    return F.when(wrote, "written").when(stale, "skipped_stale").otherwise("noop")


def guarded_refresh(stored: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str], seq: str = "seq", budget: int | None = None, **more) -> tuple[DataFrame, DataFrame]:
    """A refresh of the latest-value table from computed rows: (outcomes with counts, the folded rows).

    `budget` is a rate limit: the first rows in `order`, a distributed top-k; those beyond are counted as `limited`."""
    late = None
    if budget is not None:
        taken = rows.orderBy(*order).limit(budget)
        both = rows.select(F.lit(1).alias("n")).unionAll(taken.select(F.lit(-1)))
        late = both.agg(F.lit("limited").alias("outcome"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        rows = taken
    folded = fold_batch(stored, rows, keys, seq, **more)
    counts = folded.groupBy("outcome").agg(F.count("*").alias("n"))
    return (counts if late is None else counts.unionByName(late)), folded


def refresh_from_history(online: DataFrame, wanted: DataFrame, picked: DataFrame, keys: Sequence[str], order: Sequence[str], seq: str = "seq", budget: int | None = None, **more) -> tuple[DataFrame, DataFrame]:
    """A guarded refresh of the wanted keys from rows picked out of history as of a time: (outcomes with counts, folded
    rows).  Wanted keys for which nothing was picked count as `missing_offline`."""
    counts, folded = guarded_refresh(online, picked.join(wanted.select(*keys).distinct(), list(keys), "left_semi"), keys, order, seq, budget, **more)
    absent = wanted.join(picked.select(*keys), list(keys), "left_anti").agg(F.lit("missing_offline").alias("outcome"), F.count("*").alias("n"))
    return counts.unionByName(absent), folded
