"""Snapshot merges of requests, jobs and chunks, and the job states derived from chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed")
CHUNK_TERMINAL = ("completed", "completed_with_errors", "failed")


def _last(value: Column, seq: str, use: Column) -> Column:
    """Aggregate: the value of the last row, by `seq`, for which `use` holds."""
    return F.max_by(value, F.when(use, F.col(seq)))


def merge_requests(updates: DataFrame, seq: str = "seq", key: str = "request_id", scalars: Sequence[str] = (), lists: Sequence[str] = ()) -> DataFrame:
    """Per request: the last non-null scalars, the last non-empty lists, the first created_at; a terminal status does not
    go back to accepted or running, but a later terminal one replaces it."""
    status = F.col("status")
    settled = _last(status, seq, status.isNotNull() & ~status.isin("accepted", "running"))
    aggs = [_last(F.col(c), seq, F.col(c).isNotNull()).alias(c) for c in scalars]
    aggs += [_last(F.col(c), seq, F.size(c) > 0).alias(c) for c in lists]
    aggs += [F.min_by("created_at", F.when(F.col("created_at").isNotNull(), F.col(seq))).alias("created_at")]
    out = updates.groupBy(key).agg(*aggs, settled.alias("_settled"), _last(status, seq, status.isNotNull()).alias("_any"))
    return out.withColumn("status", F.when(F.col("_settled").isin(*TERMINAL), F.col("_settled")).otherwise(F.col("_any"))).drop("_settled", "_any")


def latest_requests(updates: DataFrame, seq: str = "seq", key: str = "request_id") -> DataFrame:
    """The operational view: the last update wins, even if it goes back."""
    rest = [c for c in updates.columns if c != key]
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(key, "_r.*")


def merge_jobs(updates: DataFrame, seq: str = "seq", key: str = "job_id", truthy: Sequence[str] = (), lists: Sequence[str] = (), flags: Sequence[str] = ("write_online",)) -> DataFrame:
    """Per job: the last truthy values (0 and '' are none), the last non-empty lists, flags by or, the first created_at."""
    types = dict(updates.dtypes)
    there = lambda c: F.col(c).isNotNull() & ((F.col(c) != "") if types[c] == "string" else (F.col(c) != 0))
    aggs = [_last(F.col(c), seq, there(c)).alias(c) for c in truthy]
    aggs += [_last(F.col(c), seq, F.size(c) > 0).alias(c) for c in lists]
    aggs += [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags]
    return updates.groupBy(key).agg(*aggs, F.min_by("created_at", seq).alias("created_at"))


def merge_chunks(updates: DataFrame, seq: str = "seq", keys: Sequence[str] = ("job_id", "chunk_id")) -> DataFrame:
    """Each chunk's last state; a terminal state does not go back to a running one."""
    rest = [c for c in updates.columns if c not in keys]
    rank = F.struct(F.col("status").isin(*CHUNK_TERMINAL).cast("int"), F.col(seq))
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")


def chunk_conflicts(processed: DataFrame, keys: Sequence[str] = ("job_id", "chunk_id"), identity: Sequence[str] = ("status", "item_count", "ok_items", "failed_items", "first_errors")) -> DataFrame:
    """Chunks whose terminal results contradict each other; equal replays do not."""
    done = processed.where(F.col("status").isin(*CHUNK_TERMINAL))
    return done.groupBy(*keys).agg(F.count_distinct(F.to_json(F.struct(*identity), {"ignoreNullFields": "false"})).alias("n_results")).where("n_results > 1")


def job_status(chunks: DataFrame, jobs: DataFrame, durable: bool = False, key: str = "job_id") -> DataFrame:
    """Status of each job (with its chunk_count) from its chunks' states.

    The operational rule looks at states only; the durable one also counts failed items, and knows `requested` chunks."""
    s = F.col("status")
    waiting = ("accepted", "requested") if durable else ("accepted",)
    sums = chunks.groupBy(key).agg(F.count("*").alias("n"), F.bool_and(s.isin(*waiting)).alias("waiting"), F.bool_and(s.isin(*CHUNK_TERMINAL)).alias("terminal"), F.bool_or(s.isin("accepted", "running")).alias("open"), F.bool_and(s == "failed").alias("all_failed"), F.bool_or(s.isin("failed", "completed_with_errors")).alias("some_failed"), F.coalesce(F.sum("failed_items"), F.lit(0)).alias("failed_items"))
    both = jobs.join(sums, key, "left")
    n = F.coalesce("n", F.lit(0))
    if durable:
        unfinished = (n < F.col("chunk_count")) | ~F.col("terminal")
        early = F.when(F.col("waiting"), "accepted").otherwise("running")
        errors = F.col("some_failed") | (F.col("failed_items") > 0)
        status = F.when(n == 0, "accepted").when(unfinished, early).when(F.col("all_failed"), "failed").when(errors, "completed_with_errors").otherwise("completed")
    else:
        unfinished = (n < F.col("chunk_count")) | F.coalesce("open", F.lit(False))
        early = F.when((n > 0) & F.col("waiting") & (n == F.col("chunk_count")), "accepted").otherwise("running")
        status = F.when(unfinished, early).when(F.coalesce("all_failed", F.lit(True)), "failed").when(F.col("some_failed"), "completed_with_errors").otherwise("completed")
    return both.select(*jobs.columns, n.alias("n_chunks"), F.coalesce("failed_items", F.lit(0)).alias("failed_items"), status.alias("status"))
