"""Deterministic chunking, chunk outcomes, change-rate limits and events that cannot be handled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunked(items: DataFrame, size: int, order: Sequence[str], job: str = "job_id", slice_by: Column | None = None) -> DataFrame:
    """Items of each job in consecutive slices: item_index, chunk_index, chunk_id (`job:index`).

    `slice_by`, a coarse column that never falls along `order` (a date, an id divided by a million), lets a large job be
    numbered by many tasks: places within a slice, and the slices' counts summed up."""
    if slice_by is None:
        place = F.row_number().over(Window.partitionBy(job).orderBy(*order)) - 1
        out = items.withColumn("item_index", place)
    else:
        items = items.withColumn("_slice", slice_by)
        sizes = items.groupBy(job, "_slice").agg(F.count("*").alias("_n"))
        before = Window.partitionBy(job).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select(job, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        nth = F.row_number().over(Window.partitionBy(job, "_slice").orderBy(*order))
        out = items.withColumn("_nth", nth).join(starts, [job, "_slice"]).withColumn("item_index", F.col("_start") + F.col("_nth") - 1).drop("_slice", "_nth", "_start")
    out = out.withColumn("chunk_index", F.floor(F.col("item_index") / size).cast("int"))
    return out.withColumn("chunk_id", F.concat_ws(":", F.col(job).cast("string"), F.col("chunk_index").cast("string")))


# The greatest chunk, and the most items of a request that carries its items or names a manifest.
MAX_CHUNK, MAX_INLINE, MAX_MANIFEST = 100, 1000, 5_000_000


def check_batch(items: DataFrame, size: int, manifest: bool = False, order: Sequence[str] = ("item_index",), job: str = "job_id", **more) -> DataFrame:
    """Items of a batch request in chunks, or ValueError: a chunk size out of range, no items, or more than the request's
    kind may have.  The count stops one past the limit."""
    if not 1 <= size <= MAX_CHUNK:
        raise ValueError(f"chunk size must be in 1..{MAX_CHUNK}")
    most = MAX_MANIFEST if manifest else MAX_INLINE
    count = items.limit(most + 1).count()
    if not count:
        raise ValueError("the scope has no eligible items")
    if count > most:
        raise ValueError(f"more than {most} items")
    return chunked(items, size, order, job, **more)


def by_chunk(chunked_items: DataFrame, partitions: int) -> DataFrame:
    """Dealt by chunk id, so that one job spreads over partitions and a chunk stays whole."""
    return chunked_items.repartition(partitions, "chunk_id")


def first_errors(error: Column, order: Column, most: int = 10, width: int = 200) -> Column:
    """Aggregate: the first `most` errors in order, cut to `width`; the report's cap, kept by top-k slices."""
    pairs = F.array_sort(F.collect_list(F.when(error.isNotNull(), F.struct(order.alias("o"), F.left(error, F.lit(width)).alias("e")))))
    return F.transform(F.slice(pairs, 1, most), lambda p: p["e"])


def chunk_outcomes(items: DataFrame, keys: Sequence[str] = ("job_id", "chunk_id"), order: str = "item_index", most: int = 10) -> DataFrame:
    """Per chunk: item counts, first errors, status.  Errors are ranked first, so no chunk gathers more than it reports."""
    failed = F.col("error").isNotNull()
    nth = F.row_number().over(Window.partitionBy(*keys, failed).orderBy(order))
    ranked = items.withColumn("_e", F.when(failed & (nth <= most), F.col("error")))
    out = ranked.groupBy(*keys).agg(F.count("*").alias("item_count"), F.count_if(~failed).alias("ok_items"), F.count_if(failed).alias("failed_items"), first_errors(F.col("_e"), F.col(order), most).alias("first_errors"))
    status = F.when(F.col("ok_items") == 0, "failed").when(F.col("failed_items") > 0, "completed_with_errors").otherwise("completed")
    return out.withColumn("status", status)


def token_bucket(requests: list[tuple[float, int]], rate: float, burst: float) -> list[int]:
    """What a bucket grants: requests are (seconds, number asked); a driver-side simulation for planning triggers."""
    tokens, last, out = float(burst), None, []
    for at, wanted in requests:
        tokens = min(burst, tokens + rate * max(0.0, at - (at if last is None else last)))
        last = at
        granted = min(wanted, int(tokens))
        tokens -= granted
        out.append(granted)
    return out


def lag_pause(lag: int, most: int, enabled: bool = True) -> bool:
    return enabled and lag > most


def split_poison(messages: DataFrame, value: str = "value", known_types: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(messages that parse, dead letters): not JSON, or of no known event type.  Ids are taken where they can be."""
    text = F.col(value).cast("string")
    body = F.try_parse_json(text)
    kind = F.try_variant_get(body, "$.event_type", "string")
    status = F.when(body.isNull(), "not_json").when(kind.isNull(), "missing_event_type")
    if known_types:
        status = status.when(~kind.isin(*known_types), "unknown_event_type")
    marked = messages.withColumn("failure_status", status).withColumn("event_type", kind)
    dead = marked.where(F.col("failure_status").isNotNull())
    get = lambda name: F.nullif(F.try_variant_get(body, f"$.{name}", "string"), F.lit(""))
    dead = dead.withColumn("payload_base64", F.base64(F.col(value).cast("binary"))).withColumn("request_id", F.coalesce(get("request_id"), get("score_write_id"))).withColumn("job_id", F.coalesce(get("job_id"), get("batch_job_id"))).withColumn("correlation_id", get("correlation_id"))
    return marked.where(F.col("failure_status").isNull()).drop("failure_status"), dead


def retry_or_bury(failed: DataFrame, most: int = 5, attempt: str = "attempt") -> tuple[DataFrame, DataFrame]:
    """(rows to try again, with the next attempt; rows that have had `most` attempts).  Failures of the platform itself
    (`infrastructure` true) are tried again for ever and do not count."""
    n = F.coalesce(F.col(attempt), F.lit(1))
    counts = ~F.coalesce(F.col("infrastructure"), F.lit(False))
    again = failed.where(~counts | (n < most)).withColumn(attempt, F.when(counts, n + 1).otherwise(n))
    return again, failed.where(counts & (n >= most))


def deadline_split(requests: DataFrame, now: Column, expires: str = "expires_at") -> tuple[DataFrame, DataFrame]:
    """(requests to serve, requests whose deadline has passed)."""
    late = F.coalesce(F.col(expires) <= now, F.lit(False))
    return requests.where(~late), requests.where(late).withColumn("status", F.lit("deadline_expired"))


def expires_at(event_ts: Column, deadline_ms: Column, cap_ms: int) -> Column:
    ms = F.greatest(F.lit(1), F.least(deadline_ms, F.lit(cap_ms)))
    return event_ts + F.make_interval(secs=(ms / 1000).cast("decimal(18,6)"))
