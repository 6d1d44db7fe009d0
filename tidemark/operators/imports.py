"""Ingestion: JSON lines with rejects, wide tables to tall rows, and the accounting of a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import casts, digests, keys
from ..ship import ship

REPORT = "entity_key map<string,string>, event_ts string, payload variant, report_ref string, source_name string, report_type string, available_at string"


def number_lines(lines: DataFrame, text: str = "value", order: Sequence[str] = ("line",)) -> DataFrame:
    """Non-blank lines with `item_index` from 0; blank lines do not count.

    Places come from per-file-chunk counts: `order` must be a pair (chunk, place) or a place; a chunk is ranked apart."""
    kept = lines.where(F.trim(text) != "")
    if len(order) == 1:
        block = F.floor(F.col(order[0]) / 100_000).alias("_chunk")
        kept, chunk, place = kept.withColumn("_chunk", block), "_chunk", order[0]
    else:
        chunk, place = order
    sizes = kept.groupBy(chunk).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(chunk, before.alias("_start"))
    nth = F.row_number().over(Window.partitionBy(chunk).orderBy(place))
    out = kept.withColumn("_nth", nth).join(starts, chunk).withColumn("item_index", F.col("_start") + F.col("_nth") - 1)
    return out.drop("_nth", "_start", "_n", *(["_chunk"] if len(order) == 1 else []))


def parse_reports(lines: DataFrame, key_fields: Sequence[str], source: str, kind: str, text: str = "value") -> DataFrame:
    """Each line as a report row or with an `error`: malformed JSON, a missing field, a bad key, a time without zone,
    availability before the report itself.  A bad line never stops the run."""
    ship(lines.sparkSession)
    lines = lines.withColumn("_body", F.try_parse_json(F.col(text)))  # a column, so that a line is parsed once
    body = F.col("_body")
    get = lambda path, type_="string": F.try_variant_get(body, f"$.{path}", type_)
    parts = {k: get(f"entity_key.{k}") for k in key_fields}
    event, known = casts.parse_zoned(get("event_ts")), casts.parse_zoned(get("available_at"))
    payload = F.get_json_object(F.col(text), "$.payload")
    error = (
        F.when(body.isNull(), "malformed JSON").when(F.try_variant_get(body, "$.entity_key", "map<string,string>").isNull(), "missing entity_key")
        .when(keys.key_error(parts).isNotNull(), keys.key_error(parts)).when(get("event_ts").isNull(), "missing event_ts")
        .when(event.isNull(), "event_ts must be a time with a zone").when(payload.isNull(), "missing payload")
        .when(get("available_at").isNotNull() & known.isNull(), "available_at must be a time with a zone").when(known < event, "available_at before event_ts")
    )
    canonical = digests.canonical_text(F.when(error.isNull(), payload))
    out = lines.withColumn("error", error).withColumn("entity_key", keys.entity_key(parts, key_fields)).withColumn("event_ts", event)
    out = out.withColumn("payload_json", canonical).withColumn("content_hash", digests.value_hash(F.col("payload_json")))
    out = out.withColumn("source_name", F.coalesce(get("source_name"), F.lit(source))).withColumn("report_type", F.coalesce(get("report_type"), F.lit(kind)))
    ref = digests.report_ref(F.col("entity_key"), F.col("source_name"), F.col("report_type"), F.col("content_hash"))
    out = out.withColumn("report_ref", F.coalesce(get("report_ref"), F.when(F.col("error").isNull(), ref))).withColumn("available_at", known)
    return out.withColumn("availability_source", F.when(F.col("available_at").isNotNull(), "source_provided").otherwise("ingestion_time")).drop("_body")


def land(parsed: DataFrame, existing_refs: DataFrame | None = None) -> DataFrame:
    """Items with `status`: rejected, duplicate (seen before, or earlier in the run) or written.

    A reject shares its window with nothing, however many there are."""
    alone = F.when(F.col("error").isNotNull(), F.col("item_index"))
    same = Window.partitionBy(alone, F.when(alone.isNull(), F.col("report_ref"))).orderBy("item_index")
    seen = parsed.withColumn("_nth", F.row_number().over(same)).withColumn("_first", F.first("content_hash").over(same))
    if existing_refs is not None:
        seen = seen.join(existing_refs.select("report_ref", F.col("content_hash").alias("_old")).distinct(), "report_ref", "left")
    else:
        seen = seen.withColumn("_old", F.lit(None).cast("string"))
    clash = F.coalesce(F.col("_old"), F.col("_first")) != F.col("content_hash")
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(clash, F.concat(F.lit("report_ref conflict: "), "report_ref"))
    status = F.when(F.col("error").isNotNull(), "rejected").when(F.col("_old").isNotNull() | (F.col("_nth") > 1), "duplicate").otherwise("written")
    return seen.withColumn("error", error).withColumn("status", status).drop("_nth", "_first", "_old")


def manifest(items: DataFrame) -> DataFrame:
    """One row: counts, the least and greatest event time of accepted items, and the fingerprint of their contents."""
    accepted = F.col("status") != "rejected"
    counts = items.agg(
        F.count("*").alias("item_count_read"), *(F.count_if(F.col("status") == s).alias(f"item_count_{s}") for s in ("written", "duplicate", "rejected")),
        F.min(F.when(accepted, F.col("event_ts"))).alias("watermark_min_event_ts"), F.max(F.when(accepted, F.col("event_ts"))).alias("watermark_max_event_ts"),
    )
    print_ = digests.dataset_fingerprint(items.where(accepted).select("content_hash"), "content_hash")
    both = counts.unionByName(print_, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def eligible_items(items: DataFrame, include_duplicates: bool = False) -> DataFrame:
    states = ["written", "duplicate"] if include_duplicates else ["written"]
    return items.where(F.col("status").isin(*states) & F.col("report_ref").isNotNull() & F.col("entity_key").isNotNull())


def tall_rows(wide: DataFrame, features: Mapping[str, tuple[str, str]], ids: Sequence[str]) -> DataFrame:
    """Wide rows to one row per feature and cell: `features` maps a name to (column, dtype).

    Columns: ids, feature_name, dtype, raw, value (converted text), missing, error."""
    cells = F.array(*(F.struct(F.lit(n).alias("feature_name"), F.lit(t).alias("dtype"), F.col(c).cast("string").alias("raw"), casts.convert(F.col(c), t).alias("value"), casts.is_missing(F.col(c)).alias("missing"), casts.convert_error(F.col(c), t).alias("error")) for n, (c, t) in features.items()))
    return wide.select(*ids, F.explode(cells).alias("_c")).select(*ids, "_c.*")


def import_summary(tall: DataFrame, n_written: Column | None = None) -> DataFrame:
    """One row: candidate cells, missing, bad and good ones."""
    return tall.agg(F.count("*").alias("n_cells"), F.count_if("missing").alias("n_missing"), F.count_if("error").alias("n_bad"), F.count_if(~F.col("missing") & ~F.col("error")).alias("n_values"))


def import_accounting(items: DataFrame, tall: DataFrame, online_written: int | None = None) -> DataFrame:
    """One row for a whole import: candidates, written, duplicate, rejected and missing cells, latest values written, and a
    warning where latest values were asked for and their number differs from what history took."""
    cells = tall.agg(F.count("*").alias("candidates"), F.count_if("missing").alias("missing"))
    states = items.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("written", "duplicate", "rejected")))
    both = cells.unionByName(states, allowMissingColumns=True)
    out = both.agg(*(F.max(c).alias(c) for c in both.columns)).withColumn("online_written", F.lit(online_written).cast("long"))
    text = F.concat(F.lit("history took "), F.col("written").cast("string"), F.lit(" rows, the latest-value table "), F.col("online_written").cast("string"))
    return out.withColumn("warning", F.when(F.col("online_written") != F.col("written"), text))
