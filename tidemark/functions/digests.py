"""Canonical text of values, and the digests that identify content.

The canonical form is compact JSON with sorted keys.  Whole numbers, booleans, strings and nulls are built in the JVM;
a double's canonical text is Spark's; `canonical_text` re-serialises arbitrary JSON text in Arrow batches."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_json(col: Column, dtype: str) -> Column:
    if dtype in ("int", "bool", "float"):
        return F.coalesce(col.cast("string"), F.lit("null"))
    if dtype == "string":
        text = F.to_json(F.struct(col.cast("string").alias("v")))
        return F.when(col.isNull(), F.lit("null")).otherwise(F.regexp_extract(text, r'^\{"v":(.*)\}$', 1))
    raise ValueError(f"no canonical form for {dtype!r}")


@F.pandas_udf(StringType())
def canonical_text(raw: pd.Series) -> pd.Series:
    """Canonical form of JSON text; null where it does not parse or holds NaN or infinity."""

    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        except (TypeError, ValueError):
            return None

    return raw.map(one)


def value_hash(canonical: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical, 256))


def input_fingerprint(inputs: list[tuple[str, Column, Column, Column]]) -> Column:
    """Of (id, time, hash, present): digest of the sorted triples [id, microseconds, hash] of the present inputs."""
    triples = F.array(*(F.when(there, F.concat(F.lit(f'["{name}",'), F.unix_micros(at.cast("timestamp")).cast("string"), F.lit(',"'), h, F.lit('"]'))) for name, at, h, there in sorted(inputs, key=lambda x: x[0])))
    return F.sha2(F.concat(F.lit("["), F.array_join(F.array_compact(triples), ","), F.lit("]")), 256)


def report_ref(entity: Column, source: Column, kind: Column, content_hash: Column) -> Column:
    """A raw report's name, derived from its content: equal reports share it."""
    return F.concat(F.lit("rep_"), F.substring(F.sha2(F.concat_ws("|", entity, source, kind, content_hash), 256), 1, 32))


def idempotency_key(entity_type: Column, entity: Column, groups: Column, features: Column, hashes: Column) -> Column:
    """Same for the same logical request: what is asked of whom, over which contents."""
    listed = lambda xs: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(xs), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ","), F.lit("]"))
    body = F.concat_ws("|", entity_type, entity, listed(groups), listed(features), listed(hashes))
    named = F.when(F.size(groups) > 0, F.array_join(F.array_sort(groups), "|")).otherwise("-")
    return F.concat_ws(":", entity_type, entity, named, F.substring(F.sha2(body, 256), 1, 16))


def group_fingerprint(hashes: Column) -> Column:
    """An aggregate: the same digest for groups whose lists are short."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(hashes)), lambda h: F.concat(F.lit('"'), h, F.lit('"'))), ", ")
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("["), body, F.lit("]")), 256))


def dataset_fingerprint(rows: DataFrame, column: str) -> DataFrame:
    """One row, `content_hash`: digest of the sorted list of a column's hashes, written as a JSON list with ", " between.

    The digest of a sequence is sequential: one task reads the sorted hashes, which Spark spills, as a stream of batches
    and holds no more than one of them."""

    def digest(batches):
        state, first = hashlib.sha256(b"["), True
        for batch in batches:
            listed = ", ".join(f'"{h}"' for h in batch.column(0).to_pylist())
            if listed:
                state.update(((", " if not first else "") + listed).encode())
                first = False
        state.update(b"]")
        yield pa.RecordBatch.from_pydict({"content_hash": [f"sha256:{state.hexdigest()}"]})

    sorted_ = rows.select(F.col(column).cast("string").alias("h")).where("h is not null").repartition(1).sortWithinPartitions("h")
    return sorted_.mapInArrow(digest, "content_hash string")


def storage_path(kind: Column, ref: Column, at: Column, bucket: str, suffix: str = ".json.gz") -> Column:
    return F.concat(F.lit(f"s3://{bucket}/"), kind, F.date_format(at, "/yyyy/MM/dd/"), ref, F.lit(suffix))
