"""Compiles a plan of features into columns: one struct column per feature, level by level.

Sources are struct columns of the entity row: payload fields and `report_ts`, `content_hash`, `available_at`
(trusted), null where the entity has no such report.  Functions of the first tier take and return columns, so that
Catalyst prunes what nobody asked for and the whole graph stays in generated code; rows never leave their partition.
`arrow_tier` makes such a function out of a Python one, run on Arrow batches.

A feature's struct: value, status, data_ts (least time of its inputs), max_input_data_ts (greatest), calc_ts,
value_hash, input_fingerprint, available_at and availability_source (only if every input has one).  A required input that is
skipped, missing or stale makes the feature SKIPPED; an optional one that is skipped drops out, one that is stale stays, and
either makes it DEGRADED, as does a degraded input.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digests
from .registry import Plan, RegistryError

OK, DEGRADED, SKIPPED = "OK", "DEGRADED", "SKIPPED"
Udf = Callable[[dict, dict], Column]


def load_functions(spec: str) -> Mapping[str, Udf]:
    """`module:callable`, which returns a mapping of names to functions, or (registry, mapping)."""
    module, _, name = spec.partition(":")
    if not module or not name:
        raise RegistryError(f"{spec!r} is not module:callable")
    try:
        got = getattr(importlib.import_module(module), name)()
    except Exception as error:
        raise RegistryError(f"{spec!r} cannot be loaded: {error}") from error
    return got[1] if isinstance(got, tuple) else got


def arrow_tier(fn: Callable, returns: str, sources: Mapping[str, list[str]] | None = None, deps: tuple[str, ...] = ()) -> Udf:
    """A column function out of `fn(sources, deps)` on plain Python values, run in Arrow batches."""
    fields = [(s, f) for s, fs in (sources or {}).items() for f in fs]

    def build(src: dict, dep: dict) -> Column:
        @F.pandas_udf(returns)
        def call(*cols: pd.Series) -> pd.Series:
            out = []
            for row in zip(*cols):
                given: dict = {}
                for (s, f), v in zip(fields, row):
                    given.setdefault(s, {})[f] = v
                out.append(fn(given, dict(zip(deps, row[len(fields) :]))))
            return pd.Series(out)

        return call(*(src[s][f] for s, f in fields), *(dep[d] for d in deps))

    return build


def _over(cols: list[Column], pick: Callable) -> Column:
    return pick(*cols) if len(cols) > 1 else cols[0]


def compute(entities: DataFrame, plan: Plan, functions: Mapping[str, Udf], calc_ts: Column, *, dtypes: Mapping[str, str] | None = None, given: tuple[str, ...] = ()) -> DataFrame:
    """`entities` with a struct column per planned feature (in `given`: already there), dependencies included."""
    view, df = plan.view, entities
    for name in plan.compute:
        if name in given:
            continue
        f = view.features[name]
        if f.udf not in functions:
            raise RegistryError(f"feature {name!r} needs the unknown function {f.udf!r}")
        skip, degraded = F.lit(False), F.lit(False)
        inputs, ts, avail, trusted, deps = [], [], [], [], {}
        for s in f.inputs:
            col = F.col(s)
            skip = skip | col.isNull()
            inputs.append((f"source:{s}", col["report_ts"], col["content_hash"], F.lit(True)))
            ts.append(col["report_ts"]), avail.append(col["available_at"]), trusted.append(F.lit(True))
        for e in f.deps:
            col, pin = F.col(e.feature), e.version or view.features[e.feature].feature_version
            out = col.isNull() | (col["status"] == SKIPPED)
            stale = F.lit(False) if e.max_input_age_seconds is None else F.coalesce(F.unix_micros(calc_ts.cast("timestamp")) - F.unix_micros(col["data_ts"].cast("timestamp")) > e.max_input_age_seconds * 1_000_000, F.lit(False))
            skip = (skip | out | stale) if e.required else skip
            degraded = degraded | (out | stale if not e.required else F.lit(False)) | F.coalesce(col["status"] == DEGRADED, F.lit(False))
            there = ~out
            inputs.append((f"{e.feature}:v{pin}", F.when(there, col["data_ts"]), col["value_hash"], there))
            ts.append(F.when(there, col["data_ts"])), avail.append(F.when(there, col["available_at"])), trusted.append(there)
            deps[e.feature] = F.when(there, col["value"])
        # nothing to compute from: all inputs were optional and are gone
        skip = skip | _over(ts, F.coalesce).isNull()
        value = functions[f.udf]({s: F.col(s) for s in f.inputs}, deps)
        kind = (dtypes or {}).get(f.dtype, {"int": "int", "string": "string", "bool": "bool"}.get(f.dtype, "float"))
        all_known = F.lit(True)
        for a, there in zip(avail, trusted):
            all_known = all_known & (~there | a.isNotNull())
        status = F.when(skip, SKIPPED).when(degraded, DEGRADED).otherwise(OK)
        live = F.when(~skip, value)
        known = F.when(all_known, _over(avail, F.greatest))
        df = df.withColumn(name, F.struct(
            live.alias("value"), status.alias("status"), F.when(~skip, _over(ts, F.least)).alias("data_ts"), F.when(~skip, _over(ts, F.greatest)).alias("max_input_data_ts"),
            calc_ts.alias("calc_ts"), F.when(~skip, digests.value_hash(digests.canonical_json(live, kind))).alias("value_hash"), F.when(~skip, digests.input_fingerprint(inputs)).alias("input_fingerprint"),
            F.when(~skip, known).alias("available_at"), F.when(~skip & known.isNotNull(), "source_provided").alias("availability_source"),
        ))
    return df


def results(computed: DataFrame, plan: Plan, keys: list[str]) -> DataFrame:
    """Tall rows of the requested features that were not skipped: dependencies that nobody asked for are not returned."""
    view = plan.view
    cells = [F.struct(F.lit(n).alias("feature_name"), F.lit(view.features[n].feature_version).alias("feature_version"), *(F.col(n)[c].cast("string").alias("value_json") if c == "value" else F.col(n)[c].alias(c) for c in ("value", "status", "data_ts", "max_input_data_ts", "calc_ts", "value_hash", "input_fingerprint", "available_at", "availability_source"))) for n in plan.outputs]
    tall = computed.select(*keys, F.explode(F.array(*cells)).alias("_r")).select(*keys, "_r.*")
    return tall.where(F.col("status") != SKIPPED).withColumn("view", F.lit(view.name)).withColumn("view_version", F.lit(view.view_version))


def from_history(wanted: DataFrame, history: DataFrame, plan: Plan, functions: Mapping[str, Udf], keys: list[str], calc: str = "calc_ts") -> DataFrame:
    """Recompute features whose inputs are all features, from history as of `calc`.  Any missing input, even an optional one,
    leaves an entity out; a value without metadata counts as its own input."""
    from ..operators.asof import as_of

    view = plan.view
    for n in plan.outputs:
        if view.features[n].inputs:
            raise RegistryError(f"feature {n!r} reads raw sources and cannot be recomputed from history")
    needed = sorted({e.feature for n in plan.outputs for e in view.features[n].deps})
    cols = ["value", "max_input_data_ts", "value_hash", "input_fingerprint", "available_at"]
    pinned = F.lit(False)
    for d in needed:
        pinned = pinned | ((F.col("feature_name") == d) & (F.col("feature_version") == view.features[d].feature_version))
    wide = as_of(wanted, history.where(pinned), keys, needed, obs_ts=calc, value=cols)
    for d in needed:
        wide = wide.where(F.col(d).isNotNull())
        own = digests.value_hash(digests.canonical_json(F.col(d)["value"], "float"))
        wide = wide.withColumn(d, F.struct(F.col(d)["value"].alias("value"), F.lit(OK).alias("status"), F.col(d)["data_ts"].alias("data_ts"), F.coalesce(F.col(d)["max_input_data_ts"], F.col(d)["data_ts"]).alias("max_input_data_ts"), F.coalesce(F.col(d)["value_hash"], own).alias("value_hash"), F.coalesce(F.col(d)["input_fingerprint"], own).alias("input_fingerprint"), F.col(d)["available_at"].alias("available_at")))
    direct = Plan(view, plan.outputs, {}, ())
    return results(compute(wide, direct, functions, F.col(calc), given=tuple(x for x in plan.compute if x not in plan.outputs)), direct, keys)


def golden(spark, cases: list[dict], run: Callable[[dict], object]) -> list[tuple[str, str]]:
    """Each case's name with passed, failed or error."""
    out = []
    for case in cases:
        try:
            state = "passed" if run(case) == case["expected"]["value"] else "failed"
        except Exception as error:  # a case that breaks is a result
            state = f"error: {error}"[:200]
        out.append((case["name"], state))
    return out
