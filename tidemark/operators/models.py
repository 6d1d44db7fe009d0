"""Models as features: inputs by point-in-time, one vectorised prediction per Arrow batch, metadata of its own."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import digests, scoring
from ..ship import ship
from .training import training_set

Predict = Callable[[pd.DataFrame], Sequence[float]]


def model_inputs(observations: DataFrame, history: DataFrame, keys: Sequence[str], deps: Mapping[str, tuple[int, bool]], **more) -> DataFrame:
    """Observations with their inputs; without a required input, or without any, an observation is skipped.

    `deps` maps a feature to (version, required).  Optional inputs that are missing stay null."""
    wide = training_set(observations, history, keys, {n: v for n, (v, _) in deps.items()}, **more)
    there = {n: F.col(n)["status"] == "ok" for n in deps}
    keep, some = F.lit(True), F.lit(False)
    for n, (_, required) in deps.items():
        keep = (keep & there[n]) if required else keep
        some = some | there[n]
    return wide.where(keep & some)


def predict(rows: DataFrame, features: Sequence[str], model: Predict, output: str = "score") -> DataFrame:
    """`rows` with the model's output; the model is called once per Arrow batch and must return a value per row."""

    def run(frames):
        for frame in frames:
            values = list(model(frame[list(features)])) if len(frame) else []
            if len(values) != len(frame):
                raise ValueError(f"the model returned {len(values)} values for {len(frame)} rows")
            yield frame.assign(**{output: values})

    ship(rows.sparkSession)
    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(output, DoubleType())]))


def check_digest(content: bytes, expected: str) -> str:
    """The digest `sha256:<hex>` of a model's content; ValueError where it is not the pinned one."""
    found = f"sha256:{hashlib.sha256(content).hexdigest()}"
    if found != expected:
        raise ValueError(f"the model's digest is {found}, the pinned one {expected}")
    return found


def linear_score(weights: Mapping[str, float], bias: float) -> Callable[[Mapping[str, Column]], Column]:
    """A linear model as a JVM expression, for models that need no Python."""
    from ..functions.scoring import logistic

    def score(columns: Mapping[str, Column]) -> Column:
        margin = F.lit(float(bias))
        for name, w in weights.items():
            margin = margin + columns[name] * float(w)
        return logistic(margin)

    return score


def model_feature(observations: DataFrame, history: DataFrame, keys: Sequence[str], deps: Mapping[str, tuple[int, bool]], model: Predict, *, uri: str, digest: str, output: str, obs_ts: str = "observation_ts", value: str = "value") -> DataFrame:
    """Rows of a model feature: value, data_ts (least of the inputs), max_input_data_ts, calc_ts (the observation's time),
    input_fingerprint over the inputs and the model itself, and no availability."""
    if not uri.startswith("mlflow://"):
        raise ValueError(f"unsupported model uri {uri!r}")
    ready = model_inputs(observations, history, keys, deps, obs_ts=obs_ts, value=(value,))
    at = [F.col(n)["data_ts"] for n in deps]
    low, high = (F.least(*at), F.greatest(*at)) if len(at) > 1 else (at[0], at[0])
    inputs = [(f"{n}:v{v}", F.col(n)["data_ts"], digests.value_hash(F.col(n)[value].cast("string")), F.col(n)["status"] == "ok") for n, (v, _) in deps.items()]
    inputs.append((f"model:{uri}#{output}", low, F.lit(digest), F.lit(True)))
    flat = ready.select(*keys, obs_ts, low.alias("data_ts"), high.alias("max_input_data_ts"), F.col(obs_ts).alias("calc_ts"), digests.input_fingerprint(inputs).alias("input_fingerprint"), *(F.col(n)[value].cast("double").alias(n) for n in deps))
    scored = predict(flat, list(deps), model, output)
    return scored.select(*keys, F.col(output).alias("value"), "data_ts", "max_input_data_ts", "calc_ts", "input_fingerprint", F.lit(uri).alias("model_uri"), F.lit(digest).alias("model_digest"), F.lit(output).alias("model_output_name"))


def score_writes(scores: DataFrame, declared: Mapping[str, int]) -> tuple[DataFrame, DataFrame]:
    """(scores of declared externally scored features, with their version; rejected rows)."""
    version = F.lit(None).cast("int")
    for name, v in declared.items():
        version = F.when(F.col("feature_name") == name, v).otherwise(version)
    marked = scores.withColumn("feature_version", version)
    return marked.where(F.col("feature_version").isNotNull()), marked.where(F.col("feature_version").isNull()).withColumn("error", F.concat(F.lit("not a score feature: "), F.coalesce("feature_name", F.lit("null"))))


def decide(latest: DataFrame, features: Sequence[str], probability: Column, reported: str = "missing", values: str = "values", ages: str | None = None, most_seconds: int | None = None) -> DataFrame:
    """Rows with status, `refused` (names, sorted) and decision: `missing_features` where a feature is reported missing or
    absent, `stale_features` where one is older than `most_seconds`, else `completed` with its band."""
    wanted = F.array(*(F.lit(f) for f in sorted(features)))
    there = F.coalesce(F.map_keys(values), F.expr("cast(array() as array<string>)"))
    missing = F.array_sort(F.array_union(F.coalesce(F.col(reported), F.expr("cast(array() as array<string>)")), F.array_except(wanted, there)))
    none = F.expr("cast(array() as array<string>)")
    stale = none if most_seconds is None else F.filter(wanted, lambda f: F.col(ages)[f] > most_seconds)
    out = latest.withColumn("refused", F.when(F.size(missing) > 0, missing).otherwise(stale))
    status = F.when(F.size(missing) > 0, "missing_features").when(F.size("refused") > 0, "stale_features").otherwise("completed")
    return out.withColumn("status", status).withColumn("decision", F.when(F.col("status") == "completed", scoring.decision(probability)))
