"""Evaluation of scores, and summaries of measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def roc_auc(rows: DataFrame, score: str = "score", label: str = "label", steps: int = 10_000) -> DataFrame:
    """One row `auc`: rank sum with midranks for ties, 0.5 if a class is empty.

    Ranks come from counts on two levels, per step of the score and per distinct score within a step, so that no task
    sorts all distinct scores (for scores from 0 to 1 the upper level has `steps` rows)."""
    by = rows.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos")).withColumn("_step", F.floor(F.col(score) * steps))
    sizes = by.groupBy("_step").agg(F.sum("n").alias("_n"))
    starts = sizes.select("_step", F.coalesce(F.sum("_n").over(Window.orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("_step").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by.withColumn("_inner", inner).join(starts, "_step").select("n", "pos", (F.col("_start") + F.col("_inner") + (F.col("n") + 1) / 2.0).alias("rank"))
    sums = ranked.agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    auc = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("q"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("q") > 0), auc).otherwise(0.5).alias("auc"))


def log_loss_brier(rows: DataFrame, score: str = "score", label: str = "label", eps: float = 1e-9, digits: int = 6) -> DataFrame:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(score)))
    y = F.col(label)
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    return rows.agg(F.round(F.avg(loss), digits).alias("log_loss"), F.round(F.avg((F.col(score) - y) * (F.col(score) - y)), digits).alias("brier"))


def standardizer(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: population mean and deviation of each column, a deviation of 0 as 1."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}_std")]
    return rows.agg(*aggs)


def percentiles(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Median, 95th and 99th percentile by linear interpolation."""
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return rows.groupBy(*by).agg(F.count(value).alias("n"), q.alias("_q")).select(*by, "n", *(F.col("_q")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))))


def histogram_summary(rows: DataFrame, value: str, labels: Sequence[str]) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))


def class_rates(rows: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))


# What a label's value may not hold, and its greatest length.
FORBIDDEN = ("payload", "object_key", "storage_uri", "storage://", "s3://", "select ", "insert ", "{", "}", "\n")
MAX_LABEL = 64


def _label(name: str) -> Column:
    """A label's text; the query fails at a value that is too long or looks like content."""
    text = F.coalesce(F.col(name).cast("string"), F.lit("null"))
    bad = F.char_length(text) > MAX_LABEL
    for part in FORBIDDEN:
        bad = bad | F.contains(F.lower(text), F.lit(part))
    return F.when(bad, F.raise_error(F.lit(f"label {name} has a value that no label may have")).cast("string")).otherwise(text)


def series(name: str, labels: Sequence[str]) -> Column:
    """A metric's name with its labels, `name{a=1,b=2}`, in order of label."""
    text = F.concat_ws(",", *(F.concat(F.lit(f"{c}="), _label(c)) for c in sorted(labels)))
    return F.concat(F.lit(name + "{"), text, F.lit("}")) if labels else F.lit(name)


def counter(rows: DataFrame, name: str, labels: Sequence[str], value: str | None = None) -> DataFrame:
    """(series, value): how many rows there are, or the sum of a column."""
    return rows.groupBy(series(name, labels).alias("series")).agg((F.sum(value) if value else F.count("*")).cast("double").alias("value"))


def gauge(rows: DataFrame, name: str, labels: Sequence[str], value: str, order: str) -> DataFrame:
    """(series, value): the last value by `order`."""
    return rows.groupBy(series(name, labels).alias("series")).agg(F.max_by(F.col(value).cast("double"), order).alias("value"))
