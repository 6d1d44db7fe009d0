"""Feature history as an append-only log of commits in a folder, and the latest-value table beside it.

A commit is a Parquet folder of a fresh name; a marker `_commits/<n>`, which names the folder and is published last by
a rename that fails where the marker exists, makes it visible.  So a failed write is never read, and of writers that race
for a number one wins and the others fail without a trace in what it wrote.  `row_id` numbers rows in append order and is the tie-break of point-in-time reads.  Folders are reached through
Hadoop's filesystem, so any store that Spark can write will do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Log:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def commits(self) -> list[tuple[int, int, str]]:
        """(commit, rows up to and with it, folder) of the published commits, in order."""
        fs, at = self._fs(f"{self.path}/_commits")
        if not fs.exists(at):
            return []
        out = []
        for status in fs.listStatus(at):
            if status.getPath().getName().isdigit():
                stream = fs.open(status.getPath())
                total, folder = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
                stream.close()
                out.append((int(status.getPath().getName()), int(total), folder))
        return sorted(out)

    def stage(self, rows: DataFrame, order: Sequence[str] | None = None) -> tuple[int, int, str]:
        """Write rows to a fresh folder, numbered on from the last commit: (commit, rows up to and with it, folder).

        Rows are numbered within partitions of a range sort and offset by the counts before: no global window."""
        done = self.commits()
        number, start = (done[-1][0] + 1, done[-1][1]) if done else (0, 0)
        name = self.spark._jvm.java.util.UUID.randomUUID().toString()
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
        staged = f"{self.path}/_staged-{name}"
        rows.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()).write.parquet(staged)
        held = self.spark.read.parquet(staged)
        counts = held.groupBy("_part").agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = counts.select("_part", before.alias("_start"), "_n")
        total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        fs, at = self._fs(staged)
        if total:
            # a place within its partition is the low 33 bits of the id
            numbered = held.join(F.broadcast(starts), "_part").withColumn("row_id", F.lit(start) + F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1))
            numbered.drop("_part", "_place", "_start", "_n").write.parquet(f"{self.path}/data-{name}")
        fs.delete(at, True)
        return number, start + total, f"data-{name}"

    def publish(self, number: int, total: int, folder: str) -> None:
        """Make a staged folder commit `number`; an error if another writer was first."""
        jvm = self.spark._jvm
        fs, draft = self._fs(f"{self.path}/_commits/.{folder}")
        stream = fs.create(draft, True)
        stream.write(bytearray(f"{total} {folder}".encode()))
        stream.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        _, marker = self._fs(f"{self.path}/_commits/{number}")
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, marker, how)
        except Exception as failed:
            fs.delete(draft, False)
            fs.delete(self._fs(f"{self.path}/{folder}")[1], True)
            raise FileExistsError(f"commit {number} of {self.path} is another writer's") from failed

    def append(self, rows: DataFrame, order: Sequence[str] | None = None) -> int:
        """Append atomically; returns the number of rows.  An empty append leaves no commit."""
        before = self.commits()
        number, total, folder = self.stage(rows, order)
        added = total - (before[-1][1] if before else 0)
        if added:
            self.publish(number, total, folder)
        return added

    def read(self, columns: Sequence[str] | None = None) -> DataFrame:
        """All published rows; Spark prunes columns and pushes filters down to the files."""
        done = self.commits()
        if not done:
            raise FileNotFoundError(f"nothing is published in {self.path}")
        df = self.spark.read.parquet(*(f"{self.path}/{folder}" for _, _, folder in done))
        return df.select(*columns) if columns else df

    def entity(self, key: str, **equal) -> DataFrame:
        """An entity's rows in append order, by equality of further columns."""
        df = self.read().where(F.col("entity_key") == key)
        for name, value in equal.items():
            df = df.where(F.col(name) == value)
        return df.orderBy("row_id")


def view_history(log: Log, registry, view: str, version: int | None = None, feature: str | None = None, feature_version: int | None = None) -> DataFrame:
    """A view's rows in append order; a view, version or feature that the registry does not know is a KeyError.

    Without a version the view's registered one must exist, and rows of all versions are read."""
    known = registry.views.get(view)
    if known is None or version not in (None, known.view_version):
        raise KeyError(f"unknown view {view!r}" + ("" if version is None else f" version {version}"))
    if feature is not None and feature not in known.features:
        raise KeyError(f"unknown feature {feature!r}")
    rows = log.read().where(F.col("view") == view)
    for name, value in (("view_version", version), ("feature_name", feature), ("feature_version", feature_version)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def lookup(online: DataFrame, wanted: DataFrame, keys: Sequence[str], features: Sequence[str], known: Sequence[str] | None = None) -> DataFrame:
    """Latest values of each wanted key as a map, and the features that are missing; KeyError for one not in `known`."""
    unknown = [f for f in features if known is not None and f not in known]
    if unknown:
        raise KeyError(f"unknown features {unknown}")
    held = online.where(F.col("feature_name").isin(*features)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("feature_name", "value"))).alias("values"))
    out = wanted.join(held, list(keys), "left")
    names = F.coalesce(F.map_keys("values"), F.expr("cast(array() as array<string>)"))
    return out.withColumn("missing", F.array_except(F.array(*(F.lit(f) for f in features)), names))


def request_results(requests: DataFrame, results: DataFrame, key: str = "request_id") -> DataFrame:
    """A request's own values, never the latest ones; without a result all its features are missing."""
    own = results.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("feature_name", "value"))).alias("values"))
    out = requests.join(own, key, "left").withColumn("result_missing", F.col("values").isNull())
    return out.withColumn("missing", F.array_except("requested_features", F.coalesce(F.map_keys("values"), F.expr("cast(array() as array<string>)"))))


def add_items(existing: DataFrame, items: DataFrame, keys: Sequence[str] = ("manifest_id", "item_index")) -> DataFrame:
    """Manifest items that are not there yet."""
    return items.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


# What an upsert of a manifest may change.
MANIFEST_CHANGES = ("status", "item_count_read", "item_count_written", "item_count_duplicate", "item_count_rejected", "watermark_min_event_ts", "watermark_max_event_ts", "content_hash")


def upsert_manifests(existing: DataFrame, incoming: DataFrame, key: str = "manifest_id") -> DataFrame:
    """Manifests after an upsert: new ones are added, known ones take status, counts, watermarks and hash only."""
    changed = [c for c in existing.columns if c in MANIFEST_CHANGES]
    new = incoming.select(key, *(F.col(c).alias(f"_{c}") for c in changed), F.lit(True).alias("_there"))
    kept = existing.join(new, key, "left")
    kept = kept.select(*(F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in existing.columns))
    return kept.unionByName(incoming.select(existing.columns).join(existing.select(key), key, "left_anti"))


def manifest_items(items: DataFrame, manifest: str) -> DataFrame:
    """A manifest's items in order."""
    return items.where(F.col("manifest_id") == manifest).orderBy("item_index")
