"""Structured Streaming over event files: guarded latest values, history appends and request projections.

Each micro-batch goes through the same functions as a batch, in `foreachBatch`.  State lives in versioned Parquet folders
that a batch's number names, so a batch that is run again writes the same folder again and nothing twice.  No path sets
a watermark: late data is judged by the guard and by point-in-time reads, never dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, guard


BUCKETS = 64


class Versioned:
    """A table in buckets of its keys' hashes, of which each batch writes those it touches: `<path>/v=<batch + 1>/_bucket=<b>`.

    The newest version of each bucket counts.  A batch that is run again writes the same version again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str, start: str) -> list[int]:
        fs, at = self._fs(path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[len(start) :]) for n in names if n.startswith(start))

    def _versions(self, version: int) -> dict[int, list[int]]:
        """The finished versions of each bucket up to the given one, newest first."""
        out: dict[int, list[int]] = {}
        for v in reversed(self._names(self.path, "v=")):
            fs, done = self._fs(f"{self.path}/v={v}/_SUCCESS")
            if v <= version and fs.exists(done):
                for b in self._names(f"{self.path}/v={v}", "_bucket="):
                    out.setdefault(b, []).append(v)
        return out

    @staticmethod
    def bucket(keys: Sequence[str]):
        return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")

    def read(self, version: int, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The newest rows up to the given version, of all or some buckets, or None."""
        held = self._versions(version)
        paths = [f"{self.path}/v={v[0]}/_bucket={b}" for b, v in sorted(held.items()) if buckets is None or b in buckets]
        return self.spark.read.parquet(*paths) if paths else None

    def write(self, version: int, rows: DataFrame, keys: Sequence[str], keep: int = 2) -> None:
        """New contents of the buckets that `rows` belong to; `keep` versions of each stay."""
        own = self.bucket(keys)
        rows.withColumn("_bucket", own).repartition(own).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/v={version}")
        for b, versions in self._versions(version).items():
            for old in versions[keep:]:
                fs, at = self._fs(f"{self.path}/v={old}/_bucket={b}")
                fs.delete(at, True)


def guarded_latest(arrivals: DataFrame, path: str, checkpoint: str, keys: Sequence[str], seq: str = "seq", available_now: bool = True):
    """Keep the latest-value table at `path` up to date with a stream of arrivals; outcomes go to `path`_outcomes.

    A batch reads and writes the buckets of its keys only."""
    spark = arrivals.sparkSession
    table = Versioned(spark, path)

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        touched = [r[0] for r in rows.select(table.bucket(keys).alias("b")).distinct().collect()]  # BUCKETS at most
        stored = table.read(number, touched)
        folded = guard.fold_batch(stored, rows, keys, seq).persist()
        held = guard.latest(folded, keys, seq).drop("outcome") if stored is None else guard.refresh(stored, folded, keys, seq)
        folded.write.mode("overwrite").parquet(f"{path}_outcomes/batch={number}")
        table.write(number + 1, held, keys)
        folded.unpersist()
        rows.unpersist()

    writer = arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def route(messages: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], dead_letters: str, checkpoint: str, available_now: bool = True):
    """Send messages of each event type to its handler; what is no JSON or of no known type goes to the dead letters.

    Handlers get (rows, batch number) and must tolerate being given a batch again."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        good, dead = chunks.split_poison(rows, known_types=list(handlers))
        dead.write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")
        for kind, handle in handlers.items():
            handle(good.where(F.col("event_type") == kind), number)
        rows.unpersist()

    writer = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def publish(events: DataFrame, path: str, topic: str, key: str, headers: dict[str, str] | None = None) -> int:
    """Append events (all columns as the JSON value) to the log of a topic, keyed and with headers; returns how many were
    delivered.  Files become visible when the write has committed, and a failure raises."""
    marks = F.create_map(*(F.lit(x) for pair in (headers or {}).items() for x in pair)) if headers else F.expr("cast(map() as map<string,string>)")
    rows = events.select(F.lit(topic).alias("topic"), F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"), marks.alias("headers"))
    seen = Observation("published")
    rows.observe(seen, F.count("*").alias("n")).write.mode("append").partitionBy("topic").parquet(path)
    return seen.get["n"]


def subscribe(spark: SparkSession, path: str, topics: Sequence[str]) -> DataFrame:
    """One stream of several topics of such a log."""
    schema = "key string, value string, headers map<string,string>, topic string"
    return spark.readStream.schema(schema).parquet(path).where(F.col("topic").isin(*topics))
