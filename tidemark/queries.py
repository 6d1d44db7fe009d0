"""Registered queries over the driver's tables, each through the library's operators, with DuckDB SQL as oracle.

History rows are events: entity = user, feature = event type, data_ts = ts; calc_ts and a trusted availability (of
every third row) follow from event_id.  Timestamps stay without zone, so both engines read them alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import casts, digests, keys, scoring
from .operators import asof, checks, chunks, dedup, evaluate, guard, imports, merges, models, propagate, reports, training
from .plans import dag, registry
from .shared import shared_dir
from .sources import history as store

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TYPES = ("click", "error", "purchase", "signup", "view")
BUCKET = 5 * 86400


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def hours(n):
    return F.make_interval(hours=n)


def event_history(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n = F.col("event_id")
    calc = F.col("ts") + hours((n % 7).cast("int"))
    source = F.when(n % 3 == 0, "source_provided").otherwise("ingestion_time")
    avail = F.when(n % 3 == 0, F.col("ts") + hours((n % 50).cast("int")))
    return e.select(keys.entity_key({"user_id": F.col("user_id")}).alias("entity_key"), F.lit("activity").alias("view"), F.lit(1).alias("view_version"), F.col("event_type").alias("feature_name"), F.lit(1).alias("feature_version"), F.col("value"), F.col("ts").alias("data_ts"), calc.alias("calc_ts"), avail.alias("available_at"), source.alias("availability_source"), n.alias("row_id"))


HISTORY_SQL = """hist AS (SELECT 'user_id=' || user_id AS entity_key, event_type AS feature_name, value, ts AS data_ts,
  ts + to_hours(CAST(event_id % 7 AS INTEGER)) AS calc_ts,
  CASE WHEN event_id % 3 = 0 THEN ts + to_hours(CAST(event_id % 50 AS INTEGER)) END AS available_at, event_id AS row_id FROM events)"""
OBS_SQL = "obs AS (SELECT event_id AS obs_id, 'user_id=' || user_id AS entity_key, ts AS observation_ts FROM events WHERE event_type = 'purchase')"


def observations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("obs_id"), keys.entity_key({"user_id": F.col("user_id")}).alias("entity_key"), F.col("ts").alias("observation_ts"))


def _known():
    return asof.known_at(F.col("available_at"), F.col("availability_source"), F.col("calc_ts"))


def _pit_sql(gap: str, known: str) -> str:
    picks = ", ".join(f"max(CASE WHEN feature_name = '{t}' THEN row_id END) FILTER (WHERE rn = 1) AS {t}_row, max(CASE WHEN feature_name = '{t}' THEN value END) FILTER (WHERE rn = 1) AS {t}_value" for t in TYPES)
    return f"""WITH {HISTORY_SQL}, {OBS_SQL},
j AS (SELECT o.obs_id, h.*, row_number() OVER (PARTITION BY o.obs_id, h.feature_name ORDER BY h.data_ts DESC, h.calc_ts DESC, h.row_id DESC) AS rn
  FROM obs o JOIN hist h ON o.entity_key = h.entity_key AND h.data_ts <= o.observation_ts - {gap} AND {known} <= o.observation_ts),
w AS (SELECT obs_id, {picks} FROM j GROUP BY obs_id)
SELECT o.obs_id, o.entity_key, o.observation_ts, {", ".join(f"w.{t}_row, w.{t}_value" for t in TYPES)} FROM obs o LEFT JOIN w USING (obs_id)"""


def _wide(df: DataFrame) -> DataFrame:
    cols = [c for t in TYPES for c in (F.col(t)["row_id"].alias(f"{t}_row"), F.col(t)["value"].alias(f"{t}_value"))]
    return df.select("obs_id", "entity_key", "observation_ts", *cols)


@query(_pit_sql("INTERVAL 0 SECOND", "coalesce(h.available_at, h.calc_ts)"))
def pit_training_wide(spark, d):
    """As-of values of every feature for each purchase: the flagship."""
    out = asof.as_of(observations(spark, d), event_history(spark, d), ["entity_key"], TYPES, known=_known(), bucket_seconds=BUCKET)
    return _wide(out)


@query(_pit_sql("INTERVAL 172800 SECOND", "coalesce(h.available_at, h.calc_ts)"))
def pit_safety_gap(spark, d):
    out = asof.as_of(observations(spark, d), event_history(spark, d), ["entity_key"], TYPES, known=_known(), gap_seconds=172800, bucket_seconds=BUCKET)
    return _wide(out)


@query(_pit_sql("INTERVAL 0 SECOND", "h.calc_ts"))
def pit_untrusted(spark, d):
    """Without trusted availability only the computation time counts."""
    return _wide(asof.as_of(observations(spark, d), event_history(spark, d), ["entity_key"], TYPES, bucket_seconds=BUCKET))


@query("""WITH h AS (SELECT o_custkey AS k, o_orderdate AS data_ts, l_shipdate AS known, l_orderkey * 10 + l_linenumber AS row_id, l_quantity AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
o AS (SELECT c_custkey AS k, TIMESTAMP '1999-06-01' AS t FROM customer),
r AS (SELECT o.k, h.row_id, h.v, row_number() OVER (PARTITION BY o.k ORDER BY h.data_ts DESC, h.known DESC, h.row_id DESC) AS rn FROM o JOIN h ON o.k = h.k AND h.data_ts <= o.t AND h.known <= o.t)
SELECT o.k AS custkey, r.row_id AS line_id, r.v AS quantity FROM o LEFT JOIN r ON o.k = r.k AND rn = 1""")
def pit_available_at(spark, d):
    """A customer's last order line that had shipped by a date: availability is the ship date; ties go to the last row.

    Lines of one order can share number and ship date.  Among these the SQL takes any; here the greatest quantity counts."""
    orders = table(spark, d, "orders").where("o_custkey IS NOT NULL")
    lines = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    hist = lines.select(F.col("o_custkey").alias("k"), F.lit("q").alias("feature_name"), F.col("l_quantity").alias("value"), F.col("o_orderdate").alias("data_ts"), F.col("l_shipdate").alias("calc_ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"))
    obs = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("1999-06-01").cast("timestamp_ntz").alias("observation_ts"))
    out = asof.as_of(obs, hist, ["k"], ["q"], bucket_seconds=180 * 86400)
    return out.select(F.col("k").alias("custkey"), F.col("q.row_id").alias("line_id"), F.col("q.value").alias("quantity"))


@query(f"""WITH {HISTORY_SQL}, {OBS_SQL},
c AS (SELECT o.obs_id, f.feature_name, bool_or(h.data_ts <= o.observation_ts - INTERVAL 86400 SECOND AND coalesce(h.available_at, h.calc_ts) <= o.observation_ts) AS ok, count(h.row_id) FILTER (WHERE h.data_ts > o.observation_ts) AS late
  FROM obs o CROSS JOIN (SELECT DISTINCT event_type AS feature_name FROM events) f LEFT JOIN hist h ON h.entity_key = o.entity_key AND h.feature_name = f.feature_name GROUP BY ALL)
SELECT (SELECT count(*) FROM obs) AS n_rows, CAST(5 AS BIGINT) AS n_features, CAST(count(*) FILTER (WHERE NOT coalesce(ok, false)) AS BIGINT) AS missing_cells, CAST(sum(late) AS BIGINT) AS future_rows_ignored, CAST(86400 AS BIGINT) AS safety_gap_seconds FROM c""")
def training_summary(spark, d):
    obs, hist = observations(spark, d), event_history(spark, d)
    wide = training.training_set(obs, hist, ["entity_key"], dict.fromkeys(TYPES, 1), known=_known(), gap_seconds=86400, bucket_seconds=BUCKET)
    out = training.training_summary(wide, obs, hist, ["entity_key"], TYPES, gap_seconds=86400)
    return out.select(*(F.col(c).cast("long") for c in out.columns))


def _export_sql() -> str:
    cells = ", ".join(f"""max(value) FILTER (WHERE feature_name = '{t}') AS "feature.{t}", CASE WHEN bool_or(feature_name = '{t}') THEN 'ok' ELSE 'missing' END AS "meta.{t}.status", max(data_ts) FILTER (WHERE feature_name = '{t}') AS "meta.{t}.data_ts\"""" for t in TYPES)
    return f"""WITH {HISTORY_SQL}, {OBS_SQL},
j AS (SELECT o.obs_id, h.feature_name, h.value, h.data_ts, row_number() OVER (PARTITION BY o.obs_id, h.feature_name ORDER BY h.data_ts DESC, h.calc_ts DESC, h.row_id DESC) AS rn
  FROM obs o LEFT JOIN hist h ON o.entity_key = h.entity_key AND h.data_ts <= o.observation_ts AND coalesce(h.available_at, h.calc_ts) <= o.observation_ts)
SELECT obs_id, {cells} FROM j WHERE rn = 1 GROUP BY obs_id"""


@query(_export_sql())
def training_export_flat(spark, d):
    """The flat export: every feature's value, status and time."""
    wide = training.training_set(observations(spark, d), event_history(spark, d), ["entity_key"], dict.fromkeys(TYPES, 1), known=_known(), bucket_seconds=BUCKET)
    flat = training.flat_rows(wide, ["entity_key"], list(TYPES), context=["obs_id"])
    cells = [F.col(f"`{c}`") for t in TYPES for c in (f"feature.{t}", f"meta.{t}.status", f"meta.{t}.data_ts")]
    return flat.select(F.col("`context.obs_id`").alias("obs_id"), *cells)


# The write guard: arrivals of a user, freshness by day, fingerprint by event type.
def arrivals(spark, d):
    e = table(spark, d, "events")
    n = F.col("event_id")
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    return e.select(F.col("user_id"), n.alias("seq"), day.alias("data_ts"), F.when(n % 4 == 0, day + hours(F.lit(24))).alias("max_input_data_ts"), F.when(n % 5 != 0, F.col("event_type")).alias("input_fingerprint"), F.when(n % 3 == 0, day + hours((n % 2).cast("int"))).alias("available_at"))


GUARD_SQL = """a AS (SELECT user_id, event_id AS seq, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, CASE WHEN event_id % 4 = 0 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 24 HOUR ELSE CAST(date_trunc('day', ts) AS TIMESTAMP) END AS m,
  CASE WHEN event_id % 5 <> 0 THEN event_type ELSE '' END AS fp, CASE WHEN event_id % 3 = 0 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) + to_hours(CAST(event_id % 2 AS INTEGER)) END AS av FROM events),
b AS (SELECT *, epoch_us(d) // 86400000000 * 10 + (epoch_us(m) - epoch_us(d)) // 86400000000 AS t FROM a),
c AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rm FROM b),
k AS (SELECT *, CASE WHEN rm IS NULL OR t > rm THEN 'new' WHEN t < rm THEN 'stale' ELSE 'eq' END AS c0 FROM c),
l AS (SELECT *, lag(fp) OVER (PARTITION BY user_id, t ORDER BY seq) AS pfp FROM k WHERE c0 <> 'stale'),
r AS (SELECT *, sum(CASE WHEN c0 = 'new' OR fp <> pfp THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, t ORDER BY seq) AS run FROM l),
s AS (SELECT *, first_value(av) OVER (PARTITION BY user_id, t, run ORDER BY seq) AS a0, last_value(av IGNORE NULLS) OVER (PARTITION BY user_id, t, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pa, row_number() OVER (PARTITION BY user_id, t, run ORDER BY seq) AS nth FROM r),
o AS (SELECT user_id, seq, d, CASE WHEN c0 = 'new' THEN 'written' WHEN nth = 1 THEN 'written_recompute' WHEN a0 IS NOT NULL AND av IS NOT NULL AND av <> pa THEN 'written_recompute' ELSE 'noop' END AS outcome FROM s
  UNION ALL SELECT user_id, seq, d, 'skipped_stale' FROM k WHERE c0 = 'stale')"""


@query(f"WITH {GUARD_SQL} SELECT user_id, seq, outcome FROM o")
def guard_fold(spark, d):
    return guard.fold(arrivals(spark, d), ["user_id"], bucket=F.floor(F.col("seq") / 1000)).select("user_id", "seq", "outcome")


@query(f"WITH {GUARD_SQL} SELECT user_id, max(seq) AS seq, arg_max(d, seq) AS data_ts FROM o WHERE outcome LIKE 'written%' GROUP BY user_id")
def guard_latest(spark, d):
    return guard.latest(guard.fold(arrivals(spark, d), ["user_id"]), ["user_id"]).select("user_id", "seq", "data_ts")


@query(f"WITH {GUARD_SQL} SELECT user_id, max(seq) AS seq, arg_max(d, seq) AS data_ts FROM o WHERE outcome LIKE 'written%' GROUP BY user_id")
def guard_in_batches(spark, d):
    """The same table, folded in three batches that go on from each other."""
    rows, held = arrivals(spark, d), None
    for k in range(3):
        part = rows.where(F.col("seq").between(*((0, 2999), (3000, 4999), (5000, 1 << 60))[k]))
        folded = guard.fold_batch(held, part, ["user_id"])
        held = guard.latest(folded, ["user_id"]).drop("outcome") if held is None else guard.refresh(held, folded, ["user_id"])
    return held.select("user_id", "seq", "data_ts")


@query(f"WITH {GUARD_SQL} SELECT user_id, d AS data_ts, CASE WHEN bool_or(outcome LIKE 'written%') THEN 'written' WHEN bool_or(outcome = 'skipped_stale') THEN 'skipped_stale' ELSE 'noop' END AS status FROM o GROUP BY user_id, d")
def guard_status(spark, d):
    """The status of all arrivals, a write batch being a user's day."""
    folded = guard.fold(arrivals(spark, d), ["user_id"])
    return folded.groupBy("user_id", "data_ts").agg(guard.overall(F.col("outcome")).alias("status"))


@query(f"WITH {GUARD_SQL} SELECT user_id, max(seq) AS seq, arg_max(d, seq) AS data_ts FROM o WHERE outcome LIKE 'written%' GROUP BY user_id")
def fold_streaming_equivalence(spark, d):
    """The same table once more, from a file stream of several micro-batches."""
    from .streaming.pipelines import Versioned, guarded_latest

    work = f"{shared_dir(spark)}/fold-{spark._jvm.java.util.UUID.randomUUID()}"
    rows = arrivals(spark, d)
    for k in range(3):
        rows.where(F.floor(F.col("seq") / 4000) == k if k < 2 else F.col("seq") >= 8000).coalesce(1).write.mode("append").parquet(f"{work}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in")
    guarded_latest(stream, f"{work}/table", f"{work}/checkpoint", ["user_id"]).awaitTermination()
    return Versioned(spark, f"{work}/table").read(1 << 30).select("user_id", "seq", "data_ts")


# Deduplication: the second half of the events, with values rounded so that some repeat, against the first half.
def coarse(spark, d):
    e = table(spark, d, "events")
    n = F.col("event_id")
    return e.select(n.alias("ord"), F.col("user_id").alias("entity_key"), F.col("event_type").alias("feature_name"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("data_ts"), F.floor(F.col("value") / 40).cast("long").alias("value"), F.when(n % 3 != 0, (n % 2).cast("string")).alias("fp"), F.when(n % 4 == 0, (n % 8).cast("long")).alias("av"))


COARSE_SQL = "e AS (SELECT event_id AS ord, user_id AS entity_key, event_type AS feature_name, CAST(date_trunc('day', ts) AS TIMESTAMP) AS data_ts, CAST(floor(value / 40) AS BIGINT) AS value, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 2 AS VARCHAR) END AS fp, CASE WHEN event_id % 4 = 0 THEN event_id % 8 END AS av FROM events)"
_ID, _SOFT = ("entity_key", "feature_name", "data_ts", "value"), ("fp", "av")
_DUP_SQL = "EXISTS (SELECT 1 FROM e h WHERE h.ord % 2 = 0 AND h.entity_key = r.entity_key AND h.feature_name = r.feature_name AND h.data_ts = r.data_ts AND h.value = r.value AND (h.fp IS NULL OR r.fp IS NULL OR h.fp = r.fp) AND (h.av IS NULL OR r.av IS NULL OR h.av = r.av))"


@query(f"WITH {COARSE_SQL} SELECT ord FROM e r WHERE ord % 2 = 1 AND NOT {_DUP_SQL}")
def dedup_against_history(spark, d):
    e = coarse(spark, d)
    return dedup.new_rows(e.where("ord % 2 = 1"), e.where("ord % 2 = 0"), _ID, _SOFT).select("ord")


@query(f"WITH {COARSE_SQL} SELECT min(ord) AS ord FROM e GROUP BY entity_key, feature_name, data_ts, value, fp, av")
def dedup_in_run(spark, d):
    return dedup.first_in_run(coarse(spark, d), ["ord"], (*_ID, *_SOFT)).select("ord")


@query(f"WITH {COARSE_SQL}, n AS (SELECT min(ord) AS ord FROM e r WHERE ord % 2 = 1 AND NOT {_DUP_SQL} GROUP BY entity_key, feature_name, data_ts, value, fp, av) SELECT (SELECT count(*) FROM e WHERE ord % 2 = 1) AS n_rows, (SELECT count(*) FROM n) AS n_new, (SELECT count(*) FROM e WHERE ord % 2 = 1) - (SELECT count(*) FROM n) AS n_duplicates")
def dedup_partition(spark, d):
    e = coarse(spark, d)
    return dedup.partition(e.where("ord % 2 = 1"), e.where("ord % 2 = 0"), ["ord"], _ID, _SOFT)[1]


@query("SELECT sha256(props) AS event_hash, min(event_id) AS event_id FROM events WHERE props NOT IN (SELECT props FROM events WHERE event_id < 100) GROUP BY 1")
def event_hash_dedup(spark, d):
    e = table(spark, d, "events")
    seen = e.where("event_id < 100").select(F.sha2(F.col("props"), 256).alias("event_hash")).distinct()
    return dedup.drop_seen_events(e, seen, "props", ["event_id"]).select("event_hash", "event_id")


# A small registry over customers: two sources, four features.
REGISTRY = {
    "registry_version": "queries-1",
    "entities": {"customer": {"key_fields": ["custkey"]}},
    "sources": {"last_order": {"type": "raw_report", "report_type": "order", "ts_field": "report_ts"}, "profile": {"type": "raw_report", "report_type": "profile", "ts_field": "report_ts"}},
    "feature_views": {"risk": {"entity": "customer", "key_fields": ["custkey"], "view_version": 1, "owner": "q", "status": "active", "features": {
        "order_size": {"kind": "udf", "feature_version": 1, "udf": "size", "inputs": ["last_order"], "dtype": "int", "status": "active"},
        "band": {"kind": "udf", "feature_version": 2, "udf": "band", "inputs": ["profile"], "dtype": "int", "status": "live"},
        "load": {"kind": "udf", "feature_version": 1, "udf": "load", "deps": ["band", {"feature": "order_size", "required": False, "max_input_age_seconds": 63072000, "propagation": "reactive"}], "dtype": "int", "status": "live"},
        "strict": {"kind": "udf", "feature_version": 1, "udf": "strict", "deps": [{"feature": "load"}, {"feature": "order_size", "max_input_age_seconds": 126144000}], "dtype": "int", "status": "live"},
    }}},
}
FUNCTIONS = {
    "size": lambda s, f: s["last_order"]["cents"] % 1000,
    "band": lambda s, f: s["profile"]["band"],
    "load": lambda s, f: f["band"] + F.coalesce(f["order_size"], F.lit(0)),
    "strict": lambda s, f: f["load"] * 2 + f["order_size"],
}


def entities(spark, d):
    o = table(spark, d, "orders")
    last = o.groupBy(F.col("o_custkey").alias("custkey")).agg(F.max_by(F.struct("o_orderkey", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    k = F.col("o.o_orderkey")
    order = F.struct(k.alias("cents"), F.col("o.o_orderdate").alias("report_ts"), F.sha2(k.cast("string"), 256).alias("content_hash"), F.when(k % 2 == 0, F.col("o.o_orderdate") + hours(F.lit(48))).alias("available_at"))
    start = F.lit("1998-01-01").cast("timestamp_ntz")
    band = F.floor(F.col("c_acctbal") / 100).cast("long")
    profile = F.struct(band.alias("band"), start.alias("report_ts"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("content_hash"), start.alias("available_at"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.when(F.col("c_custkey") % 11 != 0, profile).alias("profile"))
    return c.join(last.select("custkey", order.alias("last_order")), "custkey", "left")


def _computed(spark, d):
    view = registry.build(REGISTRY).views["risk"]
    return dag.compute(entities(spark, d), registry.plan(view, ["load", "strict"]), FUNCTIONS, F.lit("2001-01-01").cast("timestamp_ntz"))


DAG_SQL = """l AS (SELECT o_custkey AS custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k, max(o_orderdate) AS t FROM orders GROUP BY 1),
s AS (SELECT c_custkey AS custkey, CASE WHEN c_custkey % 11 <> 0 THEN CAST(floor(c_acctbal / 100) AS BIGINT) END AS band, TIMESTAMP '1998-01-01' AS pt, sha256(CAST(c_custkey AS VARCHAR)) AS ph, k % 1000 AS size, t AS ot, sha256(CAST(k AS VARCHAR)) AS oh, CASE WHEN k % 2 = 0 THEN t + INTERVAL 48 HOUR END AS oa FROM customer LEFT JOIN l ON c_custkey = custkey),
f AS (SELECT *, band IS NULL AS skip, size IS NULL AS gone, coalesce(TIMESTAMP '2001-01-01' - ot > INTERVAL 63072000 SECOND, false) AS old,
  'sha256:' || sha256(CAST(band AS VARCHAR)) AS bh, 'sha256:' || sha256(CAST(size AS VARCHAR)) AS sh,
  sha256('[["source:profile",' || epoch_us(pt) || ',"' || ph || '"]]') AS bf FROM s),
g AS (SELECT *, CASE WHEN skip THEN 'SKIPPED' WHEN gone OR old THEN 'DEGRADED' ELSE 'OK' END AS status, CASE WHEN NOT skip THEN band + coalesce(size, 0) END AS load,
  CASE WHEN NOT skip THEN least(pt, ot) END AS lo, CASE WHEN NOT skip THEN greatest(pt, ot) END AS hi,
  CASE WHEN NOT skip THEN CASE WHEN gone THEN sha256('[["band:v2",' || epoch_us(pt) || ',"' || bh || '"]]') ELSE sha256('[["band:v2",' || epoch_us(pt) || ',"' || bh || '"],["order_size:v1",' || epoch_us(ot) || ',"' || sh || '"]]') END END AS fp,
  CASE WHEN NOT skip AND (gone OR oa IS NOT NULL) THEN greatest(pt, oa) END AS av FROM f)"""


@query(f"WITH {DAG_SQL} SELECT custkey, load AS value, status, lo AS data_ts, hi AS max_input_data_ts FROM g")
def dag_freshness(spark, d):
    return _computed(spark, d).select("custkey", *(F.col("load")[x].alias(x) for x in ("value", "status", "data_ts", "max_input_data_ts")))


@query(f"""WITH {DAG_SQL} SELECT custkey, CASE WHEN dead THEN NULL ELSE load * 2 + size END AS value, CASE WHEN dead THEN 'SKIPPED' WHEN status = 'DEGRADED' THEN 'DEGRADED' ELSE 'OK' END AS status
FROM (SELECT *, skip OR gone OR TIMESTAMP '2001-01-01' - ot > INTERVAL 126144000 SECOND AS dead FROM g)""")
def dag_status(spark, d):
    return _computed(spark, d).select("custkey", F.col("strict.value").alias("value"), F.col("strict.status").alias("status"))


@query(f"WITH {DAG_SQL} SELECT custkey, fp AS input_fingerprint, CASE WHEN NOT skip THEN 'sha256:' || sha256(CAST(load AS VARCHAR)) END AS value_hash, av AS available_at, CASE WHEN av IS NOT NULL THEN 'source_provided' END AS availability_source FROM g")
def dag_provenance(spark, d):
    return _computed(spark, d).select("custkey", *(F.col("load")[x].alias(x) for x in ("input_fingerprint", "value_hash", "available_at", "availability_source")))


@query(f"WITH {DAG_SQL} SELECT custkey, 'load' AS feature_name, CAST(load AS VARCHAR) AS value_json FROM g WHERE NOT skip")
def dag_results_tall(spark, d):
    """Only requested features come back; what they needed stays internal."""
    view = registry.build(REGISTRY).views["risk"]
    plan = registry.plan(view, ["load"])
    out = dag.results(dag.compute(entities(spark, d), plan, FUNCTIONS, F.lit("2001-01-01").cast("timestamp_ntz")), plan, ["custkey"])
    return out.select("custkey", "feature_name", "value_json")


# Keys and digests.
@query("SELECT o_orderkey, 'custkey=' || o_custkey || '|orderkey=' || o_orderkey AS entity_key FROM orders")
def entity_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", keys.entity_key({"orderkey": F.col("o_orderkey"), "custkey": F.col("o_custkey")}, ["custkey", "orderkey"]).alias("entity_key"))


@query("SELECT c_custkey, CASE WHEN contains(c_name, '|') OR contains(c_name, '=') THEN 'reserved' ELSE NULL END AS error FROM customer")
def entity_key_errors(spark, d):
    return table(spark, d, "customer").select("c_custkey", keys.key_error({"name": F.col("c_name")}).alias("error"))


@query("SELECT o_orderkey, 'rep_' || substr(sha256('custkey=' || o_custkey || '|shop|order|' || 'sha256:' || sha256(CAST(o_orderkey AS VARCHAR))), 1, 32) AS report_ref FROM orders")
def report_ref(spark, d):
    h = digests.value_hash(digests.canonical_json(F.col("o_orderkey"), "int"))
    return table(spark, d, "orders").select("o_orderkey", digests.report_ref(keys.entity_key({"custkey": F.col("o_custkey")}), F.lit("shop"), F.lit("order"), h).alias("report_ref"))


@query("SELECT c_custkey, 'sha256:' || sha256('\"' || c_name || '\"') AS name_hash, 'sha256:' || sha256(CAST(c_nationkey AS VARCHAR)) AS nation_hash FROM customer")
def value_hashes(spark, d):
    return table(spark, d, "customer").select("c_custkey", digests.value_hash(digests.canonical_json(F.col("c_name"), "string")).alias("name_hash"), digests.value_hash(digests.canonical_json(F.col("c_nationkey"), "int")).alias("nation_hash"))


@query("SELECT o_custkey, 'sha256:' || sha256('[' || string_agg('\"' || h || '\"', ', ' ORDER BY h) || ']') AS content_hash FROM (SELECT o_custkey, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders) GROUP BY o_custkey")
def dataset_fingerprint(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(digests.group_fingerprint(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("content_hash"))


@query("SELECT o_orderkey, 's3://raw/order/' || strftime(o_orderdate, '%Y/%m/%d/') || 'r' || o_orderkey || '.json.gz' AS uri FROM orders")
def storage_paths(spark, d):
    return table(spark, d, "orders").select("o_orderkey", digests.storage_path(F.lit("order"), F.concat(F.lit("r"), "o_orderkey"), F.col("o_orderdate"), "raw").alias("uri"))


# Ingestion.
WIDE = {"balance": ("c_acctbal", "float"), "nation": ("c_nationkey", "int"), "segment": ("segment", "string"), "flag": ("flag", "bool"), "number": ("number", "int")}


def wide(spark, d):
    n = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey", F.when(n % 6 != 0, F.col("c_mktsegment")).otherwise("  ").alias("segment"), F.element_at(F.array(*map(F.lit, ("true", "NO", "1", "maybe", ""))), (n % 5 + 1).cast("int")).alias("flag"), F.when(n % 3 == 0, F.lit("1.0")).otherwise(n.cast("string")).alias("number"))


WIDE_SQL = """w AS (SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment ELSE '  ' END AS segment, ['true', 'NO', '1', 'maybe', ''][c_custkey % 5 + 1] AS flag, CASE WHEN c_custkey % 3 = 0 THEN '1.0' ELSE CAST(c_custkey AS VARCHAR) END AS number, CAST(c_nationkey AS VARCHAR) AS nation FROM customer),
u AS (SELECT c_custkey, 'segment' AS feature_name, segment AS raw, CASE WHEN trim(segment) <> '' THEN segment END AS value FROM w
 UNION ALL SELECT c_custkey, 'flag', flag, CASE WHEN lower(flag) IN ('true', '1', 'yes') THEN 'true' WHEN lower(flag) IN ('false', '0', 'no') THEN 'false' END FROM w
 UNION ALL SELECT c_custkey, 'number', number, CASE WHEN regexp_full_match(number, '[+-]?[0-9]+') THEN number END FROM w
 UNION ALL SELECT c_custkey, 'nation', nation, nation FROM w),
v AS (SELECT *, trim(raw) = '' AS missing, trim(raw) <> '' AND value IS NULL AS error FROM u)"""


@query(f"WITH {WIDE_SQL} SELECT c_custkey, feature_name, value, missing, error FROM v")
def unpivot_import(spark, d):
    features = {k: v for k, v in WIDE.items() if k != "balance"}
    return imports.tall_rows(wide(spark, d), features, ["c_custkey"]).select("c_custkey", "feature_name", "value", "missing", "error")


@query(f"WITH {WIDE_SQL} SELECT count(*) AS n_cells, count_if(missing) AS n_missing, count_if(error) AS n_bad, count_if(NOT missing AND NOT error) AS n_values FROM (SELECT missing, error FROM v UNION ALL SELECT false, false FROM customer)")
def import_summary(spark, d):
    return imports.import_summary(imports.tall_rows(wide(spark, d), WIDE, ["c_custkey"]))


@query("SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS as_int, CASE WHEN event_id % 2 = 0 THEN ts END AS zoned FROM events")
def dtype_convert(spark, d):
    e = table(spark, d, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_id") % 2 == 0, F.lit("Z")).otherwise(""))
    return e.select("event_id", casts.convert(F.get_json_object("props", "$.k"), "int").cast("long").alias("as_int"), F.to_utc_timestamp(casts.parse_zoned(text), F.current_timezone()).cast("timestamp_ntz").alias("zoned"))


def report_lines(spark, d):
    e = table(spark, d, "events")
    n = F.col("event_id")
    body = F.concat(F.lit('{"entity_key": {"user_id": "'), F.when(n % 13 == 0, F.lit("a|b")).otherwise(F.col("user_id").cast("string")), F.lit('"}, "event_ts": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(n % 7 == 0, F.lit("")).otherwise("Z"), F.lit('", "payload": '), F.col("props"), F.lit("}"))
    return e.select(n.alias("line"), "ts", "user_id", "props", F.when(n % 10 == 9, F.lit(" ")).when(n % 11 == 0, F.lit("{oops")).otherwise(body).alias("value"))


REPORT_SQL = """p AS (SELECT event_id, ts, user_id, props, row_number() OVER (ORDER BY event_id) - 1 AS item_index, CASE WHEN event_id % 11 = 0 THEN 'malformed JSON' WHEN event_id % 13 = 0 THEN 'reserved character in key value: user_id' WHEN event_id % 7 = 0 THEN 'event_ts must be a time with a zone' END AS error,
 'sha256:' || sha256(replace(props, ' ', '')) AS h FROM events WHERE event_id % 10 <> 9),
q AS (SELECT *, CASE WHEN error IS NULL THEN row_number() OVER (PARTITION BY error IS NULL, user_id, h ORDER BY event_id) END AS nth FROM p),
i AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'rejected' WHEN nth > 1 THEN 'duplicate' ELSE 'written' END AS status FROM q)"""


def items(spark, d):
    numbered = imports.number_lines(report_lines(spark, d), order=("line",))
    return imports.land(imports.parse_reports(numbered, ["user_id"], "feed", "activity"))


@query(f"WITH {REPORT_SQL} SELECT event_id AS line, item_index, status, error FROM i")
def jsonl_reject_split(spark, d):
    return items(spark, d).select("line", "item_index", "status", "error")


@query(f"WITH {REPORT_SQL} SELECT count(*) AS item_count_read, count_if(status = 'written') AS item_count_written, count_if(status = 'duplicate') AS item_count_duplicate, count_if(status = 'rejected') AS item_count_rejected, 'sha256:' || sha256('[' || string_agg('\"' || h || '\"', ', ' ORDER BY h) FILTER (WHERE status <> 'rejected') || ']') AS content_hash, min(ts) FILTER (WHERE status <> 'rejected') AS watermark_min_event_ts, max(ts) FILTER (WHERE status <> 'rejected') AS watermark_max_event_ts FROM i")
def manifest_counts(spark, d):
    plain = lambda c: F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz")
    marks = ("watermark_min_event_ts", "watermark_max_event_ts")
    return imports.manifest(items(spark, d)).withColumns({c: plain(c) for c in marks})


@query(f"WITH {REPORT_SQL} SELECT event_id AS line FROM i WHERE status = 'written'")
def manifest_eligible(spark, d):
    return imports.eligible_items(items(spark, d)).select("line")


# Checks.
def versions(spark, d):
    """Order lines as history of their part and as a latest-value table that lags, differs or lacks parts."""
    l = table(spark, d, "lineitem")
    hist = l.select(F.col("l_partkey").alias("k"), F.col("l_shipdate").alias("data_ts"), F.col("l_quantity").cast("long").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"))
    k = F.col("k")
    online = checks.latest_by_data(hist, ["k"]).where(k % 5 != 0).select("k", F.when(k % 7 == 0, F.col("data_ts") - hours(F.lit(24))).when(k % 7 == 1, F.col("data_ts") + hours(F.lit(24))).otherwise(F.col("data_ts")).alias("data_ts"), F.when(k % 7 == 2, F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    return hist.where(k % 9 != 0), online


CONSISTENCY_SQL = """a AS (SELECT l_partkey AS k, max(l_shipdate) AS t, arg_max(CAST(l_quantity AS BIGINT), (l_shipdate, l_orderkey * 10 + l_linenumber)) AS v FROM lineitem GROUP BY 1),
o AS (SELECT k, CASE WHEN k % 7 = 0 THEN t - INTERVAL 24 HOUR WHEN k % 7 = 1 THEN t + INTERVAL 24 HOUR ELSE t END AS t, CASE WHEN k % 7 = 2 THEN v + 1 ELSE v END AS v FROM a WHERE k % 5 <> 0), h AS (SELECT * FROM a WHERE k % 9 <> 0),
s AS (SELECT coalesce(h.k, o.k) AS k, CASE WHEN o.k IS NULL THEN 'missing_online' WHEN h.k IS NULL THEN 'missing_offline' WHEN o.t < h.t THEN 'stale_online' WHEN o.t > h.t THEN 'online_newer_than_offline' WHEN o.v <> h.v THEN 'value_mismatch' ELSE 'ok' END AS status FROM h FULL JOIN o ON h.k = o.k)"""


@query(f"WITH {CONSISTENCY_SQL} SELECT k, status FROM s")
def consistency_check(spark, d):
    return checks.consistency(*versions(spark, d), ["k"]).select("k", "status")


@query(f"WITH {CONSISTENCY_SQL} SELECT CASE WHEN bool_and(status = 'ok') THEN 'ok' ELSE 'inconsistent' END AS status, count(*) AS n_items FROM s")
def consistency_overall(spark, d):
    return checks.overall(checks.consistency(*versions(spark, d), ["k"]))


def shadowed(spark, d):
    l = table(spark, d, "lineitem")
    return l.select(F.col("l_partkey").cast("string").alias("entity_key"), F.when(F.col("l_returnflag") == "A", "live").otherwise("shadow").alias("feature_name"), F.lit(1).alias("feature_version"), F.col("l_shipdate").alias("calc_ts"), F.col("l_linenumber").cast("string").alias("value_hash"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"))


@query("""WITH p AS (SELECT CAST(l_partkey AS VARCHAR) AS k, l_returnflag = 'A' AS f, arg_max(CAST(l_linenumber AS VARCHAR), (l_shipdate, -(l_orderkey * 10 + l_linenumber))) AS h FROM lineitem GROUP BY 1, 2),
j AS (SELECT coalesce(a.k, b.k) AS k, a.h AS lh, b.h AS sh FROM (FROM p WHERE f) a FULL JOIN (FROM p WHERE NOT f) b ON a.k = b.k)
SELECT count_if(lh = sh) AS same_hash, count_if(lh <> sh) AS different_hash, count_if(lh IS NULL) AS missing_live, count_if(sh IS NULL) AS missing_shadow, count_if(lh IS NOT NULL AND sh IS NOT NULL) AS total_compared, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k FROM j WHERE lh <> sh ORDER BY k LIMIT 10)) AS sample FROM j""")
def shadow_diff(spark, d):
    out = checks.shadow_diff(shadowed(spark, d), ("live", 1), ("shadow", 1))
    return out.select("same_hash", "different_hash", "missing_live", "missing_shadow", "total_compared", F.array_join("sample_different_hash", ",").alias("sample"))


@query("""WITH r AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), h AS (SELECT DISTINCT l_orderkey FROM lineitem)
SELECT o_orderkey, h.l_orderkey IS NOT NULL AS found, CASE WHEN h.l_orderkey IS NULL THEN 'feature_value_not_found' ELSE
 CASE WHEN o_orderkey % 4 = 0 THEN 'unknown_report_ref:x' || o_orderkey || ',' ELSE '' END || CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0 THEN 'source_report_refs_not_available,' ELSE '' END || 'bundle_digest_not_available' END AS gaps
FROM orders LEFT JOIN h ON o_orderkey = h.l_orderkey""")
def lineage_gaps(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    hist = l.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("calc_ts"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("row_id"))
    n = F.col("o_orderkey")
    ref = F.when(n % 4 == 0, F.concat(F.lit("x"), n)).otherwise(F.concat(F.lit("r"), n))
    wanted = o.select("o_orderkey", F.array(ref).alias("refs"), n.cast("string").alias("entity_key"))
    metas = o.select(F.concat(F.lit("r"), n).alias("report_ref"))
    held = o.where("o_orderkey % 3 = 0").select(n.cast("string").alias("entity_key"), F.concat(F.lit("r"), n).alias("report_ref"))
    out = checks.lineage(wanted, hist, ["o_orderkey"], metas, "refs", held)
    return out.select("o_orderkey", "found", F.array_join("gaps", ",").alias("gaps"))


# Raw report metadata.
def metas(spark, d):
    o = table(spark, d, "orders")
    n = F.col("o_orderkey")
    at = F.col("o_orderdate")
    base = o.select(F.concat(F.lit("r"), n).alias("report_ref"), F.lit("order").alias("report_type"), F.lit("c").alias("entity_type"), F.col("o_custkey").cast("string").alias("entity_key"), at.alias("report_ts"), F.lit(10).alias("payload_size_bytes"), F.col("o_orderstatus").alias("content_hash"), F.lit("u").alias("storage_uri"), F.lit("json").alias("format"), F.lit("gzip").alias("compression"), (at + hours(F.lit(24))).alias("available_at"), F.lit("source_provided").alias("availability_source"), n.alias("n"))
    shift = F.element_at(F.array(*map(F.lit, (24, 48, -5, 24, 72))), (F.col("n") % 5 + 1).cast("int"))
    new = base.withColumn("available_at", F.col("report_ts") + hours(shift)).withColumn("availability_source", F.when(F.col("n") % 5 == 4, "ingestion_time").otherwise("source_provided")).withColumn("content_hash", F.when(F.col("n") % 5 == 3, F.lit("changed")).otherwise(F.col("content_hash")))
    return new, base.where("n % 8 <> 0").drop("n")


META_SQL = "m AS (SELECT 'r' || o_orderkey AS report_ref, CASE WHEN o_orderkey % 5 = 2 THEN 'invalid' WHEN o_orderkey % 8 = 0 THEN 'insert' WHEN o_orderkey % 5 = 3 THEN 'conflict' WHEN o_orderkey % 5 = 1 THEN 'correction' ELSE 'noop' END AS outcome, o_orderdate AS t FROM orders)"


@query(f"WITH {META_SQL} SELECT report_ref, outcome FROM m")
def raw_meta_upsert(spark, d):
    return reports.classify(*metas(spark, d)).select("report_ref", "outcome")


@query(f"WITH {META_SQL} SELECT report_ref, t + INTERVAL 24 HOUR AS old_available_at, t + INTERVAL 48 HOUR AS new_available_at, 'jsonl' AS change_origin FROM m WHERE outcome = 'correction'")
def availability_correction(spark, d):
    return reports.project(*metas(spark, d), "jsonl", "m1")[1].drop("manifest_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'no report for source s' WHEN o_orderkey % 7 = 0 THEN 'unknown report r' || o_orderkey WHEN o_orderkey % 4 = 0 THEN 'unexpected report type other' WHEN o_orderkey % 5 = 0 THEN 'missing payload u' || o_orderkey END AS error FROM orders""")
def report_resolution(spark, d):
    n = F.col("o_orderkey")
    o = table(spark, d, "orders")
    items = o.select("o_orderkey", F.lit("s").alias("source_name"), F.when(n % 9 != 0, F.concat(F.lit("r"), n)).alias("report_ref"))
    m = o.where("o_orderkey % 7 <> 0").select(F.concat(F.lit("r"), n).alias("report_ref"), F.when(n % 4 == 0, "other").otherwise("order").alias("report_type"), F.concat(F.lit("u"), n).alias("storage_uri"), F.col("o_orderdate").alias("report_ts"), F.lit("h").alias("content_hash"), F.lit(None).cast("timestamp_ntz").alias("available_at"), F.lit(None).cast("string").alias("availability_source"))
    p = o.where("o_orderkey % 5 <> 0").select(F.concat(F.lit("u"), n).alias("storage_uri"), F.lit("{}").alias("payload_json"))
    return reports.resolve(items, m, p, {"s": "order"}).select("o_orderkey", "error")


# Propagation.
def feed(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("entity_key"), F.lit("v").alias("view"), F.lit(1).alias("view_version"), F.col("event_type").alias("feature_name"), F.when(F.col("event_id") % 6 == 0, 2).otherwise(1).alias("feature_version"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("data_ts"), F.col("ts").alias("seen_at"))


def edges(spark):
    return spark.createDataFrame([("click", 1, "rate", 3), ("view", 1, "rate", 3), ("view", 1, "depth", 1), ("view", 2, "depth", 2)], "feature_name string, feature_version int, dependent string, dependent_version int")


FEED_SQL = """c AS (SELECT event_id, CAST(user_id AS VARCHAR) AS entity_key, ts, date_trunc('day', ts) AS day, event_type AS f, dependent, dv FROM events JOIN (VALUES ('click', 1, 'rate', 3), ('view', 1, 'rate', 3), ('view', 1, 'depth', 1), ('view', 2, 'depth', 2)) e(f0, v0, dependent, dv) ON event_type = f0 AND (CASE WHEN event_id % 6 = 0 THEN 2 ELSE 1 END) = v0)"""


@query(f"WITH {FEED_SQL} SELECT event_id, dependent, CAST(dv AS INTEGER) AS dependent_version FROM c")
def reverse_dag_candidates(spark, d):
    return propagate.candidates(feed(spark, d), edges(spark)).select("event_id", "dependent", "dependent_version")


@query(f"WITH {FEED_SQL} SELECT entity_key, dependent, CAST(dv AS INTEGER) AS dependent_version, min(ts) AS first_seen, count(*) AS n_updates, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS triggers, arg_max(event_id, (day, event_id)) AS last_trigger FROM c GROUP BY 1, 2, 3")
def debounce(spark, d):
    out = propagate.coalesce_updates(propagate.candidates(feed(spark, d), edges(spark)))
    return out.select("entity_key", "dependent", "dependent_version", "first_seen", "n_updates", F.array_join("triggers", ",").alias("triggers"), F.col("latest.trigger").alias("last_trigger"))


WAVE = {
    "registry_version": "wave-1", "entities": {"user": {"key_fields": ["user_id"]}}, "sources": {"s": {"type": "raw_report", "report_type": "r", "ts_field": "t"}},
    "feature_views": {"activity": {"entity": "user", "key_fields": ["user_id"], "view_version": 1, "owner": "q", "status": "live", "features": {
        "click": {"kind": "udf", "feature_version": 1, "udf": "raw", "inputs": ["s"], "dtype": "float", "status": "live"},
        "view": {"kind": "udf", "feature_version": 1, "udf": "raw", "inputs": ["s"], "dtype": "float", "status": "live"},
        "total": {"kind": "udf", "feature_version": 1, "udf": "total", "deps": [{"feature": "click", "propagation": "reactive"}, {"feature": "view", "propagation": "reactive"}], "dtype": "float", "status": "live"},
    }}},
}


@query("""WITH l AS (SELECT user_id, event_type, max(ts) AS t, arg_max(value, (ts, event_id)) AS v FROM events WHERE event_type IN ('click', 'view') AND ts + to_hours(CAST(event_id % 7 AS INTEGER)) <= TIMESTAMP '2024-01-20' GROUP BY 1, 2)
SELECT 'user_id=' || user_id AS entity_key, 'total' AS feature_name, sum(v) AS value, min(t) AS data_ts, max(t) AS max_input_data_ts FROM l GROUP BY user_id HAVING count(*) = 2""")
def wave_recompute(spark, d):
    """One wave: every user's total, recomputed from history as of a time."""
    view = registry.build(WAVE).views["activity"]
    hist = event_history(spark, d).withColumn("max_input_data_ts", F.lit(None).cast("timestamp_ntz")).withColumn("value_hash", F.lit(None).cast("string")).withColumn("input_fingerprint", F.lit(None).cast("string")).withColumn("value_json", F.col("value").cast("string"))
    hist = hist.withColumn("available_at", F.lit(None).cast("timestamp_ntz"))
    units = hist.select("entity_key", F.lit("total").alias("dependent"), F.lit(1).alias("dependent_version")).distinct()
    out = propagate.wave(units, hist, view, {"total": lambda s, f: f["click"] + f["view"]}, F.lit("2024-01-20").cast("timestamp_ntz"))
    return out.select("entity_key", "feature_name", F.col("value_json").cast("double").alias("value"), "data_ts", "max_input_data_ts")


# Models and their evaluation.
@query("""WITH o AS (SELECT event_id AS obs_id, user_id, ts FROM events WHERE event_type = 'purchase'),
j AS (SELECT obs_id, e.event_type AS f, arg_max(e.value, (e.ts, e.event_id)) AS v, max(e.ts) AS t FROM o JOIN events e ON e.user_id = o.user_id AND e.event_type IN ('click', 'view') AND e.ts <= o.ts AND e.ts + to_hours(CAST(e.event_id % 7 AS INTEGER)) <= o.ts GROUP BY 1, 2)
SELECT obs_id, max(v) FILTER (WHERE f = 'click') * 2 + coalesce(max(v) FILTER (WHERE f = 'view'), 0) AS value, min(t) AS data_ts, max(t) AS max_input_data_ts FROM j GROUP BY obs_id HAVING bool_or(f = 'click')""")
def model_feature_batch(spark, d):
    """A model over as-of inputs, one required and one optional, called once per Arrow batch."""
    obs, hist = observations(spark, d), event_history(spark, d)
    ready = models.model_inputs(obs, hist, ["entity_key"], {"click": (1, True), "view": (1, False)}, bucket_seconds=BUCKET)
    flat = ready.select("obs_id", F.least("click.data_ts", "view.data_ts").alias("data_ts"), F.greatest("click.data_ts", "view.data_ts").alias("max_input_data_ts"), F.col("click.value").alias("click"), F.col("view.value").alias("view"))
    return models.predict(flat, ["click", "view"], lambda x: x["click"] * 2 + x["view"].fillna(0), "value").select("obs_id", "value", "data_ts", "max_input_data_ts")


def scored(spark, d):
    l, doc = table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "n_chars")
    return l.join(doc, "doc_id").select(F.col("quality").alias("label"), (F.floor(F.col("n_chars") / 100) % 97 / 97.0).alias("score"))


SCORED_SQL = "s AS (SELECT quality AS label, CAST(CAST(floor(n_chars / 100) AS BIGINT) % 97 AS DOUBLE) / 97.0 AS score FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {SCORED_SQL}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s) SELECT round((sum(rk) FILTER (WHERE label = 1) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0) / (count_if(label = 1) * count_if(label = 0)), 9) AS auc FROM r")
def score_eval_auc(spark, d):
    return evaluate.roc_auc(scored(spark, d)).select(F.round("auc", 9).alias("auc"))


@query(f"WITH {SCORED_SQL} SELECT round(avg(-(label * ln(greatest(1e-9, least(1 - 1e-9, score))) + (1 - label) * ln(1 - greatest(1e-9, least(1 - 1e-9, score))))), 6) AS log_loss, round(avg((score - label) * (score - label)), 6) AS brier FROM s")
def brier_logloss(spark, d):
    return evaluate.log_loss_brier(scored(spark, d))


@query("SELECT round(avg(c_acctbal), 6) AS c_acctbal_mean, round(stddev_pop(c_acctbal), 6) AS c_acctbal_std, CAST(round(avg(c_custkey * 0.0), 6) AS DOUBLE) AS zero_mean, CAST(1.0 AS DOUBLE) AS zero_std FROM customer")
def standardizer(spark, d):
    out = evaluate.standardizer(table(spark, d, "customer").withColumn("zero", F.lit(0.0)), ["c_acctbal", "zero"])
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


# Scalar features per customer: the last twelve orders as monthly income.
def incomes(spark, d):
    o = table(spark, d, "orders")
    periods = F.collect_list(F.struct(F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 1000).cast("double").alias("taxable_income")))
    return o.groupBy("o_custkey").agg(F.transform(F.array_sort(periods), lambda p: F.struct(F.concat(p["period"], p["k"].cast("string")).alias("period"), p["taxable_income"].alias("taxable_income"))).alias("periods"))


@query("""WITH p AS (SELECT o_custkey, list(CAST(o_orderkey % 1000 AS DOUBLE) ORDER BY strftime(o_orderdate, '%Y-%m') || CAST(o_orderkey AS VARCHAR)) AS xs FROM orders GROUP BY 1),
t AS (SELECT o_custkey, xs[-12:] AS x12, xs[-6:] AS x6, xs[-3:] AS x3 FROM p)
SELECT o_custkey, round(list_sum(x3) / 3, 6) AS avg3, round(list_sum(x6) / 6, 6) AS avg6, round(list_sum(x12) / 12, 6) AS avg12, CAST(len(list_filter(x12, lambda x: x > 0)) AS BIGINT) AS months, round(coalesce(sqrt(greatest(list_avg(list_transform(x12, lambda x: x * x)) - list_avg(x12) * list_avg(x12), 0)), 0), 3) AS std,
 CASE WHEN list_sum(x6) / 6 <= 0 THEN 0.0 ELSE round((coalesce(list_sum(x6[4:6]), 0) / 3 - list_sum(x6[:3]) / 3) / (list_sum(x6) / 6), 6) END AS trend FROM t""")
def trailing_stats(spark, d):
    x12, x6, x3 = (F.col(f"x{n}") for n in (12, 6, 3))
    rows = incomes(spark, d).withColumn("x12", scoring.trailing(F.col("periods"), 12))
    rows = rows.withColumns({f"x{n}": scoring.last(x12, n) for n in (6, 3)})
    return rows.select("o_custkey", F.round(scoring.fixed_mean(x3, 3), 6).alias("avg3"), F.round(scoring.fixed_mean(x6, 6), 6).alias("avg6"), F.round(scoring.fixed_mean(x12, 12), 6).alias("avg12"), scoring.count_positive(x12).cast("long").alias("months"), F.round(scoring.spread(x12), 3).alias("std"), F.round(scoring.trend(x6), 6).alias("trend"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN NULL ELSE round(c_acctbal / c_nationkey, 6) END AS ratio, CASE WHEN c_acctbal <= 0 THEN 10.0 ELSE round(least(c_nationkey * 1000 / c_acctbal, 10.0), 6) END AS capped FROM customer")
def safe_ratios(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(scoring.safe_ratio(F.col("c_acctbal"), F.col("c_nationkey")), 6).alias("ratio"), F.round(scoring.capped_ratio(F.col("c_nationkey") * 1000, F.col("c_acctbal")), 6).alias("capped"))


@query("SELECT doc_id, CASE WHEN n_chars % 100 < 10 THEN 'approve' WHEN n_chars % 100 < 30 THEN 'review' ELSE 'decline' END AS decision FROM documents")
def decision_band(spark, d):
    return table(spark, d, "documents").select("doc_id", scoring.decision((F.col("n_chars") % 100) / 100.0 + 0.001).alias("decision"))


@query("SELECT c_custkey, round(1 / (1 + exp(-((c_acctbal - 4500) / 3000 * 0.8 + c_nationkey * 0.01 - 0.2))), 6) AS pd FROM customer")
def logistic_scores(spark, d):
    model = models.linear_score({"balance": 0.8, "nation": 0.01}, -0.2)
    cols = {"balance": scoring.standardise(F.col("c_acctbal"), 4500, 3000), "nation": F.col("c_nationkey")}
    return table(spark, d, "customer").select("c_custkey", model(cols).alias("pd"))


# Operations.
@query("SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS INTEGER) AS chunk_index, o_custkey || ':' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS chunk_id FROM orders")
def chunking(spark, d):
    o = table(spark, d, "orders").withColumn("job_id", F.col("o_custkey"))
    out = chunks.chunked(o, 4, ["o_orderkey"], slice_by=F.floor(F.col("o_orderkey") / 1_000_000))
    return out.select("o_orderkey", "chunk_index", "chunk_id")


def job_items(spark, d):
    o = table(spark, d, "orders").withColumn("job_id", F.col("o_custkey"))
    return chunks.chunked(o, 4, ["o_orderkey"]).withColumn("error", F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("bad order "), "o_orderkey")))


CHUNK_SQL = """i AS (SELECT o_custkey AS job_id, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders),
c AS (SELECT job_id, n // 4 AS ci, count(*) AS items, count_if(o_orderstatus <> 'F') AS ok, count_if(o_orderstatus = 'F') AS bad, coalesce(string_agg('bad order ' || o_orderkey, ';' ORDER BY n) FILTER (WHERE o_orderstatus = 'F'), '') AS errors FROM i GROUP BY 1, 2),
d AS (SELECT *, CASE WHEN ok = 0 THEN 'failed' WHEN bad > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM c)"""


@query(f"WITH {CHUNK_SQL} SELECT job_id || ':' || ci AS chunk_id, items AS item_count, ok AS ok_items, bad AS failed_items, errors, status FROM d")
def chunk_first_errors(spark, d):
    return chunks.chunk_outcomes(job_items(spark, d)).select("chunk_id", "item_count", "ok_items", "failed_items", F.array_join("first_errors", ";").alias("errors"), "status")


_JOB_SQL = "SELECT job_id, count(*) AS n_chunks, CAST(sum(bad) AS BIGINT) AS failed_items, CASE WHEN count(*) < 2 AND job_id % 3 = 0 THEN 'running' WHEN bool_and(status = 'failed') THEN 'failed' WHEN bool_or(status <> 'completed') THEN 'completed_with_errors' ELSE 'completed' END AS status FROM d GROUP BY job_id"


def _jobs(spark, d, durable):
    done = chunks.chunk_outcomes(job_items(spark, d))
    jobs = done.groupBy("job_id").agg(F.count("*").alias("n")).select("job_id", F.when(F.col("job_id") % 3 == 0, F.greatest("n", F.lit(2))).otherwise(F.col("n")).alias("chunk_count"))
    return merges.job_status(done, jobs, durable).drop("chunk_count")


@query(f"WITH {CHUNK_SQL} {_JOB_SQL}")
def job_status(spark, d):
    return _jobs(spark, d, False)


@query(f"WITH {CHUNK_SQL} {_JOB_SQL}")
def job_status_durable(spark, d):
    return _jobs(spark, d, True)


def request_updates(spark, d):
    e = table(spark, d, "events")
    return e.select(F.floor(F.col("event_id") / 3).alias("request_id"), F.col("event_id").alias("seq"), F.try_element_at(F.create_map(*[F.lit(x) for kv in (("view", "accepted"), ("click", "running"), ("purchase", "completed"), ("error", "failed")) for x in kv]), F.col("event_type")).alias("status"), F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("job_id"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 5 == 0, F.array(F.col("event_type"))).otherwise(F.expr("cast(array() as array<string>)")).alias("features"))


@query("""WITH u AS (SELECT event_id // 3 AS r, event_id AS seq, CASE event_type WHEN 'view' THEN 'accepted' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS s, CASE WHEN event_id % 4 <> 0 THEN user_id END AS j, ts, CASE WHEN event_id % 5 = 0 THEN event_type END AS f FROM events)
SELECT r AS request_id, coalesce(arg_max(s, seq) FILTER (WHERE s IN ('completed', 'failed')), arg_max(s, seq) FILTER (WHERE s IS NOT NULL)) AS status, arg_max(j, seq) FILTER (WHERE j IS NOT NULL) AS job_id, arg_min(ts, seq) AS created_at, arg_max(f, seq) FILTER (WHERE f IS NOT NULL) AS features FROM u GROUP BY r""")
def request_merge(spark, d):
    out = merges.merge_requests(request_updates(spark, d), scalars=["job_id"], lists=["features"])
    return out.select("request_id", "status", "job_id", "created_at", F.array_join("features", ",").alias("features"))


@query("SELECT event_id, status, request_id, payload_base64 FROM (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'not_json' WHEN event_id % 6 = 1 THEN 'missing_event_type' WHEN event_type = 'error' THEN 'unknown_event_type' END AS status, CASE WHEN event_id % 6 <> 0 AND event_id % 6 <> 1 THEN CAST(user_id AS VARCHAR) END AS request_id, CASE WHEN event_id % 6 = 0 THEN base64(CAST('{' || user_id AS BLOB)) END AS payload_base64 FROM events) WHERE status IS NOT NULL")
def dlq_split(spark, d):
    n = F.col("event_id")
    e = table(spark, d, "events")
    value = F.when(n % 6 == 0, F.concat(F.lit("{"), F.col("user_id"))).when(n % 6 == 1, F.col("props")).otherwise(F.concat(F.lit('{"event_type": "'), "event_type", F.lit('", "score_write_id": "'), F.col("user_id"), F.lit('"}')))
    _, dead = chunks.split_poison(e.select("event_id", value.alias("value")), known_types=[t for t in TYPES if t != "error"])
    return dead.select("event_id", F.col("failure_status").alias("status"), "request_id", F.when(n % 6 == 0, F.col("payload_base64")).alias("payload_base64"))


# Reads.
@query(f"WITH {GUARD_SQL}, h AS (SELECT user_id, max(seq) AS seq FROM o WHERE outcome LIKE 'written%' GROUP BY user_id) SELECT user_id, CAST(seq AS DOUBLE) AS activity, CASE WHEN user_id % 2 = 0 THEN 'bonus' END AS missing FROM h")
def latest_online_lookup(spark, d):
    held = guard.latest(guard.fold(arrivals(spark, d), ["user_id"]), ["user_id"])
    online = held.select("user_id", F.lit("activity").alias("feature_name"), F.col("seq").cast("double").alias("value")).union(held.where("user_id % 2 = 1").select("user_id", F.lit("bonus"), F.lit(1.0)))
    out = store.lookup(online, held.select("user_id"), ["user_id"], ["activity", "bonus"])
    return out.select("user_id", F.col("values")["activity"].alias("activity"), F.when(F.size("missing") > 0, F.array_join("missing", ",")).alias("missing"))


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_id, event_id, value FROM events")
def history_append_read(spark, d):
    """Two appends to a history log; row numbers go on where the first ended."""
    log = store.Log(spark, f"{shared_dir(spark)}/log-{spark._jvm.java.util.UUID.randomUUID()}")
    e = table(spark, d, "events").select("event_id", "value")
    log.append(e.where("event_id < 4000"), ["event_id"])
    log.append(e.where("event_id >= 4000"), ["event_id"])
    return log.read(["row_id", "event_id", "value"])


@query("SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    out = evaluate.percentiles(table(spark, d, "events"), "value", ["event_type"])
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


@query("SELECT event_type, count(value) AS count, round(sum(value), 2) AS sum, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def metric_histogram(spark, d):
    out = evaluate.histogram_summary(table(spark, d, "events"), "value", ["event_type"])
    return out.withColumn("sum", F.round("sum", 2))


@query("SELECT source, count(*) AS n, round(avg(quality), 9) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY source")
def label_rates(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return evaluate.class_rates(rows, "quality", ["source"]).withColumn("rate", F.round("rate", 9))


# Flows.
@query("""WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 17 = 0 THEN 2 ELSE 1 END AS v, CAST(floor(value / 30) AS BIGINT) AS val, CAST(date_trunc('day', ts) AS TIMESTAMP) AS t FROM events),
m AS (SELECT *, CASE WHEN event_type NOT IN ('click', 'view') THEN 'unknown feature ' || event_type WHEN v <> 1 THEN 'unexpected version of ' || event_type END AS error FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY error IS NULL, user_id, event_type, t, val ORDER BY event_id) AS nth FROM m)
SELECT event_id, CASE WHEN error IS NOT NULL THEN 'rejected' WHEN nth = 1 THEN 'written' ELSE 'duplicate' END AS status, error FROM n""")
def feature_row_import(spark, d):
    """Tall feature rows from a warehouse: exact names and versions, replays are duplicates."""
    from .plans import flows

    view = registry.build(WAVE).views["activity"]
    e = table(spark, d, "events")
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    rows = e.select("event_id", keys.entity_key({"user_id": F.col("user_id")}).alias("entity_key"), F.col("event_type").alias("feature_name"), F.when(F.col("event_id") % 17 == 0, 2).otherwise(1).alias("feature_version"), F.floor(F.col("value") / 30).cast("string").alias("value_json"), day.alias("data_ts"), F.col("ts").alias("calc_ts"))
    return flows.import_feature_rows(rows, view, None, ["event_id"])[0].select("event_id", "status", "error")


@query("""SELECT event_id AS request_id, s AS source_name, CASE WHEN (event_id + k) % 5 = 0 THEN 'missing payload p' || (event_id + k) END AS error FROM events CROSS JOIN (VALUES ('a', 0), ('b', 1)) x(s, k)""")
def report_descriptors(spark, d):
    """Events that carry their own report descriptors, joined to payloads by object key."""
    from .plans import flows

    n = F.col("event_id")
    one = lambda s, k: F.struct(F.lit(s).alias("source_name"), F.concat(F.lit("p"), n + k).alias("object_key"))
    e = table(spark, d, "events").select(n.alias("request_id"), F.array(one("a", 0), one("b", 1)).alias("reports"))
    ids = table(spark, d, "events").select(n).union(table(spark, d, "events").agg(F.max("event_id") + 1))
    payloads = ids.where("event_id % 5 <> 0").select(F.concat(F.lit("p"), n).alias("storage_uri"), F.lit("{}").alias("payload_json"))
    return flows.descriptors(e, payloads).select("request_id", "source_name", "error")


@query("SELECT event_id, CAST(CASE event_type WHEN 'purchase' THEN 3 WHEN 'view' THEN 1 END AS INTEGER) AS feature_version, CASE WHEN event_type NOT IN ('purchase', 'view') THEN 'not a score feature: ' || event_type END AS error FROM events")
def score_writeback(spark, d):
    """Scores from outside: only declared score features are taken, at their registered version."""
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("feature_name"))
    good, bad = models.score_writes(rows, {"purchase": 3, "view": 1})
    return good.select("event_id", "feature_version", F.lit(None).cast("string").alias("error")).unionByName(bad.select("event_id", "feature_version", "error"))


@query("SELECT event_id, CASE WHEN ts + to_milliseconds(CAST(greatest(1, least(CAST(value * 1000 AS BIGINT), 60000)) AS BIGINT)) <= TIMESTAMP '2024-01-15' THEN 'deadline_expired' ELSE 'served' END AS status FROM events")
def deadline_filter(spark, d):
    """Requests whose clamped deadline has passed are ended before anything is computed."""
    e = table(spark, d, "events")
    e = e.withColumn("expires_at", chunks.expires_at(F.col("ts"), (F.col("value") * 1000).cast("long"), 60000))
    ok, late = chunks.deadline_split(e, F.lit("2024-01-15").cast("timestamp_ntz"))
    return ok.select("event_id", F.lit("served").alias("status")).union(late.select("event_id", "status"))


# Merges, replays and keys.
@query("""WITH u AS (SELECT event_id // 4 AS job_id, event_id AS seq, event_id % 3 AS n, CASE WHEN event_type <> 'view' THEN event_type ELSE '' END AS label, CASE WHEN event_id % 5 = 0 THEN event_type END AS f, event_id % 7 = 0 AS w, ts FROM events)
SELECT job_id, arg_max(n, seq) FILTER (WHERE n <> 0) AS n, arg_max(label, seq) FILTER (WHERE label <> '') AS label, arg_max(f, seq) FILTER (WHERE f IS NOT NULL) AS features, bool_or(w) AS write_online, arg_min(ts, seq) AS created_at FROM u GROUP BY job_id""")
def job_merge(spark, d):
    n = F.col("event_id")
    e = table(spark, d, "events").select(F.floor(n / 4).alias("job_id"), n.alias("seq"), (n % 3).alias("n"), F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("label"), F.when(n % 5 == 0, F.array("event_type")).otherwise(F.expr("cast(array() as array<string>)")).alias("features"), (n % 7 == 0).alias("write_online"), F.col("ts").alias("created_at"))
    out = merges.merge_jobs(e, truthy=["n", "label"], lists=["features"])
    return out.select("job_id", "n", "label", F.array_join("features", ",").alias("features"), "write_online", "created_at")


def processed_chunks(spark, d):
    n = F.col("event_id")
    status = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").otherwise("completed")
    return table(spark, d, "events").select((F.col("user_id") % 50).alias("job_id"), (n % 40).alias("chunk_id"), n.alias("seq"), status.alias("status"), (n % 2).alias("item_count"), F.lit(1).alias("ok_items"), F.lit(0).alias("failed_items"), F.lit(None).cast("string").alias("first_errors"))


CHUNKS_SQL = "c AS (SELECT user_id % 50 AS job_id, event_id % 40 AS chunk_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status, event_id % 2 AS item_count FROM events)"


@query(f"WITH {CHUNKS_SQL} SELECT job_id, chunk_id, count(DISTINCT (status, item_count)) AS n_results FROM c WHERE status <> 'running' GROUP BY 1, 2 HAVING count(DISTINCT (status, item_count)) > 1")
def chunk_conflicts(spark, d):
    return merges.chunk_conflicts(processed_chunks(spark, d))


@query(f"WITH {CHUNKS_SQL} SELECT job_id, chunk_id, arg_max(status, (status <> 'running', seq)) AS status, arg_max(seq, (status <> 'running', seq)) AS seq FROM c GROUP BY 1, 2")
def chunk_merge(spark, d):
    return merges.merge_chunks(processed_chunks(spark, d)).select("job_id", "chunk_id", "status", "seq")


@query("""WITH k AS (SELECT o_orderkey, 'c|' || o_custkey || '|' || CASE WHEN o_orderkey % 3 = 0 THEN '[]' ELSE '["a","b"]' END || '|["' || least(o_orderstatus, 'M') || '","' || greatest(o_orderstatus, 'M') || '"]|["h' || (o_orderkey % 5) || '"]' AS body, CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE 'a|b' END AS g, o_custkey FROM orders)
SELECT o_orderkey, 'c:' || o_custkey || ':' || g || ':' || substr(sha256(body), 1, 16) AS key FROM k""")
def idempotency_keys(spark, d):
    n = F.col("o_orderkey")
    groups = F.when(n % 3 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("b"), F.lit("a")))
    key = digests.idempotency_key(F.lit("c"), F.col("o_custkey").cast("string"), groups, F.array("o_orderstatus", F.lit("M")), F.array(F.concat(F.lit("h"), n % 5)))
    return table(spark, d, "orders").select("o_orderkey", key.alias("key"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'top' ELSE 'base' END AS payload FROM customer UNION ALL SELECT -c_custkey, 'top' FROM customer WHERE c_custkey % 6 = 0")
def request_overlay(spark, d):
    """A request's own payloads shadow the store's and add to them."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("base").alias("payload"))
    top = c.where("k % 3 = 0").select("k", F.lit("top").alias("payload")).union(c.where("k % 6 = 0").select(-F.col("k"), F.lit("top")))
    return reports.overlay(c, top, "k")


@query("SELECT c_custkey AS request_id, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS balance, c_custkey % 4 = 0 AS result_missing, CASE WHEN c_custkey % 4 = 0 THEN 'balance,rank' WHEN c_custkey % 2 = 1 THEN 'rank' ELSE '' END AS missing FROM customer")
def request_scoped_read(spark, d):
    """Requests see their own results and never latest values."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), "c_acctbal")
    held = c.where("request_id % 4 <> 0")
    rows = held.select("request_id", F.lit("balance").alias("feature_name"), F.col("c_acctbal").alias("value")).union(held.where("request_id % 2 = 0").select("request_id", F.lit("rank"), F.lit(1.0)))
    asked = c.select("request_id", F.array(F.lit("balance"), F.lit("rank")).alias("requested_features"))
    out = store.request_results(asked, rows)
    return out.select("request_id", F.col("values")["balance"].alias("balance"), "result_missing", F.array_join("missing", ",").alias("missing"))


@query("""SELECT event_id, ts + INTERVAL 24 HOUR * (event_id % 3) AS available_at, CASE WHEN event_id % 2 = 0 THEN 'source_provided' ELSE 'ingestion_time' END AS availability_source FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, ts + INTERVAL 6 HOUR, 'ingestion_time' FROM events WHERE event_id % 2 <> 0""")
def availability_fallback(spark, d):
    """Where a report has no trusted availability, the time its metadata was made stands in."""
    n = F.col("event_id")
    e = table(spark, d, "events")
    given = n % 2 == 0
    m = e.select(n.cast("string").alias("report_ref"), F.when(given, F.col("ts") + F.make_interval(hours=(n % 3 * 24).cast("int"))).alias("available_at"), (F.col("ts") + hours(F.lit(6))).alias("created_at"), F.when(given, "source_provided").alias("availability_source"))
    return reports.with_availability(e.select("event_id", n.cast("string").alias("report_ref")), m).drop("report_ref")


# Feature functions that no other query uses.
@query("""WITH x AS (SELECT o_orderkey, o_totalprice AS p, o_custkey % 13 AS m, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS since, o_orderkey % 90 AS worst, o_orderkey % 4 AS loans, o_custkey % 1000 AS sim FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 9999 ELSE since END AS days, CASE WHEN p <= 0 THEN 0.0 ELSE round(1.0 / (1.0 + 500.0 / p) * (m / 12.0), 6) END AS stability,
 CASE WHEN since <= 180 AND worst >= 30 THEN 1 ELSE 0 END AS delinquent, CASE WHEN loans = 0 OR sim < 365 THEN 1 ELSE 0 END AS thin, round(greatest(0.0, least(1.0, p / 200000)) * 0.5 + greatest(0.0, least(1.0, CAST(m AS DOUBLE) / 10)) * 0.25, 6) AS risk FROM x""")
def risk_functions(spark, d):
    n, price = F.col("o_orderkey"), F.col("o_totalprice")
    m = F.col("o_custkey") % 13
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+05:00'")
    since = scoring.days_since(day, F.lit("1995-01-01T23:59:59Z"))
    return table(spark, d, "orders").select(
        "o_orderkey", scoring.days_since(day, F.when(n % 9 == 0, None).otherwise("1995-01-01")).cast("long").alias("days"), scoring.round_scaled(scoring.stability(price, F.lit(500.0), m)).alias("stability"),
        scoring.recent_delinquency(since, n % 90).alias("delinquent"), scoring.thin_file(n % 4, F.col("o_custkey") % 1000).alias("thin"), scoring.round_scaled(scoring.blend([(price / 200000, 0.5), (m.cast("double") / 10, 0.25)])).alias("risk"),
    )


# Propagation and refreshes.
@query("SELECT event_id, CAST(user_id AS VARCHAR) AS entity_key, event_type AS feature_name FROM events WHERE (event_type = 'click' AND event_id % 6 <> 0) OR event_type = 'view'")
def change_feed(spark, d):
    """One event without values for each written feature that something reacts to."""
    rows = feed(spark, d).withColumn("calc_ts", F.col("event_id"))
    return propagate.updates(rows, edges(spark)).select(F.col("calc_ts").alias("event_id"), "entity_key", "feature_name")


@query(f"WITH {FEED_SQL} SELECT event_id, dependent, CAST(dv AS INTEGER) AS dependent_version, CAST(row_number() OVER (PARTITION BY event_id ORDER BY dependent, dv) AS INTEGER) AS place FROM c")
def candidate_order(spark, d):
    return propagate.ordered(propagate.candidates(feed(spark, d), edges(spark)), ["event_id"]).select("event_id", "dependent", "dependent_version", "place")


@query("""WITH p AS (SELECT user_id, ts, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS c FROM events)
SELECT count(*) AS planned, count(DISTINCT user_id) AS entities, CAST(sum(c) AS BIGINT) AS computed, max(CASE WHEN c = 1 THEN greatest(0.0, epoch_us(TIMESTAMP '2024-01-20' - ts) / 1e6) END) AS max_lag_seconds, count(*) - CAST(sum(c) AS BIGINT) AS skipped FROM (SELECT user_id, ts, c FROM p)""".replace("epoch_us(TIMESTAMP '2024-01-20' - ts)", "(epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts))"))
def wave_accounting(spark, d):
    """Planned, computed and skipped units of a wave, and its greatest lag; model features wait without a runner."""
    view = registry.build(WAVE).views["activity"]
    e = table(spark, d, "events").select(F.col("user_id").alias("entity_key"), F.col("event_type").alias("dependent"), F.lit(1).alias("dependent_version"), F.col("ts").alias("data_ts"), F.lit("2024-01-20").cast("timestamp_ntz").alias("calc_ts"))
    ready, _ = propagate.deferred(e, view)
    return propagate.accounting(e, ready)


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'again' WHEN event_id % 7 >= 5 THEN 'dead' ELSE 'again' END AS fate, CASE WHEN event_type = 'error' THEN event_id % 7 WHEN event_id % 7 >= 5 THEN event_id % 7 ELSE event_id % 7 + 1 END AS attempt FROM events""")
def retry_or_bury(spark, d):
    """Failures are tried five times; those of the platform itself for ever."""
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 7).alias("attempt"), (F.col("event_type") == "error").alias("infrastructure"))
    again, dead = chunks.retry_or_bury(e)
    return again.select("event_id", F.lit("again").alias("fate"), "attempt").union(dead.select("event_id", F.lit("dead"), "attempt"))


@query(f"""WITH {GUARD_SQL}, h AS (SELECT user_id, max(seq) AS seq, arg_max(t, seq) AS t FROM (SELECT o.user_id, o.seq, k.t FROM o JOIN k USING (user_id, seq) WHERE outcome LIKE 'written%') GROUP BY user_id),
n AS (SELECT b.user_id, CASE WHEN h.t IS NULL OR b.t > h.t THEN 'written' WHEN b.t < h.t THEN 'skipped_stale' ELSE 'same' END AS outcome FROM (SELECT user_id, max(seq) AS s, arg_max(t, seq) AS t FROM b GROUP BY user_id) b LEFT JOIN h USING (user_id))
SELECT outcome, count(*) AS n FROM n WHERE outcome <> 'same' GROUP BY outcome UNION ALL SELECT 'unchanged', count(*) FROM n WHERE outcome = 'same' UNION ALL SELECT 'missing_offline', count(*) FROM (SELECT DISTINCT user_id FROM events)""")
def refresh_counts(spark, d):
    """Each user's last arrival against the latest-value table; users of other names have nothing offline."""
    rows = arrivals(spark, d)
    online = guard.latest(guard.fold(rows, ["user_id"]), ["user_id"]).drop("outcome")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "user_id"]), "seq").alias("r")).select("user_id", "r.*")
    wanted = rows.select("user_id").union(rows.select(-F.col("user_id") - 1)).distinct()
    counts, _ = guard.refresh_from_history(online, wanted, last, ["user_id"], ["user_id"])
    name = F.when(F.col("outcome").isin("noop", "written_recompute"), "unchanged").otherwise(F.col("outcome"))
    return counts.groupBy(name.alias("outcome")).agg(F.sum("n").alias("n")).unionByName(spark.createDataFrame([("unchanged", 0)], "outcome string, n long")).groupBy("outcome").agg(F.sum("n").alias("n"))


# Records and metrics.
@query("""SELECT o_orderkey AS manifest_id, CASE WHEN o_orderkey % 4 = 0 THEN 'done' ELSE 'open' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 9 ELSE 1 END AS item_count_read, 'me' AS created_by FROM orders WHERE o_orderkey % 8 <> 4
UNION ALL SELECT o_orderkey, 'done', 9, 'you' FROM orders WHERE o_orderkey % 8 = 4""")
def manifest_upsert(spark, d):
    """Known manifests take status and counts only; new ones are added whole."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("manifest_id"))
    row = lambda status, n, who: (F.lit(status).alias("status"), F.lit(n).alias("item_count_read"), F.lit(who).alias("created_by"))
    return store.upsert_manifests(o.where("manifest_id % 8 <> 4").select("*", *row("open", 1, "me")), o.where("manifest_id % 4 = 0").select("*", *row("done", 9, "you")))


@query("SELECT 'events{event_type=' || event_type || '}' AS series, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY event_type UNION ALL SELECT 'last{event_type=' || event_type || '}', arg_max(value, event_id) FROM events GROUP BY event_type")
def metric_series(spark, d):
    """Counters and gauges by label."""
    e = table(spark, d, "events")
    return evaluate.counter(e, "events", ["event_type"]).union(evaluate.gauge(e, "last", ["event_type"], "value", "event_id"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'missing_features' WHEN c_custkey % 3 = 0 THEN 'stale_features' ELSE 'completed' END AS status, CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 10 = 0 THEN 'balance,other' ELSE 'balance' END WHEN c_custkey % 3 = 0 THEN 'rank' ELSE '' END AS refused,
 CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 THEN CASE WHEN c_nationkey < 3 THEN 'approve' WHEN c_nationkey < 8 THEN 'review' ELSE 'decline' END END AS decision FROM customer""")
def decision_refusal(spark, d):
    """No decision on missing features, reported or absent, nor on stale ones."""
    n = F.col("c_custkey")
    names = F.when(n % 5 == 0, F.create_map(F.lit("rank"), F.lit(1.0))).otherwise(F.create_map(F.lit("rank"), F.lit(1.0), F.lit("balance"), F.col("c_acctbal")))
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", names.alias("values"), F.when(n % 10 == 0, F.array(F.lit("other"))).alias("missing"), F.create_map(F.lit("balance"), F.lit(1), F.lit("rank"), F.when(n % 3 == 0, 100).otherwise(1)).alias("ages"))
    out = models.decide(rows, ["balance", "rank"], (F.col("c_nationkey") + 0.5) / 28, ages="ages", most_seconds=50)
    return out.select("c_custkey", "status", F.array_join("refused", ",").alias("refused"), "decision")


@query(_pit_sql("INTERVAL 0 SECOND", "coalesce(h.available_at, h.calc_ts)").replace("SELECT o.obs_id, o.entity_key, o.observation_ts, " + ", ".join(f"w.{t}_row, w.{t}_value" for t in TYPES), "SELECT o.obs_id, o.observation_ts, " + ", ".join(f"w.{t}_value, CASE WHEN w.{t}_row IS NULL THEN 'missing' ELSE 'ok' END AS {t}_status" for t in TYPES)))
def training_export_nested(spark, d):
    """The nested export, read through its structs."""
    wide = training.training_set(observations(spark, d), event_history(spark, d), ["entity_key"], dict.fromkeys(TYPES, 1), known=_known(), bucket_seconds=BUCKET)
    rows = training.nested_rows(wide, ["entity_key"], list(TYPES), context=["obs_id"])
    return rows.select("context.obs_id", "observation_ts", *(c for t in TYPES for c in (F.col(f"features.{t}").alias(f"{t}_value"), F.col(f"feature_metadata.{t}.status").alias(f"{t}_status"))))


@query("SELECT l_orderkey * 10 + l_linenumber AS line, CAST(round_even(CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS DECIMAL(38, 6)) / 1, 6) AS DOUBLE) AS price, round(l_extendedprice / 7, 6) AS seventh FROM lineitem")
def rounded_prices(spark, d):
    """Rounding at the exact value: of prices in cents and of sevenths, which lie on no tie."""
    price = F.col("l_extendedprice").cast("double")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), scoring.round_exact(price).alias("price"), scoring.round_exact(price / 7).alias("seventh"))


@query("""WITH t AS (SELECT c_custkey, unnest([CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 1 END, 1]) AS v FROM customer)
SELECT count(*) AS candidates, count(*) FILTER (WHERE v IS NULL) AS missing, (SELECT count(*) FROM customer WHERE c_custkey % 4 <> 0) AS written, (SELECT count(*) FROM customer WHERE c_custkey % 4 = 0) AS duplicate, CAST(0 AS BIGINT) AS rejected, CAST(5 AS BIGINT) AS online_written,
 CASE WHEN (SELECT count(*) FROM customer WHERE c_custkey % 4 <> 0) <> 5 THEN 'history took ' || (SELECT count(*) FROM customer WHERE c_custkey % 4 <> 0) || ' rows, the latest-value table 5' END AS warning FROM t""")
def import_accounting(spark, d):
    c = table(spark, d, "customer")
    n = F.col("c_custkey")
    tall = imports.tall_rows(c.select(n, F.when(n % 3 != 0, 1).alias("a"), F.lit(1).alias("b")), {"x": ("a", "int"), "y": ("b", "int")}, ["c_custkey"])
    items = c.select(F.when(n % 4 == 0, "duplicate").otherwise("written").alias("status"))
    return imports.import_accounting(items, tall, 5)
