import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.plans import credit, dag, flows, registry
from tidemark.sources.history import Log

from test_plans import BASE, FUNCTIONS, entity

T = lambda n: dt.datetime(2026, 1, n)


def test_compute_and_store_once(spark, tmp_path):
    view = registry.build(BASE).views["v"]
    log = Log(spark, f"file://{tmp_path}/log")
    e = entity(spark, (1, 10, 11), (2, 5, 12)).withColumnRenamed("id", "entity_key")
    at = F.lit(T(20)).cast("timestamp_ntz")
    plan = registry.plan(view, ["c", "a"])
    assert flows.compute_and_store(e, plan, FUNCTIONS, at, log)[0] == 2
    assert flows.compute_and_store(e, plan, FUNCTIONS, F.lit(T(25)).cast("timestamp_ntz"), log)[0] == 0  # a replay
    changed = entity(spark, (7, 15, 16), (2, 5, 12)).withColumnRenamed("id", "entity_key")
    online = log.read().withColumn("seq", F.col("row_id")).select("entity_key", "view", "view_version", "feature_name", "feature_version", "value_json", "data_ts", "max_input_data_ts", "input_fingerprint", "available_at", "seq")
    n, online = flows.compute_and_store(changed, plan, FUNCTIONS, at, log, spark.createDataFrame(online.collect(), online.schema))
    assert n == 2 and log.read().count() == 4
    assert {r.feature_name: r.value_json for r in online.collect()} == {"a": "7", "c": "27"}


def test_feature_row_import(spark):
    view = registry.build(BASE).views["v"]
    cols = "ord int, entity_key string, feature_name string, feature_version int, value_json string, data_ts timestamp_ntz, calc_ts timestamp_ntz"
    rows = spark.createDataFrame([(0, "id=1", "a", 1, "5", T(1), T(2)), (1, "id=1", "a", 1, "5", T(1), T(3)), (2, "id=1", "b", 1, "5", T(1), T(2)), (3, "id=1", "zz", 1, "5", T(1), T(2)), (4, None, "a", 1, "5", T(1), T(2)), (5, "id=2", "b", 2, "6", T(1), T(2)), (6, "id=2", "a", 1, "6", None, T(2))], cols)
    items, fresh = flows.import_feature_rows(rows, view, None, ["ord"])
    assert {r.ord: r.status for r in items.collect()} == {0: "written", 1: "duplicate", 2: "rejected", 3: "rejected", 4: "rejected", 5: "written", 6: "rejected"}
    again, none = flows.import_feature_rows(rows, view, fresh, ["ord"])
    assert none.count() == 0 and {r.status for r in again.where("ord in (0, 1, 5)").collect()} == {"duplicate"}


def test_wide_import_and_descriptors(spark):
    wide = spark.createDataFrame([("id=1", "5", " "), ("id=2", "x", "yes")], "entity_key string, n string, f string")
    rows, summary = flows.import_wide(wide, {"n": ("n", "int"), "f": ("f", "bool")}, ["entity_key"], F.lit(T(1)), F.lit(T(2)))
    assert {(r.entity_key, r.feature_name, r.value_json) for r in rows.collect()} == {("id=1", "n", "5"), ("id=2", "f", "true")}
    assert tuple(summary.first()) == (4, 1, 1, 2)
    events = spark.createDataFrame([("r1", [("s", "k1"), ("t", "k2")])], "request_id string, reports array<struct<source_name: string, object_key: string>>")
    got = flows.descriptors(events, spark.createDataFrame([("k1", "{}")], "storage_uri string, payload_json string")).collect()
    assert {r.source_name: r.error for r in got} == {"s": None, "t": "missing payload k2"}


def test_backfill_and_golden_cases(spark, tmp_path):
    import yaml

    line = lambda u, ts, amount: json.dumps({"entity_key": {"user_id": u, "application_id": "1"}, "event_ts": ts, "payload": {"requested_amount": amount, "term_months": 10}})
    lines = spark.createDataFrame(list(enumerate([line("a", "2026-01-01T00:00:00Z", 100), "bad", line("a", "2026-01-05T00:00:00Z", 200), line("b", "2026-01-01T00:00:00Z", 50)])), "line int, value string")
    items, rows = flows.backfill(lines, credit.view(), ["requested_monthly_payment"], credit.FUNCTIONS, credit.attach, F.lit(T(9)).cast("timestamp"), "application_request", "application_request")
    assert {r.status for r in items.collect()} == {"written", "rejected"}
    assert {r.entity_key: float(r.value_json) for r in rows.collect()} == {"user_id=a|application_id=1": 20.0, "user_id=b|application_id=1": 5.0}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump([{"name": "ok", "feature": "x", "expected": {"value": 3}}, {"name": "bad", "feature": "x", "expected": {"value": 4}}, {"name": "err", "feature": "y", "expected": {"value": 4}}]))
    states = dict(dag.golden(spark, flows.load_cases(f"{tmp_path}/c.yaml"), lambda c: {"x": 3}[c["feature"]]))
    assert states["ok"] == "passed" and states["bad"] == "failed" and states["err"].startswith("error")
