import base64
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import checks, chunks, evaluate, imports, merges, models, propagate, reports
from tidemark.plans import registry

T = lambda n: dt.datetime(2026, 1, n)


def test_request_merge_equals_the_fold(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 20), i, rng.choice([None, "accepted", "running", "completed", "failed", "deadline_expired"]), rng.choice([None, i]), rng.choice([[], [str(i)]]), rng.choice([None, T(1 + i % 28)])) for i in range(300)]
    held = {}
    for r, _, s, j, f, c in rows:
        o = held.setdefault(r, dict(status=None, job=None, features=[], created=None))
        if not (s is None or (o["status"] in ("completed", "failed") and s in ("accepted", "running"))):
            o["status"] = s
        o["job"] = o["job"] if j is None else j
        o["features"] = f or o["features"]
        o["created"] = o["created"] or c
    df = spark.createDataFrame(rows, "request_id int, seq int, status string, job int, features array<string>, created_at timestamp_ntz")
    got = merges.merge_requests(df, scalars=["job"], lists=["features"]).collect()
    assert {r.request_id: (r.status, r.job, r.features or [], r.created_at) for r in got} == {k: (o["status"], o["job"], o["features"], o["created"]) for k, o in held.items()}
    last = {r[0]: r for r in rows}
    assert {r.request_id: r.seq for r in merges.latest_requests(df).collect()} == {k: r[1] for k, r in last.items()}


def test_jobs_chunks_and_conflicts(spark):
    jobs = spark.createDataFrame([("j", 1, "v", 0, ["a"], False, T(2)), ("j", 2, "", 7, [], True, T(3))], "job_id string, seq int, view string, total int, features array<string>, write_online boolean, created_at timestamp_ntz")
    r = merges.merge_jobs(jobs, truthy=["view", "total"], lists=["features"]).first()
    assert (r.view, r.total, r.features, r.write_online, r.created_at) == ("v", 7, ["a"], True, T(2))
    ch = spark.createDataFrame([("j", "c1", 1, "completed", 0), ("j", "c1", 2, "running", 0), ("j", "c2", 3, "accepted", 0)], "job_id string, chunk_id string, seq int, status string, failed_items int")
    assert {r.chunk_id: r.status for r in merges.merge_chunks(ch).collect()} == {"c1": "completed", "c2": "accepted"}
    done = spark.createDataFrame([("j", "c", "completed", 2, 2, 0, None), ("j", "c", "completed", 2, 2, 0, None), ("j", "d", "completed", 2, 2, 0, None), ("j", "d", "failed", 2, 0, 2, ["x"])], "job_id string, chunk_id string, status string, item_count int, ok_items int, failed_items int, first_errors array<string>")
    assert [r.chunk_id for r in merges.chunk_conflicts(done).collect()] == ["d"]


@pytest.mark.parametrize("states,count,operational,durable", [
    ([], 2, "running", "accepted"), (["accepted", "accepted"], 2, "accepted", "accepted"), (["accepted"], 2, "running", "accepted"), (["completed"], 2, "running", "running"),
    (["completed", "running"], 2, "running", "running"), (["failed", "failed"], 2, "failed", "failed"), (["failed", "completed"], 2, "completed_with_errors", "completed_with_errors"), (["completed", "completed"], 2, "completed", "completed_with_errors"),
])
def test_job_states(spark, states, count, operational, durable):
    ch = spark.createDataFrame([("j", s, 1 if states == ["completed", "completed"] else 0) for s in states], "job_id string, status string, failed_items int")
    jobs = spark.createDataFrame([("j", count)], "job_id string, chunk_count int")
    assert merges.job_status(ch, jobs).first().status == operational
    assert merges.job_status(ch, jobs, durable=True).first().status == durable


def test_consistency_states(spark):
    off = spark.createDataFrame([("ok", 1, 5, 1), ("ok", 1, 6, 2), ("stale", 3, 1, 3), ("newer", 1, 1, 4), ("differs", 1, 1, 5), ("off", 1, 1, 6), ("null", 1, None, 7)], "k string, data_ts int, value int, row_id int")
    on = spark.createDataFrame([("ok", 1, 6), ("stale", 2, 1), ("newer", 2, 1), ("differs", 1, 2), ("on", 1, 1), ("null", 1, None)], "k string, data_ts int, value int")
    wanted = spark.createDataFrame([(k,) for k in ("ok", "stale", "newer", "differs", "off", "on", "null", "none")], "k string")
    got = {r.k: r.status for r in checks.consistency(off, on, ["k"], wanted=wanted).collect()}
    assert got == {"ok": "ok", "stale": "stale_online", "newer": "online_newer_than_offline", "differs": "value_mismatch", "off": "missing_online", "on": "missing_offline", "null": "ok", "none": "missing_both"}
    assert checks.overall(checks.consistency(off, on, ["k"])).first().status == "inconsistent"


def test_two_kinds_of_latest(spark):
    h = spark.createDataFrame([("k", 1, 9, 1), ("k", 1, 9, 2)], "k string, data_ts int, calc_ts int, row_id int")
    assert checks.latest_by_data(h, ["k"]).first().row_id == 2 and checks.latest_by_calc(h, ["k"]).first().row_id == 1


def test_metadata_projection(spark):
    cols = "report_ref string, report_type string, entity_type string, entity_key string, report_ts timestamp_ntz, payload_size_bytes int, content_hash string, storage_uri string, format string, compression string, available_at timestamp_ntz, availability_source string"
    row = lambda ref, at, src="source_provided", h="h", ts=T(1): (ref, "t", "e", "k", ts, 1, h, "u", "json", None, at, src)
    old = spark.createDataFrame([row("a", T(2)), row("b", T(2)), row("c", T(2)), row("e", T(2), "ingestion_time")], cols)
    new = spark.createDataFrame([row("a", T(3)), row("b", T(3), "ingestion_time"), row("c", T(2), h="other"), row("d", T(2)), row("x", T(1), ts=T(2)), row("e", T(2))], cols)
    state, audit, refused = reports.project(new, old, "jsonl", "m")
    assert {(r.report_ref, r.available_at) for r in state.collect()} == {("a", T(3)), ("b", T(2)), ("c", T(2)), ("d", T(2)), ("e", T(2))}
    assert [(r.report_ref, r.old_available_at, r.new_available_at) for r in audit.collect()] == [("a", T(2), T(3))]
    assert {(r.report_ref, r.outcome) for r in refused.collect()} == {("c", "conflict"), ("x", "invalid")}
    over = reports.overlay(old.select("report_ref", "content_hash"), spark.createDataFrame([("a", "top")], "report_ref string, content_hash string"), "report_ref")
    assert {r.report_ref: r.content_hash for r in over.collect()}["a"] == "top" and over.count() == 4


def test_json_lines(spark):
    good = '{"entity_key": {"u": "1"}, "event_ts": "2026-01-02T00:00:00Z", "payload": {"b": 1, "a": [2]}}'
    lines = ["", good, "nope", good.replace('"1"', '"2"'), good, '{"event_ts": "2026-01-02T00:00:00Z", "payload": 1}', good.replace("Z", ""), good.replace('"payload"', '"x"'), good[:-1] + ', "available_at": "2026-01-01T00:00:00Z"}', good[:-1] + ', "report_ref": "r", "source_name": "other"}', good.replace("[2]", "[3]")[:-1] + ', "report_ref": "r"}']
    df = spark.createDataFrame(list(enumerate(lines)), "line int, value string")
    items = imports.land(imports.parse_reports(imports.number_lines(df), ["u"], "s", "t"))
    got = {r.line: (r.item_index, r.status, (r.error or "")[:20]) for r in items.collect()}
    assert got == {1: (0, "written", ""), 2: (1, "rejected", "malformed JSON"), 3: (2, "written", ""), 4: (3, "duplicate", ""), 5: (4, "rejected", "missing entity_key"), 6: (5, "rejected", "event_ts must be a ti"[:20]), 7: (6, "rejected", "missing payload"), 8: (7, "rejected", "available_at before e"[:20]), 9: (8, "written", ""), 10: (9, "rejected", "report_ref conflict:"[:20])}
    m = imports.manifest(items).first()
    assert (m.item_count_read, m.item_count_written, m.item_count_duplicate, m.item_count_rejected) == (10, 3, 1, 6)
    assert imports.eligible_items(items).count() == 3 and imports.eligible_items(items, True).count() == 4
    again = imports.land(imports.parse_reports(imports.number_lines(df), ["u"], "s", "t"), items.where("status = 'written'"))
    assert again.where("status = 'written'").count() == 0


def test_readers(spark, tmp_path):
    from tidemark.sources import readers

    (tmp_path / "a.csv").write_text("x,y\n1,\n")
    assert readers.rows(spark, f"{tmp_path}/a.csv", "csv").first().x == "1"
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{bad\n')
    with pytest.raises(Exception):
        readers.rows(spark, f"{tmp_path}/a.jsonl", "jsonl", "x int").collect()
    (tmp_path / "lines.txt").write_text("a\n\nb\n")
    numbered = imports.number_lines(readers.lines(spark, f"{tmp_path}/lines.txt"), order=("chunk", "place"))
    assert [(r.value, r.item_index) for r in numbered.orderBy("item_index").collect()] == [("a", 0), ("b", 1)]
    with pytest.raises(KeyError):
        readers.named(spark, {}, "q")
    df = spark.createDataFrame([(1, "2026-01-02T00:00:00Z", '{"v": 1}')], "id int, at string, body string")
    parsed = imports.parse_reports(readers.extract(df, {"u": "id"}, "at", "body"), ["u"], "s", "t").first()
    assert parsed.error is None and parsed.entity_key == "u=1" and parsed.payload_json == '{"v":1}'


def test_chunks_poison_retries_and_limits(spark):
    items = spark.createDataFrame([("j", i, f"e{i}" * 200 if i % 2 else None) for i in range(50)], "job_id string, n int, error string")
    out = chunks.chunk_outcomes(chunks.chunked(items, 30, ["n"])).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.item_count, r.failed_items, r.status) for r in out] == [("j:0", 30, 15, "completed_with_errors"), ("j:1", 20, 10, "completed_with_errors")]
    assert len(out[0].first_errors) == 10 and all(len(e) == 200 for e in out[0].first_errors) and out[0].first_errors[0].startswith("e1e1")
    sliced = chunks.chunked(items, 7, ["n"], slice_by=F.floor(F.col("n") / 9)).select("n", "item_index", "chunk_id")
    assert sorted(sliced.collect()) == sorted(chunks.chunked(items, 7, ["n"]).select("n", "item_index", "chunk_id").collect())
    msgs = spark.createDataFrame([("structurally-poison",), ('{"event_type": "a"}',), ('{"event_type": "zz", "batch_job_id": "b", "request_id": ""}',), ("{}",)], "value string")
    good, dead = chunks.split_poison(msgs, known_types=["a"])
    assert good.count() == 1
    d = {r.failure_status: r for r in dead.collect()}
    assert set(d) == {"not_json", "unknown_event_type", "missing_event_type"} and d["unknown_event_type"].job_id == "b" and d["unknown_event_type"].request_id is None
    assert base64.b64decode(d["not_json"].payload_base64) == b"structurally-poison"
    failed = spark.createDataFrame([(1, None, False), (2, 5, False), (3, 9, True)], "id int, attempt int, infrastructure boolean")
    again, buried = chunks.retry_or_bury(failed)
    assert {r.id: r.attempt for r in again.collect()} == {1: 2, 3: 9} and [r.id for r in buried.collect()] == [2]
    assert chunks.token_bucket([(0, 5), (1, 5), (1, 1)], 2, 4) == [4, 2, 0] and chunks.lag_pause(11, 10) and not chunks.lag_pause(11, 10, False)
    req = spark.createDataFrame([(1, T(1)), (2, T(5)), (3, None)], "id int, expires_at timestamp_ntz")
    ok, late = chunks.deadline_split(req, F.lit(T(5)).cast("timestamp_ntz"))
    assert {r.id for r in ok.collect()} == {3} and {r.id for r in late.collect()} == {1, 2}
    e = spark.range(1).select(chunks.expires_at(F.lit(T(1)), F.lit(-5), 1000).alias("a"), chunks.expires_at(F.lit(T(1)), F.lit(99999), 1000).alias("b")).first()
    assert (e.a - T(1)).total_seconds() == 0.001 and (e.b - T(1)).total_seconds() == 1


def test_evaluation(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0.1, 0.2, 0.3, 0.9]), rng.randint(0, 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(evaluate.roc_auc(df).first().auc - want) < 1e-12 and evaluate.roc_auc(df.where("label = 1")).first().auc == 0.5
    assert evaluate.percentiles(spark.createDataFrame([(float(i),) for i in range(1, 5)], "v double"), "v").first().p50 == 2.5
    assert evaluate.standardizer(df.withColumn("c", F.lit(3.0)), ["c"]).first().c_std == 1.0
    assert evaluate.log_loss_brier(spark.createDataFrame([(1.0, 1), (0.0, 0)], "score double, label int")).first().brier == 0


VIEW = {
    "registry_version": "t", "entities": {"e": {"key_fields": ["u"]}}, "sources": {"s": {"type": "raw_report", "report_type": "r", "ts_field": "t"}},
    "feature_views": {"v": {"entity": "e", "key_fields": ["u"], "view_version": 1, "owner": "o", "status": "live", "features": {
        "a": {"kind": "udf", "feature_version": 1, "udf": "x", "inputs": ["s"], "dtype": "float", "status": "live"},
        "b": {"kind": "udf", "feature_version": 1, "udf": "b", "deps": [{"feature": "a", "propagation": "reactive"}], "dtype": "float", "status": "live"},
        "c": {"kind": "udf", "feature_version": 1, "udf": "c", "deps": [{"feature": "b", "propagation": "reactive"}, {"feature": "a"}], "dtype": "float", "status": "live"},
    }}},
}
HISTORY = "row_id long, entity_key string, view string, view_version int, feature_name string, feature_version int, value double, value_json string, data_ts timestamp_ntz, calc_ts timestamp_ntz, max_input_data_ts timestamp_ntz, value_hash string, input_fingerprint string, available_at timestamp_ntz, availability_source string"


def test_waves_run_level_by_level_and_stop(spark):
    view = registry.build(VIEW).views["v"]
    hist = spark.createDataFrame([(i, k, "v", 1, "a", 1, v, str(v), T(i + 1), T(i + 1), None, None, None, None, None) for i, (k, v) in enumerate([("u=1", 2.0), ("u=2", 3.0)])], HISTORY)
    state = {}

    def append(history, rows):
        last = history.agg(F.max("row_id")).first()[0]
        got = rows.withColumn("value", F.col("value_json").cast("double")).collect()
        new = spark.createDataFrame([(last + 1 + i, r.entity_key, "v", 1, r.feature_name, 1, r.value, r.value_json, r.data_ts, r.calc_ts, r.max_input_data_ts, r.value_hash, r.input_fingerprint, r.available_at, None) for i, r in enumerate(got)], HISTORY)
        state["history"] = spark.createDataFrame(history.union(new).collect(), HISTORY)
        return state["history"]

    fns = {"b": lambda s, d: d["a"] * 10, "c": lambda s, d: d["b"] + d["a"]}
    at = F.lit(T(20)).cast("timestamp_ntz")
    events = propagate.updates(hist, propagate.edge_table(spark, view))
    assert events.count() == 2
    assert propagate.waves(events, hist, view, fns, at, append) == [2, 2]
    values = {(r.entity_key, r.feature_name): r.value for r in state["history"].collect()}
    assert values["u=1", "c"] == 22.0 and values["u=2", "c"] == 33.0
    assert propagate.waves(events, state["history"], view, fns, at, append) == []  # replays add nothing
    done = state["history"].where("feature_name = 'c'")
    acc = propagate.accounting(done.select("entity_key"), done).first()
    assert (acc.planned, acc.entities, acc.skipped) == (2, 2, 0) and acc.max_lag_seconds > 0


def test_model_feature(spark):
    hist = spark.createDataFrame([(0, "u", "v", 1, "a", 1, 2.0, None, T(1), T(1), None, None, None, None, None), (1, "u", "v", 1, "b", 1, 5.0, None, T(2), T(2), None, None, None, None, None), (2, "w", "v", 1, "b", 1, 1.0, None, T(2), T(2), None, None, None, None, None), (3, "x", "v", 1, "a", 1, 4.0, None, T(3), T(3), None, None, None, None, None)], HISTORY)
    obs = spark.createDataFrame([(k, T(9)) for k in "uwxy"], "entity_key string, observation_ts timestamp_ntz")
    args = dict(uri="mlflow://m/1", digest="sha256:d", output="s")
    run = lambda fn, **kw: models.model_feature(obs, hist, ["entity_key"], {"a": (1, True), "b": (1, False)}, fn, **(args | kw)).collect()
    got = {r.entity_key: r for r in run(lambda x: x["a"] + x["b"].fillna(0))}
    assert {k: r.value for k, r in got.items()} == {"u": 7.0, "x": 4.0}
    assert (got["u"].data_ts, got["u"].max_input_data_ts, got["u"].calc_ts) == (T(1), T(2), T(9)) and len(got["u"].input_fingerprint) == 64
    with pytest.raises(ValueError):
        run(lambda x: [], uri="http://x")
    with pytest.raises(Exception, match="returned 1 values"):
        models.predict(spark.range(3).select(F.col("id").cast("double").alias("a")).coalesce(1), ["a"], lambda x: [1.0]).collect()
    ok, bad = models.score_writes(spark.createDataFrame([("pd",), ("other",)], "feature_name string"), {"pd": 3})
    assert ok.first().feature_version == 3 and bad.first().error.startswith("not a score feature")


def test_batch_requests_are_checked_and_dealt(spark):
    from tidemark.operators import chunks

    items = spark.range(250).select(F.lit("j").alias("job_id"), F.col("id").alias("item_index"))
    out = chunks.check_batch(items, 100)
    assert {r.chunk_id: r["count"] for r in out.groupBy("chunk_id").count().collect()} == {"j:0": 100, "j:1": 100, "j:2": 50}
    assert chunks.by_chunk(out, 7).rdd.getNumPartitions() == 7
    for bad, size in ((items, 0), (items, 101), (items.limit(0), 10), (items.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(5)))), 10)):
        with pytest.raises(ValueError):
            chunks.check_batch(bad, size)
    assert chunks.check_batch(items.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(5)))), 10, manifest=True).count() == 1250


def test_labels_of_metrics_are_guarded(spark):
    from tidemark.operators import evaluate

    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), (None, 2.0, 3)], "kind string, v double, n int")
    assert {r.series: r.value for r in evaluate.counter(rows, "c", ["kind"], "v").collect()} == {"c{kind=a}": 4.0, "c{kind=null}": 2.0}
    assert evaluate.gauge(rows, "g", [], "v", "n").collect()[0].value == 2.0
    for bad in ("x" * 65, "S3://bucket", "a\nb", "{x"):
        with pytest.raises(Exception, match="no label may have"):
            evaluate.counter(spark.createDataFrame([(bad,)], "kind string"), "c", ["kind"]).collect()


def test_rejects_share_no_window_and_no_reference(spark):
    from tidemark.operators import imports

    lines = spark.createDataFrame([(i, "{oops" if i % 2 else '{"entity_key": {"u": "a"}, "event_ts": "2026-01-01T00:00:00Z", "payload": {"n": 1}}') for i in range(40)], "line long, value string")
    out = imports.land(imports.parse_reports(imports.number_lines(lines), ["u"], "s", "k"))
    rows = out.collect()
    assert [r.status for r in sorted(rows, key=lambda r: r.line)][:4] == ["written", "rejected", "duplicate", "rejected"]
    assert all(r.report_ref is None for r in rows if r.error) and len({r.report_ref for r in rows if not r.error}) == 1
    assert "CASE WHEN isnotnull(error" in out._jdf.queryExecution().optimizedPlan().toString()


def test_versions_meet_constraints():
    from tidemark.plans.promotion import satisfies

    assert satisfies("1.2.0", ">=1.2,<2") and satisfies("1.2", "==1.2.0") and not satisfies("1.10", "<1.9")
    for installed, text in (("1.0rc1", ">=1"), ("1", ""), ("1", ">=1,"), ("1", "~=1"), ("1", ">=1.*")):
        with pytest.raises(ValueError):
            satisfies(installed, text)
