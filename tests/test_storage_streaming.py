import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import guard
from tidemark.sources import history, readers
from tidemark.streaming import pipelines

from test_guard_dedup import SCHEMA, arrivals, sequential


def test_log_numbers_rows_across_commits(spark, tmp_path):
    log = history.Log(spark, f"file://{tmp_path}/log")
    with pytest.raises(FileNotFoundError):
        log.read()
    rows = spark.range(50).select(F.concat(F.lit("e"), F.col("id") % 3).alias("entity_key"), F.col("id").alias("n"))
    assert log.append(rows.where("n < 20").repartition(4), ["n"]) == 20
    assert log.append(rows.limit(0), ["n"]) == 0 and len(log.commits()) == 1
    assert log.append(rows.where("n >= 20").repartition(3), ["n"]) == 30
    assert all(r.row_id == r.n for r in log.read().collect()) and log.read().count() == 50
    assert [r.n for r in log.entity("e1", n=4).collect()] == [4]
    (tmp_path / "log" / "commit=9").mkdir()  # an unpublished commit is not read
    assert log.read().count() == 50


def test_lookups(spark):
    online = spark.createDataFrame([("k", "a", 1.0), ("k", "b", 2.0)], "k string, feature_name string, value double")
    got = {r.k: (r["values"], r.missing) for r in history.lookup(online, spark.createDataFrame([("k",), ("z",)], "k string"), ["k"], ["a", "c"]).collect()}
    assert got == {"k": ({"a": 1.0}, ["c"]), "z": (None, ["a", "c"])}
    req = spark.createDataFrame([("r1", ["a", "b"]), ("r2", ["a"])], "request_id string, requested_features array<string>")
    res = spark.createDataFrame([("r1", "a", 1.0)], "request_id string, feature_name string, value double")
    out = {r.request_id: (r.missing, r.result_missing) for r in history.request_results(req, res).collect()}
    assert out == {"r1": (["b"], False), "r2": (["a"], True)}
    items = spark.createDataFrame([("m", 0), ("m", 0), ("m", 1)], "manifest_id string, item_index int")
    assert [r.item_index for r in history.add_items(items.limit(1), items).collect()] == [1]


def test_stream_equals_batch_and_survives_a_rerun(spark, tmp_path):
    rows = arrivals(5, 300)
    for i in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 75 == i], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    start = lambda: pipelines.guarded_latest(stream, f"file://{tmp_path}/t", f"{tmp_path}/cp", ["k"]).awaitTermination()
    start()
    start()  # nothing new: nothing changes
    table = pipelines.Versioned(spark, f"file://{tmp_path}/t")
    want = {r.k: r.seq for r in guard.latest(guard.fold(spark.createDataFrame(rows, SCHEMA), ["k"]), ["k"]).collect()}
    assert {r.k: r.seq for r in table.read(1 << 30).collect()} == want
    outcomes = {r.seq: r.outcome for r in spark.read.parquet(f"{tmp_path}/t_outcomes").collect()}
    assert len(outcomes) == 300 and set(outcomes.values()) <= set(sequential(rows).values())


def test_router_splits_poison(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join([json.dumps({"event_type": "x", "n": 1}), "poison", json.dumps({"event_type": "other"})]))
    seen = []
    q = pipelines.route(readers.event_stream(spark, f"{tmp_path}/in"), {"x": lambda df, n: seen.append(df.count())}, f"{tmp_path}/dead", f"{tmp_path}/cp")
    q.awaitTermination()
    assert seen == [1] and {r.failure_status for r in spark.read.parquet(f"{tmp_path}/dead").collect()} == {"not_json", "unknown_event_type"}


def test_of_racing_writers_one_wins_and_keeps_its_rows(spark, tmp_path):
    one, two = (history.Log(spark, f"file://{tmp_path}/log") for _ in range(2))
    rows = spark.range(10).select(F.lit("e").alias("entity_key"), F.col("id").alias("n"))
    late = one.stage(rows, ["n"])  # staged, but another writer publishes first
    assert two.append(rows.where("n < 4"), ["n"]) == 4
    with pytest.raises(FileExistsError):
        one.publish(*late)
    assert sorted(r.n for r in two.read().collect()) == [0, 1, 2, 3]
    assert one.append(rows.where("n >= 4"), ["n"]) == 6
    assert sorted((r.row_id, r.n) for r in one.read().collect()) == [(i, i) for i in range(10)]
    assert len([p for p in (tmp_path / "log").iterdir() if p.name.startswith("data-")]) == 2


def test_history_of_a_view(spark, tmp_path):
    from tidemark.plans import registry
    from tidemark.queries import WAVE

    known = registry.build(WAVE)
    log = history.Log(spark, f"file://{tmp_path}/log")
    log.append(spark.createDataFrame([("u", "activity", 1, "click", 1), ("u", "activity", 2, "click", 1), ("u", "other", 1, "x", 1)], "entity_key string, view string, view_version int, feature_name string, feature_version int"))
    assert history.view_history(log, known, "activity").count() == 2 and history.view_history(log, known, "activity", 1, "click").count() == 1
    for wrong in (("none",), ("activity", 9), ("activity", None, "none")):
        with pytest.raises(KeyError):
            history.view_history(log, known, *wrong)
    with pytest.raises(KeyError):
        history.lookup(spark.range(1), spark.range(1), ["id"], ["a"], known=["b"])


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    table = pipelines.Versioned(spark, f"file://{tmp_path}/t")
    rows = spark.range(500).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    table.write(1, rows, ["k"])
    one = rows.where("k = 7").select(table.bucket(["k"]).alias("b")).first().b
    held = table.read(1, [one])
    assert 0 < held.count() < 60
    table.write(2, held.withColumn("v", F.lit(1)), ["k"])
    assert [p.name for p in (tmp_path / "t" / "v=2").iterdir() if p.is_dir()] == [f"_bucket={one}"]
    assert table.read(2).count() == 500 and table.read(2).agg(F.sum("v")).first()[0] == held.count()
    assert table.read(1).agg(F.sum("v")).first()[0] == 0


def test_publish_and_subscribe_by_topic(spark, tmp_path):
    events = spark.range(3).select(F.col("id"), F.lit("x").alias("event_type"))
    assert pipelines.publish(events, f"{tmp_path}/log", "a", "id", {"origin": "test"}) == 3
    assert pipelines.publish(events, f"{tmp_path}/log", "b", "id") == 3 and pipelines.publish(events, f"{tmp_path}/log", "c", "id") == 3
    got = []
    stream = pipelines.subscribe(spark, f"{tmp_path}/log", ["a", "b"])
    stream.writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.topic, r.key) for r in got) == [(t, str(i)) for t in "ab" for i in range(3)]
    assert {json.dumps(r.headers) for r in got if r.topic == "a"} == {'{"origin": "test"}'} and json.loads(got[0].value)["event_type"] == "x"


def test_payloads_are_put_as_canonical_text(spark, tmp_path):
    from tidemark.operators import reports

    rows = spark.createDataFrame([("u1", '{"b": 1, "a": "é"}'), ("u2", "[1, 2]")], "storage_uri string, payload_json string")
    reports.put_payloads(rows, f"{tmp_path}/p")
    assert {r.storage_uri: r.payload_json for r in reports.get_payloads(spark, f"{tmp_path}/p").collect()} == {"u1": '{"a":"é","b":1}', "u2": "[1,2]"}
    with pytest.raises(Exception, match="not JSON"):
        reports.put_payloads(spark.createDataFrame([("u", "{")], rows.schema), f"{tmp_path}/q")
