import copy
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.plans import credit, dag, promotion, registry

BASE = {
    "registry_version": "t",
    "entities": {"e": {"key_fields": ["id"]}},
    "sources": {s: {"type": "raw_report", "report_type": s, "ts_field": "t"} for s in ("sa", "sb")},
    "feature_views": {"v": {"entity": "e", "key_fields": ["id"], "view_version": 1, "owner": "o", "status": "active", "feature_groups": {"g": ["c", "a"]}, "features": {
        "a": {"kind": "udf", "feature_version": 1, "udf": "a", "inputs": ["sa"], "dtype": "int", "status": "active"},
        "b": {"kind": "udf", "feature_version": 2, "udf": "b", "inputs": ["sb"], "dtype": "int", "status": "live"},
        "c": {"kind": "udf", "feature_version": 1, "udf": "c", "deps": [{"feature": "a"}, {"feature": "b"}], "dtype": "int", "status": "live"},
        "s": {"kind": "udf", "feature_version": 1, "udf": "a", "inputs": ["sa"], "dtype": "int", "status": "shadow"},
        "score": {"kind": "model_score", "feature_version": 1, "dtype": "float", "status": "live"},
    }}},
}
FUNCTIONS = {"a": lambda s, d: s["sa"]["v"], "b": lambda s, d: s["sb"]["v"], "c": lambda s, d: F.coalesce(d["a"], F.lit(0)) + F.coalesce(d["b"], F.lit(0)) * 10}


def changed(path, value):
    data = copy.deepcopy(BASE)
    at = data
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return data


FEATURES = ("feature_views", "v", "features")


@pytest.mark.parametrize("path,value,why", [
    (("extra",), 1, "unknown keys"), (("sources", "sa"), {"type": "x", "report_type": "r", "ts_field": "t"}, "unknown type"),
    (("feature_views", "v", "entity"), "zz", "unknown entity"), (("feature_views", "v", "key_fields"), ["other"], "differ"),
    ((*FEATURES, "a", "inputs"), ["zz"], "unknown source"), ((*FEATURES, "c", "deps"), ["zz"], "unknown feature"),
    ((*FEATURES, "c", "deps"), [{"feature": "b", "version": 1}], "pins"), ((*FEATURES, "c", "deps"), ["s"], "may not depend"),
    ((*FEATURES, "a", "status"), "weird", "unknown status"), ((*FEATURES, "score", "inputs"), ["sa"], "from outside"), ((*FEATURES, "a", "kind"), "sql", "unknown kind"),
    (("feature_views", "v", "feature_groups"), {"g": ["zz"]}, "unknown feature"), (("feature_views", "v", "max_dependency_depth"), 9, "depth cap"), ((*FEATURES, "a", "feature_version"), 0, "from 1"),
    ((*FEATURES, "c", "deps"), [{"feature": "a", "propagation": "x"}], "propagation"), ((*FEATURES, "a", "deps"), ["c"], "cycle"),
])
def test_registry_rejects(path, value, why):
    with pytest.raises(registry.RegistryError, match=why):
        registry.build(changed(path, value))


def test_depth_cap():
    data = copy.deepcopy(BASE)
    features = data["feature_views"]["v"]["features"]
    for n, d in (("d1", "c"), ("d2", "d1"), ("d3", "d2")):
        features[n] = {"kind": "udf", "feature_version": 1, "udf": "a", "deps": [d], "dtype": "int", "status": "live"}
    with pytest.raises(registry.RegistryError, match="levels deep"):
        registry.build(data)
    data["feature_views"]["v"]["max_dependency_depth"] = 4
    assert registry.build(data).views["v"].order(["d3"])[-1] == "d3"


def test_yaml_planner_and_digest(tmp_path):
    import yaml

    (tmp_path / "r.yaml").write_text(yaml.safe_dump(BASE))
    r = registry.load(str(tmp_path / "r.yaml"))
    v = r.views["v"]
    p = registry.plan(v, ["b"], ["g"])
    assert p.outputs == ("b", "c", "a") and p.sources == ["sa", "sb"] and p.compute.index("c") == 2
    for args, why in ((([], []), "no features"), ((["zz"], []), "unknown feature"), (([], ["zz"]), "unknown feature group"), ((["score"], []), "not computed"), ((["s"], []), "shadow")):
        with pytest.raises(registry.RegistryError, match=why):
            registry.plan(v, *args)
    assert registry.plan(v, ["s"], allow_shadow=True).shadow == ("s",)
    data = copy.deepcopy(BASE)
    data["feature_views"]["v"]["features"] = dict(reversed(data["feature_views"]["v"]["features"].items()))
    data["feature_views"]["v"]["features"]["c"]["deps"] = ["b", {"feature": "a", "version": 1}]
    assert registry.digest(registry.build(data)) == registry.digest(r)
    assert registry.digest(registry.build(changed((*FEATURES, "a", "feature_version"), 2))) != registry.digest(r)
    for store in (registry.BundleStore(), registry.BundleStore(str(tmp_path / "b"))):
        key = store.publish(r)
        assert store.publish(r) == key and store.get(key)
        with pytest.raises(registry.RegistryError, match="other content"):
            store.put(key, {})


def test_promotion_rules(tmp_path):
    class Bundles:
        get = staticmethod({"b1": 1, "b2": 1}.get)

    day = lambda n: dt.datetime(2026, 1, n)
    s = promotion.Stages(Bundles, str(tmp_path))
    with pytest.raises(promotion.PromotionError, match="not published"):
        s.promote("zz", "prod", "shadow", "me", "r", day(1))
    s.promote("b1", "prod", "shadow", "me", "r", day(1))
    for kw, why in (({"profile": None}, "profile"), ({"profile": "bank", "approved_by": ["a", "a"]}, "approvers"), ({"profile": "bank", "approved_by": ["a", "b"]}, "days"), ({"profile": "bank", "approved_by": ["a", "b"], "override": " "}, "reason")):
        with pytest.raises(promotion.PromotionError, match=why):
            s.promote("b1", "prod", "live", "me", "r", day(3), **kw)
    assert s.promote("b1", "prod", "live", "me", "r", day(8), profile="bank", approved_by=["a", "b"]).previous is None
    assert s.promote("b2", "prod", "live", "me", "r", day(9), profile="energy", approved_by=["a"], override="urgent").override == "urgent"
    assert s.rollback("prod", "live", "me", "bad", day(10)).bundle == "b1" and s.current("prod", "live").bundle == "b1"
    assert [r.action for r in s.records] == ["promote"] * 3 + ["rollback"]
    back = promotion.Stages(Bundles, str(tmp_path))
    assert back.records == s.records and back.pointers == s.pointers
    with pytest.raises(promotion.PromotionError):
        s.rollback("dev", "live", "me", "r", day(1))


def entity(spark, a, b):
    """One entity: each source (value, day, available day) or None."""
    kind = "struct<v: int, report_ts: timestamp_ntz, content_hash: string, available_at: timestamp_ntz>"
    day = lambda n: n and dt.datetime(2026, 1, n)
    cell = lambda x: x and (x[0], day(x[1]), f"h{x[0]}", day(x[2]))
    return spark.createDataFrame([("1", cell(a), cell(b))], f"id string, sa {kind}, sb {kind}")


def run(spark, deps, a=(1, 10, 11), b=(2, 5, 12), at=dt.datetime(2026, 1, 20)):
    v = registry.build(changed((*FEATURES, "c", "deps"), deps)).views["v"]
    return dag.compute(entity(spark, a, b), registry.plan(v, ["c"]), FUNCTIONS, F.lit(at).cast("timestamp_ntz")).first().c


def test_dag_status_and_metadata(spark):
    day = lambda n: dt.datetime(2026, 1, n)
    both = [{"feature": "a"}, {"feature": "b"}]
    c = run(spark, both)
    assert (c.value, c.status, c.data_ts, c.max_input_data_ts, c.available_at, c.availability_source) == (21, "OK", day(5), day(10), day(12), "source_provided")
    c = run(spark, both, b=(2, 5, None))
    assert c.available_at is None and c.availability_source is None and c.status == "OK"
    assert run(spark, both, b=None).status == "SKIPPED" and run(spark, both, b=None).value is None
    soft = [{"feature": "a"}, {"feature": "b", "required": False}]
    c = run(spark, soft, b=None)
    assert (c.value, c.status, c.data_ts) == (1, "DEGRADED", day(10))
    old = 10 * 86400
    c = run(spark, [{"feature": "a"}, {"feature": "b", "required": False, "max_input_age_seconds": old}])
    assert (c.value, c.status) == (21, "DEGRADED")
    assert run(spark, [{"feature": "a"}, {"feature": "b", "max_input_age_seconds": old}]).status == "SKIPPED"
    assert run(spark, [{"feature": "a"}, {"feature": "b", "max_input_age_seconds": 15 * 86400}]).status == "OK"  # strict
    assert run(spark, [{"feature": "a", "required": False}, {"feature": "b", "required": False}], a=None, b=None).status == "SKIPPED"


def test_dag_reads_only_what_the_plan_needs(spark, tmp_path):
    v = registry.build(BASE).views["v"]
    entity(spark, (1, 10, 11), (2, 5, 12)).write.parquet(f"{tmp_path}/e")
    plan = registry.plan(v, ["a"])
    out = dag.results(dag.compute(spark.read.parquet(f"{tmp_path}/e"), plan, FUNCTIONS, F.lit(dt.datetime(2026, 1, 20)).cast("timestamp_ntz")), plan, ["id"])
    assert [(r.feature_name, r.value_json) for r in out.collect()] == [("a", "1")]
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "sb" not in text.split("ReadSchema")[1].split("\n")[0] and "Exchange" not in text
    with pytest.raises(registry.RegistryError, match="unknown function"):
        dag.compute(entity(spark, None, None), plan, {}, F.current_timestamp())


def test_arrow_tier_and_provider(spark):
    fn = dag.arrow_tier(lambda s, d: int(s["sa"]["v"]) * 3, "int", {"sa": ["v"]})
    v = registry.build(BASE).views["v"]
    out = dag.compute(entity(spark, (4, 10, 11), None), registry.plan(v, ["a"]), {"a": fn}, F.lit(dt.datetime(2026, 1, 20)).cast("timestamp_ntz"))
    assert out.first().a.value == 12
    with pytest.raises(registry.RegistryError):
        dag.load_functions("nowhere:x")
    with pytest.raises(registry.RegistryError):
        dag.load_functions("nocolon")


def test_credit_plan_end_to_end(spark):
    import json

    payloads = {
        "application_request": {"requested_amount": 12000, "term_months": 24},
        "tax_report": {"periods": [{"period": f"2026-{m:02d}", "taxable_income": 3000 + 100 * m} for m in range(12, 0, -1)]},
        "credit_bureau_report": {"report_ts": "2026-06-30T10:00:00+02:00", "bureau_score": 630, "active_loans": 1, "total_outstanding_amount": 9, "total_monthly_payment": 500, "max_dpd_12m": 45, "inquiries_30d": 2, "last_delinquency_date": "2026-05-01"},
        "telco_report": {"sim_age_days": 200, "active_days_30d": 30, "avg_monthly_topup": 9.5, "telco_score": 700},
        "socdem_report": {"age": 40, "region_code": "R01", "residence_tenure_months": 50},
    }
    rows = [("user_id=1|application_id=2", s, dt.datetime(2026, 6, 30), json.dumps(p), f"h-{s}", None, f"r-{s}") for s, p in payloads.items()]
    rows.append((rows[0][0], "application_request", dt.datetime(2026, 6, 1), json.dumps({"requested_amount": 1, "term_months": 1}), "old", None, "r-old"))
    reports = spark.createDataFrame(rows, "entity_key string, report_type string, report_ts timestamp_ntz, payload_json string, content_hash string, available_at timestamp_ntz, report_ref string")
    view = credit.view()
    plan = registry.plan(view, [], ["affordability"])
    got = dag.compute(credit.attach(reports.select("entity_key").distinct(), reports, plan.sources), plan, credit.FUNCTIONS, F.lit(dt.datetime(2026, 7, 1)).cast("timestamp_ntz")).first()
    income = [3000 + 100 * m for m in range(1, 13)]
    avg = sum(income) / 12
    std = round((sum((x - avg) ** 2 for x in income) / 12) ** 0.5, 6)
    total = round(min(1000 / avg, 10), 6)
    stable = round(1 / (1 + std / avg), 6)
    index = round(stable * (1 - total), 6)
    want = {"requested_monthly_payment": 500.0, "existing_payment_to_income": round(500 / avg, 6), "total_payment_to_income": total, "income_stability_index": stable, "recent_delinquency_flag": 1, "thin_file_flag": 1, "affordability_index": index, "combined_risk_index": round(0.5 * (1 - index) + 0.25 + 0.1 + 0.15 * (1 - 330 / 550), 6)}
    for name, value in want.items():
        assert abs(got[name].value - value) < 2e-6 and got[name].status == "OK", name
    assert len(view.features) == 30 and len(view.feature_groups) == 6


def test_command_line(tmp_path, capsys):
    import yaml

    from tidemark.__main__ import main

    (tmp_path / "r.yaml").write_text(yaml.safe_dump(BASE))
    reg, store = f"{tmp_path}/r.yaml", f"{tmp_path}/store"
    assert main(["validate", reg]) == 0 and main(["plan", reg, "v", "c"]) == 0
    assert "a, b, c" in capsys.readouterr().out
    assert main(["publish", reg, store]) == 0
    bundle = capsys.readouterr().out.strip()
    assert bundle == registry.digest(registry.load(reg))
    assert main(["promote", store, bundle, "prod", "shadow", "--actor", "me", "--reason", "r"]) == 0
    assert main(["promote", store, bundle, "prod", "live", "--actor", "me", "--reason", "r", "--profile", "bank"]) == 1
    assert main(["promote", store, bundle, "prod", "live", "--actor", "me", "--reason", "r", "--profile", "energy", "--approved-by", "x"]) == 0
    (tmp_path / "bad.yaml").write_text("{}")
    assert main(["validate", f"{tmp_path}/bad.yaml"]) == 1
