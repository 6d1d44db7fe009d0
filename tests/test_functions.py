import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import casts, digests, keys, scoring


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_entity_key_order_and_errors(spark):
    parts = {"user_id": F.lit("u1"), "application_id": F.lit(7)}
    assert one(spark, keys.entity_key(parts))[0] == "application_id=7|user_id=u1"
    assert one(spark, keys.entity_key(parts, ["user_id", "application_id"]))[0] == "user_id=u1|application_id=7"
    for bad, why in (("a|b", "reserved"), ("a=b", "reserved"), ("  ", "blank"), (None, "blank")):
        row = one(spark, keys.key_error({"k": F.lit(bad)}).alias("e"), keys.entity_key({"k": F.lit(bad)}).alias("k"))
        assert why in row.e and row.k is None
    with pytest.raises(ValueError):
        keys.entity_key(parts, ["user_id"])
    assert one(spark, keys.key_part(F.lit("a=1|b=2"), "b"))[0] == "2"


def test_digests_match_python(spark):
    for value, kind in ((12, "int"), ('a"é\n', "string"), (None, "string"), (True, "bool")):
        text = json.dumps(value, separators=(",", ":"), ensure_ascii=False)
        assert one(spark, digests.value_hash(digests.canonical_json(F.lit(value).cast({"int": "int", "string": "string", "bool": "boolean"}[kind]), kind)))[0] == "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    raw = '{"b": [1, 2.50, "x"], "a": null}'
    df = spark.createDataFrame([(raw,), ("{",), (None,), ('{"x": NaN}',)], "t string").coalesce(1)
    assert [r[0] for r in df.select(digests.canonical_text("t")).collect()] == ['{"a":null,"b":[1,2.5,"x"]}', None, None, None]
    at = F.lit("2026-01-02 03:04:05.000006").cast("timestamp")
    got = one(spark, digests.input_fingerprint([("source:b", at, F.lit("h2"), F.lit(True)), ("source:a", at, F.lit("h1"), F.lit(True)), ("x:v1", at, F.lit("h"), F.lit(False))]), F.unix_micros(at))
    assert got[0] == hashlib.sha256(f'[["source:a",{got[1]},"h1"],["source:b",{got[1]},"h2"]]'.encode()).hexdigest()


def test_idempotency_key_ignores_order(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    k = lambda g, f, h: one(spark, digests.idempotency_key(F.lit("app"), F.lit("u=1"), g, f, h))[0]
    assert k(a("g2", "g1"), a("f"), a("h1", "h2")) == k(a("g1", "g2"), a("f"), a("h2", "h1"))
    assert k(a("g1"), a("f"), a("h1")).startswith("app:u=1:g1:") and k(a("g1"), a("f"), a("h1")) != k(a("g1"), a("f"), a("h3"))


def test_casts(spark):
    cases = [("int", "12", "12"), ("int", " 7 ", "7"), ("int", "1.0", None), ("float", "1.5", "1.5"), ("float", "x", None), ("bool", "YES", "true"), ("bool", "0", "false"), ("bool", "on", None), ("json", '{"a":1}', '{"a":1}'), ("json", "{", None), ("string", " x ", " x "), ("string", "  ", None)]
    for kind, raw, want in cases:
        row = one(spark, casts.convert(F.lit(raw), kind).alias("v"), casts.convert_error(F.lit(raw), kind).alias("e"))
        assert row.v == want and row.e == (want is None and raw.strip() != ""), (kind, raw, row)
    assert one(spark, casts.parse_zoned(F.lit("2026-01-01T00:00:00+02:00")))[0] is not None
    assert one(spark, casts.parse_zoned(F.lit("2026-01-01T00:00:00")))[0] is None
    with pytest.raises(ValueError):
        casts.convert(F.lit("x"), "date")


def test_scalar_features_match_python(spark):
    rng = random.Random(0)
    rows = [([(f"2026-{m:02d}", rng.choice([0, rng.randint(0, 5000)])) for m in rng.sample(range(1, 13), rng.randint(1, 12))],) for _ in range(40)]
    df = spark.createDataFrame(rows, "p array<struct<period:string,taxable_income:int>>").coalesce(1)
    t = lambda n: scoring.trailing(F.col("p"), n)
    got = df.select(scoring.fixed_mean(t(3), 3), scoring.fixed_mean(t(12), 12), scoring.spread(t(12)), scoring.trend(t(6)), scoring.count_positive(t(12))).collect()
    for (p,), g in zip(rows, got):
        x = [v for _, v in sorted(p)]
        x12, x6 = x[-12:], x[-6:]
        mean, six = sum(x12) / len(x12), sum(x6) / 6
        want = [sum(x[-3:]) / 3, sum(x12) / 12, math.sqrt(sum((v - mean) ** 2 for v in x12) / len(x12)), 0.0 if six <= 0 else (sum(x6[3:]) / 3 - sum(x6[:3]) / 3) / six, sum(v > 0 for v in x12)]
        assert all(abs(a - b) < 1e-6 for a, b in zip(g, want)), (p, g, want)


def test_ratios_flags_and_scores(spark):
    L = F.lit
    row = one(spark, scoring.safe_ratio(L(3), L(0)), scoring.capped_ratio(L(3.0), L(0.0)), scoring.capped_ratio(L(300.0), L(2.0)), scoring.stability(L(0.0), L(1.0), L(5)), scoring.recent_delinquency(L(180), L(30)), scoring.thin_file(L(1), L(364)), scoring.days_since(L("2026-03-01T23:00:00-05:00"), L("2026-02-01")), scoring.days_since(L("2026-03-01"), L(None)), scoring.logistic(L(1000.0)), scoring.logistic(L(0.0)), scoring.decision(L(0.1)), scoring.decision(L(0.3)))
    assert list(row) == [None, 10.0, 10.0, 0.0, 1, 1, 28, 9999, 1.0, 0.5, "review", "decline"]


def test_rounding_equals_python_on_ties_and_edges(spark):
    import random

    from tidemark.functions import scoring

    rng = random.Random(1)
    xs = [0.0, -0.0, 0.0078125, 0.0234375, -0.0078125, 0.1234565, 2.5e-7, 5e-7, 1.5e-6, -1234.5678905, 4294967295.1234567, 1e15, -3e300]
    xs += [rng.uniform(-1, 1) * 10 ** rng.randint(-7, 9) for _ in range(3000)] + [round(rng.uniform(0, 100), 6) + 5e-7 for _ in range(3000)] + [rng.randint(0, 10**6) / 128 for _ in range(1000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [(r.x, r.y) for r in df.select("x", scoring.round_exact(df.x).alias("y")).collect()]
    assert all(y == round(x, 6) for x, y in got if abs(x) < 2**32), [(x, y, round(x, 6)) for x, y in got if y != round(x, 6)][:5]
    assert all(y == x for x, y in got if abs(x) >= 2**32)


def test_scaled_rounding_equals_c(spark):
    rng = random.Random(2)
    xs = [0.0, -0.0, 5e-7, -5e-7, 1.5e-6, 2.5e-6, -2.5e-6, 0.49999949999999997, 1e15, 9.1e15, -3e300, 1e305, -1e305, math.inf, -math.inf]
    xs += [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 20) for _ in range(3000)] + [s * (rng.randint(0, 10**6) + 0.5) / 1e6 for s in (1, -1) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")

    def want(x):
        y = x * 1e6
        if math.isinf(y):
            return x
        whole = math.trunc(y)
        return math.copysign(abs(whole) + (abs(y - whole) >= 0.5), y) / 1e6

    got = [(r.x, r.y) for r in df.select("x", scoring.round_scaled(df.x).alias("y")).collect()]
    assert [(x, y, want(x)) for x, y in got if repr(y) != repr(want(x))] == []
    assert math.isnan(one(spark, scoring.round_scaled(F.lit(math.nan)))[0])
    assert one(spark, scoring.round_scaled(F.lit(None).cast("double")))[0] is None


def test_days_need_a_report_date(spark):
    assert list(one(spark, scoring.days_since(F.lit(None).cast("string"), F.lit("2026-02-01")), scoring.days_since(F.lit(None).cast("string"), F.lit(None)))) == [None, 9999]


def test_digests_and_payloads(spark, tmp_path):
    import gzip
    import hashlib

    import pytest

    from tidemark.operators import models
    from tidemark.sources import readers

    pinned = "sha256:" + hashlib.sha256(b"m").hexdigest()
    assert models.check_digest(b"m", pinned) == pinned
    with pytest.raises(ValueError, match="pinned"):
        models.check_digest(b"n", pinned)
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(b'{"x": 1}'))
    objects = readers.payload_objects(spark, str(tmp_path))
    uri = objects.first().storage_uri
    assert readers.payload(objects, uri) == '{"x": 1}'
    with pytest.raises(KeyError):
        readers.payload(objects, "none")
