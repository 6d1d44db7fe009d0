import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup, guard

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "k string, seq long, data_ts timestamp_ntz, max_input_data_ts timestamp_ntz, input_fingerprint string, available_at timestamp_ntz"


def sequential(rows):
    """The guard as a fold over arrivals, one by one."""
    held, out = {}, {}
    for k, seq, d, m, fp, av in sorted(rows, key=lambda r: r[1]):
        old = held.get(k)
        new = ((d, m or d), fp or "", av)
        if old is None or new[0] > old[0]:
            state = "written"
        elif new[0] < old[0]:
            state = "skipped_stale"
        elif new[1] != old[1] or (av and old[2] and av != old[2]):
            state = "written_recompute"
        else:
            state = "noop"
        if state.startswith("written"):
            held[k] = new
        out[seq] = state
    return out


def arrivals(seed, n=600):
    rng = random.Random(seed)
    day = lambda k: T0 + dt.timedelta(days=k)
    return [(rng.choice("abc"), i, day(rng.randint(0, 4)), rng.choice([None, day(5), day(6)]), rng.choice([None, "", "f1", "f2"]), rng.choice([None, day(1), day(2)])) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_the_sequential_rule_in_any_batches(spark, seed):
    rows = arrivals(seed)
    want = sequential(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.seq: r.outcome for r in guard.fold(df, ["k"]).collect()} == want
    held, got, cuts = None, {}, [0, 37, 300, 601]
    for lo, hi in zip(cuts, cuts[1:]):
        folded = guard.fold_batch(held, df.where(F.col("seq").between(lo, hi - 1)), ["k"])
        got |= {r.seq: r.outcome for r in folded.collect()}
        new = guard.latest(folded, ["k"]).drop("outcome") if held is None else guard.refresh(held, folded, ["k"])
        held = spark.createDataFrame(new.collect(), new.schema)
    assert got == want


def test_known_sequence_and_single_step(spark):
    day = lambda n: dt.datetime(2026, 1, n)
    rows = [("a", i, day(1), day(m), fp, None) for i, (m, fp) in enumerate([(10, "fp1"), (20, "fp2"), (5, "fp0"), (20, "fp2"), (20, "fp3")])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.outcome for r in guard.fold(df, ["k"]).orderBy("seq").collect()] == ["written", "written", "skipped_stale", "noop", "written_recompute"]
    col = lambda a: {"data_ts": F.lit(a[0]), "max_input_data_ts": F.lit(a[1]), "fingerprint": F.lit(a[2]), "available": F.lit(None).cast("timestamp")}
    step = lambda a, b, there=True: spark.range(1).select(guard.decide(col(a), col(b), F.lit(there))).first()[0]
    assert step((day(2), day(3), "x"), (day(1), day(9), "x")) == "written"
    assert step((day(1), day(3), None), (day(1), day(3), "")) == "noop"
    assert step((day(1), day(3), "x"), (day(1), day(3), "y"), False) == "written"


def test_budgeted_refresh(spark):
    df = spark.createDataFrame(arrivals(9, 50), SCHEMA)
    stored = df.limit(0)
    counts, _ = guard.guarded_refresh(stored, df, ["k"], ["seq"], budget=20)
    got = {r.outcome: r.n for r in counts.collect()}
    assert got["limited"] == 30 and sum(got.values()) == 50


def test_dedup_matrix(spark):
    cols = "ord int, entity_key string, view string, view_version int, feature_name string, feature_version int, data_ts int, value_json string, input_fingerprint string, available_at int"
    row = lambda o, ts=1, v="10", fp=None, av=None: (o, "e", "v", 1, "f", 1, ts, v, fp, av)
    hist = spark.createDataFrame([row(0, fp="fp1", av=5)], cols)
    cases = {1: (row(1), False), 2: (row(2, v="99"), True), 3: (row(3, ts=2), True), 4: (row(4, fp="fp2"), True), 5: (row(5, fp="fp1"), False), 6: (row(6, fp="fp1", av=6), True), 7: (row(7, av=5), False)}
    rows = spark.createDataFrame([r for r, _ in cases.values()], cols)
    assert {r.ord for r in dedup.new_rows(rows, hist).collect()} == {o for o, (_, keep) in cases.items() if keep}
    twice = spark.createDataFrame([row(1), row(2), row(3, fp="a"), row(4, fp="a")], cols)
    fresh, counts = dedup.partition(twice, hist.limit(0), ["ord"])
    assert {r.ord for r in fresh.collect()} == {1, 3} and tuple(counts.first()) == (4, 2, 2)


@pytest.mark.parametrize("seed", range(2))
def test_dedup_against_random_history(spark, seed):
    rng = random.Random(seed)
    make = lambda n: [(i, rng.choice("ab"), rng.randint(0, 3), rng.choice([None, "x", "y"]), rng.choice([None, 1, 2])) for i in range(n)]
    hist, rows = make(15), make(120)
    same = lambda a, b: a is None or b is None or a == b
    want = {r[0] for r in rows if not any(h[1:3] == r[1:3] and same(h[3], r[3]) and same(h[4], r[4]) for h in hist)}
    df = lambda x: spark.createDataFrame(x, "ord int, k string, t int, fp string, av int")
    assert {r.ord for r in dedup.new_rows(df(rows), df(hist), ["k", "t"], ["fp", "av"]).collect()} == want


def test_every_arrival_enters_a_daily_status(spark):
    from tidemark import queries

    d = "/root/testdata/sf0.001"
    got = {(r.user_id, r.data_ts) for r in queries.QUERIES["guard_status"](spark, d).collect()}
    assert got == {(r.user_id, r.data_ts) for r in queries.arrivals(spark, d).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_fold_in_stretches_equals_the_plain_fold(spark, seed):
    rows = arrivals(seed, 400)
    df = spark.createDataFrame(rows, SCHEMA)
    cut = guard.fold(df, ["k"], bucket=F.floor(F.col("seq") / 37))
    assert sorted((r.k, r.seq, r.outcome) for r in cut.collect()) == sorted((r.k, r.seq, r.outcome) for r in guard.fold(df, ["k"]).collect())
