import zlib
from collections import Counter, defaultdict

from tidemark.llm import hilbert_shard as h


def test_curve_visits_every_cell_by_single_steps():
    for bits, dims in ((2, 2), (3, 3), (4, 3)):
        index = h.curve(bits, dims)
        assert sorted(index) == list(range(1 << bits * dims))
        at = sorted(range(len(index)), key=index.__getitem__)
        split = lambda c: [c >> bits * (dims - 1 - d) & (1 << bits) - 1 for d in range(dims)]
        assert all(sum(abs(a - b) for a, b in zip(split(p), split(q))) == 1 for p, q in zip(at, at[1:]))


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, shard int, hash string")
    return h.hilbert_shards(df, **more)


def check(out, rows, n=8):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(n)]
    assert set(slots) <= set(range(n)) and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in out)


def test_shards_are_even_runs_of_the_curve(spark):
    for n in (0, 1, 7, 8, 9, 203):
        rows = [(i if i % 9 else None, "té " * (i * i % 300) if i % 5 else None, [None, "en", "de"][i % 3], "s0" if i % 3 else f"s{i}") for i in range(n)]
        rows += rows[: n // 4]
        check(run(spark, rows).collect(), rows)
    ranges = h.pruning_ranges(run(spark, rows)).collect()
    assert sum(r.n_rows for r in ranges) == len(rows)


def test_one_cell_holds_all(spark):
    rows = [(i, "same", "en", "s0") for i in range(100)]
    check(run(spark, rows, slices=4).collect(), rows)
    got = h.report(run(spark, rows)).columns
    assert got[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
