import random
import re

import numpy as np

from tidemark.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            p = words(t)
            for i in range(max(1, len(p) - window + 1) if p else 0):
                q = p[i : i + window]
                for at in range(len(w) - len(q) + 1):
                    if w[at : at + len(q)] == q:
                        hit |= set(range(at, at + len(q)))
                        found.add(item)
        out.append((doc, len(w), len(hit), len(found), d.digest(list(found)), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = d.report(d.contamination(df, bench, **more)).collect()
    kept = d.drop_contaminated(df, bench, **{k: v for k, v in more.items()}).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in out if not r.contaminated)
    return sorted((tuple(r) for r in out), key=str)


def cases():
    rng = random.Random(3)
    vocab = ["alpha", "été", "b2", "ccc", "Dd", "e", "f", "g9", "h", "ij"]
    say = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, say(rng.randint(3, 30))) for i in range(14)] + [(50, ""), (51, None), (7, "other text ccc e"), (52, "alpha alpha alpha")]
    docs = []
    for i in range(60):
        t = say(rng.randint(0, 60))
        if i % 3 == 0:
            p = words(rng.choice(items)[1])
            k = rng.randint(0, max(0, len(p) - 11))
            t += " ".join(p[k : k + rng.randint(9, 14)]).upper() + " " + say(5)
        docs.append((i, t))
    return docs + [(90, None), (91, ""), (None, say(40)), (5, docs[5][1]), (92, "alpha " * 20_000)], items


def test_matches_brute_force(spark):
    docs, items = cases()
    docs = docs[:-1] + [(92, "alpha " * 300)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, window=4) == brute(docs, items, 4)


def test_slices_of_a_large_benchmark_agree(spark):
    docs, items = cases()
    docs = docs[:-1]
    assert run(spark, docs, items, slice_bytes=300) == brute(docs, items)


def test_items_without_an_id_are_found_and_removed(spark):
    docs = [(1, "x one two three y"), (2, "four five"), (3, "nothing"), (4, "one two three four five six seven"), (5, "six seven")]
    items = [(None, "one two three"), (None, "four five"), (8, "six seven"), (9, "four five six")]
    out = run(spark, docs, items)
    assert out == brute(docs, items)
    assert [(r[0], r[2], r[3], r[5]) for r in out] == [(1, 3, 1, True), (2, 2, 1, True), (3, 0, 0, False), (4, 7, 3, True), (5, 2, 1, True)]
    assert out[0][4] == d.digest([]) and out[3][4] == d.digest([8, 9])
    assert run(spark, docs, items, slice_bytes=12) == out


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    assert run(spark, [(1, "a b c")], []) == brute([(1, "a b c")], [])


def test_index_parts():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 5, 300)
    s[::37] = 0
    zeros = iter(range(10**6))
    named = [(0, next(zeros)) if x == 0 else (1, x) for x in s.tolist()]
    assert d.suffix_array(s).tolist() == sorted(range(300), key=lambda i: named[i:])
    w = d.Wavelet(s, 5)
    assert w.access(np.arange(300)).tolist() == s.tolist()
    for x in range(5):
        assert w.rank(np.full(301, x), np.arange(301)).tolist() == [int((s[:i] == x).sum()) for i in range(301)]


def test_long_items_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(d, "PART", 12)
    docs, items = cases()
    items += [(60, items[0][1] + " " + items[1][1] + " " + items[2][1]), (60, items[3][1] * 3)]
    docs = docs[:20] + [(95, items[-1][1]), (96, items[-2][1][30:200])]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, window=3, slice_bytes=400) == brute(docs, items, 3)
