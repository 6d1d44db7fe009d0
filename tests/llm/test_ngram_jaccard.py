import random
import re

from tidemark.llm.ngram_jaccard import similar_groups

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def brute(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, cls string, n long")
    out = similar_groups(df).select("doc_id", "n_shingles", "component_id").collect()
    return sorted((tuple(r) for r in out), key=str)


def test_matches_brute_force_with_chains_and_common_passages(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows = []
    for base in range(12):
        words = [rng.choice(vocab) for _ in range(rng.randint(12, 120))]
        for _ in range(rng.randint(1, 12)):
            rows.append((len(rows), " ".join(words)))
            if rng.random() < 0.8:
                words = list(words)
                words[rng.randrange(len(words))] = rng.choice(vocab)  # drifts away step by step
        rows.append((len(rows), " ".join(passage + words[: rng.randint(0, 20)])))
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (5, "one"), (6, "a b c d"), (7, "a b c d e"), (None, "a b c d"), (8, "é É"), (9, "x " * 30_000), (10, "x x")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(None, None), (None, "only")]) == [(None, 0, None), (None, 1, None)]


def test_threshold_is_inclusive(spark):
    words = [f"a{i}" for i in range(13)]  # 9 shingles
    one = words[:12]  # 8 of 9 shared
    two = words[:12] + ["z"]  # 8 shared of 10: exactly 0.8
    rows = [(1, " ".join(words)), (2, " ".join(two)), (3, " ".join(one[:9]))]
    assert run(spark, rows) == brute(rows)


def test_a_cloud_of_near_copies_takes_several_stars(spark):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(3000)]
    seedling = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(150):
        words = list(seedling)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    assert run(spark, rows) == brute(rows)


def test_one_row_of_each_group_stays(spark):
    from tidemark.llm.ngram_jaccard import first_of_groups

    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (None, "a b c d e f"), (None, "only null"), (None, "only null"), (5, "other words"), (5, "third text"), (5, "third text"), (7, None), (7, ""), (8, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, _id string, _words long")
    out = first_of_groups(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, "A b c d e f"), (None, "only null"), (5, "other words"), (5, "third text"), (7, None), (7, ""), (8, "")], key=str)


def test_every_link_is_counted(spark):
    from tidemark.llm.ngram_jaccard import similarity_links

    rng = random.Random(13)
    vocab = [f"v{i}" for i in range(3000)]
    rows = [(None, None), (900, ""), (901, "alone")]
    for size, most, long in ((90, 4, 300), (4, 1, 60), (60, 3, 60)):  # a dense cloud, some near copies, a loose group
        seedling = [rng.choice(vocab) for _ in range(long)]
        for _ in range(size):
            words = list(seedling)
            for _ in range(rng.randint(0, most)):
                words[rng.randrange(long)] = rng.choice(vocab)
            rows += [(len(rows), " ".join(words))] * rng.choice([1, 1, 3])
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").split() for _, t in rows)]
    linked = lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y)
    want = [(d, min((e for (e, _), y in zip(rows, sets) if y == x), default=d) if x else d, sum(bool(linked(x, y)) for y in sets) - bool(x)) for (d, _), x in zip(rows, sets)]
    distinct = {frozenset(x) for x in sets if x}
    pairs = sum(bool(linked(x, y)) for x in distinct for y in distinct) - len(distinct)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = similar_groups(df, count_links=True, block=20).select("doc_id", "class_first", "n_links")  # cut into cells
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(want, key=str)
    ends = [tuple(r) for r in similarity_links(df).collect()]
    assert all(a < b for a, b in ends) and len(ends) == len(set(ends)) == pairs // 2
