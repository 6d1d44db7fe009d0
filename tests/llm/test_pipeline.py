import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidemark.llm import decontaminate, mix_flow, quality_fm  # noqa: E402

SF = "/root/testdata/sf0.001"


def near_copies(rows):
    word = re.compile(rb"[^\x20\x09-\x0d]+")
    sets = []
    for r in rows:
        w = word.findall((r.text or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    return [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in groups.values()]


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.collect()
    model = quality_fm.fit(docs, labels)
    metas = [r.m for r in docs.select(quality_fm.levels(docs).alias("m")).collect()]
    scores = model.scores([(r.text or "").encode() for r in rows], metas)
    rows = [r for r, s in zip(rows, scores) if s >= 0.7]
    rows = near_copies(rows)
    items = [decontaminate.words_of((r.text or "").encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    clean = []
    for r in rows:
        w = decontaminate.words_of((r.text or "").encode())
        if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            clean.append(r)
    out = corpus_pipeline.run(spark, SF).collect()
    known = {(r.doc_id, zlib.crc32((r.text or "").encode())): r for r in clean}
    got = Counter((r.doc_id, r.text_crc32) for r in out)
    assert set(got) <= set(known)
    size = Counter()
    for r in clean:
        size[r.source] += len((r.text or "").split())
    goal = mix_flow.targets(size, 1.5 * sum(size.values()))
    taken = Counter()
    for k, n in got.items():
        assert n <= 2
        taken[known[k].source] += n * len((known[k].text or "").split())
    longest = max(len((r.text or "").split()) for r in clean)
    assert all(abs(taken[s] - goal[s]) <= longest for s in size)
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontaminate", "mix", "shard"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), SF).columns == docs.columns
        more = docs.limit(30).drop("n_chars").withColumn("_id", F.lit("x")).withColumn("score", F.lit(1))
        assert stage(spark, more, SF).columns == more.columns  # columns beyond those of documents pass
