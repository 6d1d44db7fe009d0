import random
import zlib

import numpy as np

from tidemark.llm import quality_fm as q


def test_identity_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = q.Machine(0.3, rng.normal(size=q.SIZE), rng.normal(size=(q.SIZE, q.RANK)))
    at, x = next(q.features([b"Some words, and some MORE words!\nsome 12"]))
    pairs = sum(float(m.v[at[i]] @ m.v[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert abs(m.margin(at, x)[0] - (0.3 + m.w[at] @ x + pairs)) < 1e-8


def tables(spark, n=600):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("aeiorstln") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 80))]
        bad = i % 3 == 0
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words).capitalize() + "."
        docs.append((i, text, "en", "s", 0.0))
        labels.append((i, 0 if bad else 1, 0))
    docs += [(n, None, None, None, None), (n + 1, "", "en", "s", 1.0), (None, "fine words", "en", "s", 1.0), docs[4]]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double"), spark.createDataFrame(labels + [(n + 5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_rows(spark):
    docs, labels = tables(spark)
    out = q.quality(docs, labels).collect()
    assert len(out) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    judged = [r.predicted == truth[r.doc_id] for r in out if r.held_out and r.doc_id in truth]
    assert len(judged) > 100 and np.mean(judged) > 0.97
    again = {(r.doc_id, r.score) for r in q.quality(docs, labels).collect()}
    assert again == {(r.doc_id, r.score) for r in out}


def test_labels_of_held_out_rows_and_metadata_do_not_matter(spark):
    from pyspark.sql import functions as F

    docs, labels = tables(spark, 200)
    flipped = labels.withColumn("quality", F.when(q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("y"))
    assert {tuple(r) for r in q.quality(docs, labels).collect()} == {tuple(r) for r in q.quality(other, flipped).collect()}


def test_keep_good_and_empty_tables(spark):
    docs, labels = tables(spark, 200)
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns and 100 < kept.count() < 160
    none = spark.createDataFrame([], docs.schema)
    assert q.quality(none, labels).collect() == [] and q.keep_good(none, labels).collect() == []
    assert {r.score for r in q.quality(docs, spark.createDataFrame([], labels.schema)).collect()} == {0.5}


def test_metadata_has_a_level_for_every_case(spark):
    df = spark.createDataFrame([(None, "a"), (-3, "7"), (0, None), (1, "1e400"), (2, " 12 "), (1 << 60, "x")], "n_chars long, other string")
    assert [r[0][0] for r in df.select(q.levels(df)).collect()] == [0, 1, 1, 2, 3, q.LEVELS - 1]
    text = df.select(df.other.alias("n_chars"))
    assert [r[0][0] for r in text.select(q.levels(text)).collect()][0] == 0
    none = df.select("other")
    assert {bytes(r[0]) for r in none.select(q.levels(none)).collect()} == {bytes(len(q.METADATA))}


def test_repeated_ids_and_long_texts_stay_bounded_on_the_driver(spark):
    docs, labels = tables(spark, 120)
    many = docs.union(docs.where("doc_id = 5")).union(docs.where("doc_id = 5"))
    a, b = q.fit(docs, labels), q.fit(many, labels.union(labels))
    assert a.w0 == b.w0 and (a.w == b.w).all()
    at, _ = next(q.features([b" ".join(b"w%d" % i for i in range(200_000))]))
    assert len(at) <= q.WORDS + q.STATS + len(q.METADATA)


def test_held_out_labels_of_the_corpus(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = q.quality(docs, labels).join(labels, "doc_id").where("held_out and quality is not null").select("score", "quality").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    auc = np.mean([(g > x) + 0.5 * (g == x) for g in good for x in bad])
    print(f"held-out rows {len(rows)}, AUC {auc:.3f}")
    assert auc > 0.95
