import random

from tidemark.llm import _common as c


def test_components_match_union_find(spark):
    rng = random.Random(2)
    for n, m in ((1, 0), (60, 40), (200, 190)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(30)]
        top = {}

        def find(x):
            while top.setdefault(x, x) != x:
                x = top[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
        want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
        got = {r.node: r.component for r in c.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == want
    assert c.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_written_tables_can_be_forgotten(spark):
    df = c.materialize(spark.range(3), "x")
    assert df.count() == 3
    path = c.shared_dir(spark)
    c.forget(spark)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tidemark")
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 5, None, "b" * 50, "c", "", "d" * 9])], ["i", "t"])
    parts = list(c.pieces(batch, 1, 10))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(6)) and len(parts) > 2
    assert list(c.pieces(batch.slice(0, 0), 1)) == []
