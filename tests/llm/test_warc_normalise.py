import gzip
import io
import os
import zlib

from tidemark.llm import warc_normalise as w


def brute(rows):
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        keep = best.get(h or "")
        again = keep is not None and keep != i
        out.append((i, len(p), w.digest(p), "revisit" if again else "response", keep if again else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/ü b\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (6, "%zz", "x" * 3_000_000), (7, "u", "<p>é</p>"), (7, "u", "<p>é</p>"), (None, "u", "<p>é</p>"), (None, "u", "only"), (9, "u", "tail"), (10, "http://x/a%20b?c=%25", "q")]


def df(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha string, keep int")


def test_round_trip(spark):
    for more in ({}, {"file_bytes": 1}, {"broadcast_rows": 0}):
        got = sorted((tuple(r) for r in w.round_trip(df(spark, ROWS), **more).collect()), key=str)
        assert got == brute(ROWS)


def test_empty_table(spark):
    assert w.round_trip(df(spark, [])).collect() == []


def test_files_are_streams_then_members_with_sidecars(spark, tmp_path):
    whole, split = f"file://{tmp_path}/whole", f"file://{tmp_path}/split"
    archives = w.write(df(spark, ROWS).coalesce(1), whole)
    index = w.normalise(archives, whole, split).collect()
    (stream,) = os.listdir(tmp_path / "whole")
    raw = (tmp_path / "whole" / stream).read_bytes()
    one = zlib.decompressobj(wbits=31)
    text = one.decompress(raw)
    assert not one.unused_data and text.count(b"WARC-Record-ID") == len(ROWS)
    assert {r.path for r in index} == {p for p in os.listdir(tmp_path / "split") if not p.endswith(".idx")}
    path = index[0].path
    members = (tmp_path / "split" / path).read_bytes()
    assert gzip.decompress(members) == text
    side = [tuple(map(int, x.split())) for x in (tmp_path / "split" / f"{path}.idx").read_text().splitlines()]
    assert side == [(r.offset, r.length) for r in index] and sum(n for _, n in side) == len(members)
    urls = {r.page_id: r.url for r in w.read(spark.createDataFrame(index), split).collect() if r.page_id}
    assert urls[1] == ROWS[0][1] and urls[2] is None and urls[6] == "%zz" and urls[10] == "http://x/a%20b?c=%25"


def test_a_stream_that_compresses_well_is_inflated_in_steps():
    one = w.record(1, "u", b"0" * 300_000, "d", None, "2000-01-01T00:00:00Z")
    seen = []

    class Watch(bytearray):
        def __iadd__(self, more):
            seen.append(len(more))
            return super().__iadd__(more)

    w.bytearray = Watch
    try:
        got = list(w.records(io.BytesIO(gzip.compress(one * 100))))
    finally:
        del w.bytearray
    assert got == [one] * 100 and max(seen) <= w.PIECE


def test_damage_is_noticed():
    raw = w.record(1, "u", b"payload", w.digest(b"payload"), None, "2000-01-01T00:00:00Z")
    assert [w.parse(x)[0] for x in w.records(io.BytesIO(gzip.compress(raw + raw)))] == [1, 1]
    for bad in (raw[:-5], raw.replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n")):
        try:
            [w.parse(x) for x in w.records(io.BytesIO(gzip.compress(bad)))]
        except ValueError:
            continue
        raise AssertionError("not noticed")
