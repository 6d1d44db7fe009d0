"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents in a task.  Its text is the sequence of word numbers of the phrases' vocabulary, with one 0
for any stretch of other words, which no phrase can cross, and between documents.  Over it an FM-index is built: suffix array by prefix doubling, Burrows-Wheeler transform, a wavelet matrix with
bit ranks, and suffix positions sampled at every eighth place and at each run's start.  All phrases are searched
backwards together; occurrences are located by walking to a sampled row, and overlapping spans are merged.

Phrases are the windows of `window` item words (an item of fewer words is one).  They are held by each task in slices
of about `slice_bytes` of benchmark text; a larger benchmark takes several passes whose spans are merged, so what is
sent to tasks is bounded whatever the benchmark's size.  Items of more than `PART` words are cut into parts that overlap
by a window less a word, and parts are dealt to slices by their texts, so no item, long or repeated, fills a slice.
Time grows with the number of slices: documents are indexed once for each.

Edge cases: null or wordless texts have no words and no hits; items without words have no phrases; repeated item
texts each count; repeated rows are judged alike, each on its own; items whose id is null are phrases like all others and
count as one item together, but have no name in the digest; ids are whole numbers; a null doc_id is kept; other columns pass through `flag`, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

SHARD = 1 << 20
SAMPLE = 8
PART = 1 << 15  # words of an item that one row holds
#: A-Z to a-z; bytes that are not of words to a space.  UTF-8 bytes from 0x80 are of words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of non-negative numbers; each 0 counts as a letter of its own, smaller than all others, by place.

    Prefix doubling: a suffix's rank is where its group of equal prefixes starts in the order, so only suffixes in
    groups of several are sorted again, and those become few after the first rounds."""
    n = len(s)
    zeros = s == 0
    start = np.where(zeros, np.cumsum(zeros) - 1, s.astype(np.int64) + int(zeros.sum()))
    counts = np.bincount(start) if n else np.empty(0, np.int64)
    rank = (np.cumsum(counts) - counts)[start]
    open_, k = np.flatnonzero(counts[start] > 1), 1
    while len(open_):
        after = np.where(open_ + k < n, rank[np.minimum(open_ + k, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + after
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        head = rank[open_]
        place = np.arange(len(open_))
        group = np.maximum.accumulate(np.where(np.append(True, head[1:] != head[:-1]), place, 0))
        new = np.append(True, key[1:] != key[:-1])
        own = np.maximum.accumulate(np.where(new, place, 0))
        rank[open_] = head + own - group
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone]
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Bits:
    """A bit vector with rank in constant time: packed words and a count before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.append(bits, np.zeros(-n % 64 + 64, bool)), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.cumsum(np.append(0, np.bitwise_count(self.words[:-1])), dtype=np.int64)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet matrix: for each binary digit, from the highest, a bit vector, then a stable split by the digit."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        for d in range(self.depth - 1, -1, -1):
            bit = (s >> d & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[~bit], s[bit]])

    def _down(self, k: int, one: np.ndarray, i: np.ndarray) -> np.ndarray:
        r = self.levels[k].rank(i)
        return np.where(one, self.zeros[k] + r, i - r)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i."""
        start = np.zeros_like(i)
        for k in range(self.depth):
            one = (symbol >> (self.depth - 1 - k) & 1).astype(bool)
            i, start = self._down(k, one, i), self._down(k, one, start)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for k in range(self.depth):
            one = self.levels[k].get(i)
            out = out << 1 | one
            i = self._down(k, one, i)
        return out


class FMIndex:
    def __init__(self, s: np.ndarray, sigma: int):
        sa = suffix_array(s)
        self.first = np.cumsum(np.append(0, np.bincount(s, minlength=sigma)))
        self.bwt = Wavelet(s[sa - 1], sigma)
        kept = (sa % SAMPLE == 0) | (s[sa - 1] == 0) | (sa == 0)
        self.marks, self.places = Bits(kept), sa[kept]
        self.size = len(s)

    def ranges(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that start with each phrase; phrases are padded on the left."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        width = phrases.shape[1]
        live = np.arange(len(phrases))
        for step in range(width):
            live = live[(sizes[live] > step) & (lo[live] < hi[live])]
            if not len(live):
                break
            symbol = phrases[live, width - 1 - step]
            lo[live] = self.first[symbol] + self.bwt.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.bwt.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(left):
            found = self.marks.get(rows)
            out[left[found]] = self.places[self.marks.rank(rows[found])] + steps
            left, rows = left[~found], rows[~found]
            if len(rows):
                symbol = self.bwt.access(rows)
                rows = self.first[symbol] + self.bwt.rank(symbol, rows)
            steps += 1
        return out


class Phrases:
    """The windows of a benchmark's items, as word numbers from 1."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.vocab: dict[bytes, int] = {}
        seen: dict[tuple, list[int | None]] = {}
        for item, text in items:
            w = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in words_of(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                own = seen.setdefault(tuple(w[i : i + window]), [])
                if not own or own[-1] != item:
                    own.append(item)
        self.items = [list(set(x)) for x in seen.values()]
        self.sizes = np.array([len(p) for p in seen], np.int64)
        width = int(self.sizes.max()) if seen else 0
        self.table = np.zeros((len(seen), width), np.int64)
        for row, p in zip(self.table, seen):
            row[width - len(p) :] = p


def occurrences(ids: np.ndarray, docs: np.ndarray, places: np.ndarray, phrases: Phrases):
    """(document, first word, phrase) of all occurrences in a shard of runs, which zeros part."""
    none = (np.empty(0, np.int64),) * 3
    if not len(ids) or not len(phrases.items):
        return none
    index = FMIndex(ids, len(phrases.vocab) + 1)
    lo, hi = index.ranges(phrases.table, phrases.sizes)
    count = hi - lo
    if not count.sum():
        return none
    which = np.repeat(np.arange(len(lo)), count)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]
    at = index.locate(rows)
    return docs[at], places[at], which


def runs(ids: np.ndarray, starts: np.ndarray):
    """Of a batch's word numbers: the runs of vocabulary words within one document, a 0 after each."""
    live = ids > 0
    edge = np.append(True, live[1:] != live[:-1])
    edge[starts[:-1][starts[:-1] < len(ids)]] = True
    at = np.flatnonzero(edge)
    long = np.diff(np.append(at, len(ids)))
    keep = live[at]
    at, long = at[keep], long[keep]
    room = long + 1
    index = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + np.repeat(at, room)
    last = np.cumsum(room) - 1
    out = ids[np.minimum(index, max(len(ids) - 1, 0))]
    out[last] = 0
    doc = np.searchsorted(starts, np.repeat(at, room), side="right") - 1
    return out, doc, index - starts[doc]


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    return list(zip(starts[new].tolist(), ends[np.append(new[1:] - 1, len(ends) - 1)].tolist()))


def _scan(phrases: Phrases, schema: pa.Schema):
    def flush(rows, shard):
        ids, docs, places = (np.concatenate(x) for x in zip(*shard)) if shard else (np.empty(0, np.int64),) * 3
        doc, first, which = occurrences(ids, docs, places, phrases)
        spans, items = [[] for _ in rows], [[] for _ in rows]
        order = np.argsort(doc, kind="stable")
        doc, first, which = doc[order], first[order], which[order]
        cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(doc)) if len(doc) else []):
            spans[doc[lo]] = [{"start": a, "end": b} for a, b in _merged(first[lo:hi], first[lo:hi] + phrases.sizes[which[lo:hi]])]
            items[doc[lo]] = sorted({i for p in np.unique(which[lo:hi]).tolist() for i in phrases.items[p]}, key=lambda i: (i is None, i))
        key, words = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((key, words, spans, items), schema)], schema=schema)

    def run(batches):
        number, rows, shard, held = phrases.vocab.get, [], [], 0
        for batch in (x for whole in batches for x in c.pieces(whole, 1)):
            words = [words_of(t) for t in c.as_bytes(batch.column(1))]
            starts = np.cumsum([0] + [len(w) for w in words])
            ids = np.fromiter((i for w in words for i in map(number, w, repeat(0))), np.int64, int(starts[-1]))
            if len(ids) and phrases.items:
                out, doc, place = runs(ids, starts)
                shard.append((out, doc + len(rows), place))
                held += len(out)
            rows += zip(batch.column(0).to_pylist(), [len(w) for w in words])
            if held >= SHARD or len(rows) >= 50_000:
                yield flush(rows, shard)
                rows, shard, held = [], [], 0
                c.release()
        if rows:
            yield flush(rows, shard)

    return run


def _slices(benchmark: DataFrame, item_col: str, text_col: str, window: int, slice_bytes: int):
    """The benchmark's items in slices, each a list of (item, text); at least one."""
    bench = benchmark.select(F.col(item_col).cast("long").alias("item"), c.text_of(text_col).alias("text"))
    # only long texts are cut; two bytes are the least of a word and its gap
    words = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    long = bench.where(F.octet_length("text") > 2 * PART).select("item", words.alias("w"))
    long = long.select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(PART))).alias("at"))
    long = long.select("item", F.array_join(F.slice("w", F.col("at") + 1, F.lit(PART + window - 1)), " ").alias("text"))
    bench = c.materialize(bench.where(F.octet_length("text") <= 2 * PART).union(long).distinct(), "phrases")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total // slice_bytes))
    at = F.pmod(F.xxhash64("item", "text"), F.lit(slices))
    return slices, ([(i, t.encode()) for i, t in bench.where(at == k).orderBy("item", "text").collect()] for k in range(slices))


OUT = "id long, n_words long, spans array<struct<start: long, end: long>>, items array<long>"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, slice_bytes: int = 8 << 20) -> DataFrame:
    """One row per input row: id, n_words, spans (merged, in words, end exclusive) and the items that occur in it."""
    slices, parts = _slices(benchmark, item_col, item_text_col, window, slice_bytes)
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.int64()))])
    flat = c.bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if slices > 1:  # rows need a name by which the passes' results meet
        flat = c.materialize(flat.withColumn("row", F.monotonically_increasing_id()), "rows")
        names = flat.select("row", "id")
        flat = flat.select(F.col("row").alias("id"), "text")
    found = None
    for part in parts:
        one = flat.mapInArrow(c.tidy(_scan(Phrases(part, window), schema)), OUT)
        found = one if found is None else found.union(one)
    if slices > 1:
        found = found.groupBy("id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        start = F.array_sort("spans")
        grow = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x)))
        found = found.withColumn("spans", F.aggregate(start, F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"), grow))
        found = names.join(found.withColumnRenamed("id", "row"), "row").select("id", "n_words", "spans", "items")
    return found.withColumnRenamed("id", id_col)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest columns of `contamination`: counts, the items' digest and the verdict."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10, slice_bytes: int = 8 << 20) -> DataFrame:
    """The rows of `docs` without any occurrence, all columns as they were.

    Judges rows where they stand: a whole benchmark of one slice takes no shuffle."""
    _, parts = _slices(benchmark, "item_id", "text", window, slice_bytes)
    columns = c.bounded_batches(docs).columns
    spot = columns.index(text_col)
    for part in parts:
        docs = docs.mapInArrow(c.tidy(_clean(Phrases(part, window), spot)), docs.schema)
    return docs


def _clean(phrases: Phrases, spot: int):
    def flush(batches, shard):
        ids, docs, places = (np.concatenate(x) for x in zip(*shard)) if shard else (np.empty(0, np.int64),) * 3
        bad = np.unique(occurrences(ids, docs, places, phrases)[0])
        seen = 0
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[bad[(bad >= seen) & (bad < seen + b.num_rows)] - seen] = False
            seen += b.num_rows
            yield b.filter(pa.array(keep))

    def run(batches):
        number, kept, shard, held, rows, size = phrases.vocab.get, [], [], 0, 0, 0
        for batch in (x for whole in batches for x in c.pieces(whole, spot)):
            words = [words_of(t) for t in c.as_bytes(batch.column(spot))]
            starts = np.cumsum([0] + [len(w) for w in words])
            ids = np.fromiter((i for w in words for i in map(number, w, repeat(0))), np.int64, int(starts[-1]))
            if len(ids) and phrases.items:
                out, doc, place = runs(ids, starts)
                shard.append((out, doc + rows, place))
                held += len(out)
            kept.append(batch)
            rows += batch.num_rows
            size += batch.nbytes
            if held >= SHARD or size >= 64 << 20:
                yield from flush(kept, shard)
                kept, shard, held, rows, size = [], [], 0, 0, 0
                c.release()
        yield from flush(kept, shard)

    return run


def digest(items: list[int | None]) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in items if i is not None)).encode()).hexdigest()
