"""Exact n-gram Jaccard join with size-banded tiles and bitmap signatures.

Plan, each step a shuffle of bounded units:

1. Every document becomes its set of hashed n-word shingles; equal sets share a *class*, so copies never meet as
   pairs.  Shingles move in packed arrays, at most one entry per shingle and flush of a task (map-side combine), in runs
   by class; rows of documents and sizes of classes travel beside them, dealt evenly.
2. By shingle range, shingles that two or more classes hold are *shared*.  Others cannot be in any intersection.
   Sent back by class, they leave each class its sorted array of shared shingles; a class with fewer than
   `threshold` of its set shared has no partner and is done.
3. Remaining classes enter tiles: (shingle of the prefix, size band).  Bands double in size; a set near a band's top
   also visits the next.  By the prefix principle all partners meet in some tile.
4. First each class is compared with one pivot of its tiles (a star, linear in rows) and what links is contracted;
   where large tiles still hold many components, with further pivots while that helps.  Then only pairs of
   different components in a tile are left.  Parity bitmaps bound each pair's overlap from above,
   (c1 + c2 - hamming) / 2, in stars and in tiles, before the exact intersection of the sorted arrays.
5. Links are counted on demand.  They all lie within components, so the classes of each component are cut into blocks
   and every two blocks meet in a cell, where bitmaps bound all pairs and those left are intersected exactly.

Nothing is dropped or capped: a link between classes of one component is redundant for components, all others are
verified exactly; with the count, or as `links`, each link is.  Shingles and classes are 64-bit hashes; a shared
shingle goes by 40 bits and its range's number, 43 bits with eight ranges, more with more.  Two shingles of one set of n
share a number with a chance of n * n / 2 ** 44 (a text of 20 000 words: 1 in 44 000); such a set counts one less in
common, which matters only to a pair exactly at the threshold.

Edge cases: null or wordless text has an empty set and links with nothing; texts shorter than `n` words are one
shingle; repeated rows and equal texts share a class; ids are whole numbers; a null id takes part but is never a
component's id (which is null if no member has one); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c

FLUSH = (1_000_000, 3_000_000)  # shingles a task holds before it deals them: more with more ranges, within these bounds
RANGE = 32 << 20  # bytes of input whose shingles make a range
WORDS = 8  # of a bitmap
BLOCK = 1024  # classes of a component that meet as one side of a cell
_ODD = np.random.default_rng(20240601).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEPT = np.uint64(40)  # bits that name a shingle within its range
_LOW = np.uint64((1 << 40) - 1)
PIECES = 4  # of a range of shingles, a power of two
_WIDE = 7  # bytes of a shingle's number: 40 bits within its range, 16 for the range
PACKED = "part int, kind int, a binary, b binary, d binary"


def shingles(words: np.ndarray, starts: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; `starts` are offsets into `words`, one more than documents."""
    size = len(words)
    whole = np.zeros(max(size - n + 1, 0), np.uint64)
    for i in range(n):
        whole += words[i : i + len(whole)] * _ODD[i]
    whole = c.mix(whole)
    out = []
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if hi - lo >= n:
            out.append(np.unique(whole[lo : hi - n + 1]))
        elif hi > lo:
            short = np.append(words[lo:hi] * _ODD[: hi - lo], _ODD[32 + (hi - lo) % 32]).sum(dtype=np.uint64, keepdims=True)
            out.append(c.mix(short))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    """A hash of a set, never 0; 0 is the empty set's."""
    if not len(s):
        return 0
    total = c.mix(s ^ _ODD[60]).sum(dtype=np.uint64, keepdims=True) + np.array([len(s)], np.uint64) * _ODD[61]
    return int(c.mix(total)[0]) or 1


def _row(part, kind, a, b=b"", d=b""):
    return part, kind, a, b, d


def _batch(rows):
    cols = list(zip(*rows)) or [[]] * 5
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["part", "kind", "a", "b", "d"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names)


def _range_of(classes: np.ndarray, parts: int) -> np.ndarray:
    return (classes >> np.uint64(40)).astype(np.int64) * parts >> 24


def _planes(tokens: np.ndarray, size: int) -> bytes:
    """Numbers of `size` bytes as planes of their low words and their higher bytes; planes of few values compress."""
    high = [(tokens >> np.uint64(8 * i)).astype(np.uint8).tobytes() for i in range(4, size)]
    return tokens.astype(np.uint32).tobytes() + b"".join(high)


def _numbers(raw: bytes, size: int) -> np.ndarray:
    n = len(raw) // size
    out = np.frombuffer(raw, np.uint32, n).astype(np.uint64)
    for i in range(4, size):
        out |= np.frombuffer(raw, np.uint8, n, i * n).astype(np.uint64) << np.uint64(8 * i)
    return out


def _runs(sorted_names: np.ndarray):
    """(names, first places, lengths) of the runs of a sorted array."""
    first = np.flatnonzero(np.append(True, sorted_names[1:] != sorted_names[:-1])) if len(sorted_names) else np.empty(0, np.int64)
    return sorted_names[first], first, np.diff(np.append(first, len(sorted_names)))


def _by_class(classes: np.ndarray, tokens: np.ndarray, parts: int):
    """Rows of (classes, counts, tokens), each pair once, dealt by the class's top bits."""
    order = np.lexsort((tokens, classes))
    classes, tokens = classes[order], tokens[order]
    new = np.append(True, (classes[1:] != classes[:-1]) | (tokens[1:] != tokens[:-1]))
    classes, tokens = classes[new], tokens[new]
    names, first, counts = _runs(classes)
    cuts = np.searchsorted(_range_of(names, parts), np.arange(parts + 1))
    ends = np.append(first, len(classes))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        lo, hi = cuts[p], cuts[p + 1]
        yield _row(p, 1, names[lo:hi].tobytes(), counts[lo:hi].astype(np.uint32).tobytes(), _planes(tokens[ends[lo] : ends[hi]], _WIDE))


def _flush(ids, keys, sets, parts, turn):
    """Rows of one flush: its documents (dealt in turn, kind 2), its classes' sizes (3), and its pairs of shingle and
    class, by range of shingle (0), or, where classes of the flush meet in a shingle, by class (1); of such a shingle
    one entry without a class tells its range that others share it."""
    classes = np.array([class_of(s) for s in sets], np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    known = np.array([i is not None for i in ids], np.int64)
    own = np.array([i or 0 for i in ids], np.int64)
    for lo in range(0, len(ids), 4096):
        at = slice(lo, lo + 4096)
        yield _row((turn + lo // 4096) % parts, 2, np.stack([own[at], known[at], np.array(keys[at], np.int64)]).tobytes(), classes[at].tobytes(), sizes[at].tobytes())
    uniq, first = np.unique(classes, return_index=True)
    first = first[uniq > 0]
    uniq = uniq[uniq > 0]
    if not len(uniq):
        return
    to = _range_of(uniq, parts)
    cuts = np.searchsorted(to, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        yield _row(p, 3, uniq[cuts[p] : cuts[p + 1]].tobytes(), sizes[first[cuts[p] : cuts[p + 1]]].tobytes())
    tok = np.concatenate([sets[i] for i in first.tolist()])
    idx = np.repeat(np.arange(1, len(first) + 1, dtype=np.uint32), sizes[first])  # 0: no class
    order = np.argsort(tok)
    tok, idx = tok[order], idx[order]
    del order
    same = tok[1:] == tok[:-1]
    met = np.append(same, False) | np.append(False, same)
    lead = met & ~np.append(False, same)
    shift = np.uint64(64 - (parts.bit_length() - 1))
    if met.any():
        yield from _by_class(uniq[idx[met] - 1], tok[met] & _LOW | (tok[met] >> shift) << _KEPT, parts)
    idx[lead] = 0
    keep = ~met | lead
    tok, idx = tok[keep], idx[keep]
    cuts = np.searchsorted((tok >> shift).astype(np.int64), np.arange(parts + 1))
    uniq = np.append(np.zeros(1, np.uint64), uniq)
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        at = idx[cuts[p] : cuts[p + 1]]
        order = np.argsort(at, kind="stable")
        used, _, counts = _runs(at[order])
        yield _row(p, 0, uniq[used].tobytes(), counts.astype(np.uint32).tobytes(), _planes(tok[cuts[p] : cuts[p + 1]][order], 5))


def _mapper(n: int, parts: int):
    most = min(max(FLUSH[0], parts << 15), FLUSH[1])

    def run(batches):
        ids, keys, sets, held, turn = [], [], [], 0, 0
        for batch in (x for whole in batches for x in c.pieces(whole, 1)):
            texts = c.as_bytes(batch.column(1))
            words = [t.lower().split() for t in texts]
            starts = np.cumsum([0] + [len(w) for w in words])
            hashed = c.hash_words([x for w in words for x in w])
            new = shingles(hashed, starts, n)
            del words, hashed
            for i, k, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), new):
                ids.append(i)
                keys.append(k)
                sets.append(s)
                held += len(s)
                if held >= most or len(ids) >= 60_000:
                    turn = turn or int(keys[0]) % parts
                    yield from (_batch([row]) for row in _flush(ids, keys, sets, parts, turn))
                    turn += 1 + len(ids) // 4096
                    ids, keys, sets, held = [], [], [], 0
                    c.release()
        if ids:
            yield from (_batch([row]) for row in _flush(ids, keys, sets, parts, turn or int(keys[0]) % parts))

    return run


def _share(parts: int):
    """Of one range of shingles: those of two classes or more, dealt by class; other rows pass.  The range is sorted in
    pieces, so that only a piece is held unpacked."""

    def run(key, table):
        part = key[0].as_py()
        out, packed = [], []
        for kind, a, b, d in zip(*(table.column(x).to_pylist() for x in ("kind", "a", "b", "d"))):
            (out if kind else packed).append(_row(part, kind, a, b, d))
        for piece in range(PIECES if packed else 0):
            toks, owners = [], []
            for _, _, a, b, d in packed:
                tok = _numbers(d, 5)
                own = (tok >> _KEPT - np.uint64(PIECES.bit_length() - 1)) == piece
                toks.append(tok[own])
                owners.append(np.repeat(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32))[own])
            tok, own = np.concatenate(toks), np.concatenate(owners)
            if not len(tok):
                continue
            order = np.argsort(tok)
            tok, own = tok[order], own[order]
            at = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
            many = np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)
            shared = np.repeat(many, np.diff(np.append(at, len(tok)))) & (own > 0)
            if shared.any():
                out += _by_class(own[shared], tok[shared] | np.uint64(part) << _KEPT, parts)
        c.release()
        return pa.Table.from_batches([_batch(out)])

    return run


def _gather(need_of):
    """Of one range of classes: the classes with enough shared shingles (kind 1); documents pass (kind 0)."""

    def run(key, table):
        ids, keys, doc_class, doc_n, classes, tokens, known, sizes = [], [], [], [], [], [], [], []
        for kind, a, b, d in zip(*(table.column(x).to_pylist() for x in ("kind", "a", "b", "d"))):
            if kind == 2:
                own, valid, key_of = np.frombuffer(a, np.int64).reshape(3, -1)
                keys.append(key_of)
                ids.append(pa.array(own, mask=valid == 0))
                doc_class.append(np.frombuffer(b, np.uint64))
                doc_n.append(np.frombuffer(d, np.int64))
            elif kind == 3:
                known.append(np.frombuffer(a, np.uint64))
                sizes.append(np.frombuffer(b, np.int64))
            else:
                classes.append(np.repeat(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32)))
                tokens.append(_numbers(d, _WIDE))
        cls = np.concatenate(doc_class) if doc_class else np.empty(0, np.uint64)
        n = np.concatenate(doc_n) if doc_n else np.empty(0, np.int64)
        out_ids = pa.concat_arrays(ids) if ids else pa.array([], pa.int64())
        kept_c, kept_n, kept_t = [], [], []
        if classes:
            own, tok = np.concatenate(classes), np.concatenate(tokens)
            del classes, tokens
            order = np.argsort(own, kind="stable")
            own, tok = own[order], tok[order]
            names, at, counts = _runs(own)
            u, first = np.unique(np.concatenate(known), return_index=True)
            size = np.concatenate(sizes)[first[np.searchsorted(u, names)]]
            for name, lo, k, m in zip(names.tolist(), at.tolist(), counts.tolist(), size.tolist()):
                if k >= need_of(m):
                    t = np.unique(tok[lo : lo + k])
                    if len(t) >= need_of(m):
                        kept_c.append(name), kept_n.append(m), kept_t.append(_planes(t, _WIDE))
        k = len(kept_c)
        signed = np.concatenate([cls, np.array(kept_c, np.uint64)]).view(np.int64)
        return pa.table({
            "kind": pa.array(np.repeat([0, 1], [len(cls), k]), pa.int32()),
            "id": pa.concat_arrays([out_ids, pa.nulls(k, pa.int64())]),
            "key": pa.concat_arrays([pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)), pa.nulls(k, pa.int64())]),
            "cls": pa.array(signed),
            "n": pa.array(np.concatenate([n, np.array(kept_n, np.int64)])),
            "toks": pa.concat_arrays([pa.nulls(len(cls), pa.binary()), pa.array(kept_t, pa.binary())]),
        })

    return run


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity bits of a token array, as words of 64."""
    bit = (c.mix(tokens) & np.uint64(64 * WORDS - 1)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=64 * WORDS) & 1).astype(np.uint8)).view(np.int64)


def _bitmaps(batches):
    """(cls, n, c, b0, b1, ...) of each class."""
    for batch in batches:
        tokens = [_numbers(raw, _WIDE) for raw in batch.column(2).to_pylist()]
        bits = np.array([bitmap(t) for t in tokens], np.int64).reshape(-1, WORDS)
        size = pa.array([len(t) for t in tokens], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, *(pa.array(np.ascontiguousarray(b)) for b in bits.T)], ["cls", "n", "c", *(f"b{i}" for i in range(WORDS))])


def _tiles(pct: int):
    """Prefix rows: (tok, band, cls, pos), pos the token's place in the class."""

    def run(batches):
        for batch in batches:
            tok, size, band, cls, pos = [], [], [], [], []
            for name, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                t = _numbers(raw, _WIDE).astype(np.int64)
                prefix = t[: len(t) - -(-pct * n // 100) + 1]
                top = n.bit_length()
                for x in [top] + [top + 1] * (100 * n >= pct * (1 << top)):
                    tok.append(prefix), size.append(len(prefix)), band.append(x), cls.append(name), pos.append(np.arange(len(prefix)))
            if tok:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tok)), pa.array(np.repeat(band, size), pa.int64()), pa.array(np.repeat(cls, size), pa.int64()), pa.array(np.concatenate(pos), pa.int64())], ["tok", "band", "cls", "pos"])

    return run


def _verify(pct: int):
    def run(batches):
        for batch in batches:
            a, b, na, nb, ta, tb = (batch.column(i).to_pylist() for i in range(6))
            ok = []
            for m, n, x, y in zip(na, nb, ta, tb):
                both = len(np.intersect1d(_numbers(x, _WIDE), _numbers(y, _WIDE), assume_unique=True))
                ok.append(100 * both >= pct * (m + n - both))
            keep = [i for i, k in enumerate(ok) if k]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    return run


def _meet(x, y, pct: int) -> np.ndarray:
    """Which classes of x link with which of y; x and y are (sizes, token arrays, bitmaps)."""
    (m, s, u), (n, t, v) = x, y
    cx, cy = np.array([len(a) for a in s], np.int64), np.array([len(a) for a in t], np.int64)
    hamming = np.zeros((len(s), len(t)), np.int64)
    for i in range(WORDS):
        hamming += np.bitwise_count(u[:, i, None] ^ v[None, :, i])
    bound = np.minimum((cx[:, None] + cy[None, :] - hamming) // 2, np.minimum(cx[:, None], cy[None, :]))
    total = m[:, None] + n[None, :]
    open_ = bound * (100 + pct) >= total * pct
    rows, cols = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    hit = np.zeros_like(open_)
    if 8 * open_.sum() < len(rows) * len(cols) or len(rows) * len(cols) < 64:
        for i, j in np.argwhere(open_).tolist():
            both = len(np.intersect1d(s[i], t[j], assume_unique=True))
            hit[i, j] = both * (100 + pct) >= total[i, j] * pct
        return hit
    # many pairs: overlaps of all at once, as a product of 0-1 matrices over slices of their tokens
    flat = np.concatenate([s[i] for i in rows] + [t[j] for j in cols])
    owner = np.repeat(np.arange(len(rows) + len(cols)), np.concatenate([cx[rows], cy[cols]]))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    at = np.cumsum(np.append(False, flat[1:] != flat[:-1]))
    both = np.zeros((len(rows), len(cols)), np.int64)
    for lo in range(0, int(at[-1]) + 1, 4096):
        a, b = np.searchsorted(at, [lo, lo + 4096])
        has = np.zeros((len(rows) + len(cols), int(at[b - 1]) + 1 - lo), np.float32)
        has[owner[a:b], at[a:b] - lo] = 1
        both += (has[: len(rows)] @ has[len(rows) :].T).astype(np.int64)
    hit[np.ix_(rows, cols)] = both * (100 + pct) >= total[np.ix_(rows, cols)] * pct
    return hit & open_


def _cell(pct: int, pairs: bool):
    """Of the classes of a cell, as (a, b): its links, or each class that has any with the documents it links to."""

    def run(table):
        side = table.column("side").to_numpy()
        cls, n, w = (table.column(x).to_numpy() for x in ("cls", "n", "w"))
        toks = [_numbers(raw, _WIDE) for raw in table.column("toks").to_pylist()]
        bits = np.array([bitmap(t) for t in toks], np.int64).reshape(-1, WORDS).view(np.uint64)
        part = lambda at: (n[at], [toks[i] for i in at.tolist()], bits[at])
        cut = lambda at: [at[i : i + BLOCK] for i in range(0, len(at), BLOCK)]
        left, right = cut(np.flatnonzero(side == 0)), cut(np.flatnonzero(side == 1))
        alone = table.column("lo")[0] == table.column("hi")[0]
        total, out = np.zeros(len(cls), np.int64), []
        for i, x in enumerate(left):
            for y in left[i:] if alone else right:
                hit = _meet(part(x), part(y), pct)
                if x is y:
                    hit = np.triu(hit, 1)
                if pairs:
                    at = np.argwhere(hit)
                    out.append((cls[x[at[:, 0]]], cls[y[at[:, 1]]]))
                else:
                    total[x] += hit @ w[y]
                    total[y] += w[x] @ hit
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2
            a, b = np.minimum(a, b), np.maximum(a, b)
        else:
            a, b = cls[total > 0], total[total > 0]
        c.release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _all_links(held: DataFrame, classes: DataFrame, pct: int, pairs: bool, block: int) -> DataFrame:
    """(a, b) of every link between classes, a < b, or (cls, others): the documents of other classes each links to.

    `classes` has (cls, comp, weight).  Components of more than a block are cut by a hash of the class; the smaller
    ones share cells, where classes of different components do not link."""
    size = c.materialize(classes.groupBy("comp").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    placed = c.materialize(classes.join(size, "comp").select("cls", "comp", "m", F.col("weight").alias("w")), "placed")
    small = placed.where(F.col("m") <= block).agg(F.count("*")).first()[0]
    bins = max(1, -(-small // block))
    k = F.ceil(F.col("m") / block).cast("int")
    rows = held.join(placed, "cls").withColumn("k", k).withColumn("own", F.when(F.col("k") > 1, F.pmod(F.xxhash64("cls"), F.col("k"))).otherwise(0).cast("int"))
    rows = rows.withColumn("comp", F.when(F.col("k") > 1, F.col("comp")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(bins))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cells = rows.select((F.col("k") > 1).alias("cut"), "comp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cls", "n", "w", "toks")
    found = cells.groupBy("cut", "comp", "lo", "hi").applyInArrow(_cell(pct, pairs), "a long, b long")
    return found if pairs else found.groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("others"))


def _over(x: str, y: str):
    """By their bitmaps, the most shingles that classes x and y can share: (c1 + c2 - hamming) / 2, and the smaller set."""
    hamming = sum((F.bit_count(F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}"))) for i in range(WORDS)), F.lit(0))
    return F.least((F.col(f"{x}.c") + F.col(f"{y}.c") - hamming) / 2, F.col(f"{x}.c"), F.col(f"{y}.c"))


def _links(pairs: DataFrame, held: DataFrame, pct: int, sketch: DataFrame | None = None) -> DataFrame:
    """Of pairs (a, b), those that link: bounded by bitmaps if there are any, then intersected exactly."""
    if sketch is not None:
        x, y = sketch.alias("x"), sketch.alias("y")
        fits = _over("x", "y") * (100 + pct) >= (F.col("x.n") + F.col("y.n")) * pct
        pairs = pairs.join(x, F.col("a") == F.col("x.cls")).join(y, F.col("b") == F.col("y.cls")).where(fits).select("a", "b")
    left = held.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    right = held.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ta", "tb")
    return full.mapInArrow(c.tidy(_verify(pct)), "a long, b long")


def _nearest(star: DataFrame) -> DataFrame:
    """Of (tok, band, cls, pivot): for each class the pair (a, b) with the pivot it shares most tiles with."""
    shared = star.groupBy("cls", "pivot").agg(F.count("*").alias("shared"))
    best = shared.groupBy("cls").agg(F.max_by("pivot", F.struct("shared", "pivot")).alias("a"))
    return best.select("a", F.col("cls").alias("b"))


def _merge(label: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, comp, weight) after links: each component goes to the heaviest that a link joins it to (of equals the
    smaller), and on to where that goes.  Cheaper than full components and enough to thin out what tiles compare."""
    rank = lambda x: F.struct(F.col(f"{x}.weight").alias("w"), F.bitwise_not(F.col(f"{x}.comp")).alias("o"))
    ends = links.join(label.alias("x"), F.col("a") == F.col("x.cls")).join(label.alias("y"), F.col("b") == F.col("y.cls")).where("x.comp <> y.comp")
    low, high = F.least(rank("x"), rank("y")), F.greatest(rank("x"), rank("y"))
    up = ends.select(F.bitwise_not(low["o"]).alias("u"), high.alias("top")).groupBy("u").agg(F.max("top").alias("top"))
    up = c.materialize(up.select("u", F.bitwise_not(F.col("top.o")).alias("v")), "up")
    for _ in range(2):
        on = up.select(F.col("u").alias("v"), F.col("v").alias("far"))
        up = up.join(on, "v", "left").select("u", F.coalesce("far", "v").alias("v"))
    up = c.materialize(up, "up")
    moved = label.join(up.withColumnRenamed("u", "comp"), "comp", "left").select("cls", F.coalesce("v", "comp").alias("comp"))
    moved = c.materialize(moved, "moved")
    weight = c.materialize(moved.groupBy("comp").agg(F.count("*").alias("weight")), "weight")
    return moved.join(weight, "comp").select("cls", "comp", "weight")


def _mixed(tiles: DataFrame, label: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows of tiles with several components (big: the largest of them); pairs and rows at stake."""
    placed = tiles.join(label, "cls")
    by = placed.groupBy("tok", "band", "comp").agg(F.count("*").alias("m"), F.max("weight").alias("weight"))
    by = by.groupBy("tok", "band").agg(F.sum("m").alias("m"), F.max_by(F.struct("comp", "m"), F.struct("weight", "comp")).alias("big"), F.count("*").alias("comps"))
    by = by.where("comps > 1").select("tok", "band", F.col("big.comp").alias("big"), ((F.col("m") - F.col("big.m")) * F.col("m")).alias("pairs"), "m")
    apart = c.materialize(placed.join(c.materialize(by, "mixed"), ["tok", "band"]), "apart")
    sums = apart.agg(F.sum(F.col("pairs") / F.col("m")), F.count("*")).first()
    return apart.drop("pairs", "m", "weight"), int(sums[0] or 0), sums[1]


def text_key(text_col: str = "text"):
    """By this and the id, a text's row finds its result again without the text."""
    return F.xxhash64(c.text_of(text_col))


def _grouped(docs: DataFrame, id_col: str, text_col: str, n: int, pct: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, key, cls, n), the classes that may have partners (cls, n, toks), and (cls, comp) of those that have some."""
    parts = c.partitions_for(c.bounded_batches(docs), RANGE, docs.sparkSession.sparkContext.defaultParallelism, 1 << 16)
    need = lambda m, pct=pct: max(1, -(-pct * m // 100))
    flat = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), text_key(text_col).alias("key"))
    packed = flat.mapInArrow(c.tidy(_mapper(n, parts)), PACKED)
    shared = packed.groupBy("part").applyInArrow(_share(parts), PACKED)
    gathered = shared.groupBy("part").applyInArrow(_gather(need), "kind int, id long, key long, cls long, n long, toks binary")
    gathered = c.materialize(gathered, "shingles", "kind")
    rows = gathered.where("kind = 0").select("id", "key", "cls", "n")
    held = gathered.where("kind = 1").select("cls", "n", "toks")
    tiles = held.mapInArrow(c.tidy(_tiles(pct)), "tok long, band long, cls long, pos long")

    sketch = c.materialize(held.mapInArrow(c.tidy(_bitmaps), "cls long, n long, c long, " + ", ".join(f"b{i} long" for i in range(WORDS))), "sketch")

    # the star: each class meets one pivot, the one it shares most tiles with
    meet = tiles.groupBy("tok", "band").agg(F.min("cls").alias("pivot"), F.max("cls").alias("last"), F.count("*").alias("m")).where("pivot <> last")
    meet = c.materialize(meet.select("tok", "band", "pivot"), "meet")  # so that AQE can split the join's hot tiles
    star = tiles.join(meet, ["tok", "band"]).where("cls <> pivot")
    links = c.materialize(_links(_nearest(star), held, pct, sketch), "links")
    label = _merge(held.select("cls", F.col("cls").alias("comp"), F.lit(1).cast("long").alias("weight")), links)
    apart, rest, all_rows = _mixed(tiles, label)

    # more stars while many pairs of different components are left and stars still make them much fewer
    turn, before, open_ = 0, 2 * rest, held
    while rest > 2 * all_rows and 4 * rest < 3 * before:
        turn, before = turn + 1, rest
        open_ = c.materialize(open_.join(apart.select("cls").distinct(), "cls", "left_semi").select("cls", "n", "toks"), "open")
        big = apart.where("comp = big").groupBy("tok", "band").agg(F.min_by("cls", F.xxhash64("cls", F.lit(turn))).alias("pivot"))
        big = c.materialize(big, "pivots")
        star = apart.where("comp <> big").select("tok", "band", "cls").join(big, ["tok", "band"])
        new = c.materialize(_links(_nearest(star), open_, pct, sketch), "links")
        links, label = links.union(new), _merge(label, new)
        apart, rest, all_rows = _mixed(apart.select("tok", "band", "cls", "pos"), label)

    # what is left: pairs of different components in a tile, of which one is not the tile's largest
    apart = apart.join(sketch, "cls")
    l, r = apart.where("comp <> big").alias("l"), apart.alias("r")
    # neither is below the overlap; the second holds in the pair's first common tile, where the pair must come up
    bound = F.least(_over("l", "r"), F.col("l.c") - F.col("l.pos"), F.col("r.c") - F.col("r.pos"))
    ordered = (F.col("r.comp") == F.col("r.big")) | (F.col("l.cls") < F.col("r.cls"))
    fits = F.least("l.n", "r.n") * 100 >= F.greatest("l.n", "r.n") * pct
    more = l.join(r, (F.col("l.tok") == F.col("r.tok")) & (F.col("l.band") == F.col("r.band")) & (F.col("l.comp") != F.col("r.comp")) & ordered & fits & (bound * (100 + pct) >= (F.col("l.n") + F.col("r.n")) * pct))
    more = more.select(F.least("l.cls", "r.cls").alias("a"), F.greatest("l.cls", "r.cls").alias("b")).distinct()
    links = c.materialize(links.union(_links(more, open_, pct)), "links")
    return rows, held, c.components(links).withColumnsRenamed({"node": "cls", "component": "comp"})


def similarity_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, pct: int = 80, block: int = BLOCK) -> DataFrame:
    """Every link (a, b) between different classes, a < b; `similar_groups` says by class_id which class a row is of."""
    _, held, groups = _grouped(docs, id_col, text_col, n, pct)
    return _all_links(held, groups.withColumn("weight", F.lit(1).cast("long")), pct, True, block)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, pct: int = 80, count_links: bool = False, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, class_id, text_key; sets link at 100 * |A and B| >= pct * |A or B|.

    With `count_links` also class_first, the smallest id of the class (of a wordless row its own), and n_links, the number
    of other rows the row's set links to, those of its own class included."""
    rows, held, groups = _grouped(docs, id_col, text_col, n, pct)

    # the smallest id of each component, by way of classes: copies are summed up before anything is joined
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("id").alias("first"), F.count("*").alias("weight")).join(groups, "cls", "left")
    classes = c.materialize(classes.withColumn("comp", F.coalesce("comp", "cls")), "classes")
    least = c.materialize(classes.groupBy("comp").agg(F.min("first").alias("least")), "least")
    own = ["first", "weight"] if count_links else []
    named = c.materialize(classes.join(least, "comp").select("cls", "comp", "least", *own), "named")
    if count_links:
        others = c.materialize(_all_links(held, classes.select("cls", "comp", "weight"), pct, False, block), "others")
        named = c.materialize(named.join(others, "cls", "left"), "counted")
    rows = rows.join(named, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id"))
    more = []
    if count_links:
        links = F.when(F.col("n") > 0, F.col("weight") - 1 + F.coalesce("others", F.lit(0))).otherwise(0)
        more = [F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("id")).alias("class_first"), links.cast("long").alias("n_links")]
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("cls").alias("class_id"), F.col("key").alias("text_key"), "comp", *more)


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, pct: int = 80) -> DataFrame:
    """The rows of `docs`, columns unchanged, of which one stays of each group: that of the smallest id (null last).

    Rows without words have no group and all stay.  Groups are found on narrow rows; texts move once, to meet the
    verdict on their id and key.  Of equal rows the window keeps one; it needs no shuffle beyond the join's."""
    found = similar_groups(docs, id_col, text_col, n, pct).select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key"), (F.col("n_shingles") > 0).alias("_words"), "comp")
    rank = F.struct(F.col("_id").isNull(), "_id", "_key")
    first = found.where("_words").groupBy("comp").agg(F.min(rank).alias("r")).select(F.col("r._id").alias("_id"), F.col("r._key").alias("_key"), F.lit(True).alias("_words"))
    stay = first.union(found.where("not _words").select("_id", "_key", "_words").distinct())
    whole = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_own"), text_key(text_col).alias("_at"))
    joined = whole.join(stay, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_at") == F.col("_key")))
    nth = F.row_number().over(Window.partitionBy("_id", "_key").orderBy("_words"))
    return joined.withColumn("_nth", nth).where("_nth = 1 or not _words").select("_row.*")
