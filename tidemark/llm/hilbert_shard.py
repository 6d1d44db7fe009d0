"""Hilbert-curve ordering into shards, in DataFrame functions only.

Metadata dimensions are quantised to a few bits each (categories by hash, sizes by logarithm), the cell's index along
the Hilbert curve orders the rows, and the order is cut into runs of equal row counts.  Neighbouring cells share most
dimensions' high bits, so each shard spans a small box of the metadata space and readers skip whole files.

The order is total: (curve index, hash of the row, id).  Ranks come from two levels of counts - per cell, of which
there are at most 2 ** (bits * dimensions), and per slice of a cell by its hash - so no task sorts a whole cell, and
no rows meet in one partition however common one combination of metadata is.

Edge cases: null dimensions share one category; null text has no bytes (size 1, checksum 0); repeated rows each get a
slot of their own; a null id is kept and sorts first among equal hashes; other columns do not matter; an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c


def curve(bits: int, dims: int) -> list[int]:
    """Hilbert index of every cell, numbered with the first dimension's digits highest (Skilling 2004)."""
    out = []
    for cell in range(1 << bits * dims):
        x = [cell >> bits * (dims - 1 - d) & (1 << bits) - 1 for d in range(dims)]
        q = 1 << bits - 1
        while q > 1:
            for d in range(dims):
                if x[d] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[d]) & q - 1
                    x[0] ^= t
                    x[d] ^= t
            q >>= 1
        for d in range(1, dims):
            x[d] ^= x[d - 1]
        t, q = 0, 1 << bits - 1
        while q > 1:
            if x[-1] & q:
                t ^= q - 1
            q >>= 1
        index = 0
        for b in range(bits - 1, -1, -1):
            for d in range(dims):
                index = index << 1 | (x[d] ^ t) >> b & 1
        out.append(index)
    return out


def category(col: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(col.cast("string"), F.lit("\0"))), F.lit(1 << bits)).cast("int")


def magnitude(col: Column, bits: int) -> Column:
    return F.least(F.floor(F.log2(F.greatest(col, F.lit(1)))), F.lit((1 << bits) - 1)).cast("int")


def hilbert_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source"), bits: int = 4, slices: int = 1024) -> DataFrame:
    """One row per input row: id, size, text_crc32, cell, hilbert, shard, slot; shard counts differ by one at most."""
    text = c.text_of(text_col)
    size = F.octet_length(text).cast("long") + 1
    dims = [category(F.col(x), bits) for x in categories] + [magnitude(size, bits)]
    cell = F.lit(0)
    for d in dims:
        cell = cell * (1 << bits) + d
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("crc"), cell.alias("cell"))
    rows = rows.withColumn("hash", F.xxhash64("id", "crc", "size")).withColumn("slice", F.pmod("hash", F.lit(slices)).cast("int"))
    # the table of cells has a fixed size, whatever the input
    along = F.split(F.lit(" ".join(map(str, curve(bits, len(dims))))), " ")
    table = docs.sparkSession.range(1).select(F.posexplode(along).alias("cell", "hilbert")).select("cell", F.col("hilbert").cast("int"))
    rows = c.materialize(rows.join(F.broadcast(table), "cell"), "cells")

    counts = c.materialize(rows.groupBy("hilbert", "slice").agg(F.count("*").alias("n")), "counts")
    cells = counts.groupBy("hilbert").agg(F.sum("n").alias("n"))
    before = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("hilbert", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("hilbert").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("hilbert", "slice", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inner"))
    starts = starts.join(F.broadcast(cells), "hilbert").select("hilbert", "slice", (F.col("first") + F.col("inner")).alias("start"))
    total = counts.agg(F.sum("n")).first()[0] or 0

    order = Window.partitionBy("hilbert", "slice").orderBy("hash", "id", "crc", "size")
    ranked = rows.withColumn("nth", F.row_number().over(order)).join(starts, ["hilbert", "slice"])
    rank = F.col("start") + F.col("nth") - 1
    ranked = ranked.withColumn("rank", rank).withColumn("shard", F.floor(F.expr(f"(rank * {n_shards}L) div {max(total, 1)}L")).cast("int"))
    first = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}L")
    return ranked.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "cell", "hilbert", "shard", (F.col("rank") - first).alias("slot"))


def pruning_ranges(sharded: DataFrame) -> DataFrame:
    """What a reader needs to skip shards: rows, and the ranges of size and curve index in each."""
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.min("hilbert").alias("min_hilbert"), F.max("hilbert").alias("max_hilbert"))


def report(sharded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return sharded.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")
