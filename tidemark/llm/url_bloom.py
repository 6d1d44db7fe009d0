"""URL filter in DataFrame functions only: rules first, then a blocked Bloom filter before an exact hash join.

A rule is (verdict, host, path): it fits its host and all subdomains where the URL's path starts with the rule's; the
longest wins.  A URL without a rule is blocked if its canonical form is listed.  The list becomes a Bloom filter of
blocks of four 64-bit words: one hash picks the block, others two bits in each word, so that a probe touches one row
of the filter.  The filter is a table (block, w0..w3) of a size that the list's count fixes.  Up to `broadcast_bytes` it
is broadcast, so that URLs are probed where they stand and only what passes is shuffled; the default holds the filter
of 25 million listed URLs.  A larger filter is joined by block.  What the filter lets pass meets the list in an exact
join, which removes its false positives; the rest, nearly all rows, never reaches that join.

Edge cases: a null URL or one without "://" has an empty host and path, fits no rule and is not listed; repeated rows
are judged alike; duplicates and nulls in the list do not matter; a null page_id is kept; an empty list blocks
nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
WORDS = 4
ROW_BYTES = 8 * (WORDS + 1)  # of a filter's block


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) of a URL; all empty where it is null or has no "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def canonical(host: Column, path: Column, query: Column) -> Column:
    """One spelling of a URL: no user, default port, www. or m., repeated or last slash, .html or tracking parameter."""
    h = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)$", ""), r"\.$", "")
    h = F.regexp_replace(h, r"^(www|m)\.", "")
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/+", "/"), r"/(index\.html?)?$", ""), r"\.html?$", "")
    q = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&", "")
    return F.concat(h, p, F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as struct (verdict, rule), or null."""
    out = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key and its bits in each word."""
    first, second = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(second, 7 * i), F.lit(64)).cast("int"))
    return F.pmod(first, F.lit(blocks)), [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of a column `canonical`; partial aggregates of one row a block leave each task."""
    block, bits = _place(F.col("canonical"), blocks)
    rows = listed.select(block.alias("block"), *(b.alias(f"b{i}") for i, b in enumerate(bits)))
    return rows.groupBy("block").agg(*(F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)))


def passing(rows: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """`rows` and whether the filter lets each pass."""
    block, bits = _place(F.col("canonical"), blocks)
    placed = rows.withColumn("block", block).withColumns({f"b{i}": b for i, b in enumerate(bits)})
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(F.col(f"b{i}")) == F.col(f"b{i}"))
    return placed.join(filter_, "block", "left").select(*rows.columns, hit.alias("maybe"))


def judge(pages: DataFrame, listed: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", bits_per_key: int = 16, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, canonical.

    `listed` has a column `canonical`; by default it holds the canonical URLs of all pages that a rule blocks, so that
    other spellings of those pages, which escape the rules' hosts or paths, are blocked too."""
    host, path, query = split_url(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), query.alias("query"))
    rows = rows.withColumn("by", rule_of(F.col("host"), F.col("path"), rules)).withColumn("canonical", F.when(F.col("host") != "", canonical(F.col("host"), F.col("path"), F.col("query"))).otherwise(""))
    rows = c.materialize(rows.select("id", "host", "path", "canonical", F.col("by.rule").alias("rule"), F.col("by.verdict").alias("verdict")), "urls")
    if listed is None:
        listed = rows.where("verdict = 'block'").select("canonical")
    listed = c.materialize(listed.where("canonical <> ''").select("canonical").distinct(), "listed")
    blocks = 1 << max(0, (max(1, listed.count() * bits_per_key // (64 * WORDS)) - 1).bit_length())
    filter_ = bloom(listed, blocks)
    open_ = passing(rows.where("rule is null"), F.broadcast(filter_) if blocks * ROW_BYTES <= broadcast_bytes else filter_, blocks)
    open_ = c.materialize(open_, "open")
    exact = open_.where("maybe").join(listed.withColumn("found", F.lit(True)), "canonical", "left")
    exact = exact.withColumn("verdict", F.when(F.col("found"), "block").otherwise("allow"))
    clear = open_.where("not maybe").withColumn("verdict", F.lit("allow"))
    names = ["id", "host", "path", "rule", "verdict", "canonical"]
    return rows.where("rule is not null").select(names).union(exact.select(names)).union(clear.select(names)).withColumnRenamed("id", id_col)


def report(judged: DataFrame, id_col: str = "page_id") -> DataFrame:
    return judged.select(id_col, "host", "path", "rule", "verdict")
