"""Multipart credential linking in DataFrame functions only.

Strong findings (assignments, access identifiers, long hex strings) stand alone.  Weak candidates - a login name, a
mixed-case token, a short hex string, an endpoint - are common in clean text, so they count only where complementary
parts co-occur: an identifier needs a secret in its scope, a secret an identifier, an endpoint both.  Parts that
overlap are one thing seen twice and never confirm each other; an endpoint's two parts must not overlap either.  A
scope is the part of one text whose starts lie within `scope` code points.

The interval join runs on (row, bucket of `scope` code points).  Matches of a kind do not overlap and have a least
length, so a bucket holds a few dozen parts at most, whatever the text; they travel as one array for each role, and a
candidate meets at most three buckets.

Edge cases: null is an empty text and has no spans; offsets are code points, end exclusive; repeated rows get the same
spans; a null doc_id is kept; very long texts take time in proportion to their matches; extra columns are ignored, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c

#: The base kinds in their order, with pattern, group that is measured, and least length.
BASE = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: The same matches that reach their least length, found without stopping at each shorter one.  An assignment's
#: shorter matches do hide later ones, so it keeps its pattern (letters of its words in either case).
SEARCH = {"assign": BASE[0][1].replace("(password", "((?i)password", 1), "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Weak kinds, after the base kinds, with role (I identifier, S secret, E endpoint), pattern, and what a match must hold
#: besides: patterns that all of them match.
WEAK = [
    ("weak_id", "I", r"""(?i:access_?key_?id|client_?id|user_?name|login|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,64}""", []),
    ("weak_token", "S", r"[A-Za-z0-9+/_-]{20,}={0,2}", ["[0-9]", "[A-Z]", "[a-z]"]),
    ("weak_hex", "S", r"[0-9A-Za-z]{16,}", ["^[0-9a-f]{16,23}$", "[0-9]"]),
    ("weak_endpoint", "E", r"""(?i:https?|ftp|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]{4,}|(?i:host(?:name)?|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}(?::[0-9]{1,5})?""", []),
]
ROLE = {"assign": "S", "access": "I", "hex": "S"} | {k: r for k, r, *_ in WEAK}
ORDER = {k: i for i, k in enumerate([*(b[0] for b in BASE), *(w[0] for w in WEAK)])}
SPAN = "array<struct<start: int, rank: int, end: int>>"


BLOCK = 64


def found(text: Column, kind: str, pattern: str, test: Callable[[Column], Column]) -> Column:
    """Spans of the leftmost non-overlapping matches that pass a test: what split() leaves between matches gives their places.

    Appending to an array copies it, so matches are taken in blocks: first each block's place, then the spans within it."""
    pieces, matches = F.split(text, F.lit(pattern), F.lit(-1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("gap"), matches.alias("hit"))
    long = lambda x: F.char_length(x["gap"]) + F.char_length(x["hit"])
    none = F.expr(f"cast(array() as {SPAN})")

    def step(acc, x):
        end = acc["at"] + long(x)
        own = F.array(F.struct((end - F.char_length(x["hit"])).alias("start"), F.lit(ORDER[kind]).alias("rank"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(test(x["hit"]), F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    def spans(all_):
        block = lambda i: F.slice(all_, i * BLOCK + 1, F.lit(BLOCK))
        within = lambda i, at: F.aggregate(block(i), F.struct(at.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
        index = F.sequence(F.lit(0), F.ceil(F.size(all_) / BLOCK).cast("int") - 1)
        total = lambda i: F.aggregate(block(i), F.lit(0), lambda n, x: n + long(x))
        onward = lambda acc, i: F.struct((acc["at"] + total(i)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
        places = F.aggregate(index, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")), onward, lambda acc: acc["all"])
        return F.when(F.size(all_) <= BLOCK, within(F.lit(0), F.lit(0))).otherwise(F.flatten(F.zip_with(index, places, within)))

    once = F.transform(F.array(both), spans)[0]  # a lambda's variable is evaluated once, however often it is used
    return F.when(F.rlike(text, F.lit(pattern)), once).otherwise(none)


def _long(pattern: str, group: int, least: int) -> Callable[[Column], Column]:
    return lambda hit: F.char_length(F.regexp_extract(hit, pattern, group) if group else hit) >= least


def _holds(patterns: list[str]) -> Callable[[Column], Column]:
    def test(hit):
        ok = F.lit(True)
        for p in patterns:
            ok = ok & hit.rlike(p)
        return ok

    return test


def printed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in ORDER))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2, base, weak): spans of every row's text; k1 and k2 name rows of equal id and text."""
    flat = docs.select(F.col(id_col).alias("id"), c.text_of(text_col).alias("text"))
    base = F.concat(*(found(F.col("text"), k, SEARCH[k], _long(SEARCH[k], group, least)) for k, _, group, least in BASE))
    weak = F.concat(*(found(F.col("text"), k, p, _holds(more)) for k, _, p, more in WEAK))
    return flat.select("id", F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", F.lit(7), "id").alias("k2"), base.alias("base"), weak.alias("weak"))


def _apart(a: Column, b: Column) -> Column:
    return (a["end"] <= b["start"]) | (a["start"] >= b["end"])


def linked_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row per input row: id, base spans, and weak spans that their scope confirms, as arrays of (start, rank, end)."""
    rows = c.materialize(parts(docs, id_col, text_col), "parts")
    some = rows.where(F.size("weak") > 0).dropDuplicates(["k1", "k2"])
    role = F.element_at(F.array(*(F.lit(ROLE[k]) for k in ORDER)), F.col("s.rank") + 1)
    flat = some.select("k1", "k2", F.explode(F.concat("base", "weak")).alias("s"))
    flat = flat.select("k1", "k2", "s", role.alias("role"), F.floor(F.col("s.start") / scope).alias("bucket"))
    near = flat.where("role <> 'E'").groupBy("k1", "k2", F.col("role").alias("other"), "bucket").agg(F.collect_list("s").alias("parts"))
    near = near.withColumn("bucket", F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)))
    weak = flat.where(F.col("s.rank") >= len(BASE))
    in_scope = F.filter("parts", lambda x: (F.abs(x["start"] - F.col("s.start")) <= scope) & _apart(x, F.col("s")))
    met = weak.join(near, ["k1", "k2", "bucket"]).where("role <> other").withColumn("parts", in_scope).where(F.size("parts") > 0)
    of = lambda r: F.flatten(F.collect_list(F.when(F.col("other") == r, F.col("parts"))))
    met = met.groupBy("k1", "k2", "s", "role").agg(of("I").alias("ids"), of("S").alias("secrets"))
    pair = F.exists("ids", lambda x: F.exists("secrets", lambda y: _apart(x, y)))
    kept = met.where((F.col("role") != "E") | pair).groupBy("k1", "k2").agg(F.array_sort(F.collect_list("s")).alias("linked"))
    out = rows.drop("weak").join(kept, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), "base", F.coalesce("linked", F.expr(f"cast(array() as {SPAN})")).alias("linked"))


def report(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == ORDER[k])).cast("long").alias(f"n_{k}")
    return spans.select(id_col, *(count(b[0]) for b in BASE), F.sha2(printed(F.col("base")), 256).alias("base_sha256"), printed(F.concat("base", "linked")).alias("spans"))
