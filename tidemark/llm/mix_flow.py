"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources.  They are aggregated by membership pattern; a flow network routes each
pattern's words to the quotas of its sources.  Every pattern has one layer of capacity per repetition, the k-th at
cost k, so costs are convex and fresh words go before repeated ones.  The flow fixes how many words each layer of a
pattern gives; a seeded order of the pattern's documents then decides which documents those are: a document is in a
layer if at least its first half lies within the layer's flow, so a pattern misses its flow by half a document at most.

Only sums by pattern reach the driver, `max_patterns` of them at most (checked).  Beyond that targets come from sums,
connected components part the network, and each part's flow is a task of its own, the same flow as before; a part that
is a single source needs no network, since its layers fill up in order.  Running sums use two levels, slices by hash and rows within a slice, so that a source
with most of the rows is spread over `16 ** digits` slices.

Edge cases: null text has no words and is never taken; a null or empty array of sources has no target and gives no
words; the null source is a source like others, last in order;
repeated rows are taken or left one by one in a fixed order; a null id is kept; extra columns are ignored; an empty
table gives an empty mix.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)


def targets(sizes: dict, budget: float, most: float = 2, weights=WEIGHTS) -> dict:
    """Share `budget` by weight among sources in code point order, null last; no source above `most` times its size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_ = {}, list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        left = budget - sum(out.values())
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: float(most * sizes[s]) for s in over}
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(supply: dict, quota: dict, layers: int) -> dict:
    """{(pattern, layer, source): words}; a pattern is a tuple of sources.  Successive shortest paths on the residual
    network; what is left of quotas that no pattern can fill stays open."""
    graph = defaultdict(dict)  # node -> node -> [capacity, cost]

    def edge(a, b, capacity, cost):
        graph[a][b] = [capacity, cost]
        graph[b].setdefault(a, [0, -cost])

    for p, words in supply.items():
        for k in range(layers):
            edge("from", ("layer", p, k), words, k)
            for s in p:
                edge(("layer", p, k), ("source", s), words, 0)
    for s, q in quota.items():
        edge(("source", s), "to", q, 0)
    while True:
        cost, back, queue, queued = {"from": 0}, {}, deque(["from"]), {"from"}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for b, (capacity, price) in graph[a].items():
                if capacity > 0 and cost[a] + price < cost.get(b, 1 << 60):
                    cost[b], back[b] = cost[a] + price, a
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if "to" not in back:
            break
        # all paths of this cost, by depth-first search along edges that keep distances
        found = True
        while found:
            found = False
            path, at, used = [], "from", {"from"}
            dead = set()
            while at != "to":
                step = next((b for b, (capacity, price) in graph[at].items() if capacity > 0 and b in cost and cost[b] == cost[at] + price and b not in used and b not in dead), None)
                if step is None:
                    if not path:
                        break
                    dead.add(at)
                    at = path.pop()
                    continue
                path.append(at)
                used.add(step)
                at = step
            if at == "to":
                nodes = [*path, "to"]
                amount = min(graph[a][b][0] for a, b in zip(nodes, nodes[1:]))
                for a, b in zip(nodes, nodes[1:]):
                    graph[a][b][0] -= amount
                    graph[b][a][0] += amount
                found = True
    return {(p, k, s): got for p in supply for k in range(layers) for s in p if (got := graph[("source", s)][("layer", p, k)][0]) > 0}


def parts_of_flow(supply: dict, quota: dict, layers: int) -> dict:
    """The flow, one connected part of the network after the other: disjoint sources are small networks of their own."""
    top: dict = {}

    def find(s):
        while top.setdefault(s, s) != s:
            top[s] = top[top[s]]
            s = top[s]
        return s

    for p in supply:
        for s in p[1:]:
            top[find(s)] = find(p[0])
    parts = defaultdict(dict)
    for p, words in supply.items():
        if p:
            parts[find(p[0])][p] = words
    out: dict = {}
    for part in parts.values():
        sources = {s for p in part for s in p}
        out |= min_cost_flow(part, {s: quota[s] for s in sources}, layers)
    return out


def _plan_flow(patterns: DataFrame, share: float, repeats: int) -> DataFrame:
    """(key, source_size, target, amounts by layer) from a flow on the driver; there are few patterns."""
    rows = patterns.collect()
    sizes: dict = defaultdict(int)
    supply = {}
    for r in rows:
        p = tuple(r.pattern or ())
        supply[p] = r.words
        for s in p:
            sizes[s] += r.words
    goal = targets(sizes, share * sum(supply.values()), repeats)
    amounts = defaultdict(lambda: [0] * repeats)
    for (p, k, _), words in parts_of_flow(supply, {s: round(t) for s, t in goal.items()}, repeats).items():
        amounts[p][k] += words
    table = [(r.key, sizes[p[0]] if p else 0, float(goal[p[0]]) if p else 0.0, amounts[p]) for r in rows for p in [tuple(r.pattern or ())]]
    return patterns.sparkSession.createDataFrame(table, "key string, source_size long, target double, amounts array<long>")


def _levels(sizes: DataFrame, budget: float, repeats: int) -> DataFrame:
    """(source, size) with `target`, as `targets` finds them, for any number of sources: target = least(level * weight, cap),
    and the level is found by sums."""
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (nth % len(WEIGHTS) + 1).cast("int"))
    rows = c.materialize(sizes.select("source", "size", w.alias("w"), (F.col("size") * repeats).alias("cap")), "weighed")
    level = -1.0
    while True:
        full = F.col("cap") < F.lit(level) * F.col("w")
        done, open_ = rows.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        new = (budget - (done or 0)) / open_ if open_ else level
        if new <= level:
            break
        level = new
    return rows.select("source", "size", F.least(F.lit(level) * F.col("w"), F.col("cap").cast("double")).alias("target"))


def _flow_of_part(repeats: int):
    """The amounts of a connected part's patterns."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        supply = {tuple(r["pattern"]): r["words"] for r in rows}
        quota = {s["source"]: round(s["target"]) for r in rows for s in r["goals"]}
        amounts = defaultdict(lambda: [0] * repeats)
        for (p, k, _), words in min_cost_flow(supply, quota, repeats).items():
            amounts[p][k] += words
        return pa.table({"key": pa.array([r["key"] for r in rows], pa.string()), "amounts": pa.array([amounts[tuple(r["pattern"])] for r in rows], pa.list_(pa.int64()))})

    return run


def _plan_parts(patterns: DataFrame, share: float, repeats: int) -> DataFrame:
    """The same as `_plan_flow` for any number of patterns, without collecting them."""
    budget = share * (patterns.agg(F.sum("words")).first()[0] or 0)
    each = c.materialize(patterns.select("key", "words", F.explode("pattern").alias("source")), "each")
    goals = c.materialize(_levels(each.groupBy("source").agg(F.sum("words").alias("size")), budget, repeats), "goals")
    node = lambda x, mark: F.xxhash64(F.lit(mark), x.isNull(), x)
    linked = each.join(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key", "left_semi")
    linked = linked.select(node(F.col("key"), "pattern").alias("a"), node(F.col("source"), "source").alias("b"))
    parts = c.components(linked)
    placed = each.join(goals, each.source.eqNullSafe(goals.source)).select("key", each.source, "words", "size", "target", node(each.source, "source").alias("node"))
    placed = placed.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    one = F.min(F.struct(F.col("source").isNull().alias("none"), "source", "size", "target"))
    full = placed.groupBy("key").agg(F.any_value("words").alias("words"), F.any_value("part").alias("part"), F.collect_list(F.struct("source", "target")).alias("goals"), one.alias("least"))
    full = c.materialize(full.join(patterns.select("key", "pattern"), "key"), "parts")
    single = full.groupBy("part").agg(F.count("*").alias("n"), F.max(F.size("pattern")).alias("wide")).withColumn("alone", (F.col("n") == 1) & (F.col("wide") == 1)).select("part", "alone")
    full = c.materialize(full.join(single, "part"), "single")
    own = F.array(*(F.greatest(F.lit(0), F.least(F.col("words"), F.bround("least.target").cast("long") - F.col("words") * k)) for k in range(repeats)))
    flows = full.where("not alone").select("part", "key", "pattern", "words", "goals").groupBy("part").applyInArrow(_flow_of_part(repeats), "key string, amounts array<long>")
    amounts = flows.union(full.where("alone").select("key", own.alias("amounts")))
    none = patterns.where(F.size("pattern") == 0).select("key", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.array_repeat(F.lit(0).cast("long"), repeats).alias("amounts"))
    planned = amounts.join(full.select("key", F.col("least.size").alias("source_size"), F.col("least.target").alias("target")), "key")
    return planned.select("key", "source_size", "target", "amounts").union(none)


def drawn(id_col: str, text_col: str, source_col: str, seed: str):
    """The seeded place of a row in its pattern's order; only rows of equal id, text and source share one."""
    mark = lambda col: F.coalesce(F.concat(F.lit("="), col), F.lit(""))
    return F.md5(F.concat_ws("|", F.lit(seed), mark(F.col(id_col).cast("string")), F.md5(c.text_of(text_col).cast("binary")), mark(F.col(source_col).cast("string"))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, repeats: int = 2, seed: str = "mix", digits: int = 3, max_patterns: int = 100_000) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken (words, repeats counted), times.

    `source_col` is a string, or an array of strings for documents of several sources (source_size and target are
    then those of the pattern's least source)."""
    many = dict(docs.dtypes)[source_col].startswith("array")
    text = c.text_of(text_col)
    pattern = F.array_sort(F.array_distinct(F.coalesce(F.col(source_col), F.expr("cast(array() as array<string>)")))) if many else F.array(F.col(source_col).cast("string"))
    rows = docs.select(F.col(id_col).alias("id"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), pattern.alias("pattern"), drawn(id_col, text_col, source_col, seed).alias("draw"))
    # a null within a pattern has a name no other value has
    key = F.to_json(F.struct(F.transform("pattern", lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("null"))).alias("p")))
    rows = rows.withColumn("key", key).withColumn("slice", F.substring("draw", 1, digits))
    rows = c.materialize(rows, "sizes")
    sums = c.materialize(rows.groupBy("key", "slice").agg(F.sum("size").alias("words"), F.any_value("pattern").alias("pattern")), "sums")
    patterns = sums.groupBy("key").agg(F.sum("words").alias("words"), F.any_value("pattern").alias("pattern"))
    if patterns.limit(max_patterns + 1).count() > max_patterns:
        plan = _plan_parts(c.materialize(patterns, "patterns"), share, repeats)
    else:
        plan = _plan_flow(patterns, share, repeats)
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("key", "slice").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.select("id", "size", "key", "slice", "draw").withColumn("sum", F.sum("size").over(order)).join(starts.hint("merge"), ["key", "slice"]).join(plan, "key")
    # merged, not broadcast: rows lie by key and slice already, and the table of slices grows with the sources
    middle = (F.col("start") + F.col("sum") - F.col("size")) * 2 + F.col("size")
    times = F.when(F.col("size") > 0, F.size(F.filter("amounts", lambda a: middle <= a * 2))).otherwise(0)
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"), times.cast("int").alias("times"), "draw")


def report(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return mixed.select(id_col, "size", "source_size", "target", "taken")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **more) -> DataFrame:
    """The rows of `docs`, columns unchanged, each as often as the mix takes it.

    The plan is made on narrow rows; texts move once, to meet their times by draw.  Equal rows share a draw: one of
    them stands for all, which a window finds without a shuffle beyond the join's."""
    times = mix(docs, id_col, text_col, source_col, seed=seed, **more).groupBy("draw").agg(F.sum("times").alias("_times"))
    times = times.where("_times > 0").select(F.col("draw").alias("_draw"), F.col("_times").cast("int"))
    whole = docs.select(F.struct("*").alias("_row"), drawn(id_col, text_col, source_col, seed).alias("_own"))
    joined = whole.join(times, F.col("_own") == F.col("_draw"))
    one = joined.withColumn("_nth", F.row_number().over(Window.partitionBy("_draw").orderBy("_times"))).where("_nth = 1")
    return one.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select("_row.*")
