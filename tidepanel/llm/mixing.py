"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). Each pattern
offers its words once at no cost, a second time at cost 1, a third at cost 2; the flow routes these
to the sources' quotas. Only patterns and sources reach the driver. The words that a pattern sends
are then taken from its documents: all of them so many times over, and once more those that come
first in a seeded order, and others that fit in what these leave.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.session import saved

# Weights of the sources in code point order, repeating, and the greatest repetition.
WEIGHTS = (5, 2, 1)
REPEATS = 3
# Levels of the seeded order that are resolved by sums before single documents are looked at.
LEVELS = (12, 24, 36)
KEY_BITS = 60
# So many documents of a pattern, on average, are put in order one by one.
FEW = 256
# Seeded order; the last three only tell apart what the key doesn't.
ORDER = ("key", "order_id", "size", "_row")


def count_words(text: Column) -> Column:
    """Runs of characters other than space and the controls from tab to carriage return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def capped_targets(sizes: list[int], weights: list[int], total: int, repeats: int = REPEATS) -> list[float]:
    """Shares of ``total`` by weight, each at most ``repeats`` times its size, excess reshared.

    All targets are the least of the cap and level * weight for one level, which is found by taking
    the sources in the order in which they reach their caps.
    """
    order = sorted(range(len(sizes)), key=lambda i: (repeats * sizes[i] / weights[i], i))
    left, weight, level = total, sum(weights), 0.0
    for i in order:
        level = left / weight
        if level * weights[i] <= repeats * sizes[i]:
            break
        left, weight = left - repeats * sizes[i], weight - weights[i]
        if not weight:
            break
    return [float(min(repeats * s, level * w)) for s, w in zip(sizes, weights)]


def min_cost_flow(supply: list[int], quota: list[int], members: list[list[int]], repeats: int = REPEATS) -> list[list[int]]:
    """Units from each pattern to each of its sources; as much as possible at the least cost.

    Pattern p offers ``supply[p]`` units at each of the costs 0 .. repeats - 1, for all its sources
    together. Successive cheapest paths with potentials; each path fills an offer, an arc or a quota.
    """
    n, m = len(supply), len(quota)
    end = n + m + 1  # 0: start, 1 .. n: patterns, n + 1 .. n + m: sources
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    arcs: list[list[int]] = []  # to, capacity, cost

    def link(a: int, b: int, capacity: int, cost: int) -> int:
        graph[a].append(len(arcs))
        graph[b].append(len(arcs) + 1)
        arcs.extend(([b, capacity, cost], [a, 0, -cost]))
        return len(arcs) - 2

    routes = []
    for p, s in enumerate(supply):
        for r in range(repeats):
            link(0, 1 + p, s, r)
        routes.append([link(1 + p, 1 + n + i, s * repeats, 0) for i in members[p]])
    for i, q in enumerate(quota):
        link(1 + n + i, end, q, 0)
    height = [0] * (end + 1)
    while True:
        far, via, heap = {0: 0}, {}, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k in graph[a]:
                b, capacity, cost = arcs[k]
                if capacity and (e := d + cost + height[a] - height[b]) < far.get(b, e + 1):
                    far[b], via[b] = e, k
                    heapq.heappush(heap, (e, b))
        if end not in far:
            break
        height = [h + far.get(v, far[end]) for v, h in enumerate(height)]
        path, v = [], end
        while v:
            path.append(via[v])
            v = arcs[via[v] ^ 1][0]
        units = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= units
            arcs[k ^ 1][1] += units
    return [[arcs[k ^ 1][1] for k in ks] for ks in routes]


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: Callable[[], Column] | None = None,
    source_col: str = "source", seed: int = 0, weights: tuple[int, ...] = WEIGHTS, carry: Sequence[str] = (),
) -> DataFrame:
    """Words to take from each document: id, size, source, source_size, target, taken.

    By default a document belongs to the source in ``source_col`` (null: one source of its own,
    last); ``sources`` may give an array of sources per document instead, whose columns are then
    sums over its sources. Sources in code point order weigh ``weights`` in turn and share the size
    of all documents; targets stop at three times the size of what the source holds. A document is
    taken 0 to 3 times. Of the documents of a pattern, those first in the order of a hash of seed
    and id are taken once more than the rest, as many as fit; what is left then is filled from the
    others by classes of size, greatest first. One more, the nearest in size, closes what is still
    missing. Rows with equal ids follow each other by size; null ids count as one id.
    Empty documents take nothing. No rows in, no rows out. Other columns are not read. There may
    be many documents, but patterns and sources must fit the driver: they do for sources of a mix.
    ``carry`` names small columns to hand through. Tables with one row per pattern come from or fit
    the driver, so they are broadcast: a pattern that holds a third of all rows is not gathered.
    """
    member = F.array(F.col(source_col).cast("string")) if sources is None else F.array_sort(F.array_distinct(sources()))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, KEY_BITS // 4), 16, 10).cast("long")
    number = F.col(id_col).cast("long")
    rows = docs.select(
        number.alias("_id"), F.coalesce(number, F.lit(-(1 << 63))).alias("order_id"), member.alias("pattern"),
        count_words(F.col(text_col)).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("_row"), *carry,
    )
    rows = saved(rows, "sizes")
    spark = docs.sparkSession
    patterns = [(tuple(r["pattern"] or ()), r["size"]) for r in rows.groupBy("pattern").agg(F.sum("size").alias("size")).collect()]
    patterns.sort(key=lambda p: [(s is None, (s or "").encode()) for s in p[0]])
    names = sorted({s for p, _ in patterns for s in p}, key=lambda s: (s is None, (s or "").encode()))
    at = {s: i for i, s in enumerate(names)}
    held = [sum(size for p, size in patterns if s in p) for s in names]
    total = sum(size for _, size in patterns)
    targets = capped_targets(held, [weights[i % len(weights)] for i in range(len(names))], total) if names else []
    routes = min_cost_flow([size for _, size in patterns], [math.floor(t + 0.5) for t in targets], [[at[s] for s in p] for p, _ in patterns])
    plan = []
    for (pattern, size), sent in zip(patterns, routes):
        full, rest = divmod(sum(sent), size) if size else (0, 0)
        plan.append((list(pattern), sum(held[at[s]] for s in pattern), float(sum(targets[at[s]] for s in pattern)), full, rest))
    table = spark.createDataFrame(plan, "pattern array<string>, source_size long, target double, full long, rest long")
    marked = saved(_mark_fitting(rows, table), "marked")
    # The document nearest to what is still missing closes the gap, if it brings the sum nearer.
    missing = marked.groupBy("pattern").agg((F.max("rest") - F.sum(F.when(F.col("once"), F.col("size")).otherwise(0))).alias("missing"))
    gap = F.abs(F.col("missing") - F.col("size"))
    closing = marked.where("not once and size > 0").join(F.broadcast(missing.where("missing > 0")), "pattern").where(gap < F.col("missing"))
    closing = closing.groupBy("pattern").agg(F.min(F.struct(gap.alias("gap"), *ORDER)).alias("closing"))
    closes = F.coalesce(F.struct(*ORDER) == F.struct(*[F.col(f"closing.{c}").alias(c) for c in ORDER]), F.lit(False))
    taken = F.col("size") * (F.col("full") + (F.col("once") | closes).cast("long"))
    source = F.col("pattern")[0] if sources is None else F.col("pattern")
    return marked.join(F.broadcast(table.drop("rest").join(saved(closing, "closing"), "pattern", "left")), "pattern").select(
        F.col("_id").alias(id_col), "size", source.alias("source"), "source_size", "target", taken.alias("taken"),
        *carry,
    )


def _mark_fitting(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``rest`` and ``once``: whether a document is taken once more, of ``rest`` words for its pattern.

    First the longest prefix in seeded order that fits. Then, among the documents behind it, one
    class of sizes after the other from the greatest (class j: 2**j words and up to twice that): of
    each the longest prefix that fits in what is left. So a document greater than what is left ends
    neither the choice nor a class below its own, and the number of rounds is at most the logarithm
    of the words missing after the prefix. A round is known by its class, its first document not
    taken and where it begins, so only one row per pattern and round reaches the driver.
    """
    spark = rows.sparkSession
    rows = rows.join(F.broadcast(table.select("pattern", "rest")), "pattern")
    order, of_order = F.struct(*ORDER), ", ".join(f"{c}: bigint" for c in ORDER)
    schema = f"pattern array<string>, left long, class int, after struct<{of_order}>, cut struct<{of_order}>"
    size_class = F.length(F.bin("size")) - 1

    def inside(after: Column, class_: Column) -> Column:
        return (F.col("size") > 0) & F.coalesce(order >= after, F.lit(True)) & F.coalesce(size_class == class_, F.lit(True))

    def cut_of(state: list[tuple], count: int) -> dict[tuple, object]:
        frame = spark.createDataFrame([(p, left, j, after, None) for p, left, j, after in state], schema)
        fit = rows.join(F.broadcast(frame), "pattern").where(inside(F.col("after"), F.col("class")))
        return {_key(r["pattern"]): r["cut"] for r in _cuts(fit.select("pattern", *ORDER, "left"), _levels(count)).collect()}

    rounds: list[tuple] = []
    counts = {_key(r["pattern"]): r["n"] for r in rows.where("size > 0").groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    first = [(list(r["pattern"] or ()), r["rest"], None, None) for r in table.where("rest > 0").collect()]
    cuts = cut_of(first, max(counts.values(), default=0)) if first else {}
    rounds += [(*o, cuts.get(_key(o[0]))) for o in first]
    # What the prefix left, and the classes of the documents behind it.
    ends = [o for o in rounds if o[4] is not None]
    left: dict[tuple, int] = {}
    classes: dict[tuple, tuple[int, int]] = {}
    if ends:
        done = rows.join(F.broadcast(spark.createDataFrame(ends, schema)), "pattern").where("size > 0")
        before = order < F.col("cut")
        for r in done.groupBy("pattern", F.when(~before, size_class).alias("j")).agg(
                F.max("left").alias("left"), F.sum("size").alias("sum"), F.count("*").alias("n")).collect():
            key = _key(r["pattern"])
            left[key] = left.get(key, r["left"]) - (r["sum"] if r["j"] is None else 0)
            if r["j"] is not None:
                classes[(key, r["j"])] = (r["sum"], r["n"])
    after = {_key(o[0]): o[4] for o in ends}
    for j in range(max((v for v in left.values()), default=0).bit_length() - 1, -1, -1):
        here = [k for k in after if (k, j) in classes and left[k] >= 1 << j]
        whole = [k for k in here if classes[(k, j)][0] <= left[k]]
        rounds += [(list(k), left[k], j, after[k], None) for k in whole]
        for k in whole:
            left[k] -= classes[(k, j)][0]
        part = [(list(k), left[k], j, after[k]) for k in here if k not in whole]
        if not part:
            continue
        cuts = cut_of(part, max(classes[(_key(o[0]), j)][1] for o in part))
        now = [(*o, cuts[_key(o[0])]) for o in part]
        rounds += now
        taken = rows.join(F.broadcast(spark.createDataFrame(now, schema)), "pattern").where(inside(F.col("after"), F.col("class")) & (order < F.col("cut")))
        for r in taken.groupBy("pattern").agg(F.sum("size").alias("sum")).collect():
            left[_key(r["pattern"])] -= r["sum"]
    by: dict[tuple, list[tuple]] = {}
    for pattern, _, *window in rounds:
        by.setdefault(_key(pattern), []).append(tuple(window))
    made = spark.createDataFrame([(list(k), w) for k, w in by.items()], f"pattern array<string>, rounds array<struct<class: int, after: struct<{of_order}>, cut: struct<{of_order}>>>")
    chosen = F.exists("rounds", lambda r: inside(r["after"], r["class"]) & F.coalesce(order < r["cut"], F.lit(True)))
    return rows.join(F.broadcast(made), "pattern", "left").withColumn("once", F.coalesce(chosen, F.lit(False))).drop("rounds")


def _levels(count: int) -> list[int]:
    """Bits of the seeded key to resolve, so that about ``FEW`` of ``count`` documents share them."""
    return [bits for bits in LEVELS if count > FEW << (bits - LEVELS[0])]


def _key(pattern: Sequence[str | None]) -> tuple[str | None, ...]:
    return tuple(pattern or ())


def _cuts(inside: DataFrame, levels: Sequence[int]) -> DataFrame:
    """For each pattern the first document, in order, up to which there are more than ``left`` words; no row if there is none.

    The seeded key is resolved 12 bits at a time: sums per prefix, at most 4,096 for a pattern, tell
    in which the prefix ends. ``levels`` are as many as leave a few hundred documents of a pattern,
    which are put in order one by one.
    """
    for bits in levels:
        prefix = F.shiftright("key", KEY_BITS - bits)
        sums = inside.groupBy("pattern", prefix.alias("prefix")).agg(F.sum("size").alias("sum"), F.max("left").alias("left"))
        before = F.coalesce(F.sum("sum").over(Window.partitionBy("pattern").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = sums.withColumn("before", before).where("before <= left and before + sum > left").select("pattern", "prefix", (F.col("left") - F.col("before")).alias("left"))
        inside = saved(inside.drop("left").withColumn("prefix", prefix).join(F.broadcast(hit), ["pattern", "prefix"]).drop("prefix"), "cut")
    upto = F.sum("size").over(Window.partitionBy("pattern").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("upto", upto).where("upto > left").groupBy("pattern").agg(F.min(F.struct(*ORDER)).alias("cut"))
