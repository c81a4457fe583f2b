"""Mixing of overlapping sources to target weights, by min-cost flow over membership patterns.

A document may belong to several sources. Documents are added up by the set of their sources, their pattern; the flow is
planned over patterns, not documents. From the start a pattern takes its words once for nothing, once more at cost 1, a third
time at cost 2, and so on (convex, so repetition is spread as thinly as possible); from it words flow to any source of the
set, and from a source at most its target to the end. The cheapest of the largest flows says how many words each pattern
gives to each of its sources. Then documents are chosen: in seeded hash order the words of a pattern form a line, which is
laid out as often as the flow needs; a document takes what of it lies before the end, and its words go to the sources in
turn. The document at the end is taken in part, its first words.

Sources are ordered by code point, null last, weigh 5, 2, 1, repeating, and share the words of all documents by weight; a
target stops at `repeats` times the words of its source, and the excess is shared by weight again.

Places in the line are prefix sums: a pattern is dealt into ranges of the hash of about GROUP documents, so no task sorts a
pattern. At most MAX_PATTERNS patterns may come to the driver, which is an error beyond, never a cut.

Null text has no words. A null source is a source; an empty or null set of sources takes no part and is taken 0 times.
Repeated rows are documents each; ties go by id, then size. An empty table gives no rows. Other columns, of any name, pass
unread.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import hash_order
from .common import table

WEIGHTS, REPEATS, SEED = (5, 2, 1), 3, 13
#: Documents in a range of the hash, at least; ranges at most, apart from one for each pattern; patterns at most.
GROUP, RANGES, MAX_PATTERNS = 1000, 100_000, 100_000


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D."""
    short = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(short, " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sizes: list[int], weights: list[int], total: int, repeats: int = REPEATS) -> list[float]:
    """total shared by weight, none above repeats times its size, the excess shared by weight among the others."""
    out, left, weight = [0.0] * len(sizes), total, sum(weights)
    for i in sorted(range(len(sizes)), key=lambda i: (repeats * sizes[i] / weights[i], i)):
        if repeats * sizes[i] * weight < weights[i] * left:  # full before the others are
            out[i], left, weight = float(repeats * sizes[i]), left - repeats * sizes[i], weight - weights[i]
        else:
            out[i] = left * weights[i] / weight
    return out


class Flow:
    """Min-cost flow: for each length of the cheapest path, all flow that paths of this length take."""

    def __init__(self, nodes: int):
        self.to, self.room, self.cost, self.out = [], [], [], [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def _lengths(self, s: int) -> list[float]:
        far, queue, waits = [float("inf")] * len(self.out), deque([s]), [False] * len(self.out)
        far[s] = 0
        while queue:
            x = queue.popleft()
            waits[x] = False
            for e in self.out[x]:
                y = self.to[e]
                if self.room[e] and far[x] + self.cost[e] < far[y]:
                    far[y] = far[x] + self.cost[e]
                    if not waits[y]:
                        waits[y] = True
                        queue.append(y)
        return far

    def run(self, s: int, t: int) -> None:
        while (far := self._lengths(s))[t] < float("inf"):
            tight = lambda x, e: self.room[e] and far[x] + self.cost[e] == far[self.to[e]]  # noqa: B023, E731
            while True:
                step, queue = {s: 0}, deque([s])
                while queue:
                    x = queue.popleft()
                    for e in self.out[x]:
                        if tight(x, e) and self.to[e] not in step:
                            step[self.to[e]] = step[x] + 1
                            queue.append(self.to[e])
                if t not in step:
                    break
                at, path = [0] * len(self.out), []
                while True:
                    x = self.to[path[-1]] if path else s
                    if x == t:
                        n = min(self.room[e] for e in path)
                        for e in path:
                            self.room[e] -= n
                            self.room[e ^ 1] += n
                        path = path[: next(i for i, e in enumerate(path) if not self.room[e])]
                        continue
                    while at[x] < len(self.out[x]) and not (tight(x, e := self.out[x][at[x]]) and step.get(self.to[e]) == step[x] + 1):
                        at[x] += 1
                    if at[x] < len(self.out[x]):
                        path.append(self.out[x][at[x]])
                    elif path:
                        at[self.to[path.pop() ^ 1]] += 1
                    else:
                        break


def plan(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int = REPEATS) -> list[list[int]]:
    """Words that each pattern (its sources, its words) gives to each of its sources."""
    flow, first = Flow(2 + len(patterns) + len(quotas)), 2 + len(patterns)
    for s, quota in enumerate(quotas):
        flow.edge(first + s, 1, quota)
    routes = []
    for p, (sources, words) in enumerate(patterns):
        for r in range(repeats):
            flow.edge(0, 2 + p, words, r)
        routes.append([flow.edge(2 + p, first + s, repeats * words) for s in sources])
    flow.run(0, 1)
    return [[flow.room[e ^ 1] for e in edges] for edges in routes]


def mix(docs: DataFrame, sources: Column, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """doc_id, size, taken, and routes: an array of (source, source_size, target, words) for each source of the document;
    sources: an array of the names of a document's sources."""
    spark = docs.sparkSession
    # Names sorted, each once, null last; a pattern is known by its JSON text.
    names = F.array_distinct(F.filter(sources, lambda x: x.isNotNull()))
    names = F.concat(F.array_sort(names.cast("array<string>")), F.filter(F.array(F.lit(None).cast("string")), lambda _: F.exists(sources, lambda x: x.isNull())))
    names = F.coalesce(names, F.array().cast("array<string>"))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), names.alias("names"), n_words(F.col("text")).alias("size"))
    keyed = table(sized.withColumn("pattern", F.to_json("names", {"ignoreNullFields": "false"})).withColumn("key", hash_order(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mix")
    found = keyed.groupBy("pattern").agg(F.first("names").alias("names"), F.sum("size").alias("size"), F.count("*").alias("n"))
    known = sorted(found.limit(MAX_PATTERNS + 1).collect(), key=lambda r: r.pattern)
    if len(known) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} different sets of sources")
    order = sorted({x for r in known for x in r.names}, key=lambda x: (x is None, x or ""))
    number = {x: i for i, x in enumerate(order)}
    held = [0] * len(order)
    for r in known:
        for x in r.names:
            held[number[x]] += r["size"]
    wanted = targets(held, [weights[i % len(weights)] for i in range(len(order))], sum(r["size"] for r in known), repeats)
    given = plan([(tuple(number[x] for x in r.names), r["size"]) for r in known], [int(t) for t in wanted], repeats)
    least = max(group, sum(r.n for r in known) // RANGES)
    rows = [(r.pattern, -(-r.n // least), r["size"], sum(words), [(x, held[number[x]], wanted[number[x]], n) for x, n in zip(r.names, words, strict=True)]) for r, words in zip(known, given, strict=True)]
    planned = F.broadcast(spark.createDataFrame(rows, "pattern string, ranges long, line long, flow long, routes array<struct<source:string,source_size:long,target:double,words:long>>"))  # at most MAX_PATTERNS rows
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(1 << 32))
    dealt = keyed.drop("names").join(planned.select("pattern", "ranges"), "pattern").withColumn("range", at).drop("ranges")
    before = F.coalesce(F.sum("words").over(Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("pattern", "range").agg(F.sum("size").alias("words")).withColumn("start", before).drop("words")  # at most RANGES rows and one for each pattern
    inside = F.sum("size").over(Window.partitionBy("pattern", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = dealt.withColumn("inside", inside).join(F.broadcast(starts), ["pattern", "range"]).withColumn("begin", F.col("start") + F.col("inside")).join(planned, "pattern")

    def lying(low: Column, high: Column) -> Column:
        """Words of the document that lie from low to high, in all lines."""
        each = [F.greatest(F.lit(0), F.least(high, F.col("begin") + r * F.col("line") + F.col("size")) - F.greatest(low, F.col("begin") + r * F.col("line"))) for r in range(repeats)]
        return sum(each[1:], each[0]).cast("long")

    until = lambda i: F.aggregate(F.slice("routes", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["words"])
    routes = F.transform("routes", lambda x, i: F.struct(x["source"].alias("source"), x["source_size"].alias("source_size"), x["target"].alias("target"), lying(until(i), until(i) + x["words"]).alias("words")))
    return placed.select("doc_id", "size", lying(F.lit(0).cast("long"), F.col("flow")).alias("taken"), routes.alias("routes"))
