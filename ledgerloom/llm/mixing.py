"""Mixing sources to target weights, by a min-cost flow over membership patterns.

A text may stand in several sources.  Texts are aggregated by the set of weighted
sources that hold them; each pattern offers its tokens once at no cost, a second
time at cost one, a third at cost three and so on (convex, so repetition is spread
evenly), up to the smallest max_repeats of its sources.  Token capacity is routed
to the quotas of the sources by successive shortest paths.  The network has a node
per pattern and source, however large the corpus; the flows are then laid out over
each pattern's texts in seeded order, so selection is a prefix sum and a range test.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import settle
from . import bpe

#: Sources with a weight; the patterns are sets of them.
MAX_SOURCES = 64
#: Patterns beyond this bound are refused, as the network is solved on the driver.
MAX_PATTERNS = 200_000
#: Rows that one bucket of the seeded order holds, about.
BUCKET_ROWS = 20_000


class Network:
    """Integer min-cost flow by successive shortest paths, all paths of one distance at once."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def _distances(self, source: int) -> list[float]:
        dist = [math.inf] * len(self.out)
        waiting = [False] * len(self.out)
        dist[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            waiting[x] = False
            for e in self.out[x]:
                y = self.to[e]
                if self.room[e] and dist[x] + self.cost[e] < dist[y]:
                    dist[y] = dist[x] + self.cost[e]
                    if not waiting[y]:
                        waiting[y] = True
                        queue.append(y)
        return dist

    def run(self, source: int, sink: int) -> int:
        """The largest flow at least cost: for each distance all shortest paths at once, as a largest flow over their arcs."""
        total = 0
        while (dist := self._distances(source))[sink] < math.inf:
            while push := self._blocking(source, sink, dist):
                total += push
        return total

    def _blocking(self, source: int, sink: int, dist: list[float]) -> int:
        """Fill the arcs of shortest paths along their layers until no path of that many arcs is left."""
        level = [-1] * len(self.out)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                y = self.to[e]
                if self.room[e] and level[y] < 0 and dist[x] + self.cost[e] == dist[y]:
                    level[y] = level[x] + 1
                    queue.append(y)
        if level[sink] < 0:
            return 0
        at = [0] * len(self.out)
        total, path = 0, []
        x = source
        while True:
            if x == sink:
                push = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= push
                    self.room[e ^ 1] += push
                total += push
                k = next(k for k, e in enumerate(path) if not self.room[e])
                x = self.to[path[k] ^ 1]
                del path[k:]
                continue
            while at[x] < len(self.out[x]):
                e = self.out[x][at[x]]
                y = self.to[e]
                if self.room[e] and level[y] == level[x] + 1 and dist[x] + self.cost[e] == dist[y]:
                    path.append(e)
                    x = y
                    break
                at[x] += 1
            else:
                if not path:
                    return total
                x = self.to[path.pop() ^ 1]
                at[x] += 1


def route(patterns: dict[tuple[str, ...], int], weights: dict[str, tuple[float, int]], total: int | None = None) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens of each pattern for each source.

    ``patterns`` has the tokens of each set of sources, ``weights`` the (share,
    max_repeats) of each source.  The mix has ``total`` tokens, or as many as the
    corpus has once, but never more than the shares and repetition caps allow.
    """
    names = sorted(weights)
    keys = sorted(patterns)
    share_sum = sum(weights[s][0] for s in names)
    if not keys or share_sum <= 0:
        return {}

    def solve(size: int) -> tuple[bool, dict]:
        net = Network(2 + len(keys) + len(names))
        for i, p in enumerate(keys):
            for r in range(min(weights[s][1] for s in p)):
                net.arc(0, 2 + i, patterns[p], r * (r + 1) // 2)
        links = {}
        at = {s: 2 + len(keys) + k for k, s in enumerate(names)}
        for i, p in enumerate(keys):
            for s in p:
                links[p, s] = net.arc(2 + i, at[s], patterns[p] * weights[s][1], 0)
        quotas = {s: math.floor(size * weights[s][0] / share_sum) for s in names}
        for s in names:
            net.arc(at[s], 1, quotas[s], 0)
        full = net.run(0, 1) == sum(quotas.values())
        return full, {k: net.room[e ^ 1] for k, e in links.items()}

    low, high = 0, total if total is not None else sum(patterns.values())
    full, flows = solve(high)
    if full:
        return flows
    best: dict = {}
    while high - low > 1:
        middle = (low + high) // 2
        full, flows = solve(middle)
        if full:
            low, best = middle, flows
        else:
            high = middle
    return best


def weighted_texts(documents: DataFrame, source_weights: DataFrame, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(text_key, doc_id, n_tokens, sources): each text once, with the weighted sources that hold it.

    Null, empty and tokenless texts, and sources without a weight, take no part.
    Of rows with equal texts the smallest doc_id stands for all.
    """
    weighted = source_weights.where("source is not null and target_share > 0 and max_repeats > 0").select("source").distinct()
    rows = documents.where("text is not null and text <> ''").select("doc_id", "source", "text").join(weighted, "source")
    keyed = rows.withColumn("text_key", F.sha2("text", 256))
    sources = keyed.groupBy("text_key").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.min("doc_id").alias("doc_id"))
    chosen = documents.select("doc_id", "text").join(sources, "doc_id").dropDuplicates(["text_key"])
    return bpe.token_counts(chosen, ["text_key", "doc_id", "sources"], vocabulary=vocabulary).where("n_tokens > 0")


def mixed(documents: DataFrame, source_weights: DataFrame, total: int | None = None, seed: int = 17, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(source, doc_id, n_tokens, copies): the mix.

    No text is used more often than the smallest max_repeats of its sources, over
    all sources together.  Shares differ from their targets by parts of one text
    per pattern and source.  The same seed gives the same mix at any partitioning.
    Empty tables give an empty mix.
    """
    spark = documents.sparkSession
    weights = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in source_weights.where("source is not null and target_share > 0 and max_repeats > 0").limit(MAX_SOURCES + 1).collect()}
    if len(weights) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} weighted sources")
    texts = settle(weighted_texts(documents, source_weights, vocabulary))
    by_pattern = texts.groupBy("sources").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(by_pattern) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["sources"]): int(r["tokens"]) for r in by_pattern}
    flows = route(patterns, weights, total)
    # each source owns a stretch of its patterns' repeated line of tokens
    stretches = []
    for p in patterns:
        at = 0
        for s in p:
            f = flows.get((p, s), 0)
            if f:
                stretches.append((list(p), s, at, at + f, patterns[p]))
                at += f
    layout = spark.createDataFrame(stretches, "sources array<string>, source string, a bigint, z bigint, round bigint")
    n_buckets = max(1, math.ceil(sum(r["n"] for r in by_pattern) / BUCKET_ROWS))
    order = F.xxhash64(F.lit(seed), "text_key")
    placed = texts.withColumn("order", order).withColumn("bucket", F.floor((order.cast("double") / 2.0**64 + 0.5) * n_buckets))
    sums = placed.groupBy("sources", "bucket").agg(F.sum("n_tokens").alias("held"))
    before = sums.select("sources", "bucket", (F.sum("held").over(Window.partitionBy("sources").orderBy("bucket")) - F.col("held")).alias("base"))
    inner = Window.partitionBy("sources", "bucket").orderBy("order", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = placed.withColumn("within", F.sum("n_tokens").over(inner) - F.col("n_tokens")).join(before, ["sources", "bucket"]).withColumn("u", F.col("base") + F.col("within"))
    # uses r of a text lie at u + r * round; count those inside the stretch
    first = F.greatest(F.ceil((F.col("a") - F.col("u")) / F.col("round")), F.lit(0))
    copies = F.greatest(F.ceil((F.col("z") - F.col("u")) / F.col("round")), F.lit(0)) - first
    used = lined.join(layout, "sources").withColumn("copies", copies.cast("int")).where("copies > 0")
    return used.select("source", "doc_id", "n_tokens", "copies")


def shares(mix: DataFrame, source_weights: DataFrame) -> DataFrame:
    """The actual share of every weighted source beside its target."""
    got = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("copies").alias("most_copies"))
    both = source_weights.select("source", "target_share", "max_repeats").join(got, "source", "left")
    both = both.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # one row a source, at most MAX_SOURCES
    return both.select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(F.coalesce(F.try_divide(F.col("tokens"), F.col("all_tokens")), F.lit(0.0)), 6).alias("actual_share"),
    )
