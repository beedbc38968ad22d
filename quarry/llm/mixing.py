"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, materialize, n_words, text_of

#: Cells of the seeded order of each pattern's documents: shares are exact to one cell.
CELLS = 4096
#: Parts of a use, each of a cost of its own, so that patterns are drawn on alike.
PARTS = 4
#: Cost a token of each quarter of the 1st to 4th use of a pattern's documents; convex.
REPEAT_COSTS = tuple(k + 8 * (k // PARTS) for k in range(4 * PARTS))
#: Parts that later uses come in, as many each time that the uses double.
LATER_PARTS = 16
#: Cost of a token of quota that stays unmet, where the uses are limited.
SHORT = 1000


class Flow:
    """Min-cost flow by primal-dual phases: shortest distances, then all augmentations
    along arcs of reduced cost zero. Phases are as many as there are distinct path costs."""

    def __init__(self, nodes: int):
        self.adj: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.adj[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            dist: list[float] = [float("inf")] * len(self.adj)
            dist[s], queue, queued = 0, deque([s]), {s}
            while queue:
                v = queue.popleft()
                queued.discard(v)
                for e in self.adj[v]:
                    if self.cap[e] and dist[v] + self.cost[e] < dist[self.to[e]]:
                        dist[self.to[e]] = dist[v] + self.cost[e]
                        if self.to[e] not in queued:
                            queued.add(self.to[e])
                            queue.append(self.to[e])
            if dist[t] == float("inf"):
                return total
            while True:  # breadth-first augmentations along tight arcs
                came, queue = {s: -1}, deque([s])
                while queue and t not in came:
                    v = queue.popleft()
                    for e in self.adj[v]:
                        if self.cap[e] and self.to[e] not in came and dist[v] + self.cost[e] == dist[self.to[e]]:
                            came[self.to[e]] = e
                            queue.append(self.to[e])
                if t not in came:
                    break
                path, v = [], t
                while v != s:
                    path.append(came[v])
                    v = self.to[came[v] ^ 1]
                by = min(self.cap[e] for e in path)
                for e in path:
                    self.cap[e] -= by
                    self.cap[e ^ 1] += by
                    total += by * self.cost[e]


def later_uses(tokens: int, most: int) -> list[tuple[int, int]]:
    """(tokens, cost a token) of the parts after the 4th use of a pattern of ``tokens``, until it
    gives ``most`` in all. Costs rise as those of REPEAT_COSTS do, by the use that a part begins at."""
    out, at, uses = [], 4 * tokens, 4
    while at < most:
        for k in range(LATER_PARTS):
            low, high = (tokens * uses * (LATER_PARTS + x) // LATER_PARTS for x in (k, k + 1))
            out.append((high - low, 12 * uses * (LATER_PARTS + k) // LATER_PARTS))
        at, uses = 2 * at, 2 * uses
    return out


def route(patterns: list[tuple[tuple[str, ...], int]], quotas: dict[str, int], costs=REPEAT_COSTS, parts: int = PARTS, limited: bool = True) -> tuple[dict[tuple[int, str], int], int]:
    """Tokens that pattern i sends to each source, and the cost. Each pattern offers a
    ``parts``-th of its tokens at each of ``costs``, and unless ``limited`` as many uses more as
    the quotas of its sources can need (:func:`later_uses`). Quota that nothing fills costs SHORT
    a token, or more than any use if not limited: only sources without tokens then stay short."""
    names = sorted(quotas)
    s, t, p0, q0 = 0, 1, 2, 2 + len(patterns)
    flow = Flow(q0 + len(names))
    at = {n: q0 + i for i, n in enumerate(names)}
    arcs, short = {}, SHORT
    for i, (members, tokens) in enumerate(patterns):
        if not limited:
            for n, c in later_uses(tokens, sum(quotas.get(m, 0) for m in members)):
                flow.arc(s, p0 + i, n, c)
                short = max(short, c + 1)
        for k, c in enumerate(costs):
            flow.arc(s, p0 + i, tokens * (k % parts + 1) // parts - tokens * (k % parts) // parts, c)
        for m in members:
            if m in at:
                arcs[i, m] = flow.arc(p0 + i, at[m], sum(quotas.values()) + 1, 0)
    for n in names:
        flow.arc(s, at[n], quotas[n], short)
        flow.arc(at[n], t, quotas[n], 0)
    cost = flow.run(s, t)
    return {k: flow.cap[e ^ 1] for k, e in arcs.items() if flow.cap[e ^ 1]}, cost


def tempered_targets(tokens: dict[str, int], alpha: float = 0.5) -> dict[str, float]:
    """Weights in proportion to tokens ** alpha: small sources get more than their share."""
    raw = {k: v**alpha for k, v in tokens.items() if v > 0}
    whole = sum(raw.values())
    return {k: v / whole for k, v in raw.items()}


def default_members() -> Column:
    """Two overlapping families of sources: where a text is from, and its language."""
    return F.array_compact(F.array(F.concat(F.lit("lang="), F.col("lang")), F.concat(F.lit("source="), F.col("source"))))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, budget: int | None = None, share: float = 0.75, alpha: float = 0.5, seed: int = 23, members: Column | None = None, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """Chooses documents so that each source gets its share of ``budget`` tokens.

    members: an array of the sources a document belongs to, which may be several; its
    tokens count for one of them at a time. targets: weight by source, tempered by
    ``alpha`` unless given; budget: tokens in all, ``share`` of the input's unless given. Tokens
    are counted over all documents by pattern of membership; a min-cost flow routes them
    to quotas, each further use of a pattern costing more (REPEAT_COSTS, then
    :func:`later_uses`), as many as the quotas need: none stays unmet. Within a pattern
    documents stand in the order of a seeded hash, cut into CELLS cells; each routed amount
    takes the next run of cells, and goes on from the first cell as a further use when it
    passes the last. Shares are exact to one cell.

    Returns ``doc_id, source, use, tokens``, a row a use (use 1, 2, ...); with rows=True
    the input's own columns, a row a use. Null ids hash like any value; documents with no
    source or no tokens are never chosen; repeated rows are chosen together. Sources of
    targets that no document has are dropped and the weights of the others keep their ratio.
    """
    spark = docs.sparkSession
    c_tokens, c_key, c_cell, c_use = fresh(docs, "tokens", "members", "cell", "use")
    member = F.sort_array(F.array_distinct(default_members() if members is None else members))
    keyed = docs.withColumns({c_tokens: n_words(text_of(text_col)).cast("long"), c_key: member, c_cell: F.shiftrightunsigned(F.xxhash64(col(id_col), F.lit(seed)), 52).cast("int")})
    slim = materialize(keyed.select(col(id_col).alias("doc_id"), c_tokens, c_key, c_cell).where(f"{c_tokens} > 0 and size({c_key}) > 0"), "counted")  # words are counted once
    cells = materialize(slim.groupBy(F.col(c_key).alias("members"), F.col(c_cell).alias("cell")).agg(F.sum(c_tokens).alias("tokens")), "cells")
    found = sorted(((tuple(r[0]), r[1]) for r in cells.groupBy("members").agg(F.sum("tokens")).collect()), key=lambda x: x[0])  # a row a pattern

    by_source: dict[str, int] = {}
    for names, n in found:
        for m in names:
            by_source[m] = by_source.get(m, 0) + n
    weights = tempered_targets(by_source, alpha) if targets is None else {k: v for k, v in targets.items() if by_source.get(k) and v > 0}
    whole = sum(weights.values())
    total = int(share * sum(n for _, n in found)) if budget is None else budget
    quotas = {k: int(total * v / whole) for k, v in sorted(weights.items())}
    sent, _ = route(found, quotas, limited=False)

    spans, at = [], 0
    for i, (names, n) in enumerate(found):
        at = 0
        for m in names:
            left = sent.get((i, m), 0)
            while left:
                use, low = divmod(at, n)
                step = min(left, n - low)
                spans.append((list(names), m, use + 1, low, low + step))
                at, left = at + step, left - step
    spans_df = spark.createDataFrame(spans, "members array<string>, source string, use int, low long, high long")
    ordered = Window.partitionBy("members").orderBy("cell")
    middle = cells.withColumn("at", F.sum("tokens").over(ordered) - F.col("tokens") / 2)
    runs = F.broadcast(spans_df) if len(spans) < 100_000 else spans_df
    cuts = middle.join(runs, "members").where("at >= low and at < high").groupBy("members", "source", "use").agg(F.min("cell").alias("low"), F.max("cell").alias("high"))
    by_pattern = cuts.groupBy("members").agg(F.sort_array(F.collect_list(F.struct("use", "source", "low", "high"))).alias("uses"))
    by_pattern = materialize(by_pattern.select(F.col("members").alias(c_key), F.col("uses").alias(c_use)), "uses")
    small = F.broadcast(by_pattern) if len(found) < 20_000 else by_pattern
    uses = F.explode(F.filter(F.col(c_use), lambda u: F.col(c_cell).between(u["low"], u["high"])))
    if rows:
        return keyed.where(text_of(text_col).rlike(r"\S")).join(small, c_key).withColumn(c_use, uses).select(*[col(c) for c in docs.columns])
    chosen = slim.join(small, c_key).withColumn(c_use, uses)
    return chosen.select("doc_id", F.col(c_use)["source"].alias("source"), F.col(c_use)["use"].alias("use"), F.col(c_tokens).alias("tokens"))
