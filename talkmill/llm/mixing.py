"""Mixing sources to target shares of the tokens.

Exact copies of a text are one text; its pattern is the set of sources that hold it. Tokens are summed by pattern (at most
2^sources of them, so the flow problem is small whatever the corpus). A min-cost flow routes the patterns' tokens to the
sources' quotas: the first use of a text is free, each further use costs more (convex), a source may use a text max_repeats
times, and a text is used no more often than the largest max_repeats of its sources. The total is the largest that lets every
quota be met, unless one is given.

Then documents are selected: the texts of a pattern lie in seeded order on a line of their token counts; the flow to each
source is an interval of that line, wound round as often as it is longer, and a text is used for a source as often as the
place where it begins falls into the source's interval. So the tokens of a source miss its quota by less than one text for
each pattern it draws on.

Defined results: sources without target are left out, as are null, empty and other texts without tokens; a null or negative
share is 0, a null max_repeats 1; shares are taken relative to their sum; of copies within a source the smallest id stands
for all; a source with a share but no tokens gets none, and the others share by their relative weights.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.common import lookup_rows, running, spread, table, written
from talkmill.llm.encoding import NAME, TOKENIZERS, token_counter

SEED = "mix-1"


class Flow:
    """Min-cost flow by successive cheapest paths (Bellman-Ford with a queue); for the few nodes of patterns and sources."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.arcs: list[list] = []  # to, capacity, cost

    def arc(self, a: int, b: int, capacity: float, cost: float) -> int:
        self.out[a].append(len(self.arcs))
        self.arcs.append([b, capacity, cost])
        self.out[b].append(len(self.arcs))
        self.arcs.append([a, 0, -cost])
        return len(self.arcs) - 2

    def run(self, s: int, t: int) -> float:
        total, tiny = 0, 1e-9
        while True:
            dist, via = {s: 0}, {}
            queue, waiting = deque([s]), {s}
            while queue:
                a = queue.popleft()
                waiting.discard(a)
                for k in self.out[a]:
                    b, capacity, cost = self.arcs[k]
                    if capacity > tiny and dist[a] + cost < dist.get(b, float("inf")) - 1e-12:
                        dist[b], via[b] = dist[a] + cost, k
                        if b not in waiting:
                            queue.append(b)
                            waiting.add(b)
            if t not in dist:
                return total
            step, b = float("inf"), t
            while b != s:
                step = min(step, self.arcs[via[b]][1])
                b = self.arcs[via[b] ^ 1][0]
            b = t
            while b != s:
                self.arcs[via[b]][1] -= step
                self.arcs[via[b] ^ 1][1] += step
                b = self.arcs[via[b] ^ 1][0]
            total += step


def route(tokens: dict[str, int], members: dict[str, list[str]], repeats: dict[str, int], quota: dict[str, float]) -> tuple[dict[tuple[str, str], float], float]:
    """Tokens of each pattern used for each source, and their sum."""
    patterns, sources = sorted(tokens), sorted(quota)
    flow = Flow(len(patterns) + len(sources) + 2)
    s, t = len(patterns) + len(sources), len(patterns) + len(sources) + 1
    arcs = {}
    for i, p in enumerate(patterns):
        for level in range(max(repeats[x] for x in members[p])):
            flow.arc(s, i, tokens[p], level)
        for x in members[p]:
            arcs[p, x] = (flow.arc(i, len(patterns) + sources.index(x), tokens[p] * repeats[x], 0), tokens[p] * repeats[x])
    for j, x in enumerate(sources):
        flow.arc(len(patterns) + j, t, quota[x], 0)
    total = flow.run(s, t)
    return {k: c - flow.arcs[a][1] for k, (a, c) in arcs.items()}, total


def largest_total(tokens: dict[str, int], members: dict[str, list[str]], repeats: dict[str, int], share: dict[str, float]) -> int:
    """The largest whole number of tokens of which every source can hold its share."""
    lo, hi = 0, sum(n * max(repeats[x] for x in members[p]) for p, n in tokens.items())
    while lo < hi:
        mid = (lo + hi + 1) // 2
        quota = {x: mid * w for x, w in share.items()}
        lo, hi = (mid, hi) if route(tokens, members, repeats, quota)[1] >= mid * (1 - 1e-9) else (lo, mid - 1)
    return lo


def mix(documents: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: str = SEED, tokenizer: str = f"{TOKENIZERS}/{NAME}.tiktoken") -> DataFrame:
    """(doc_id, source, tokens, repeats) of the selected documents."""
    spark = documents.sparkSession
    rows = [r for r in lookup_rows(targets.select("source", "target_share", "max_repeats")) if r.source is not None]
    weight = {r.source: max(r.target_share or 0.0, 0.0) for r in rows}
    repeats = {r.source: max(int(r.max_repeats or 1), 1) for r in rows}
    whole = sum(weight.values())
    share = {x: w / whole for x, w in weight.items() if w > 0} if whole else {}
    schema = "doc_id bigint, source string, tokens int, repeats bigint"
    if not share:
        return spark.createDataFrame([], schema)
    docs = spread(documents.filter(F.col("source").isin(*share)).select("doc_id", "source", "text")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.sha2("text", 256).alias("h"), token_counter(spark, tokenizer)(F.col("text")).alias("tokens"))
    held = docs.filter("tokens > 0").groupBy("h", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    texts = written(held.groupBy("h").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "doc_id")))).alias("docs"), F.max("tokens").alias("tokens")).withColumn("pattern", F.array_join(F.map_keys("docs"), "\x01")))
    sums = {r.pattern: r.n for r in texts.groupBy("pattern").agg(F.sum("tokens").alias("n")).collect()}  # at most 2^sources rows
    members = {p: p.split("\x01") for p in sums}
    held_by = {x for m in members.values() for x in m}
    there = sum(w for x, w in share.items() if x in held_by)
    share = {x: w / there for x, w in share.items() if x in held_by}
    total = largest_total(sums, members, repeats, share)
    if total_tokens is not None:
        total = min(total, total_tokens)
    used, _ = route(sums, members, repeats, {x: total * w for x, w in share.items()})
    spans = []
    for p in sorted(sums):
        at = 0.0
        for x in members[p]:
            if used[p, x] > 1e-6:
                spans.append((p, x, at, at + used[p, x], sums[p]))
                at += used[p, x]
    if not spans:
        return spark.createDataFrame([], schema)
    placed = running(texts.withColumn("_rank", F.sha2(F.concat(F.lit(seed), "h"), 256)), "pattern", ["_rank"], F.col("tokens"), "place")
    part = F.broadcast(spark.createDataFrame(spans, "pattern string, source string, first double, last double, length bigint"))  # a row for each pattern and source
    times = F.ceil((F.col("last") - F.col("place")) / F.col("length")) - F.ceil((F.col("first") - F.col("place")) / F.col("length"))
    out = placed.join(part, "pattern").select(F.col("docs")[F.col("source")].alias("doc_id"), "source", "tokens", times.cast("bigint").alias("repeats"))
    return out.filter("repeats > 0")


def shares(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source got: target and reached share, tokens, documents and the most repeats."""
    got = selected.groupBy("source").agg(F.sum(F.col("tokens").cast("bigint") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    t = targets.filter("source is not null").select("source", "target_share", "max_repeats")
    return t.join(got, "source", "left").crossJoin(F.broadcast(whole)).select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), "most_repeats", (F.coalesce("tokens", F.lit(0)) / F.nullif("whole", F.lit(0))).alias("share"))


def p9_documents(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark, sf_dir: str) -> DataFrame:
    return shares(p9_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
