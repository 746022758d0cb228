"""Documents of several sources put together so that each source has its target share of the tokens.

Documents are aggregated by membership pattern (the set of sources that hold them), so what is solved is small
whatever the number of documents: a min-cost flow from patterns through their repetitions (the j-th use of
a document costs j - 1, a convex cost, so repeats come last and evenly) into the sources' quotas. The flow
then becomes documents: those of a pattern are put in a seeded order, and every use of the pattern goes
to the source whose token interval it falls into.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vocabulary of a public tokenizer; the path is a parameter.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenization pattern that belongs to this vocabulary (a fixed value of the tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Buckets of a pattern's seeded order: a task orders the documents of one bucket.
BUCKETS = 16_384
#: Most membership patterns that the driver solves at once.
MAX_PATTERNS = 50_000


def with_tokens(documents: DataFrame, text: str = "text", vocabulary: str = TOKENIZER) -> DataFrame:
    """documents without the text, with ``tokens`` (bigint), the text's length in tokens; 0 for null and empty texts. A column called tokens is replaced."""
    cols = [c for c in documents.columns if c not in (text, "tokens")]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in documents.select(*cols).dtypes), "tokens long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*cols, "tokens"])

    return documents.select(*cols, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost >= 0) of a largest flow from source to sink that costs least."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for a, b, c, w in edges:
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)
    while True:
        dist, via, queued = [None] * n, [-1] * n, [False] * n
        dist[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            queued[x] = False
            for e in graph[x]:
                if cap[e] and (dist[to[e]] is None or dist[x] + cost[e] < dist[to[e]]):
                    dist[to[e]], via[to[e]] = dist[x] + cost[e], e
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        queue.append(to[e])
        if dist[sink] is None:
            return [cap[2 * i + 1] for i in range(len(edges))]
        x, push = sink, None
        while x != source:
            push = cap[via[x]] if push is None else min(push, cap[via[x]])
            x = to[via[x] ^ 1]
        x = sink
        while x != source:
            cap[via[x]] -= push
            cap[via[x] ^ 1] += push
            x = to[via[x] ^ 1]


def plan(patterns: dict[tuple[str, ...], int], targets: list[tuple[str, float, int]], size: int | None = None) -> tuple[list[tuple[tuple[str, ...], int, str, int, int]], dict[str, tuple[int, int]]]:
    """Token intervals (pattern, use, source, from, to) and, by source, (quota, routed) of one mix.

    patterns: sources that a document is in, to tokens; targets: source, weight, most uses of a document; size: of
    the mix in tokens, by default that of all documents. Sources with a weight of 0 or less get nothing.
    """
    weights = {s: (max(w, 0.0), max(r, 0)) for s, w, r in targets}
    total = sum(w for w, _ in weights.values())
    size = sum(patterns.values()) if size is None else size
    quota = {s: -int(-(w / total * size) // 1) if total else 0 for s, (w, _) in weights.items()}
    quota = {s: min(q, size) for s, q in quota.items()}
    kinds = sorted(p for p in patterns if any(s in weights for s in p))
    names = sorted(weights)
    at: dict[object, int] = {"from": 0, "to": 1}
    edges: list[tuple[int, int, int, int]] = []
    for s in names:
        at[s] = len(at)
        edges.append((at[s], 1, quota[s], 0))
    routes = []
    for p in kinds:
        for use in range(1, max(weights[s][1] for s in p if s in weights) + 1):
            at[(p, use)] = len(at)
            edges.append((0, at[(p, use)], patterns[p], use - 1))
            for s in p:
                if s in weights and weights[s][1] >= use:
                    routes.append((len(edges), p, use, s))
                    edges.append((at[(p, use)], at[s], patterns[p], 0))
    flow = min_cost_flow(len(at), edges, 0, 1)
    intervals, filled = [], dict.fromkeys(names, 0)
    spot: dict[tuple, int] = {}
    for e, p, use, s in routes:
        if flow[e]:
            begin = spot.get((p, use), 0)
            intervals.append((p, use, s, begin, begin + flow[e]))
            spot[(p, use)] = begin + flow[e]
            filled[s] += flow[e]
    return intervals, {s: (quota[s], filled[s]) for s in names}


def read_targets(targets: DataFrame, canonical) -> dict[str, list[tuple[str, float, int]]]:
    """By mix its (source, weight, most uses); a null number of uses is once, repeated rows count once, nulls elsewhere leave a row out."""
    rows = targets.where("mix_name is not null and source is not null and target_share is not null").select("mix_name", canonical(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("w"), F.coalesce("max_repeats", F.lit(1)).cast("int").alias("r"))
    out: dict[str, list[tuple[str, float, int]]] = {}
    for r in rows.groupBy("mix_name", "source").agg(F.max("w").alias("w"), F.max("r").alias("r")).orderBy("mix_name", "source").limit(MAX_PATTERNS).collect():
        out.setdefault(r["mix_name"], []).append((r["source"], r["w"], r["r"]))
    return out


class Mix:
    """All mixes over one corpus. documents: doc_id, sources (array<string>, canonical names), tokens."""

    def __init__(self, documents: DataFrame, targets: dict[str, list[tuple[str, float, int]]], size: int | None = None):
        self.documents = documents.select("doc_id", F.array_sort(F.array_distinct(F.filter("sources", lambda s: s.isNotNull()))).alias("sources"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
        self.targets = targets
        rows = self.documents.groupBy("sources").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).limit(MAX_PATTERNS + 1).collect()
        if len(rows) > MAX_PATTERNS:
            raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
        self.patterns = {tuple(r["sources"] or ()): int(r["tokens"] or 0) for r in rows}
        self.total = sum(self.patterns.values())
        self.plans = {m: plan(self.patterns, t, size) for m, t in sorted(targets.items())}
        self.spark = documents.sparkSession

    def report(self) -> DataFrame:
        """mix_name, source, target_share, target_tokens, available_tokens, mixed_tokens, actual_share, falls_short."""
        rows = []
        for m, (_, filled) in self.plans.items():
            weights, mixed = sum(max(w, 0.0) for _, w, _ in self.targets[m]), sum(f for _, f in filled.values())
            for s, w, r in self.targets[m]:
                quota, got = filled[s]
                available = sum(t for p, t in self.patterns.items() if s in p) * max(r, 0)
                rows.append((m, s, max(w, 0.0) / weights if weights else 0.0, quota, available, got, got / mixed if mixed else 0.0, got < quota))
        return self.spark.createDataFrame(rows, "mix_name string, source string, target_share double, target_tokens long, available_tokens long, mixed_tokens long, actual_share double, falls_short boolean")

    def select(self, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
        """mix_name, source, doc_id, repeats, tokens: the documents of every mix and how often each is used.

        A document's use counts for the source in whose interval its first token falls, so a source is off
        its routed tokens by one document at most. Documents without tokens are not used.
        """
        key = F.xxhash64(F.lit(seed), "doc_id")
        docs = self.documents.where("tokens > 0").withColumn("bucket", F.pmod(key, F.lit(buckets))).withColumn("rank", key)
        in_bucket = Window.partitionBy("sources", "bucket").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        sums = docs.groupBy("sources", "bucket").agg(F.sum("tokens").alias("sum"))
        before = sums.select(F.col("sources").alias("b_sources"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("sum").over(Window.partitionBy("sources").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        placed = docs.withColumn("inside", F.coalesce(F.sum("tokens").over(in_bucket), F.lit(0))).join(before, (F.col("sources") == F.col("b_sources")) & (F.col("bucket") == F.col("b_bucket"))).select("doc_id", "sources", "tokens", (F.col("inside") + F.col("before")).alias("spot"))
        rows = [(m, list(p), s, a, b) for m, (intervals, _) in self.plans.items() for p, _, s, a, b in intervals]
        routes = self.spark.createDataFrame(rows, "mix_name string, r_sources array<string>, source string, begin long, end long")
        small = F.broadcast(routes) if len(rows) <= 100_000 else routes
        used = placed.join(small, (F.col("sources") == F.col("r_sources")) & (F.col("spot") >= F.col("begin")) & (F.col("spot") < F.col("end")))
        return used.groupBy("mix_name", "source", "doc_id").agg(F.count("*").cast("int").alias("repeats"), F.max("tokens").alias("tokens"))


def member_of(*sources: Column) -> Column:
    """The membership pattern of a document that is in the given sources."""
    return F.array(*sources)


__all__ = ["Mix", "member_of", "min_cost_flow", "plan", "read_targets", "with_tokens"]
