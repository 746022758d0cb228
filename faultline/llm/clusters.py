"""Clusters of similar records by parallel pivot correlation clustering.

In every unit of work (a block of a cell with a block of its visitors) pivots are found in rounds: of all
vectors still free, those whose hash is the smallest among their similar free ones become pivots and absorb
them. What crosses between two pivots' groups gives one link between the pivots, so a unit sends a star and a
few links and never its pairs. Links are contracted over the cluster until every connected set has one
label; then members are reassigned to the most typical member, recomputed from the set's sum of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import vectors as V
from faultline.runtime import cut

#: Most rounds of contraction: sets of 2 ** ROUNDS members and more.
ROUNDS = 40


def pivot_links(order: np.ndarray, rows: np.ndarray, cols: np.ndarray, cosine: np.ndarray) -> list[tuple[int, int]]:
    """Links (member, pivot) and (pivot, pivot) that connect exactly what the similar pairs (rows, cols) connect.

    order: the hash rank of every vertex, a permutation. In a round the free vertices that come first among their free neighbours
    are pivots, and every free neighbour joins its most similar pivot.
    """
    n = len(order)
    a, b, s = np.concatenate([rows, cols]), np.concatenate([cols, rows]), np.concatenate([cosine, cosine])
    of = np.full(n, -1, np.int64)
    has = np.zeros(n, bool)
    has[a] = True
    free = has.copy()
    while True:
        live = free[a] & free[b]
        if not live.any():
            break
        x, y, z = a[live], b[live], s[live]
        first = np.full(n, n, np.int64)
        np.minimum.at(first, x, order[y])
        pivot = free & (order < first)
        of[pivot] = np.flatnonzero(pivot)
        touch = pivot[y] & ~pivot[x]
        x, y, z = x[touch], y[touch], z[touch]
        rank = np.lexsort((order[y], -z, x))
        x, y = x[rank], y[rank]
        head = np.r_[True, x[1:] != x[:-1]] if len(x) else np.empty(0, bool)
        of[x[head]] = y[head]
        free &= ~pivot
        free[x] = False
    alone = np.flatnonzero(free)
    of[alone] = alone
    p, q = of[a], of[b]
    cross = np.unique(np.stack([p, q], 1)[p < q], axis=0) if len(a) else np.empty((0, 2), np.int64)
    stars = np.flatnonzero((of >= 0) & (of != np.arange(n)))
    return [*zip(stars.tolist(), of[stars].tolist(), strict=True), *map(tuple, cross.tolist())]


def similar_links(reps: DataFrame, dim: int, least: float, probes: int = V.PROBES) -> DataFrame:
    """Links (a, b) between points (id, u) that connect what pairs at cosine least or more connect."""
    cells = V.make_cells(reps, dim, probes)
    kind = dict(reps.dtypes)["id"]

    def unit(key: tuple, t: pa.Table) -> pa.Table:
        mine = t.column("is_home").to_numpy(zero_copy_only=False)
        home, visitor = t.filter(pa.array(mine)), t.filter(pa.array(~mine))
        hid, vid = home.column("id").to_pylist(), visitor.column("id").to_pylist()
        names = sorted(set(hid) | set(vid))
        at = {x: i for i, x in enumerate(names)}
        h, v = np.array([at[x] for x in hid], np.int64), np.array([at[x] for x in vid], np.int64)
        rows, cols, cos = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(h) and len(v):
            hm, vm = V.as_matrix(home.column("u"), dim), V.as_matrix(visitor.column("u"), dim)
            for start in range(0, len(v), 1024):
                s = vm[start : start + 1024] @ hm.T
                r, c = np.nonzero(s >= least - 1e-5)
                x, y, z = v[start + r], h[c], s[r, c].astype(np.float64)
                close = np.abs(z - least) < 2e-5  # too near to call in single precision
                if close.any():
                    e = np.einsum("ij,ij->i", vm[start + r[close]].astype(np.float64), hm[c[close]].astype(np.float64))
                    z[close] = e
                ok = (x != y) & (z >= least)
                rows.append(x[ok]), cols.append(y[ok]), cos.append(z[ok])
        rng = np.array([hash_rank(x) for x in names], np.uint64)
        order = np.empty(len(names), np.int64)
        order[np.lexsort((np.arange(len(names)), rng))] = np.arange(len(names))
        links = pivot_links(order, np.concatenate(rows), np.concatenate(cols), np.concatenate(cos))
        return pa.table({"a": pa.array([names[x] for x, _ in links], home.schema.field("id").type), "b": pa.array([names[y] for _, y in links], home.schema.field("id").type)})

    return V.spread(reps, cells, dim, probes).groupBy(*V.UNIT).applyInArrow(unit, f"a {kind}, b {kind}")


def hash_rank(x) -> int:
    """The hash that orders vertices, the same everywhere."""
    import xxhash

    return xxhash.xxh64_intdigest(str(x).encode())


def connect(links: DataFrame) -> DataFrame:
    """id and label (the smallest id reached) of every id that has a link, by contraction in logarithmic rounds."""
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = cut(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().select("id", F.col("id").alias("label")))
    for _ in range(ROUNDS):
        if edges.isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # every label points to the smallest of its neighbours and itself; two hops at once
        step = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")).select(F.col("a").alias("n"), "to"))
        hop = step.select(F.col("n").alias("m"), F.col("to").alias("to2"))
        step = cut(step.join(hop, F.col("to") == F.col("m"), "left").select("n", F.coalesce("to2", "to").alias("to")))
        s2 = step.select(F.col("n").alias("n2"), F.col("to").alias("t2"))
        labels = cut(labels.join(step, F.col("label") == F.col("n"), "left").select("id", F.coalesce("to", "label").alias("label")))
        edges = cut(
            edges.join(step, F.col("a") == F.col("n")).select(F.col("to").alias("a"), "b").join(s2, F.col("b") == F.col("n2")).select("a", F.col("t2").alias("b")).where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
    return labels


def clusters(rows: DataFrame, dim: int, least: float = 0.70, smallest: int = 5, probes: int = V.PROBES) -> DataFrame:
    """id, label, size, medoid, centrality of every member of a cluster (rows: id, v, distinct ids); what is in none is noise and left out.

    label: the cluster's smallest id. medoid: the member with the highest mean cosine to all members, of equals
    the smallest id. centrality: a member's mean cosine to the cluster. Unusable vectors (null, of another length, not finite, all
    zero) are noise; exact copies are in one cluster, whatever else is. Empty in, empty out.
    """
    reps, members = V.collapse_copies(rows, dim)
    if members.isEmpty():
        return members.select("id", F.col("id").alias("label"), F.lit(0).cast("long").alias("size"), F.col("id").alias("medoid"), F.lit(0.0).alias("centrality"))
    labels = connect(cut(similar_links(reps, dim, least, probes)))
    named = members.join(labels.select(F.col("id").alias("rep_id"), "label"), F.col("rep") == F.col("rep_id"), "left").select("id", F.coalesce("label", "rep").alias("label"))
    sizes = named.groupBy(F.col("label").alias("z_label")).agg(F.count("*").alias("size")).where(F.col("size") >= smallest)
    kept = named.join(sizes, F.col("label") == F.col("z_label")).select(F.col("id").alias("k_id"), "label", "size")
    kind = dict(rows.dtypes)["id"]
    own = cut(kept.join(rows.select("id", "v"), F.col("k_id") == F.col("id")).select("id", "v", "label", "size"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                names, at = np.unique(np.array(b.column(2).to_pylist(), object), return_inverse=True)
                _, unit = V._usable(b, dim)
                sums = np.zeros((len(names), dim))
                np.add.at(sums, at, unit.astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), b.column(2).type), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["s_label", "part"])

    parts = own.select("id", "v", "label").mapInArrow(add, f"s_label {kind}, part array<double>")
    sums = parts.groupBy("s_label").agg(Summarizer.sum(array_to_vector("part")).alias("s")).select("s_label", vector_to_array("s").alias("s"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, unit = V._usable(b, dim)
                s = b.column(4).values.to_numpy().reshape(-1, dim)
                mean = np.einsum("ij,ij->i", unit.astype(np.float64), s) / b.column(3).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(mean)], names=["id", "label", "size", "centrality"])

    scored = cut(own.join(sums, F.col("label") == F.col("s_label")).select("id", "v", "label", "size", "s").mapInArrow(score, f"id {kind}, label {kind}, size long, centrality double"))
    best = scored.groupBy(F.col("label").alias("m_label")).agg(F.min(F.struct((-F.col("centrality")).alias("c"), "id")).getField("id").alias("medoid"))
    return scored.join(best, F.col("label") == F.col("m_label")).select("id", "label", "size", "medoid", "centrality")
