"""The most similar vectors of every vector, by randomly rotated one-bit codes.

Within a cell every home vector is reduced to the signs of its rotated residual from the cell's centroid
(one bit a dimension, packed) and two correction scalars. A visitor estimates its inner product with all homes
from the packed bits; the estimate's error bound says which of them can still be among its k most similar, and
only those are reranked with the exact product. Groups of exact copies are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm import vectors as V
from faultline.runtime import cut

#: Seed of the random rotation, and how many standard errors the bound allows.
ROTATION_SEED, ERRORS = 20_24, 3.0
#: Bits of a visitor's rotated residual in the estimate.
QUERY_BITS = 4
#: From this least cosine on, points visit cells as codes: so few pairs are left open that their vectors can be fetched. Below it they visit as vectors.
CODES_FROM = 0.5


def rotation(dim: int, seed: int = ROTATION_SEED) -> np.ndarray:
    """A random orthogonal matrix, the same on every executor."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(residuals: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (uint64 words), length and correction <code, unit residual> of every residual."""
    dim = residuals.shape[1]
    length = np.linalg.norm(residuals, axis=1)
    unit = residuals / np.maximum(length, 1e-12)[:, None]
    turned = unit @ turn
    signs = turned > 0
    fit = np.abs(turned).sum(1) / np.sqrt(dim)
    words = -(-dim // 64)
    padded = np.zeros((len(signs), words * 64), bool)
    padded[:, :dim] = signs
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64), length, fit


def encode_queries(residuals: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Queries' rotated residuals, rounded to QUERY_BITS bits a dimension, as rows of bytes: least value, step, length (float32) and the packed bit planes."""
    dim = residuals.shape[1]
    turned = residuals @ turn
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / (2**QUERY_BITS - 1), 1e-12)
    padded = np.zeros((len(turned), -(-dim // 64) * 64), np.uint8)
    padded[:, :dim] = np.rint((turned - low[:, None]) / step[:, None])
    head = np.stack([low, step, np.linalg.norm(residuals, axis=1)], 1).astype(np.float32).view(np.uint8)
    return np.concatenate([head, *(np.packbits((padded >> k) & 1, axis=1, bitorder="little") for k in range(QUERY_BITS))], 1)


def estimate(bits: np.ndarray, fit: np.ndarray, coded: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x codes) of unit residuals with encoded queries, and the bounds of their errors.

    The product with the codes is a sum of population counts over a query's bit planes.
    """
    low, step, length = (x[:, None] for x in np.ascontiguousarray(coded[:, :12]).view(np.float32).T)
    planes = np.ascontiguousarray(coded[:, 12:]).view(np.uint64).reshape(len(coded), QUERY_BITS, -1)
    total, levels = np.zeros((len(coded), len(bits)), np.float32), np.zeros((len(coded), 1), np.float32)
    for plane in range(QUERY_BITS):
        ones = np.zeros(total.shape, np.uint16)
        for w in range(bits.shape[1]):
            ones += np.bitwise_count(planes[:, plane, w, None] & bits[None, :, w])
        total += np.float32(1 << plane) * ones
        levels += np.float32(1 << plane) * np.bitwise_count(planes[:, plane]).sum(1, keepdims=True)
    count = np.bitwise_count(bits).sum(1).astype(np.float32)
    # <code, q> with code = (2 bit - 1) / sqrt(dim)
    raw = (2 * (step * total + low * count[None, :]) - (step * levels + low * dim)) / np.sqrt(dim)
    fit = np.maximum(fit, 1e-6)
    bound = ERRORS * np.sqrt(np.maximum(1 - fit**2, 0) / fit**2 / max(1, dim - 1))
    rounding = ERRORS * step * np.sqrt(1 / 12) / fit.min()
    return raw / fit[None, :], length * bound[None, :] + rounding


def _survivors(home: np.ndarray, home_id: np.ndarray, coded: np.ndarray, dots: np.ndarray, visitor_id: np.ndarray, centroid: np.ndarray, turn: np.ndarray, k: int, least: float):
    """Blocks of (visitor rows, home rows, lower and upper bounds) of the pairs that the bounds leave: not wholly below least or the k-th best lower bound of this unit."""
    bits, length, fit = encode(home - centroid, turn)
    home_part = home @ centroid  # <o, q> = |o - c| <unit, q - c> + <o, c> + <c, q> - <c, c>
    for start in range(0, len(coded), 512):
        est, err = estimate(bits, fit, coded[start : start + 512], home.shape[1])
        mid = length[None, :] * est + home_part[None, :] + dots[start : start + 512, None] - float(centroid @ centroid)
        err = length[None, :] * err + 1e-5
        same = visitor_id[start : start + 512][:, None] == home_id[None, :]
        mid[same] = -9.0
        err[same] = 0.0
        upper, lower = mid + err, mid - err
        floor = np.full(len(mid), least, np.float32)
        if len(home) > k:
            floor = np.maximum(floor, np.partition(lower, len(home) - k, axis=1)[:, len(home) - k])
        r, c = np.nonzero((upper >= floor[:, None]) & ~same)
        if len(r):
            yield r + start, c, lower[r, c], upper[r, c]


def _first(rows: np.ndarray, names: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of every row, ties by name."""
    order = np.lexsort((names.astype(str), -score, rows))
    r = rows[order]
    first = np.r_[0, np.flatnonzero(r[1:] != r[:-1]) + 1] if len(r) else np.empty(0, np.int64)
    return order[np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)])) < k]


def search_unit(home: np.ndarray, home_id: np.ndarray, visitor: np.ndarray, visitor_id: np.ndarray, centroid: np.ndarray, turn: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(visitor rows, home rows, cosines): for each visitor its k most similar homes of this unit, none below least."""
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    out = [none]
    for r, c, _, _ in _survivors(home, home_id, encode_queries(visitor - centroid, turn), visitor @ centroid, visitor_id, centroid, turn, k, least):
        exact = np.einsum("ij,ij->i", visitor[r].astype(np.float64), home[c].astype(np.float64))
        r, c, exact = r[exact >= least], c[exact >= least], exact[exact >= least]
        best = _first(r, home_id[c], exact, k)
        out.append((r[best], c[best], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search_codes(home: np.ndarray, home_id: np.ndarray, coded: np.ndarray, visitor_id: np.ndarray, centroid: np.ndarray, turn: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(visitor rows, home rows, lower, upper) of the pairs that may count, the visitors being codes. Where a visitor is at home in this unit the cosine is exact, and lower and upper are equal."""
    at = {x: i for i, x in enumerate(home_id.tolist())}
    mine = np.array([at.get(x, -1) for x in visitor_id.tolist()], np.int64)
    dots = np.ascontiguousarray(coded[:, -4:]).view(np.float32)[:, 0]
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))]
    for r, c, low, high in _survivors(home, home_id, coded[:, :-4], dots, visitor_id, centroid, turn, k, least):
        low, high, own = low.astype(np.float64), high.astype(np.float64), mine[r] >= 0
        low[own] = high[own] = np.einsum("ij,ij->i", home[mine[r[own]]].astype(np.float64), home[c[own]].astype(np.float64))
        keep = high >= least
        out.append((r[keep], c[keep], low[keep], high[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(rows: DataFrame, dim: int, k: int = 5, least: float = -1.0, probes: int = V.PROBES) -> DataFrame:
    """id, neighbour, cosine, rank (1 to k) of every point of rows (id, v: distinct ids).

    A vector that is null, of another length, not finite or all zero has no neighbours and is none. Ties go to
    the smaller id. Exact copies are each other's neighbours at cosine 1. least: no neighbour below this
    cosine is wanted. A point with fewer than k others has fewer rows. Empty in, empty out.
    """
    kind = dict(rows.dtypes)["id"]
    reps, members = V.collapse_copies(rows, dim)
    if members.isEmpty():
        return members.select("id", F.col("id").alias("neighbour"), F.lit(1.0).alias("cosine"), F.lit(1).alias("rank"))
    cells = V.make_cells(reps, dim, probes)
    sent = rows.sparkSession.sparkContext.broadcast(cells.centroids)

    turn = rows.sparkSession.sparkContext.broadcast(rotation(dim))
    far = least >= CODES_FROM

    def unit(key: tuple, t: pa.Table) -> pa.Table:
        mine = t.column("is_home").to_numpy(zero_copy_only=False)
        home, visitor = t.filter(pa.array(mine)), t.filter(pa.array(~mine))
        hid, vid = np.array(home.column("id").to_pylist(), object), np.array(visitor.column("id").to_pylist(), object)
        v, h, low, high = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)
        if len(hid) and len(vid):
            hm, centre = V.as_matrix(home.column("u"), dim), sent.value[key[0].as_py()]
            if far:
                coded = np.frombuffer(b"".join(visitor.column("u").to_pylist()), np.uint8).reshape(len(vid), -1)
                v, h, low, high = search_codes(hm, hid, coded, vid, centre, turn.value, k, least)
            else:
                v, h, low = search_unit(hm, hid, V.as_matrix(visitor.column("u"), dim), vid, centre, turn.value, k, least)
                high = low
        return pa.table({"id": visitor.column("id").combine_chunks().take(pa.array(v)), "other": home.column("id").combine_chunks().take(pa.array(h)), "low": pa.array(low, pa.float64()), "high": pa.array(high, pa.float64())})

    def code(m: np.ndarray, cell: np.ndarray) -> list[bytes]:
        c = sent.value[cell]
        dots = np.einsum("ij,ij->i", m, c).astype(np.float32)[:, None].view(np.uint8)
        return [x.tobytes() for x in np.concatenate([encode_queries(m - c, turn.value), dots], 1)]

    found = V.spread(reps, cells, dim, probes, code if far else None).groupBy(*V.UNIT).applyInArrow(unit, f"id {kind}, other {kind}, low double, high double")
    if far:
        # what lies wholly below a point's k-th best lower bound over all units is out; of the rest the vectors are fetched
        w = Window.partitionBy("id").orderBy(F.desc("low"), "other").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        found = cut(found)
        left = found.withColumn("floor", F.nth_value("low", k).over(w)).where(F.col("high") >= F.coalesce("floor", F.lit(least)))
        exact = left.where("low = high").select("id", "other", F.col("low").alias("cosine"))
        open_ = left.where("low < high").select(F.col("id").alias("p_id"), F.col("other").alias("p_other"))
        one, two = reps.select(F.col("id").alias("a_id"), F.col("u").alias("a")), reps.select(F.col("id").alias("b_id"), F.col("u").alias("b"))
        both = open_.join(one, F.col("p_id") == F.col("a_id")).join(two, F.col("p_other") == F.col("b_id")).select("p_id", "p_other", "a", "b")

        def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    dot = np.einsum("ij,ij->i", V.as_matrix(b.column(2), dim).astype(np.float64), V.as_matrix(b.column(3), dim).astype(np.float64))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dot)], names=["id", "other", "cosine"])

        found = exact.unionByName(both.mapInArrow(rerank, f"id {kind}, other {kind}, cosine double")).where(F.col("cosine") >= least)
    else:
        found = found.select("id", "other", F.col("low").alias("cosine"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))).where(F.col("r") <= k).select("id", "other", "cosine")
    # copies: the k + 1 smallest ids of a group are all that can be among anyone's k most similar
    w = Window.partitionBy("rep").orderBy("id")
    few = members.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).select(F.col("rep").alias("r_rep"), F.col("id").alias("neighbour"))
    wide = best.join(few, F.col("other") == F.col("r_rep")).select(F.col("id").alias("q_rep"), "neighbour", "cosine")
    wide = wide.withColumn("r", F.row_number().over(Window.partitionBy("q_rep").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("r") <= k).drop("r")
    sizes = members.groupBy("rep").count().where("count > 1").select(F.col("rep").alias("s_rep"))
    copies = few.join(sizes, F.col("r_rep") == F.col("s_rep"), "left_semi").select(F.col("r_rep").alias("q_rep"), "neighbour", F.lit(1.0).alias("cosine"))
    table = members.select("id", "rep").join(wide.unionByName(copies), F.col("rep") == F.col("q_rep")).where("id <> neighbour").where(F.col("cosine") >= least)
    ranked = table.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("rank") <= k)
    return ranked.select("id", "neighbour", "cosine", "rank")
