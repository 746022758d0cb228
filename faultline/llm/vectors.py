"""What the vector operators share: usable unit vectors, groups of exact copies, cells around sampled centroids.

A vector's home cell is that of its closest centroid. To search, a vector also visits the PROBES cells that
are closest to it. Centroids are sampled in proportion to the data, so a dense region gets as many cells as it
needs; what is still too large is split into blocks of bounded size. A unit of work is one block of homes
with one block of visitors, never a whole group of unknown size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.runtime import bounded_broadcast, cut

#: Mean homes in a cell, most cells, cells that a vector visits, most homes and most visitors in one unit of work.
PER_CELL, MAX_CELLS, PROBES, HOMES, VISITORS = 256, 4096, 6, 4096, 8192


def latest(rows: DataFrame, key: str, when: str, vector: str) -> DataFrame:
    """id and v of the latest row of every key, written; rows without a key are left out, a null time counts as earliest, and of equal times the vector that sorts last counts.

    Only the vectors of repeated keys meet others of their key; those of single rows stay where they are scanned.
    """
    own = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(when).alias("t"), F.col(vector).alias("v"))
    repeated = cut(own.groupBy("id").count().where("count > 1").select(F.col("id").alias("r_id")))
    some = bounded_broadcast(repeated)
    single = own.join(some, F.col("id") == F.col("r_id"), "left_anti").select("id", "v")
    several = own.join(some, F.col("id") == F.col("r_id"), "left_semi").groupBy("id").agg(F.max(F.struct("t", "v")).getField("v").alias("v"))
    return cut(single.unionByName(several))


def _usable(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch (id, v) with a usable vector, and these as unit vectors in float32."""
    lists = b.column(1)
    n = np.diff(lists.offsets.to_numpy())
    keep = np.flatnonzero((n == dim) & ~np.asarray(lists.is_null()))
    flat = np.asarray(lists.values.fill_null(np.nan) if lists.values.null_count else lists.values, np.float64)
    m = flat[lists.offsets.to_numpy()[keep][:, None] + np.arange(dim)] if len(keep) else np.empty((0, dim))
    fine = np.isfinite(m).all(1)
    size = np.zeros(len(m))
    size[fine] = np.sqrt((m[fine] ** 2).sum(1))
    fine &= size > 0
    return keep[fine], (m[fine] / size[fine][:, None]).astype(np.float32)


def unit_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """id and u (unit vector as float32 bytes) of the usable vectors: dim finite values, not all zero. Distinct ids in, distinct ids out."""
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, unit = _usable(b, dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array([x.tobytes() for x in unit], pa.binary())], names=["id", "u"])

    return rows.select("id", "v").where("v is not null").mapInArrow(run, f"id {kind}, u binary")


def digests(rows: DataFrame, dim: int) -> DataFrame:
    """id and d (128 bits of its unit vector) of the usable vectors."""
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            keep, unit = _usable(b, dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in unit], pa.binary())], names=["id", "d"])

    return rows.select("id", "v").where("v is not null").mapInArrow(run, f"id {kind}, d binary")


def as_matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of float32 bytes as one matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


@dataclass
class Cells:
    """Centroids (bounded: MAX_CELLS) and how many blocks of homes and visitors each cell is split into."""

    centroids: np.ndarray
    home_blocks: np.ndarray
    visitor_blocks: np.ndarray


def closest(vectors: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    """The k closest centroids of every vector, closest first; ties go to the lower number."""
    s = vectors @ centroids.T
    k = min(k, s.shape[1])
    top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.tile(np.arange(k), (len(s), 1))
    order = np.lexsort((top, -np.take_along_axis(s, top, 1)), axis=1)
    return np.take_along_axis(top, order, 1)


def make_cells(points: DataFrame, dim: int, probes: int = PROBES, per_cell: int = PER_CELL, rounds: int = 4) -> Cells:
    """Cells for points (id, u): centroids from a bounded sample in hash order, refined on it, and block counts from all points."""
    n = points.count()
    wanted = int(min(MAX_CELLS, max(1, n // per_cell)))
    take = int(min(4 * MAX_CELLS, max(wanted * 8, 64)))
    # the least of all hash keys first, so that only the sample's own vectors are gathered
    chosen = points.select("id").select("id", F.xxhash64("id").alias("s")).orderBy("s", "id").limit(take).agg(F.max("s")).first()[0]
    sample = points.withColumn("s", F.xxhash64("id")).where(F.col("s") <= F.lit(chosen if chosen is not None else 0)).select("s", "id", "u").toArrow()
    order = np.array(sorted(range(sample.num_rows), key=list(zip(sample.column("s").to_pylist(), sample.column("id").to_pylist(), strict=True)).__getitem__)[:take], np.int64)
    m = as_matrix(sample.column("u").take(pa.array(order, pa.int64())), dim)
    centroids = m[:wanted].copy() if len(m) else np.zeros((1, dim), np.float32)
    for _ in range(rounds if len(m) > wanted else 0):  # Lloyd on the sample
        home = closest(m, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, m)
        norm = np.linalg.norm(sums, axis=1)
        live = norm > 1e-6
        centroids[live] = sums[live] / norm[live][:, None]
    sent = points.sparkSession.sparkContext.broadcast(centroids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        homes, visits = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        for b in batches:
            if b.num_rows:
                near = closest(as_matrix(b.column(0), dim), c, probes)
                homes += np.bincount(near[:, 0], minlength=len(c))
                visits += np.bincount(near.ravel(), minlength=len(c))
        at = np.flatnonzero(visits)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(homes[at]), pa.array(visits[at])], names=["cell", "homes", "visits"])

    homes, visits = np.zeros(len(centroids), np.int64), np.zeros(len(centroids), np.int64)
    for r in points.select("u").mapInArrow(count, "cell int, homes long, visits long").groupBy("cell").agg(F.sum("homes").alias("h"), F.sum("visits").alias("v")).collect():  # MAX_CELLS rows at most
        homes[r["cell"]], visits[r["cell"]] = r["h"], r["v"]
    return Cells(centroids, np.maximum(1, -(-homes // HOMES)), np.maximum(1, -(-visits // VISITORS)))


def spread(points: DataFrame, cells: Cells, dim: int, probes: int = PROBES, code=None) -> DataFrame:
    """Rows (cell, home_block, visitor_block, is_home, id, u): every point as home of its cell and as visitor of its closest cells, once for each unit of work it takes part in.

    code: a function of vectors and the cells they visit that gives what a visitor is sent as, by default the vector itself.
    """
    kind = dict(points.dtypes)["id"]
    sent = points.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                m = as_matrix(part.column(1), dim)
                near = closest(m, c.centroids, probes)
                salt = m.view(np.uint32).sum(1, dtype=np.uint64).astype(np.int64)
                row, cell, hb, vb, home = [], [], [], [], []
                for i in range(len(m)):
                    mine = int(near[i, 0])
                    for v in range(int(c.visitor_blocks[mine])):
                        row.append(i), cell.append(mine), hb.append(int(salt[i] % c.home_blocks[mine])), vb.append(v), home.append(True)
                    for x in near[i].tolist():
                        for h in range(int(c.home_blocks[x])):
                            row.append(i), cell.append(x), hb.append(h), vb.append(int(salt[i] // 7 % c.visitor_blocks[x])), home.append(False)
                at = pa.array(row, pa.int64())
                sent_as = part.column(1).take(at)
                if code is not None and row:
                    goes = np.flatnonzero(~np.array(home))
                    texts = sent_as.to_pylist()
                    for i, x in zip(goes.tolist(), code(m[np.array(row)[goes]], np.array(cell)[goes]), strict=True):
                        texts[i] = x
                    sent_as = pa.array(texts, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(hb, pa.int32()), pa.array(vb, pa.int32()), pa.array(home, pa.bool_()), part.column(0).take(at), sent_as], names=["cell", "home_block", "visitor_block", "is_home", "id", "u"])

    return points.select("id", "u").mapInArrow(run, f"cell int, home_block int, visitor_block int, is_home boolean, id {kind}, u binary")


UNIT = ["cell", "home_block", "visitor_block"]


def collapse_copies(rows: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(id and u of one point for each distinct usable vector, under its smallest id; id and rep of every point, written). rows: id, v.

    Copies are found by 128 bits of their unit vectors, so no vector is moved for it.
    """
    d = cut(digests(rows, dim))
    reps = d.groupBy(F.col("d").alias("r_d")).agg(F.min("id").alias("rep"))
    members = cut(d.join(reps, F.col("d") == F.col("r_d")).select("id", "rep"))
    copies = bounded_broadcast(members.where("id <> rep").select(F.col("id").alias("c_id")))
    return unit_vectors(rows.join(copies, F.col("id") == F.col("c_id"), "left_anti"), dim), members
