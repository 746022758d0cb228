"""Global positions without a global sort in one task, and exact nearest neighbours of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.runtime import cut

#: Query vectors that are sent to every task at a time.
BLOCK = 4_096


def global_index(df: DataFrame, by: str) -> DataFrame:
    """df with ``position`` (0-based in the order of the distinct column by) and ``total``.

    Rows are range-partitioned and numbered inside their partition; a partition's offset comes from the
    counts of those before it.
    """
    parts = cut(df.repartitionByRange(by).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy("__part").count()
    offsets = counts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("count").over(Window.partitionBy(F.lit(0))).alias("total"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(by))
    return parts.withColumn("__n", inside).join(F.broadcast(offsets), F.col("__part") == F.col("__p")).withColumn("position", F.col("__n") - 1 + F.col("__before")).drop("__part", "__n", "__p", "__before")


def even_sample(df: DataFrame, by: str, size: int) -> DataFrame:
    """The rows at positions floor(k * total / size) for k below size; all rows if there are no more than that."""
    return global_index(df, by).where((F.ceil(F.col("position") * size / F.col("total")) < size) & (F.floor(F.ceil(F.col("position") * size / F.col("total")) * F.col("total") / size) == F.col("position")))


def nearest_of(queries: DataFrame, base: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """id, other, cosine: the k rows of base (id, v) most similar to each row of queries (id, v), itself left out.

    Queries go out in blocks of a fixed size, each against all rows of base in place; every task sends back k rows for each
    query at most. Vectors that are null or all zero are no one's neighbour. Ties go to the smaller id.
    """
    spark, found = queries.sparkSession, None
    held: list[tuple] = []

    def one(rows: list[tuple]) -> DataFrame:
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], float)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            q = q / np.maximum(np.linalg.norm(q, axis=1), 1e-12)[:, None]
            for b in batches:
                pairs = [(i, v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if v is not None and len(v) == q.shape[1] and any(v)]
                if not pairs:
                    continue
                names, m = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], float)
                s = q @ (m / np.linalg.norm(m, axis=1)[:, None]).T
                s[np.array(ids)[:, None] == names[None, :]] = -9
                take = min(k, s.shape[1])
                order = np.lexsort((np.broadcast_to(names, s.shape), -s), axis=1)[:, :take]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, take)), pa.array(names[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], names=["id", "other", "cosine"])

        kind = dict(base.dtypes)["id"]
        part = base.select("id", "v").mapInArrow(run, f"id {kind}, other {kind}, cosine double")
        return part.where("cosine > -2").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))).where(F.col("r") <= k)

    for row in queries.select("id", "v").toLocalIterator():
        held.append((row["id"], row["v"]))
        if len(held) == block:
            found, held = (one(held) if found is None else found.unionByName(one(held))), []
    if held or found is None:
        last = one(held) if held else base.select("id", F.col("id").alias("other"), F.lit(0.0).alias("cosine"), F.lit(0).alias("r")).limit(0)
        found = last if found is None else found.unionByName(last)
    return found.select("id", "other", "cosine", F.col("r").alias("rank"))
