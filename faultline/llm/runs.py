"""Runs of adjacent events that say the same, collapsed to one row with count and duration.

Only boundary rows are kept: events whose signature differs from that of the event before. Over them, the
next boundary's position gives the count of a run, and the end of the event before the next boundary gives
its duration. Sequences may be of any length: they are cut into buckets of bounded length, the window
functions work inside a bucket, and only the edges of the buckets of a sequence that has several meet again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.runtime import cut

#: Most positions in one bucket, and so the most rows of a sequence that meet in one task's window.
BUCKET = 4096


def normal_signature(signature: Column) -> Column:
    """kind, actor, tool or action, and outcome of a signature: without letter case, white space, separators, flags, counters and ids. Null stays null."""
    s = F.regexp_replace(F.lower(signature), r"[​‌‍﻿]", "")
    s = F.regexp_replace(s, r"\|.*$", "")
    s = F.regexp_replace(s, r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", "")
    s = F.regexp_replace(s, r"[#~@*]\s*\d+", "")
    s = F.regexp_replace(s, r"(?U)\s*(?:->|::|[:/>;,])\s*", ":")
    s = F.regexp_replace(s, r"(?U)[\s_\-.]+", "")
    s = F.regexp_replace(s, r"(^|:)w\d+(?=:|$)", "$1w")
    return F.regexp_replace(s, r"^:+|:+$", "")


def runs(events: DataFrame, sequence: list[str], order: str, signature: str, start: str | None = None, end: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """One row per maximal run: sequence columns, start_index, run_length, signature, start, end, duration.

    Rows repeated under one (sequence, order) count once (the one with the smallest signature counts); rows
    without an order value are left out. A null signature equals nothing, not even another null, so it is
    always a run of its own. start and end name columns of any type that can be subtracted, or None. Extra
    columns are not read. Empty in, empty out.
    """
    s, e = (F.col(start) if start else F.lit(None).cast("long")), (F.col(end) if end else F.lit(None).cast("long"))
    k = [f"k{i}" for i in range(len(sequence))]
    index = F.col(order).cast("long")
    rows = (
        events.where(F.col(order).isNotNull())
        .groupBy(*(F.col(c).alias(n) for c, n in zip(sequence, k, strict=True)), F.floor(index / bucket).alias("bucket"), index.alias("idx"))
        .agg(F.min(F.struct(normal_signature(F.col(signature)).alias("sig"), s.alias("s"), e.alias("e"))).alias("r"))
        .select(*k, "bucket", "idx", "r.sig", "r.s", "r.e")
    )
    inside = Window.partitionBy(*k, "bucket").orderBy("idx")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = F.struct("sig", "e")
    rows = rows.select("*", F.row_number().over(inside).alias("n"), F.lag("sig").over(inside).alias("lag_sig"), F.lag("e").over(inside).alias("prev_e"), F.count("*").over(whole).alias("size"), F.last(edge).over(whole).alias("last"))
    # boundary rows, and the first row of every bucket, of which only the bucket before can tell
    starts = rows.where("n = 1 or lag_sig is null or sig is null or sig <> lag_sig")
    starts = cut(starts.select(*k, "bucket", "idx", "sig", "s", "n", "size", "last", F.lead(F.struct("n", "prev_e")).over(inside).alias("next")))
    # one row per bucket of the sequences that have several: where its first run goes on from, and what closes its last one
    across = Window.partitionBy(*k).orderBy("bucket")
    edges = starts.where("n = 1").select(*k, "bucket", "sig", "size", "last", "next", F.lag("last").over(across).alias("before"), F.coalesce(F.sum("size").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.count("*").over(Window.partitionBy(*k)).alias("buckets"), F.max(F.struct("bucket", "last")).over(Window.partitionBy(*k))["last"]["e"].alias("very_last"), F.sum("size").over(Window.partitionBy(*k)).alias("total")).where("buckets > 1")
    goes_on = F.coalesce(F.col("sig") == F.col("before.sig"), F.lit(False))
    opens = F.when(~goes_on, F.struct((F.col("offset") + 1).alias("pos"), F.col("before.e").alias("prev_e"))).otherwise(F.when(F.col("next").isNotNull(), F.struct((F.col("offset") + F.col("next.n")).alias("pos"), F.col("next.prev_e").alias("prev_e"))))
    edges = edges.select(*k, "bucket", "offset", "total", "very_last", goes_on.alias("goes_on"), opens.alias("opens"))
    edges = edges.select(*(F.col(c).alias(f"e_{c}") for c in (*k, "bucket")), "offset", "goes_on", F.coalesce(F.first("opens", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)), F.struct((F.col("total") + 1).alias("pos"), F.col("very_last").alias("prev_e"))).alias("after"))
    same = [*(F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in k), F.col("bucket") == F.col("e_bucket")]
    led = starts.join(edges, same, "left").where("n > 1 or not coalesce(goes_on, false)")
    length = F.coalesce(F.col("next.n") - F.col("n"), F.col("after.pos") - F.col("offset") - F.col("n"), F.col("size") + 1 - F.col("n"))
    closed = F.when(F.col("next").isNotNull(), F.col("next.prev_e")).when(F.col("after").isNotNull(), F.col("after.prev_e")).otherwise(F.col("last.e"))
    out = led.select(*(F.col(c).alias(n) for c, n in zip(k, sequence, strict=True)), F.col("idx").alias("start_index"), length.cast("int").alias("run_length"), F.col("sig").alias("signature"), F.col("s").alias("start"), closed.alias("end"))
    return out.withColumn("duration", F.col("end") - F.col("start"))
