"""Bounded context packets for the model: goal, steps around a candidate, the last step, and as much of the spine as fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that count as one token; size of a packet, of the goal and of a line of the spine.
CHARS, TOKENS, GOAL, LINE, RADIUS = 4, 12_000, 1_500, 80, 2


def excerpt(text: Column, limit: int) -> Column:
    """A text cut in its middle to exactly limit characters, or as it is."""
    head = limit // 2 - 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(" ... "), F.right(text, F.lit(limit - head - 5))))


def packets(candidates: DataFrame, steps: DataFrame, goals: DataFrame, tokens: int = TOKENS) -> DataFrame:
    """key, packet, visible (step indexes in it), tokens for each candidate (key, trace_id, step_index).

    The steps within RADIUS and the last step are always in; lines of the spine are kept from both ends
    of the run until half the budget each is used, by running sums, so a run of any length is never rendered whole.
    """
    s = steps.select("trace_id", "step_index", F.concat_ws(" ", F.col("step_index").cast("string"), "signature", F.coalesce("summary", F.lit(""))).alias("text"))
    line = F.substring("text", 1, LINE)
    w = Window.partitionBy("trace_id")
    sized = s.select("*", line.alias("line"), F.max("step_index").over(w).alias("last"), F.sum(F.length(line) + 1).over(w.orderBy("step_index")).alias("from_start"), F.sum(F.length(line) + 1).over(w.orderBy(F.desc("step_index"))).alias("from_end"))
    half = tokens * CHARS // 4
    c = candidates.select("key", F.col("trace_id").alias("c_trace"), F.col("step_index").alias("c_step"))
    near = F.abs(F.col("step_index") - F.col("c_step")) <= RADIUS
    ends = (F.col("from_start") <= half) | (F.col("from_end") <= half)
    shown = c.join(sized, F.col("c_trace") == F.col("trace_id")).where(near | ends | (F.col("step_index") == F.col("last")))
    part = shown.select("key", "trace_id", "step_index", F.when(near | (F.col("step_index") == F.col("last")), excerpt(F.col("text"), 400)).otherwise(F.col("line")).alias("show"))
    joined = part.groupBy("key", "trace_id").agg(F.array_sort(F.collect_list(F.struct("step_index", "show"))).alias("parts"))
    g = goals.select(F.col("trace_id").alias("g_trace"), F.substring(F.coalesce("task_goal", F.lit("")), 1, GOAL).alias("goal"))
    packet = F.concat_ws("\n", "goal", F.array_join(F.transform("parts", lambda p: p["show"]), "\n"))
    out = joined.join(g, F.col("trace_id") == F.col("g_trace"), "left").select("key", packet.alias("packet"), F.transform("parts", lambda p: p["step_index"]).alias("visible"))
    return out.withColumn("tokens", F.floor(F.length("packet") / CHARS).cast("int"))
