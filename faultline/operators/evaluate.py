"""Predictions and shortlists against cases with known causes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators import judge

TOLERANCES, TOP, BINS = (0, 1, 3), (1, 3, 5), 10
EVIDENCED = ["l1", "l2", "both"]


def predictions(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every case with its trace's prediction; a trace without one abstained. cases: case_id, trace_id, true_step_index, true_span_id, true_class, is_primary; verdicts:
    trace_id, step_index, span_id, failure_class, confidence, one row a trace."""
    v = verdicts.select(F.col("trace_id").alias("v_t"), F.col("step_index").alias("step"), F.col("span_id").alias("span"), F.col("failure_class").alias("class"), "confidence")
    return cases.join(v, F.col("trace_id") == F.col("v_t"), "left").withColumn("abstained", F.col("step").isNull()).drop("v_t")


def report(predicted: DataFrame) -> DataFrame:
    """One row: n, abstained, exact and within each tolerance (of all cases), exact of those committed, joint with the class, earliness, span and class accuracy (of the cases that have one; null without any), Brier score."""
    off = F.abs(F.col("step") - F.col("true_step_index"))
    share = lambda c: F.avg(F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0))
    known = lambda c, hit: F.avg(F.when(F.col(c).isNotNull(), F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)))
    same_class = F.col("class") == F.col("true_class")
    return predicted.agg(
        F.count("*").alias("n"), F.sum(F.col("abstained").cast("int")).alias("abstained"), *(share(off <= t).alias("exact" if t == 0 else f"within_{t}") for t in TOLERANCES), F.avg(F.when(~F.col("abstained"), F.when(off == 0, 1.0).otherwise(0.0))).alias("exact_of_committed"),
        share((off == 0) & same_class).alias("joint"), F.avg(F.col("step") - F.col("true_step_index")).alias("earliness"), known("true_span_id", F.col("span") == F.col("true_span_id")).alias("span_accuracy"), known("true_class", same_class).alias("class_accuracy"),
        F.avg(F.when(~F.col("abstained"), F.pow(F.col("confidence") - F.when(off == 0, 1.0).otherwise(0.0), 2))).alias("brier"),
    )


def confusion(predicted: DataFrame) -> DataFrame:
    """true_class, class, n over what was predicted."""
    return predicted.where("class is not null").groupBy("true_class", "class").agg(F.count("*").alias("n"))


def reliability(predicted: DataFrame) -> DataFrame:
    """bin, n, mean_confidence, accuracy, and gap, the bin's share of the expected calibration error; empty bins are left out."""
    p = predicted.where("not abstained and confidence is not null").select(F.least(F.floor(F.col("confidence") * BINS).cast("int"), F.lit(BINS - 1)).alias("bin"), "confidence", F.when(F.col("step") == F.col("true_step_index"), 1.0).otherwise(0.0).alias("hit"))
    b = p.groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("hit").alias("accuracy"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # ten rows at most
    return b.withColumn("gap", F.col("n") / total * F.abs(F.col("accuracy") - F.col("mean_confidence")))


def recall(cases: DataFrame, shortlist: DataFrame) -> DataFrame:
    """One row: n (cases whose trace has a shortlist), recall_k over the whole list and evidenced_k over its evidenced part (n_evidenced)."""
    s = shortlist.groupBy(F.col("trace_id").alias("s_t")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "step_index"))), lambda x: x["step_index"]).alias("whole"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("source").isin(EVIDENCED), F.struct("rank", "step_index")))), lambda x: x["step_index"]).alias("evidenced"),
    )  # a shortlist is bounded
    j = cases.join(s, F.col("trace_id") == F.col("s_t"))
    hit = lambda c, k: F.avg(F.when(F.size(c) > 0, F.when(F.array_contains(F.slice(c, 1, k), F.col("true_step_index")), 1.0).otherwise(0.0)))
    return j.agg(F.count("*").alias("n"), F.sum((F.size("evidenced") > 0).cast("int")).alias("n_evidenced"), *(hit("whole", k).alias(f"recall_{k}") for k in TOP), *(hit("evidenced", k).alias(f"evidenced_{k}") for k in TOP))


def by_source(cases: DataFrame, shortlist: DataFrame) -> DataFrame:
    """source, candidates, hits, precision: how many shortlisted steps of each source are the true step of a case of their trace."""
    truth = cases.select(F.col("trace_id").alias("c_t"), F.col("true_step_index").alias("c_s")).distinct()
    own = shortlist.join(cases.select(F.col("trace_id").alias("o_t")).distinct(), F.col("trace_id") == F.col("o_t"), "left_semi")
    j = own.join(truth, (F.col("trace_id") == F.col("c_t")) & (F.col("step_index") == F.col("c_s")), "left")
    return j.groupBy("source").agg(F.count("*").alias("candidates"), F.count("c_s").alias("hits")).withColumn("precision", F.col("hits") / F.col("candidates"))


def by_detector(cases: DataFrame, signals: DataFrame) -> DataFrame:
    """detector, flagged (distinct steps), hits."""
    truth = cases.select(F.col("trace_id").alias("c_t"), F.col("true_step_index").alias("c_s")).distinct()
    own = signals.select("trace_id", "step_index", "detector").distinct().join(cases.select(F.col("trace_id").alias("o_t")).distinct(), F.col("trace_id") == F.col("o_t"), "left_semi")
    return own.join(truth, (F.col("trace_id") == F.col("c_t")) & (F.col("step_index") == F.col("c_s")), "left").groupBy("detector").agg(F.count("*").alias("flagged"), F.count("c_s").alias("hits"))


def coverage(cases: DataFrame, signals: DataFrame, shortlist: DataFrame) -> DataFrame:
    """One row: cases, cases whose step a signal flags, cases whose step is shortlisted, traces, traces with a signal at all."""
    mark = lambda df, n: df.select(F.col("trace_id").alias(f"{n}_t"), F.col("step_index").alias(f"{n}_s")).distinct()
    on = lambda n: (F.col("trace_id") == F.col(f"{n}_t")) & (F.col("true_step_index") == F.col(f"{n}_s"))
    any_ = signals.select(F.col("trace_id").alias("a_t")).distinct()
    j = cases.join(mark(signals, "f"), on("f"), "left").join(mark(shortlist, "l"), on("l"), "left").join(any_, F.col("trace_id") == F.col("a_t"), "left")
    return j.agg(F.count("*").alias("cases"), F.count("f_s").alias("flagged"), F.count("l_s").alias("shortlisted"), F.count_distinct("trace_id").alias("traces"), F.count_distinct("a_t").alias("traces_with_signal"))


def leave_one_out(cases: DataFrame, signals: DataFrame, divergences: DataFrame, names: list[str], most: int = judge.MOST) -> DataFrame:
    """left_out, candidates, hits of the shortlists merged anew without each detector of names; '' leaves out none. Signals are computed once."""
    runs = F.array(*map(F.lit, ["", *names]))
    apart = signals.withColumn("left_out", F.explode(F.filter(runs, lambda d: d != F.col("detector")))).withColumn("k", F.struct("left_out", "trace_id"))
    div = divergences.withColumn("left_out", F.explode(runs)).withColumn("k", F.struct("left_out", "trace_id"))
    best = judge.top(judge.merge(apart, div, "k"), "k", most).select("k.left_out", "k.trace_id", "step_index", "source")
    truth = cases.select(F.col("trace_id").alias("c_t"), F.col("true_step_index").alias("c_s")).distinct()
    own = best.join(truth.select(F.col("c_t").alias("o_t")).distinct(), F.col("trace_id") == F.col("o_t"), "left_semi")
    return own.join(truth, (F.col("trace_id") == F.col("c_t")) & (F.col("step_index") == F.col("c_s")), "left").groupBy("left_out").agg(F.count("*").alias("candidates"), F.count("c_s").alias("hits"))


def ablation(full: DataFrame, without: DataFrame) -> DataFrame:
    """One row of report's exact, within_3 and joint of both runs, full less without: a positive difference says that the layer helps."""
    a = full.select(*(F.col(c).alias(f"a_{c}") for c in ("exact", "within_3", "joint")))
    b = without.select(*(F.col(c).alias(f"b_{c}") for c in ("exact", "within_3", "joint")))
    return a.join(b).select(*((F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"{c}_delta") for c in ("exact", "within_3", "joint")))  # one row each
