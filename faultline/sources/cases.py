"""Annotated records to benchmark cases: the true step, span and failure class of every annotated error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators import shred

# Normalised category names of annotations, singular, plural and misspelt, and their failure classes. All else is unknown.
CATEGORIES = {
    "formatting error": "malformed_tool_input", "formatting errors": "malformed_tool_input", "instruction non compliance": "constraint_violation", "instruction non complience": "constraint_violation",
    "goal deviation": "plan_omission", "task orchestration": "plan_omission", "task orchestration error": "plan_omission", "task orchestration errors": "plan_omission", "language only": "information_fabrication",
    "resource abuse": "infinite_loop_or_oscillation", "tool related": "hallucinated_tool_or_parameter", "tool selection": "wrong_tool_selected", "tool selection errors": "wrong_tool_selected",
    "context handling failure": "context_loss", "context handling failures": "context_loss", "incorrect memory usage": "context_loss", "poor information retrieval": "retrieval_miss", "incorrect problem identification": "task_misinterpretation",
    "tool output misinterpretation": "tool_failure_unhandled", "resource exhaustion": "step_budget_exhausted",
}


def failure_class(category: Column) -> Column:
    """The failure class of an annotation's category, whatever its letter case, blanks, hyphens and underscores."""
    name = F.trim(F.regexp_replace(F.lower(category), r"(?U)[\s\-_]+", " "))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))[name], F.lit("unknown"))


def annotations(records: DataFrame, key: str, body: str) -> DataFrame:
    """trace_id (the record's key), ord, category, location of every entry of a record's errors."""
    rows = shred.shred(records, [key], body, ["errors"], ["category", "location"], ["errors"]).where("not is_null")
    f = F.col("fields")
    return rows.select(F.col(key).cast("string").alias("trace_id"), F.element_at("ordinals", -1).alias("ord"), f["category"].alias("category"), F.lower(F.trim(f["location"])).alias("location"))


def resolve(marks: DataFrame, steps: DataFrame) -> DataFrame:
    """Cases of annotations: case_id, trace_id, true_step_index, true_span_id, true_class, is_primary.

    An error's step is that of the span it names, or the step that collapsed it; an error whose span is in no step is left out. Of a trace the
    first case by (step, order of annotation) is the primary one.
    """
    whole = steps.select(F.col("trace_id").alias("s_t"), F.col("span_id").alias("at"), "step_index", F.col("span_id").alias("s_span"))
    held = steps.select(F.col("trace_id").alias("s_t"), F.explode("collapsed_span_ids").alias("at"), "step_index", F.col("span_id").alias("s_span"))
    found = marks.join(whole.unionByName(held), (F.col("trace_id") == F.col("s_t")) & (F.col("location") == F.col("at")))
    n = F.row_number().over(Window.partitionBy("trace_id").orderBy("step_index", "ord")) - 1
    return found.withColumn("n", n).select(
        F.concat_ws("#", "trace_id", F.col("n").cast("string")).alias("case_id"), "trace_id", F.col("step_index").alias("true_step_index"), F.col("s_span").alias("true_span_id"), failure_class(F.col("category")).alias("true_class"), (F.col("n") == 0).alias("is_primary")
    )


def annotated_cases(records: DataFrame, key: str, body: str, steps: DataFrame) -> DataFrame:
    """resolve over the errors of records. steps: of the same records, trace_id being the key."""
    return resolve(annotations(records, key, body), steps)


def turn_cases(cases: DataFrame) -> DataFrame:
    """Cases of turn logs: case_id, messages, mistake_step (text or number): the true step is that turn; a mistake outside of the turns is left out."""
    step = F.col("mistake_step").try_cast("int")
    return cases.where((step >= 0) & (step < F.size("messages"))).select("case_id", F.col("case_id").alias("trace_id"), step.alias("true_step_index"), F.concat(F.lit("turn-"), step.cast("string")).alias("true_span_id"), F.lit("unknown").alias("true_class"), F.lit(True).alias("is_primary"))


def pair_files(traces: DataFrame, annotated: DataFrame) -> DataFrame:
    """stem, trace, annotation of files (path, content) that share their name without folder and suffix; trailing commas are mended."""
    stem = lambda c: F.regexp_extract(c, r"([^/\\]+?)(?:\.[^./\\]+)?$", 1)
    mend = lambda c: F.regexp_replace(c, r",(\s*[\]}])", "$1")
    b = annotated.select(stem(F.col("path")).alias("b_stem"), mend(F.col("content")).alias("annotation"))
    return traces.select(stem(F.col("path")).alias("stem"), mend(F.col("content")).alias("trace")).join(b, F.col("stem") == F.col("b_stem")).drop("b_stem")


def plain_role(name: Column) -> Column:
    """A speaker's name without what stands in brackets."""
    return F.trim(F.regexp_replace(name, r"(?U)\s*\(.*\)\s*", ""))
