"""Plain turn logs (who said what) to spans: every turn is one span under a synthetic root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL = r"(?s)^\s*([A-Za-z_]\w*)\((.*)\)\s*$"
EXIT = r"(?s)^\s*exitcode:\s*(\d+)\s*\(execution (succeeded|failed)\)"


def turns_to_steps(cases: DataFrame) -> DataFrame:
    """cases: case_id, messages array<struct<agent, content>>. One row a turn: case_id, step_index, actor, kind, status, tool_name, text.

    A turn that is nothing but name(arguments) is a tool, or a retriever if the name says search or retrieve; an exit code is a tool's
    result and an error unless 0; all else is the agent speaking. Null messages give no turns, a null content is empty.
    """
    t = cases.select("case_id", F.posexplode("messages").alias("step_index", "m")).select("case_id", "step_index", F.col("m.agent").alias("actor"), F.coalesce("m.content", F.lit("")).alias("text"))
    call, code = F.regexp_extract("text", CALL, 1), F.regexp_extract("text", EXIT, 1)
    kind = F.when(call != "", F.when(F.lower(call).rlike("search|retriev"), "retriever").otherwise("tool")).when(code != "", "tool").otherwise("agent")
    tool = F.when(call != "", call).when(code != "", "execution_result")
    status = F.when(code == "", "ok").when(code == "0", "ok").otherwise("error")
    body = F.when(code != "", F.substring_index("text", "Code output:", -1)).otherwise(F.col("text"))
    return t.select("case_id", "step_index", "actor", kind.alias("kind"), status.alias("status"), tool.alias("tool_name"), body.alias("text"))


def iso_duration_ns(col):
    """PT#H#M#S as nanoseconds; null reads as 0, what is no duration as null."""
    part = lambda unit: F.coalesce(F.regexp_extract(col, rf"([0-9.]+){unit}", 1).try_cast("double"), F.lit(0.0))
    return F.when(col.isNull(), F.lit(0)).when(col.rlike(r"^PT([0-9.]+H)?([0-9.]+M)?([0-9.]+S)?$"), F.round((part("H") * 3600 + part("M") * 60 + part("S")) * 1e9).cast("bigint"))
