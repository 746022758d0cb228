"""One model call for each candidate, its verdict parsed and checked. The model is any function of a prompt.

Call failures and answers that are no verdict become rows with error set; no task fails because of them. The
calls have a cost, so their results are written before anything reads them twice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.runtime import cut

SCHEMA = "key string, is_root_cause boolean, failure_class string, confidence double, rationale string, cited array<int>, error string"
_FENCE = re.compile(r"^\s*```(?:json)?\s*\n?(.*?)\n?\s*```\s*$", re.S)


def parse_verdict(raw: str) -> tuple:
    """(is_root_cause, failure_class, confidence, rationale, cited) of a model's answer; ValueError if it is none."""
    m = _FENCE.match(raw)
    v = json.loads(m[1] if m else raw)
    confidence = float(v["confidence"])
    if not 0 <= confidence <= 1 or not isinstance(v["is_root_cause"], bool):
        raise ValueError("no verdict")
    return v["is_root_cause"], str(v["failure_class"]), confidence, str(v.get("rationale", "")), [int(x) for x in v.get("cited_step_indices", [])]


def adjudicate(prompts: DataFrame, call: Callable[[str], str], parallel: int = 4) -> DataFrame:
    """prompts: key, prompt. parallel is how many calls are made at a time over the whole cluster."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, prompt in zip(f["key"], f["prompt"], strict=True):
                try:
                    rows.append((key, *parse_verdict(call(prompt)), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((key, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return cut(prompts.select("key", "prompt").repartition(parallel).mapInPandas(run, SCHEMA))


def cite_check(cited, visible):
    """The share of cited steps that were visible; duplicates count, nothing cited is 0."""
    return F.coalesce(F.size(F.filter(cited, lambda x: F.array_contains(visible, x))) / F.nullif(F.size(cited), F.lit(0)), F.lit(0.0))
