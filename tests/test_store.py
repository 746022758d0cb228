import datetime as D

from pyspark.sql import functions as F

from faultline.operators.store import Store, append

T = "trace_id string, outcome string"
SP = "trace_id string, span_id string, start_ns long"
ST = "trace_id string, step_index int"


def test_reingest_replaces_and_diagnoses_stand_side_by_side(spark, tmp_path):
    s, day = Store(spark, str(tmp_path)), lambda n: D.datetime(2026, 1, n)
    f = spark.createDataFrame
    s.write_traces(f([("a", "success"), ("b", "failure")], T), f([("a", "x", 2), ("a", "y", 1), ("b", "z", 1)], SP), f([("a", 1), ("a", 0)], ST), day(1))
    s.write_traces(f([("a", "failure")], T), f([("a", "w", 3)], SP), f([], ST), day(5))
    got = {r.trace_id: (r.outcome, r.ingested_at) for r in s.traces().collect()}
    assert got == {"a": ("failure", day(1)), "b": ("failure", day(1))}
    head, spans, steps = s.read_trace("a")
    assert [r.outcome for r in head.collect()] == ["failure"] and [r.span_id for r in spans.collect()] == ["w"] and steps.count() == 0
    assert all(x.count() == 0 for x in s.read_trace("none"))
    # a version that was not committed is not seen
    append(f([("c", "success")], T).withColumn("ingested_at", F.lit(day(9)).cast("timestamp")), f"{tmp_path}/traces", 99)
    assert s.traces().count() == 2
    child = "diagnosis_id string, ord int, detector string"
    for n in ("d1", "d2"):
        s.write_diagnoses(f([(n, "a", day(int(n[1])))], "diagnosis_id string, trace_id string, created_at timestamp"), f([(n, 1, "second"), (n, 0, "first")], child), f([], child), f([(n, 0, n)], child))
    rows = s.diagnoses("a").collect()
    assert [r.diagnosis_id for r in rows] == ["d1", "d2"] and [x.detector for x in rows[0].signals] == ["first", "second"] and rows[0].divergences is None and s.diagnoses("b").count() == 0
    s.write_assignments(f([("d1", "k", "r1"), ("d2", None, "r1")], "diagnosis_id string, cluster_id string, run_id string"))
    s.write_assignments(f([("d1", "m", "r2")], "diagnosis_id string, cluster_id string, run_id string"))
    assert [tuple(r) for r in s.previous_membership(f([("d1",), ("d2",), ("d9",)], "diagnosis_id string")).collect()] == [("d1", "m")]
    labels = "cluster_id string, label string, error string"
    s.write_labels(f([("k", "one", None), ("m", "two", None)], labels), day(1))
    s.write_labels(f([("k", None, "boom"), ("m", "three", None)], labels), day(2))
    assert {r.cluster_id: r.label for r in s.latest("labels", "cluster_id").collect()} == {"k": "one", "m": "three"}
    s.write_cases(f([("c1", 1)], "case_id string, true_step_index int"))
    s.write_cases(f([("c1", 2)], "case_id string, true_step_index int"))
    assert [r.true_step_index for r in s.latest("cases", "case_id").collect()] == [2]
