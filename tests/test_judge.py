import math

from pyspark.sql import functions as F

from faultline.operators import evaluate, judge

SIG = "trace_id string, step_index int, detector string, severity double, category string"


def _short(spark, signals, divs, kinds, failed=True):
    s = spark.createDataFrame(signals, SIG)
    d = spark.createDataFrame(divs, "trace_id string, step_index int, score double")
    st = spark.createDataFrame([("t", i, k) for i, k in enumerate(kinds)], "trace_id string, step_index int, kind string")
    f = spark.createDataFrame([("t",)] if failed else [], "trace_id string")
    return [(r.step_index, r.source, round(r.prior, 6)) for r in judge.shortlist(judge.merge(s, d, "trace_id"), st, f, "trace_id").orderBy("rank").collect()]


def test_shortlist_goldens(spark):
    one = [("t", 2, "x", 0.7, "a")]
    assert _short(spark, [], [], ["llm", "tool", "llm"]) == [(2, "fallback", 0.0), (0, "filler", 0.0), (1, "filler", 0.0)]
    assert _short(spark, [], [], ["llm"] * 3, failed=False) == []
    assert _short(spark, one, [], ["llm"] * 5) == [(2, "l1", 0.7), (0, "filler", 0.0), (1, "filler", 0.0), (3, "filler", 0.0), (4, "filler", 0.0)]
    # both layers; errors without a step; the better divergence; unknown kinds never fill; a lone filler takes the middle of six
    got = _short(spark, [*one, ("t", -1, "x", 0.0, None), ("t", None, "x", 0.9, "a"), ("t", 2, "y", 0.4, "b")], [("t", 2, 0.8), ("t", 2, 0.1), ("t", 1, -0.01), ("t", 0, None)], ["unknown"] * 9)
    assert got == [(2, "both", 0.95), (1, "l2", -0.01)]
    got = _short(spark, [("t", i, "x", 0.9 - i / 100, "a") for i in (6, 7, 8, 9)], [], ["llm"] * 6 + ["tool"] * 4)
    assert got[-1] == (3, "filler", 0.0) and len(got) == 5


def test_verdict_gates_and_calibration(spark):
    rows = [("a", 1, True, "x", 0.5, None), ("a", 2, True, "x", 0.48, None), ("b", 1, True, "x", 0.5, None), ("b", 2, True, "y", 0.43, None), ("c", 3, True, "x", 0.1, None), ("d", 1, False, "x", 0.9, None), ("e", 2, True, "x", 0.9, "boom"), ("f", 4, True, "x", 0.6, None), ("f", 1, True, "y", 0.6, None)]
    judged = spark.createDataFrame(rows, "k string, step_index int, is_root_cause boolean, failure_class string, calibrated double, error string")
    got = {r.k: (r.verdict, r.step_index) for r in judge.select_verdict(judged, spark.createDataFrame([(x,) for x in "abcdefg"], "k string"), "k").collect()}
    assert got == {"a": ("committed", 1), "b": ("ambiguous", None), "c": ("low_confidence", None), "d": ("none", None), "e": ("none", None), "f": ("ambiguous", None), "g": ("none", None)}
    lit = F.lit
    r = spark.range(1).select(judge.calibrate(lit(0.8), lit(0.7), lit(True), lit(0.5), lit(2), lit(0.25), lit(1.0), lit(3), lit("filler")).alias("c"), judge.cite_share(F.array(lit(1), lit(1), lit(9)), F.array(lit(1))).alias("s"), judge.degraded(lit(False), lit(True), lit(False), lit("few"), lit(False)).alias("d")).first()
    x = -5.3395 + 0.0077 * math.log(4) - 1.4268 * 0.7 - 0.4531 - 0.4575 * 0.5 + 0.8888 * 0.75 + 1.3492 * 0.25 + 2.5913 + 0.7388 * 3 + 0.7661
    assert abs(r.c - 1 / (1 + math.exp(-x))) < 1e-12 and abs(r.s - 2 / 3) < 1e-12 and r.d == ["l1", "l2:few"]
    p = spark.range(1).select(judge.prompt(lit(7), lit("PACKET")).alias("p")).first().p
    assert "step 7" in p and "<run>\nPACKET\n</run>" in p and all(k in p for k in judge.TAXONOMY) and len(judge.TAXONOMY) == 21


def test_evaluation_against_hand_counts(spark):
    cases = spark.createDataFrame([("1", "a", 3, "s3", "x", True), ("2", "b", 8, None, "y", True), ("3", "c", 2, "s2", None, True), ("4", "d", 0, "s0", "x", True)], "case_id string, trace_id string, true_step_index int, true_span_id string, true_class string, is_primary boolean")
    v = spark.createDataFrame([("a", 3, "s3", "x", 0.9), ("b", 7, "s7", "y", 0.5), ("c", 2, "s2", "z", 1.0)], "trace_id string, step_index int, span_id string, failure_class string, confidence double")
    p = evaluate.predictions(cases, v)
    r = evaluate.report(p).first()
    assert (r.n, r.abstained, r.exact, r.within_1, r.joint) == (4, 1, 0.5, 0.75, 0.25) and abs(r.earliness + 1 / 3) < 1e-9 and abs(r.exact_of_committed - 2 / 3) < 1e-9
    assert abs(r.span_accuracy - 2 / 3) < 1e-9 and abs(r.class_accuracy - 2 / 3) < 1e-9 and abs(r.brier - (0.01 + 0.25 + 0) / 3) < 1e-9
    assert {(x["bin"], x.n, round(x.gap, 6)) for x in evaluate.reliability(p).collect()} == {(9, 2, round(2 / 3 * 0.05, 6)), (5, 1, round(0.5 / 3, 6))}
    assert sorted((x.true_class or "", x["class"], x.n) for x in evaluate.confusion(p).collect()) == [("", "z", 1), ("x", "x", 1), ("y", "y", 1)]
    sig = spark.createDataFrame([("a", 3, "d1", 0.5, "x"), ("a", 1, "d2", 0.9, "x"), ("b", 1, "d2", 0.4, "x"), ("z", 1, "d1", 0.4, "x")], SIG)
    short = spark.createDataFrame([("a", 1, "l1", 1), ("a", 3, "l1", 2), ("b", 8, "filler", 2), ("b", 1, "l1", 1)], "trace_id string, step_index int, source string, rank int")
    q = evaluate.recall(cases, short).first()
    assert (q.n, q.n_evidenced, q.recall_1, q.recall_3, q.evidenced_3) == (2, 2, 0.0, 1.0, 0.5)
    assert {(x.source, x.candidates, x.hits) for x in evaluate.by_source(cases, short).collect()} == {("l1", 3, 1), ("filler", 1, 1)}
    assert {(x.detector, x.flagged, x.hits) for x in evaluate.by_detector(cases, sig).collect()} == {("d1", 1, 1), ("d2", 2, 0)}
    c = evaluate.coverage(cases, sig, short).first()
    assert (c.cases, c.flagged, c.shortlisted, c.traces, c.traces_with_signal) == (4, 1, 2, 4, 2)
    none = spark.createDataFrame([], "trace_id string, step_index int, score double")
    assert {(x.left_out, x.candidates, x.hits) for x in evaluate.leave_one_out(cases, sig, none, ["d1", "d2"]).collect()} == {("", 3, 1), ("d1", 2, 0), ("d2", 1, 1)}
    assert evaluate.ablation(evaluate.report(p), evaluate.report(p.limit(0))).first().exact_delta is None
    assert evaluate.ablation(evaluate.report(p), evaluate.report(p)).first().exact_delta == 0.0
