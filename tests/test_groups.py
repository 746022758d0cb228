import json

from pyspark.sql import functions as F

from faultline.operators import groups

V = "id string, label int, v array<float>"


def test_medoid_and_spread(spark):
    df = spark.createDataFrame([(f"m{i}", 0, [1.0, i / 10]) for i in range(11)] + [("z", 1, [0.0, 0.0]), ("y", 2, None)], V)
    mid = groups.medoids(df)
    got = {r.label: (r.medoid, r.size) for r in mid.collect()}
    assert got[0] == ("m5", 11) and got[1] == ("z", 1)
    shown = {(r.label, r.place): r.id for r in groups.spread_sample(df, mid.where("label = 0")).collect()}
    assert shown[(0, 0)] == "m5" and len(shown) == 5 and shown[(0, 1)] in ("m4", "m6")
    assert groups.medoids(df.limit(0)).count() == 0


def test_identity_is_kept_by_a_strict_majority_and_by_one_group_only(spark):
    rows = [("a1", 1, "P"), ("a2", 1, "P"), ("a3", 1, None), ("b1", 2, "P"), ("b2", 2, "Q"), ("b3", 2, None), ("c1", 3, "R"), ("c2", 3, "R"), ("c3", 3, "R"), ("d1", 4, "R"), ("d2", 4, "R"), ("e1", 5, None)]
    df = spark.createDataFrame(rows, "id string, label int, previous string")
    got = {r.label: (r.cluster_id, r.reused) for r in groups.identities(df).collect()}
    assert got[1] == ("P", True) and not got[2][1] and got[3] == ("R", True) and not got[4][1] and len({v for v, _ in got.values()}) == 5
    assert {r.label: r.cluster_id for r in groups.identities(df).collect()} == {k: v for k, (v, _) in got.items()}


def test_relabel(spark):
    now = spark.createDataFrame([("a", "m", 15), ("b", "m", 16), ("c", "x", 10), ("d", "m", 10), ("e", "m", 99)], "cluster_id string, medoid string, size long")
    states = spark.createDataFrame([("a", "L", "m", 10), ("b", "L", "m", 10), ("c", "L", "m", 10), ("d", None, "m", 10), ("e", "L", "m", None)], "cluster_id string, label string, medoid string, labeled_size int")
    assert {r.cluster_id: r.relabel for r in groups.needs_relabel(now, states).collect()} == {"a": False, "b": True, "c": True, "d": True, "e": False}


def test_cards_embedding_and_labels(spark):
    g = spark.createDataFrame([("d", "t", 3, None, "order ORD-12 on 2026-01-02 failed " + "x" * 400), ("e", "u", None, "k", None)], "diagnosis_id string, trace_id string, root_cause_step_index int, failure_class string, rationale string")
    v = spark.createDataFrame([("d", 1, "first", "due"), ("d", 3, "here", None)], "diagnosis_id string, step_index int, observed_signature string, expected string")
    s = spark.createDataFrame([("t", "b"), ("t", "a"), ("t", "b")], "trace_id string, detector string")
    cards = {r.diagnosis_id: r.card for r in groups.cards(g, v, s).collect()}
    assert cards["d"].split("\n")[:4] == ["failure_class: unknown", "observed: here", "expected: due", "detectors: a, b"] and "ORD-<ID> on <DATE> failed" in cards["d"] and cards["e"].endswith("rationale: ")
    vec = {r.diagnosis_id: r.v for r in groups.embed(groups.cards(g, v, s), "diagnosis_id", "card").collect()}
    assert len(vec["d"]) == groups.DIM and abs(sum(x * x for x in vec["d"]) - 1) < 1e-5
    shown = spark.createDataFrame([("k1", "one", 0), ("k1", "two", 1), ("k2", "three", 0)], "cluster_id string, card string, place int")
    got = {r.cluster_id: r for r in groups.label_groups(shown, lambda p: json.dumps({"label": "L", "description": "D", "suggested_fix": "F"}) if "one\n---\ntwo" in p else "no").collect()}
    assert got["k1"].label == "L" and got["k1"].error is None and got["k2"].label is None and got["k2"].error


def test_flags(spark):
    from faultline.operators.steps import PAYLOAD

    rows = [("tool", "s", {"arguments_json": "{broken"}), ("tool", "s", {"arguments_json": "{}"}), ("llm", "s", {"total_tokens": 95, "max_tokens": 100, "response_format_schema": "{}", "response_messages": [{"content": "no"}]}), ("retriever", "retr:a:w2:hit", {"query": "a b c", "documents": [{"score": 0.1}, {"score": None}]}), ("agent", "s", {"delegated_to": ["x", "y"]}), ("agent", "s", None)]
    df = spark.createDataFrame([(k, s, None if p is None else json.dumps(p)) for k, s, p in rows], "kind string, signature string, payload string").withColumn("p", F.from_json("payload", PAYLOAD))
    got = [r.t for r in df.select(groups.flagged_signature(F.col("signature"), F.col("kind"), F.col("p")).alias("t")).collect()]
    assert got == ["s|argsmalformed", "s", "s|neartokenlimit,schemaviolation", "retr:a:w2:hit|lowscore,querydrift", "s|delegates2", "s"]
