import itertools

import pytest

from faultline.llm.mixing import Mix, min_cost_flow, plan, read_targets, with_tokens
from faultline.runtime import canonical_source


def test_flow_is_largest_and_cheapest():
    edges = [(0, 2, 3, 0), (0, 3, 3, 1), (2, 4, 9, 0), (3, 4, 9, 0), (3, 5, 9, 0), (4, 1, 4, 0), (5, 1, 2, 0)]
    flow = min_cost_flow(6, edges, 0, 1)
    best = None
    for f in itertools.product(range(4), range(4), range(4), range(4), range(4)):
        a, b, c, d, e = f  # flows of the first five edges
        if a == c and b == d + e and c + d <= 4 and e <= 2:
            best = max(best, (a + b, -b)) if best else (a + b, -b)
    assert (flow[0] + flow[1], -flow[1]) == best


def test_caps_shares_and_overlap():
    intervals, filled = plan({("a",): 100, ("b",): 900, (): 50}, [("a", 0.5, 2), ("b", 0.5, 1)])
    assert filled == {"a": (525, 200), "b": (525, 525)}
    _, filled = plan({("a", "b"): 100, ("a",): 100}, [("a", 1, 1), ("b", 1, 1)])
    assert filled == {"a": (100, 100), "b": (100, 100)}  # what both have goes to the one that has nothing else
    assert plan({}, [("a", 1, 1)])[1] == {"a": (0, 0)}
    assert plan({("a",): 10}, [("a", 0, 1)])[1] == {"a": (0, 0)}


@pytest.fixture
def docs(spark):
    rows = [(i, ["a"] if i % 10 == 0 else ["b"], 7 + i % 5) for i in range(2000)] + [(5000, ["a", None, "a"], 9), (5001, None, 11), (5002, ["b"], None)]
    return spark.createDataFrame(rows, "doc_id long, sources array<string>, tokens long")


def test_selection_follows_the_plan(docs):
    mix = Mix(docs, {"m": [("a", 0.4, 3), ("b", 0.6, 1)]})
    report = {r.source: r for r in mix.report().collect()}
    rows = mix.select(buckets=16).collect()
    for s in "ab":
        got = sum(r.tokens * r.repeats for r in rows if r.source == s)
        assert abs(got - report[s].mixed_tokens) <= 12
        assert max(r.repeats for r in rows if r.source == s) <= {"a": 3, "b": 1}[s]
    assert report["a"].falls_short and not report["b"].falls_short
    assert sorted(map(tuple, mix.select(buckets=16).collect())) == sorted(map(tuple, rows))


def test_tokens_and_targets(spark):
    t = with_tokens(spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "x" * 5000)], "doc_id long, text string").selectExpr("*", "9 as tokens"))
    got = {r.doc_id: r.tokens for r in t.collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 0
    df = spark.createDataFrame([("m", "Lab Diary ", 1.0, None), ("m", "lab-diary", 1.0, 3), ("m", None, 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    assert read_targets(df, canonical_source) == {"m": [("lab_diary", 1.0, 3)]}


def test_empty_corpus(docs):
    mix = Mix(docs.limit(0), {"m": [("a", 1.0, 1)]})
    assert [r.mixed_tokens for r in mix.report().collect()] == [0] and mix.select().count() == 0
