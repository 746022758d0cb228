import random

import pytest

from faultline.operators.hierarchy import clean_parent, descendants, distinct_nodes, hierarchy
from pyspark.sql import functions as F


def _rows(seed: int):
    r, rows = random.Random(seed), []
    for t in range(12):
        n = r.randint(1, 90)
        for i in range(n):
            x = r.random()
            p = None if i == 0 or x < 0.05 else f"n{r.randint(max(0, i - 3), i - 1)}" if x < 0.8 else f"n{r.randint(0, n - 1)}" if x < 0.9 else f"n{r.randint(0, max(0, i - 1))}" if x < 0.97 else "gone"
            rows.append((f"t{t}", f"n{i}", p))
    # a chain, a star and a pure circle
    rows += [("chain", f"n{i}", f"n{i - 1}" if i else None) for i in range(70)]
    rows += [("star", f"n{i}", "n0" if i else None) for i in range(70)]
    rows += [("ring", f"n{i}", f"n{(i + 1) % 5}") for i in range(5)]
    return rows


def _brute(rows):
    up, out = {(t, n): p for t, n, p in rows}, {}
    for t, n, _ in rows:
        path, bad = [n], False
        while (p := up[(t, path[-1])]) is not None and (t, p) in up:
            if p in path:
                bad = True
                break
            path.append(p)
        out[(t, n)] = ("", -1, None) if bad else (path[-1], len(path) - 1, path[::-1])
    return out


@pytest.mark.parametrize("local_rows", [20_000, 40])
def test_matches_brute_force_on_both_routes(spark, local_rows):
    rows = _rows(3)
    want = _brute(rows)
    got = hierarchy(spark.createDataFrame(rows, "trace string, node string, parent string"), ["trace"], True, local_rows).collect()
    assert len(got) == len(rows)
    assert {(r.trace, r.node): (r.root_id, r.depth, r.path) for r in got} == want
    for r in got:
        if r.depth >= 0:
            below = {x.node for x in got if x.trace == r.trace and x.depth >= 0 and r.node in x.path}
            inside = {x.node for x in got if x.trace == r.trace and x.root_id == r.root_id and r.preorder <= x.preorder < r.preorder + r.subtree_size}
            assert below == inside and len(below) == r.subtree_size


def test_repeats_nulls_empty_and_extra_columns(spark):
    rows = [("a", "x", None, 1), ("a", "x", None, 2), ("a", "y", "x", 1), (None, "z", None, 1), ("a", None, "x", 1), ("b", "self", "self", 1)]
    df = spark.createDataFrame(rows, "g string, id string, up string, parent int").drop("parent").withColumn("depth", F.lit(9))
    nodes = distinct_nodes(df, ["g"], "id", "up")
    got = {(r.g, r.node): (r.root_id, r.depth) for r in hierarchy(nodes, ["g"]).collect()}
    assert got == {("a", "x"): ("x", 0), ("a", "y"): ("x", 1), (None, "z"): ("z", 0), ("b", "self"): ("", -1)}
    assert hierarchy(nodes.limit(0), ["g"]).count() == 0


def test_descendants_and_spellings_of_no_parent(spark):
    df = spark.createDataFrame([("g", "a", None), ("g", "b", "a"), ("g", "c", "b")], "g string, node string, parent string")
    got = {(r.node, r.descendant, r.distance) for r in descendants(hierarchy(df, ["g"], True), ["g"]).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    none = spark.createDataFrame([(x,) for x in ("", " ", "NULL", "0000000000000000", "none", None)], "p string")
    assert [r.p for r in none.select(clean_parent(F.col("p")).alias("p")).collect()] == [None] * 6
    assert spark.createDataFrame([(" AB1 ",)], "p string").select(clean_parent(F.col("p")).alias("p")).first().p == "ab1"


@pytest.mark.parametrize("local_rows", [20_000, 40])
def test_preorder_by_a_given_order_and_labels(spark, local_rows):
    r = random.Random(4)
    rows = [(t, f"n{i}", f"n{r.randint(max(0, i - 6), i - 1)}" if i else None, r.randint(0, 5) if t else i % 3 - 10**15) for t in range(3) for i in range(90)]
    rows += [(9, f"n{i}", "n0" if i else None, r.randint(0, 10**18)) for i in range(200)]
    df = spark.createDataFrame(rows, "t int, node string, parent string, at long").withColumn("name", F.concat(F.lit("l"), "node"))
    got = {(x.t, x.node): x for x in hierarchy(df, ["t"], True, local_rows, "at", "name").collect()}
    kids = {}
    for t, n, p, at in rows:
        kids.setdefault((t, p), []).append((at, n))
    want, walk = {}, []
    for t in {x[0] for x in rows}:
        stack, k = [("n0", ("ln0",))], 0
        while stack:
            n, path = stack.pop()
            want[(t, n)] = (k, list(path))
            k += 1
            stack.extend((c, (*path, "l" + c)) for _, c in sorted(kids.get((t, n), []), reverse=True))
    assert {key: (x.preorder, x.path) for key, x in got.items()} == want
