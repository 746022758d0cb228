import random

from pyspark.sql import functions as F

from faultline.llm.runs import normal_signature, runs

SCHEMA = "seq string, idx int, sig string, s long, e long"


def test_spellings_say_the_same(spark):
    same = ["tool:bench_lead:find_it:ok", "TOOL:Bench-Lead:FIND_IT:OK", "tool : bench_lead : find_it : ok\t", "tool::bench_lead::find_it::ok", "tool/bench_lead/find_it/ok", "tool > bench_lead > find_it > ok", "tool:bench_lead:find_it:ok|lowscore|delegates2", "tool:bench_lead:find_it:ok (attempt 11)", "tool:bench_lead:find_it:ok#4", "tool:bench_lead:find_it:ok~6", "tool:bench_lead:find_it[97066]:ok", "tool:bench_lead:find_it(d6fed37):ok"]
    got = {r.n for r in spark.createDataFrame([(x,) for x in same], "x string").select(normal_signature(F.col("x")).alias("n")).collect()}
    assert len(got) == 1
    two = spark.createDataFrame([("retr:a:w5:hit",), ("retr:a:w9:hit",), ("retr:a:w9:miss",), ("tool:a:find_all:ok",)], "x string").select(normal_signature(F.col("x")).alias("n")).collect()
    assert two[0].n == two[1].n != two[2].n and two[3].n != list(got)[0]


def _brute(rows):
    by, out = {}, set()
    for q, i, s, b, e in rows:
        if i is not None:
            by.setdefault(q, {}).setdefault(i, []).append((s is not None, s or "", b, e))
    for q, d in by.items():
        line = [(i, *min(v)) for i, v in sorted(d.items())]
        k = 0
        while k < len(line):
            j = k
            while j + 1 < len(line) and line[k][1] and line[j + 1][1:3] == line[k][1:3]:
                j += 1
            out.add((q, line[k][0], j - k + 1, line[k][3], line[j][4]))
            k = j + 1
    return out


def test_matches_brute_force_at_any_bucket(spark):
    r, rows = random.Random(2), []
    for q in [*"abcdef", None]:
        for i in range(60):
            if r.random() < 0.85:
                rows.append((q, i * (3 if q == "c" else 1), r.choice(["tool:a:x:ok", "tool:a:y:ok", None]) if r.random() < 0.6 else "tool:a:x:ok", i * 10, i * 10 + 5))
    rows += rows[::7] + [("a", None, "tool:a:x:ok", 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("bucket", F.lit("clash")).withColumn("n", F.lit(1))
    want = _brute(rows)
    for bucket in (4, 4096):
        got = {(x.seq, x.start_index, x.run_length, x.start, x.end) for x in runs(df, ["seq"], "idx", "sig", "s", "e", bucket).collect()}
        assert got == want
    assert runs(df.limit(0), ["seq"], "idx", "sig").count() == 0
