import random

import numpy as np

from faultline.llm.leakage import LEAST, Matcher, find_leaks, myers, words_of

R = random.Random(5)
WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
ITEM = {i: " ".join(R.choice(WORDS) for _ in range(90)) for i in range(1, 9)}
OPENING = " ".join(R.choice(WORDS) for _ in range(30))
ITEM[9], ITEM[10] = OPENING + " " + ITEM[1][::-1], OPENING + " " + ITEM[2][::-1]
FILL = " ".join(f"q{n}x" for n in range(40))


def _cut(i, a, b):
    return " ".join(ITEM[i].split()[a:b])


def test_myers_is_the_edit_distance():
    r = np.random.default_rng(0)
    for _ in range(200):
        p, t = r.integers(1, 5, (3, 9)), r.integers(1, 5, 25)
        want = []
        for row in p:
            prev, best = list(range(10)), 1 << 30
            for c in t:
                cur = [0]
                for j in range(1, 10):
                    cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (row[j - 1] != c)))
                prev, best = cur, min(best, cur[9]) if c == row[-1] else best
            want.append(best)
        assert myers(p, np.stack([t[::-1], t]), np.ones(3, np.int64)).tolist() == want


def test_disguises(spark):
    leak = _cut(3, 10, 60).split()
    edited = [("also" if k % 12 == 5 else w) for k, w in enumerate(leak)]
    docs = [
        FILL + " " + " ".join(leak).upper() + " " + FILL, "> " + "\n> ".join(" ".join(leak[k : k + 6]) for k in range(0, 50, 6)), "<p>" + " <b>".join(leak) + "</b></p>",
        '{"prompt": "' + "\\n".join(leak) + '"}', "\n".join(f"[user] {' '.join(leak[k : k + 9])}" for k in range(0, 50, 9)), " ".join(edited), "​ ".join(leak), "%20".join(leak), "; ".join(leak), "**" + " _".join(leak) + "_**",
    ]
    clean = ["", None, FILL, _cut(3, 0, 16), "\n".join(f'"{_cut(3, k, k + 7)}"' + " " + FILL for k in (0, 20, 40)), OPENING + " " + FILL, FILL + " x" * 100_000]
    rows = [(i, t) for i, t in enumerate(docs)] + [(100 + i, t) for i, t in enumerate(clean)]
    items = spark.createDataFrame(list(ITEM.items()), "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(df, items).collect()}
    assert got == {(i, 3) for i in range(len(docs))}
    assert find_leaks(df.limit(0), items).count() == 0 and find_leaks(df, items.limit(0)).count() == 0


def test_length_and_budget_against_brute_force():
    m = Matcher(ITEM)
    item = words_of(ITEM[4])
    for n in (17, LEAST, 24):
        found = {i for i, *_ in m.leaks(FILL + " " + " ".join(item[5 : 5 + n]) + " " + FILL)}
        assert found == ({4} if n >= LEAST else set())
    w = item[30:70]
    for step, hit in ((12, True), (4, False)):  # every fourth word changed is too much
        t = " ".join("zzz" if k % step == 3 else x for k, x in enumerate(w))
        assert bool(m.leaks(t)) == hit


def test_blocks_of_items_change_nothing(spark):
    r = random.Random(8)
    docs = [(k, " ".join([FILL, _cut(1 + k % 8, a := r.randrange(40), a + 30), FILL])) for k in range(30)] + [(90, OPENING + " " + FILL), (91, None)]
    items = spark.createDataFrame([*ITEM.items(), (3, "twice"), (11, None)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = sorted(map(tuple, find_leaks(df, items).collect()))
    assert len(whole) == 30 and sorted(map(tuple, find_leaks(df, items, block=3).collect())) == whole
