import collections

import numpy as np

from faultline.llm.clusters import clusters, pivot_links
from faultline.llm.neighbours import encode, encode_queries, estimate, nearest, rotation

DIM = 32


def _points(seed=0):
    r, rows = np.random.default_rng(seed), []
    for c in range(12):
        center = r.standard_normal(DIM)
        for i in range(3 + c * 2):
            rows.append((f"c{c}-{i:02d}", (center + 0.25 * r.standard_normal(DIM)).tolist()))
    rows += [(f"noise{i}", r.standard_normal(DIM).tolist()) for i in range(60)]
    rows += [(f"copy{i}", rows[40][1]) for i in range(9)]
    rows += [("null", None), ("zero", [0.0] * DIM), ("short", [1.0] * 5), ("nan", [float("nan")] * DIM), ("inf", [float("inf")] + [1.0] * (DIM - 1)), ("hole", [None, *[1.0] * (DIM - 1)])]
    return rows


def _unit(rows):
    ok = [(i, np.array(v)) for i, v in rows if v is not None and len(v) == DIM and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    return [i for i, _ in ok], np.array([v / np.linalg.norm(v) for _, v in ok])


def test_neighbours_match_brute_force(spark):
    rows = _points()
    ids, u = _unit(rows)
    s = u.astype(np.float32).astype(float) @ u.astype(np.float32).astype(float).T
    got = collections.defaultdict(dict)
    for r in nearest(spark.createDataFrame(rows, "id string, v array<double>"), DIM, k=5).collect():
        got[r.id][r.neighbour] = r.cosine
    assert set(got) == set(ids)
    hits = 0
    for i, x in enumerate(ids):
        order = sorted((k for k in range(len(ids)) if k != i), key=lambda k: (-round(s[i, k], 6), ids[k]))[:5]
        assert len(got[x]) == 5
        hits += sum(ids[k] in got[x] or abs(s[i, k] - min(got[x].values())) < 1e-5 for k in order)
    assert hits >= 0.99 * 5 * len(ids)


def test_codes_estimate_within_their_bounds():
    r = np.random.default_rng(1)
    turn, base, q = rotation(96), r.standard_normal((400, 96)).astype(np.float32), r.standard_normal((50, 96)).astype(np.float32)
    bits, length, fit = encode(base, turn)
    est, err = estimate(bits, fit, encode_queries(q, turn), 96)
    exact = q @ (base / length[:, None]).T
    assert (np.abs(est - exact) <= err).mean() > 0.99
    assert np.allclose(turn @ turn.T, np.eye(96), atol=1e-4)


def _components(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return [find(x) for x in range(n)]


def test_pivot_links_connect_the_same(spark):
    r = np.random.default_rng(4)
    for _ in range(60):
        n = int(r.integers(1, 25))
        pairs = [(a, b) for a in range(n) for b in range(n) if a < b and r.random() < 0.12]
        x, y = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
        links = pivot_links(r.permutation(n), x, y, r.random(len(pairs)))
        a, b = _components(n, pairs), _components(n, links)
        assert all((a[i] == a[j]) == (b[i] == b[j]) for i in range(n) for j in range(n))


def test_clusters_match_brute_force(spark):
    rows = _points(3)
    ids, u = _unit(rows)
    s = u @ u.T
    comp = _components(len(ids), [(a, b) for a, b in np.argwhere(np.triu(s >= 0.7, 1)).tolist()])
    want = set()
    for c in set(comp):
        m = [i for i, x in enumerate(comp) if x == c]
        if len(m) >= 5:
            mean = s[np.ix_(m, m)].mean(1)
            best = ids[m[min(range(len(m)), key=lambda k: (-round(mean[k], 9), ids[m[k]]))]]
            want |= {(ids[i], best, len(m)) for i in m}
    got = clusters(spark.createDataFrame(rows, "id string, v array<double>"), DIM)
    assert {(r.id, r.medoid, r.size) for r in got.collect()} == want


def test_nothing_usable(spark):
    df = spark.createDataFrame([("null", None), ("zero", [0.0] * DIM)], "id string, v array<double>")
    for x in (df, df.limit(0)):
        assert nearest(x, DIM).count() == 0 and clusters(x, DIM).count() == 0
    one = spark.createDataFrame([("a", [1.0] * DIM)], "id string, v array<double>")
    assert nearest(one, DIM).count() == 0 and clusters(one, DIM).count() == 0


def test_visits_as_codes_find_what_brute_force_finds_over_many_cells(spark):
    r = np.random.default_rng(7)
    centres = r.standard_normal((60, 48))
    m = (centres[r.integers(0, 60, 3000)] + 0.45 * r.standard_normal((3000, 48))).astype(np.float32)
    m[100:130] = m[0]  # copies
    rows = [(f"p{i:04d}", x.tolist()) for i, x in enumerate(m)]
    got = {}
    for x in nearest(spark.createDataFrame(rows, "id string, v array<float>"), 48, k=4, least=0.6).collect():
        got.setdefault(x.id, set()).add((x.neighbour, round(x.cosine, 5)))
    u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1)[:, None]
    s, want, hit = u @ u.T, 0, 0
    np.fill_diagonal(s, -9)
    for i in range(0, 3000, 3):
        for j in np.lexsort((np.arange(3000), -s[i].round(12)))[:4]:
            if s[i, j] >= 0.6:
                want += 1
                hit += (f"p{j:04d}", round(s[i, j], 5)) in got.get(f"p{i:04d}", ())
    assert want > 500 and hit >= 0.97 * want
