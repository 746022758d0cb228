"""Density clusters of one bounded set of vectors: mutual-reachability spanning tree, condensed hierarchy, excess of mass."""

from __future__ import annotations

import numpy as np

#: A set above this size is not one task's work; the distributed pivot clustering is for those.
MOST_POINTS = 5_000


def spanning_tree(x: np.ndarray, neighbours: int) -> np.ndarray:
    """Edges (a, b, distance) of the minimum spanning tree under mutual reachability, shortest first."""
    n = len(x)
    sq = (x**2).sum(1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))
    core = np.partition(d, min(neighbours, n - 1), axis=1)[:, min(neighbours, n - 1)]
    inside, best, via = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        reach = np.maximum(np.maximum(d[at], core[at]), core)
        closer = ~inside & (reach < best)
        best[closer], via[closer] = reach[closer], at
        at = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((via[at], at, best[at]))
    return np.array(sorted(edges, key=lambda e: (e[2], e[0], e[1]))) if edges else np.empty((0, 3))


def hdbscan(x: np.ndarray, smallest: int = 5) -> np.ndarray:
    """Cluster label of every row, -1 for noise. Fewer than ``smallest`` rows are all noise."""
    n = len(x)
    if n > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points")
    if n < max(2, smallest):
        return np.full(n, -1)
    tree = spanning_tree(np.asarray(x, float), smallest)
    # single linkage: node n + i joins two nodes at edge i
    up, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    kids: dict[int, tuple[int, int, float]] = {}

    def find(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for i, (a, b, w) in enumerate(tree):
        a, b = find(int(a)), find(int(b))
        up[a] = up[b] = n + i
        size[n + i] = size[a] + size[b]
        kids[n + i] = (a, b, w)

    def leaves(v: int) -> list[int]:
        out, stack = [], [v]
        while stack:
            y = stack.pop()
            if y < n:
                out.append(y)
            else:
                stack.extend(kids[y][:2])
        return out

    # condense: a split counts only if both sides are large enough; what falls off leaves its cluster at that density
    born, children, mass, fell = {0: 0.0}, {0: []}, {0: 0.0}, {0: []}
    stack = [(2 * n - 2, 0)]
    while stack:
        node, c = stack.pop()
        a, b, w = kids[node]
        density = 1.0 / max(w, 1e-12)
        big = [k for k in (a, b) if size[k] >= smallest]
        for k in (a, b):
            if size[k] < smallest:
                off = leaves(k)
                fell[c].extend(off)
                mass[c] += len(off) * (density - born[c])
        if len(big) == 2:
            mass[c] += (size[a] + size[b]) * (density - born[c])
            for k in big:
                new = len(born)
                born[new], children[new], mass[new], fell[new] = density, [], 0.0, []
                children[c].append(new)
                if k >= n:
                    stack.append((k, new))
        elif big and big[0] >= n:
            stack.append((big[0], c))
    chosen, worth = set(), {}
    for c in sorted(born, reverse=True):
        below = sum(worth[k] for k in children[c])
        if c and (not children[c] or mass[c] >= below):
            worth[c] = mass[c]
            chosen.add(c)
            drop = list(children[c])
            while drop:
                k = drop.pop()
                chosen.discard(k)
                drop.extend(children[k])
        else:
            worth[c] = below
    labels = np.full(n, -1)
    for number, c in enumerate(sorted(chosen)):
        todo = [c]
        while todo:
            k = todo.pop()
            labels[fell[k]] = number
            todo.extend(children[k])
    return labels
