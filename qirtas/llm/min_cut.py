"""Minimum cut of small binary labelling problems."""

from __future__ import annotations

from collections import deque


def label(costs: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node True or False, of least total cost: costs[i] = (cost of False, cost of True); an edge (i, j, w) costs w if
    its ends differ.

    A node whose own preference outweighs all its edges has its label in every minimum; those are settled first and their
    edges folded into the neighbours' costs. Max-flow by shortest augmenting paths then cuts what is left, which is small.
    """
    n = len(costs)
    want = [f - t for f, t in costs]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    out: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if out[i] is None and abs(want[i]) >= sum(near[i].values()):
            out[i] = want[i] > 0
            for j, w in near[i].items():
                want[j] += w if out[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if out[i] is None]
    if rest:
        source, sink = -1, -2
        cap: dict[int, dict[int, float]] = {source: {}, sink: {}} | {i: dict(near[i]) for i in rest}
        for i in rest:
            if want[i] > 0:
                cap[source][i], cap[i][source] = want[i], 0.0
            elif want[i] < 0:
                cap[i][sink], cap[sink][i] = -want[i], 0.0
        while True:
            back, queue = {source: source}, deque([source])
            while queue and sink not in back:
                u = queue.popleft()
                for v, c in cap[u].items():
                    if c > 1e-12 and v not in back:
                        back[v] = u
                        queue.append(v)
            if sink not in back:
                break
            path, v = [], sink
            while v != source:
                path.append((back[v], v))
                v = back[v]
            flow = min(cap[u][v] for u, v in path)
            for u, v in path:
                cap[u][v] -= flow
                cap[v][u] = cap[v].get(u, 0.0) + flow
        for i in rest:
            out[i] = i in back
    return [bool(x) for x in out]
