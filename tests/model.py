"""Plain-Python versions of the algorithms."""

from collections import deque


def bfs(n, edges, root):
    out = [[] for _ in range(n)]
    for s, d in edges:
        out[s].append(d)
    depth = {root: 0}
    todo = deque([root])
    while todo:
        v = todo.popleft()
        for d in out[v]:
            if d not in depth:
                depth[d] = depth[v] + 1
                todo.append(d)
    parent = {v: min((s for s, d in edges if d == v and depth.get(s) == k - 1), default=v) for v, k in depth.items()}
    return {v: (parent.get(v), depth.get(v)) for v in range(n)}


def labels(n, edges):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for s, d in edges:
            if label[s] < label[d]:
                label[d], changed = label[s], True
    return dict(enumerate(label))


def ranks(n, edges, k, mode):
    deg = [0] * n
    for s, _ in edges:
        deg[s] += 1
    published = mode == "published"
    delta, rank, active = [1 / n] * n, [0.0] * n, [True] * n
    for i in range(k):
        got = [0.0] * n
        for s, d in edges:
            if active[s]:
                got[d] += delta[s] / deg[s]
        for v in range(n):
            if i == 0:
                x = 0.85 * got[v] + 0.15000000000000002 / (n if published else 1)
                rank[v] += x
                delta[v] = x - 1 / n
                active[v] = abs(delta[v]) > (0.01 * rank[v] if published else rank[v] + 0.01)
            else:
                delta[v] = 0.85 * got[v]
                active[v] = abs(delta[v] if published else rank[v]) > 0.01 * rank[v]
                if active[v]:
                    rank[v] += delta[v]
        if (sum(map(abs, delta)) if published else sum(delta)) < 1e-7:
            break
    return dict(enumerate(rank))
