"""Slow, obvious versions of the graph operators, for small inputs."""

import math
from collections import defaultdict

R = 6371008.8


def metres(p, q):
    (_, x1, y1), (_, x2, y2) = p, q
    s1, s2 = math.sin(math.radians(y2 - y1) / 2), math.sin(math.radians(x2 - x1) / 2)
    return 2 * R * math.asin(math.sqrt(s1 * s1 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * s2 * s2))


def kruskal(points, gap_m):
    """points: {id: (road, lon, lat)} -> set of (a, b), {id: component}."""
    links = []
    ids = sorted(points)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if points[a][0] == points[b][0]:
                w = metres(points[a], points[b])
                if round(w, 3) <= gap_m:
                    links.append((w, a, b))
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    kept = set()
    for _, a, b in sorted(links):
        p, q = top(a), top(b)
        if p != q:
            up[p] = q
            kept.add((a, b))
    return kept, {i: top(i) for i in ids}


def tree_chainage(points, edges):
    """Distance from one end of the longest path, by plain walks over each tree."""
    near = defaultdict(list)
    for a, b in edges:
        w = metres(points[min(a, b)], points[max(a, b)])
        near[a].append((b, w))
        near[b].append((a, w))
    place = lambda i: (points[i][2], points[i][1], i)

    def walk(start):
        dist, todo = {start: 0.0}, [start]
        while todo:
            x = todo.pop()
            for y, w in near[x]:
                if y not in dist:
                    dist[y] = dist[x] + w
                    todo.append(y)
        return dist

    out, seen = {}, set()
    for i in sorted(points):
        if i in seen:
            continue
        comp = walk(i)
        seen |= set(comp)
        root = min(comp, key=place)
        far = lambda d: min(d, key=lambda k: (-round(d[k], 6), *place(k)))
        u = far(walk(root))
        v = far(walk(u))
        out.update(walk(min(u, v, key=place)))
    return out
