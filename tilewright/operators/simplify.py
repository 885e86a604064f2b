"""Line simplification and snapping to the tile grid, for Arrow-batched operators."""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from math import floor

from tilewright.functions.geometry import LINE, POINT, Geometry, Part


def _triangle(a, b, c) -> float:
    return abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2


def visvalingam(line: Part, tolerance: float) -> Part:
    """Remove the inner vertex of least triangle area while that area is at most ``tolerance``; ends stay."""
    n = len(line)
    if n < 3 or tolerance <= 0:
        return line
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    alive, version = [True] * n, [0] * n
    heap = [(_triangle(line[i - 1], line[i], line[i + 1]), i, 0) for i in range(1, n - 1)]
    heapify(heap)
    while heap:
        area, i, seen = heappop(heap)
        if area > tolerance:
            break
        if not alive[i] or seen != version[i]:
            continue
        alive[i] = False
        a, b = left[i], right[i]
        right[a], left[b] = b, a
        for k in (a, b):
            if 0 < k < n - 1:
                version[k] += 1
                heappush(heap, (_triangle(line[left[k]], line[k], line[right[k]]), k, version[k]))
    return [p for p, keep in zip(line, alive) if keep]


def simplify_lines(g: Geometry, tolerance: float) -> Geometry:
    """Lines simplified as a whole; other kinds as they are."""
    if (g[0] - 1) % 3 + 1 != LINE:
        return g
    return g[0], [[visvalingam(m[0], tolerance)] for m in g[1]]


def half_away(v: float) -> int:
    """Round half away from zero."""
    return int(floor(abs(v) + 0.5)) if v >= 0 else -int(floor(abs(v) + 0.5))


def _snapped(part: Part) -> Part:
    out: Part = []
    for x, y in part:
        p = (half_away(x), half_away(y))
        if not out or out[-1] != p:
            out.append(p)
    return out


def snap(g: Geometry) -> Geometry:
    """Vertices, in tile units, on whole units, without repeats. What collapses (a line under two vertices, a ring under four) falls
    away if other members stay, holes always; if all members collapse the geometry stays as it was."""
    kind, members = g
    base = (kind - 1) % 3 + 1
    if base == POINT:
        return kind, [[[(half_away(x), half_away(y)) for x, y in m[0]]] for m in members]
    least = 2 if base == LINE else 4
    kept = []
    for m in members:
        first = _snapped(m[0])
        if len(first) >= least:
            kept.append([first, *(h for h in map(_snapped, m[1:]) if len(h) >= least)])
    return (kind, kept) if kept else g
