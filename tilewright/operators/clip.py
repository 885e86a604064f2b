"""Clipping to rectangles, for Arrow-batched operators."""

from __future__ import annotations

from tilewright.functions.geometry import LINE, POINT, Geometry, Part, area2, bbox, multi

Box = tuple[float, float, float, float]


def clip_line(line: Part, box: Box) -> list[Part]:
    """Pieces of a line within ``box``, by the parameter interval of each segment that lies inside; pieces that meet are joined."""
    west, south, east, north = box
    pieces: list[Part] = []
    for (ax, ay), (bx, by) in zip(line, line[1:]):
        lo, hi, dx, dy = 0.0, 1.0, bx - ax, by - ay
        for p, q in ((-dx, ax - west), (dx, east - ax), (-dy, ay - south), (dy, north - ay)):
            if p == 0:
                if q < 0:
                    lo = 2.0
            elif p < 0:
                lo = max(lo, q / p)
            else:
                hi = min(hi, q / p)
        if lo > hi:
            continue
        start = (ax, ay) if lo == 0.0 else (ax + lo * dx, ay + lo * dy)
        end = (bx, by) if hi == 1.0 else (ax + hi * dx, ay + hi * dy)
        if pieces and abs(pieces[-1][-1][0] - start[0]) < 1e-10 and abs(pieces[-1][-1][1] - start[1]) < 1e-10:
            pieces[-1].append(end)
        else:
            pieces.append([start, end])
    return [p for p in pieces if len(p) > 2 or p[0] != p[1]]


def _open(ring: Part) -> Part:
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else list(ring)


def _inside(point: tuple[float, float], ring: Part) -> bool:
    x, y = point
    odd = False
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def _half(rings: list[Part], axis: int, limit: float, sign: int) -> list[Part]:
    """Oriented open rings (outer counter-clockwise, holes clockwise) cut by one half-plane, ``sign * (c - limit) >= 0``. Chains of vertices
    inside start and end on the border; sorted along it, neighbours are joined by pairs (the even-odd rule), so that a concave
    polygon falls into pieces instead of keeping bridges along the border."""
    whole, chains = [], []
    for ring in rings:
        flags = [sign * (c[axis] - limit) >= 0 for c in ring]
        if all(flags):
            whole.append(ring)
            continue
        if not any(flags):
            continue
        n = len(ring)
        start = next(i for i in range(n) if flags[i] and not flags[i - 1])
        chain = None
        for k in range(n + 1):
            i = (start + k) % n
            if flags[i] != flags[i - 1]:
                a, b = ring[i - 1], ring[i]
                t = (limit - a[axis]) / (b[axis] - a[axis])
                other = a[1 - axis] + t * (b[1 - axis] - a[1 - axis])
                cross = (limit, other) if axis == 0 else (other, limit)
                if flags[i]:
                    if k == n:
                        break
                    chain = [cross]
                else:
                    chain.append(cross)
                    chains.append(chain)
                    chain = None
            if flags[i] and chain is not None:
                chain.append(ring[i])
    if not chains:
        return whole
    ends = sorted([(c[0][1 - axis], k, 0) for k, c in enumerate(chains)] + [(c[-1][1 - axis], k, 1) for k, c in enumerate(chains)])
    follows: dict[int, int] = {}
    for (_, k, is_end), (_, m, other_end) in zip(ends[::2], ends[1::2]):
        if is_end == other_end:  # touching rings or a ring that crosses itself: each chain closes on itself
            follows = {c: c for c in range(len(chains))}
            break
        follows[k if is_end else m] = m if is_end else k
    out, used = whole, set()
    for k in range(len(chains)):
        ring: Part = []
        while k not in used:
            used.add(k)
            ring += [c for c in chains[k] if not ring or c != ring[-1]]
            k = follows[k]
        if len(ring) > 1 and ring[0] == ring[-1]:
            ring.pop()
        if len(ring) >= 3 and area2(ring) != 0:
            out.append(ring)
    return out


def clip_polygon(member: list[Part], box: Box) -> list[list[Part]]:
    """Polygons (closed rings) of one polygon with holes within ``box``."""
    west, south, east, north = box
    xs, ys = [c[0] for c in member[0]], [c[1] for c in member[0]]
    if min(xs) >= west and max(xs) <= east and min(ys) >= south and max(ys) <= north:
        return [member]
    if max(xs) < west or min(xs) > east or max(ys) < south or min(ys) > north:
        return []
    rings = []
    for k, ring in enumerate(member):
        ring = _open(ring)
        if len(ring) >= 3:
            rings.append(ring if (area2(ring) > 0) == (k == 0) else ring[::-1])
    for axis, limit, sign in ((0, west, 1), (0, east, -1), (1, south, 1), (1, north, -1)):
        rings = _half(rings, axis, limit, sign)
    outer = [r for r in rings if area2(r) > 0]
    found = [[r] for r in outer]
    for hole in (r for r in rings if area2(r) < 0):
        home = next((p for p in found if _inside(hole[0], p[0])), found[0] if found else None)
        if home is not None:
            home.append(hole)
    return [[[*r, r[0]] for r in p] for p in found]


def clip(g: Geometry, box: Box) -> Geometry | None:
    """``g`` within the closed ``box``; None where nothing is left."""
    kind, members = g
    west, south, east, north = box
    base = (kind - 1) % 3 + 1
    if base == POINT:
        kept = [m for m in members if west <= m[0][0][0] <= east and south <= m[0][0][1] <= north]
        return (kind if kind == POINT else kind, kept) if kept else None
    a, b, c, d = bbox(g)
    if a >= west and b >= south and c <= east and d <= north:
        return g
    if base == LINE:
        return multi(kind, [[p] for m in members for p in clip_line(m[0], box)])
    return multi(kind, [p for m in members for p in clip_polygon(m, box)])
