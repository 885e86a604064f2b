"""Merging features of a tile that have equal properties, for Arrow-batched operators.

Points come first and stay; then lines, chained at shared ends; then polygons, gathered into multipolygons. Groups keep the order of their first
member, whose id they take.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geometry import LINE, POINT, POLYGON, Part, multi
from tilewright.operators.graph import components


def chain_lines(lines: list[Part], key=lambda p: p) -> list[Part]:
    """Lines joined at ends of equal ``key``: each chain starts with the first line left, grows at its end as long as some line fits
    (the earliest first, turned if need be), then at its start."""
    ends: dict = defaultdict(list)
    for i, line in enumerate(lines):
        ends[key(line[0])].append(i)
        ends[key(line[-1])].append(i)
    used = [False] * len(lines)
    place: dict = defaultdict(int)

    def fitting(at):
        mine = ends[at]
        while place[at] < len(mine) and used[mine[place[at]]]:
            place[at] += 1
        return mine[place[at]] if place[at] < len(mine) else None

    out = []
    for i, first in enumerate(lines):
        if used[i]:
            continue
        used[i] = True
        chain = deque(first)
        while (k := fitting(key(chain[-1]))) is not None:
            used[k] = True
            line = lines[k] if key(lines[k][0]) == key(chain[-1]) else lines[k][::-1]
            chain.extend(line[1:])
        while (k := fitting(key(chain[0]))) is not None:
            used[k] = True
            line = lines[k] if key(lines[k][0]) == key(chain[0]) else lines[k][::-1]
            chain.extendleft(line[1:])
        out.append(list(chain))
    return out


def coalesce(features, key=lambda p: p):
    """``features`` are (id, geometry, values)."""
    if len(features) < 2:
        return features
    points, groups = [], {LINE: {}, POLYGON: {}}
    for f in features:
        base = (f[1][0] - 1) % 3 + 1
        if base == POINT:
            points.append(f)
        else:
            same = tuple((type(v), v) for v in f[2])
            groups[base].setdefault(same, []).append(f)
    out = points
    for base in (LINE, POLYGON):
        for members in groups[base].values():
            if len(members) == 1:
                out.append(members[0])
                continue
            if base == LINE:
                parts = [m[0] for f in members for m in f[1][1] if len(m[0]) >= 2]
                g = multi(LINE, [[p] for p in chain_lines(parts, key)])
            else:
                g = multi(POLYGON, [m for f in members for m in f[1][1]])
            if g:
                out.append((members[0][0], g, members[0][2]))
    return out


def with_group(lines: DataFrame, first: list[str], last: list[str]) -> DataFrame:
    """``lines``, which must be a written table, with ``group``: equal where lines hang together by equal ends (of columns ``first`` and ``last``). Merging depends on
    nothing outside of a group, so that groups, not tiles, are what a task must hold. Ends are told by hashes: two that collide make one group of two, no more."""
    end = lambda names: F.xxhash64(*[F.col(c) + F.lit(0.0) for c in names])  # noqa: E731  (0.0 and -0.0 are equal)
    named = lines.withColumns({"__a": end(first), "__b": end(last)})
    roots = components(named.select(F.col("__a").alias("a"), F.col("__b").alias("b"))).select(F.col("node").alias("__a"), "root")
    return named.join(roots, "__a", "left").withColumn("group", F.coalesce("root", "__a")).drop("__a", "__b", "root")
