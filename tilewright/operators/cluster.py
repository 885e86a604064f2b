"""Point clustering: greedy by input order within a radius, zoom by zoom from the highest down.

In input order, a point that no earlier seed took is a seed and takes the untaken points within the radius. Seeds are thus the first maximal set of points
out of each other's reach, and a point goes to its earliest seed in reach. Both are found without gathering more than a bounded number of points in a task:

1. Points lie in square cells so small that any two of a cell are in reach: a cell has one seed at most. Of the undecided points of each cell the
   first ``PER_CELL`` (a group limit before and after the shuffle) are dealt to blocks of ``BLOCK`` cells a side, with a rim of two cells.
2. A block decides its points in input order: a point is a seed if all earlier points in reach are known to be none. Where an earlier point
   beyond the rim or beyond the first of a cell may be in reach, it stays undecided.
3. Undecided points in reach of new seeds go (a join on cells; at most one seed of each of 25 cells). Rounds end when none is left; each decides the
   earliest point at least, and long chains of neighbours within a block at once.
4. Points are joined to the seeds around their cell, and summed up by seed in a map-side combined group-by.

Centroids add up in whole units of 2^-32 degrees, so they do not hang on the order of addition.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.plans.store import forget, saved

#: Cells a side of a block, and undecided points of a cell that a round looks at: a task holds a block with its rim, (68 * 68 * 17) points at most.
BLOCK, PER_CELL = 64, 16
#: Side of a cell in radii, under the root of a half; points in reach are two cells away at most.
SIDE, REACH = 0.7, 2
UNIT = float(1 << 32)


def greedy(lon, lat, count, radius: float):
    """Seeds in order with their centroid and weight, for points in input order, one by one: what ``cluster_zoom`` is tested against."""
    cells: dict[tuple[int, int], list[int]] = {}
    home = [(math.floor(x / radius), math.floor(y / radius)) for x, y in zip(lon, lat)]
    for i, c in enumerate(home):
        cells.setdefault(c, []).append(i)
    taken, limit, out = [False] * len(home), radius * radius, []
    for i, (cx, cy) in enumerate(home):
        if taken[i]:
            continue
        taken[i] = True
        members = [i]
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                for j in cells.get((cx + dx, cy + dy), ()):
                    if not taken[j] and (lon[j] - lon[i]) * (lon[j] - lon[i]) + (lat[j] - lat[i]) * (lat[j] - lat[i]) <= limit:
                        taken[j] = True
                        members.append(j)
        if len(members) == 1:
            out.append((i, lon[i], lat[i], count[i]))
            continue
        weight = [1 if count[j] is None else count[j] for j in members]
        total = sum(weight)
        centre = lambda v: float(sum(math.floor(v[j] * UNIT + 0.5) * w for j, w in zip(members, weight))) / total / UNIT  # noqa: B023,E731
        out.append((i, centre(lon), centre(lat), total))
    return out


def decide(points: list[tuple], limit: float) -> list[int]:
    """Places of the certain seeds among ``points(lon, lat, cx, cy, own, barrier)`` in input order. A barrier is the first point of its
    cell that a round does not look at: it and whatever follows it in the cell stay open."""
    seed: dict[tuple[int, int], tuple[float, float]] = {}
    open_: dict[tuple[int, int], list[tuple[float, float]]] = {}
    shut: set[tuple[int, int]] = set()
    around = [(dx, dy) for dx in range(-REACH, REACH + 1) for dy in range(-REACH, REACH + 1)]
    found = []
    for i, (x, y, cx, cy, own, barrier) in enumerate(points):
        near = [(cx + dx, cy + dy) for dx, dy in around]
        if any((s := seed.get(c)) and (s[0] - x) * (s[0] - x) + (s[1] - y) * (s[1] - y) <= limit for c in near):
            if barrier:
                shut.add((cx, cy))
            continue
        unsure = barrier or not own or any(c in shut for c in near)
        if not unsure:
            unsure = any((px - x) * (px - x) + (py - y) * (py - y) <= limit for c in near for px, py in open_.get(c, ()))
        if unsure:
            open_.setdefault((cx, cy), []).append((x, y))
            if barrier:
                shut.add((cx, cy))
        else:
            seed[cx, cy] = (x, y)
            found.append(i)
    return found


def _cells(n: int, column: str):
    """Cells within ``REACH`` of a cell, a row each."""
    return F.explode(F.sequence(F.col(column) - n, F.col(column) + n))


def seeds_of(points: DataFrame, radius: float) -> DataFrame:
    """The seeds ``(fid, lon, lat, cx, cy)`` of ``points(fid, lon, lat, cx, cy)``."""
    limit = radius * radius
    schema = "fid long, lon double, lat double, cx long, cy long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fid", "lon", "lat"], kind="stable").reset_index(drop=True)
        columns = [pdf[c].tolist() for c in ("lon", "lat", "cx", "cy")]
        own = ((pdf["cx"] // BLOCK == pdf["bx"]) & (pdf["cy"] // BLOCK == pdf["by"])).tolist()
        return pdf.loc[decide(list(zip(*columns, own, (pdf["r"] > PER_CELL).tolist())), limit), ["fid", "lon", "lat", "cx", "cy"]]

    left, found = points, None
    while True:
        first = left.withColumn("r", F.row_number().over(W.partitionBy("cx", "cy").orderBy("fid", "lon", "lat"))).where(F.col("r") <= PER_CELL + 1)
        blocks = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + d) / BLOCK).cast("long") for d in (-REACH, 0, REACH)])))
        dealt = first.withColumn("bx", blocks("cx")).withColumn("by", blocks("cy"))
        fresh = saved(dealt.groupBy("bx", "by").applyInPandas(run, schema))
        found = fresh if found is None else found.unionByName(fresh)
        rim = fresh.select(F.col("lon").alias("slon"), F.col("lat").alias("slat"), _cells(REACH, "cx").alias("x"), "cy").select("slon", "slat", "x", _cells(REACH, "cy").alias("y"))
        dx, dy = F.col("lon") - F.col("slon"), F.col("lat") - F.col("slat")
        rest = saved(left.join(rim, (F.col("cx") == F.col("x")) & (F.col("cy") == F.col("y")) & (dx * dx + dy * dy <= limit), "left_anti"))
        forget(left)
        left = rest
        if not left.limit(1).count():
            return found


def cluster_zoom(points: DataFrame, radius: float) -> DataFrame:
    """``points(fid, lon, lat, point_count)`` clustered once; ``fid``, unique, is the input order and the seed's stays."""
    cell = lambda c: F.floor(F.col(c) / F.lit(radius * SIDE)).cast("long")
    placed = saved(points.select("fid", "lon", "lat", "point_count", cell("lon").alias("cx"), cell("lat").alias("cy")))
    seeds = seeds_of(placed.select("fid", "lon", "lat", "cx", "cy"), radius)
    spread = seeds.select(F.struct(F.col("fid").alias("s"), F.col("lon").alias("x"), F.col("lat").alias("y")).alias("seed"), _cells(REACH, "cx").alias("cx"), "cy")
    around = spread.select("seed", "cx", _cells(REACH, "cy").alias("cy")).groupBy("cx", "cy").agg(F.array_sort(F.collect_list("seed")).alias("near"))
    reach = F.filter("near", lambda s: (s["x"] - F.col("lon")) * (s["x"] - F.col("lon")) + (s["y"] - F.col("lat")) * (s["y"] - F.col("lat")) <= radius * radius)
    homed = placed.join(around, ["cx", "cy"]).withColumn("seed", reach[0]["s"])
    weight = F.coalesce("point_count", F.lit(1)).cast("decimal(18,0)")
    units = lambda c: F.floor(F.col(c) * UNIT + 0.5).cast("decimal(20,0)") * weight
    mine = lambda c: F.max(F.when(F.col("fid") == F.col("seed"), F.col(c)))
    groups = homed.groupBy(F.col("seed").alias("fid")).agg(
        F.count(F.lit(1)).alias("members"), F.sum(weight).alias("total"), F.sum(units("lon")).alias("x"), F.sum(units("lat")).alias("y"), mine("lon").alias("lon"), mine("lat").alias("lat"), mine("point_count").alias("own")
    )
    alone = F.col("members") == 1
    centre = lambda c, sum_: F.when(alone, F.col(c)).otherwise(F.col(sum_).cast("double") / F.col("total").cast("double") / UNIT)
    return groups.select("fid", centre("lon", "x").alias("lon"), centre("lat", "y").alias("lat"), F.when(alone, F.col("own")).otherwise(F.col("total").cast("long")).alias("point_count"))


def clusters(points: DataFrame, distance: float, highest: int, lowest: int) -> DataFrame:
    """``(z, fid, lon, lat, point_count)`` for each zoom from ``highest`` down to ``lowest``."""
    state = points.select("fid", "lon", "lat", F.lit(None).cast("long").alias("point_count"))
    out = None
    for z in range(highest, lowest - 1, -1):
        state = saved(cluster_zoom(state, distance * 360.0 / (256.0 * 2**z)))
        level = state.select(F.lit(z).alias("z"), "fid", "lon", "lat", "point_count")
        out = level if out is None else out.unionByName(level)
    return out
