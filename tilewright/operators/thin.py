"""Thinning: ranks along a space-filling curve and the rules that keep features at low zooms."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.tilemath import keeps_even_rank, keeps_integer_rule, layer_morton, pixel_degrees, retain_count

#: Rows that are ranked in one piece, about, and how many quantiles are taken at most: three times as many numbers are what is broadcast at most.
PIECE, PIECES = 50_000, 10_000
LOWEST = -(1 << 63)


def constant_array(values: list[int]) -> Column:
    """Whole numbers as a constant, folded once when the plan is made."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast("array<bigint>")


def with_piece(df: DataFrame, key: str, n: int, piece: int = PIECE, tie: str = "fid") -> DataFrame:
    """``df`` with ``__piece``, which never falls as (``key``, ``tie``) grows: bisection over approximate quantiles in constant arrays. A key so
    frequent that several quantiles fall on it is cut again by quantiles of ``tie``, so that one place of many points is several pieces."""
    wanted = max(1, min(PIECES, n // piece))
    found = (df.agg(F.percentile_approx(key, [i / wanted for i in range(1, wanted)], 10 * wanted)).first()[0] or []) if wanted > 1 else []
    often = Counter(found)
    hot = {k: c for k, c in often.items() if c > 1}
    inner = {}
    if hot:
        parts = max(hot.values()) + 1
        rows = df.where(F.array_contains(constant_array(sorted(hot)), F.col(key))).groupBy(key).agg(F.percentile_approx(tie, [i / parts for i in range(1, parts)], 10 * parts).alias("q"))
        inner = {r[0]: r[1] for r in rows.collect()}
    cuts = sorted({(k, t) for k in often for t in (LOWEST, *(inner.get(k) or []))})
    df = df.withColumn("__piece", F.lit(0))
    step = 1 << (len(cuts).bit_length() - 1) if cuts else 0
    keys, ties = constant_array([c[0] for c in cuts]), constant_array([c[1] for c in cuts])
    while step:
        ahead = F.col("__piece") + step
        at, own = F.get(keys, ahead - 1), F.col(key)
        passed = (at < own) | ((at == own) & (F.get(ties, ahead - 1) <= F.col(tie)))
        df = df.withColumn("__piece", F.when((ahead <= len(cuts)) & passed, ahead).otherwise(F.col("__piece")))
        step >>= 1
    return df


def morton_ranks(points: DataFrame, n: int, piece: int = PIECE) -> DataFrame:
    """``points(fid, lon, lat, …)`` with ``morton`` and its 0-based ``rank`` by (morton, fid). Exact, without a window over all rows: pieces of the
    curve are ranked apart and shifted by the counts of the pieces before."""
    df = with_piece(points.withColumn("morton", layer_morton("lon", "lat")), "morton", n, piece)
    # a number a piece comes to the driver and goes back as a constant array
    counts = {r["__piece"]: r["count"] for r in df.groupBy("__piece").count().collect()}
    starts, before = [], 0
    for k in range(max(counts, default=0) + 1):
        starts.append(before)
        before += counts.get(k, 0)
    local = F.row_number().over(W.partitionBy("__piece").orderBy("morton", "fid")) - 1
    return df.withColumn("__local", local).withColumn("rank", (F.get(constant_array(starts), F.col("__piece")) + F.col("__local")).cast("long")).drop("__piece", "__local")


def keeps_point(rule: str, rank: Column, n: int, rate: float, base: int, z: Column) -> Column:
    """Whether a point of ``rank`` stays at ``z``. ``even``: evenly spaced ranks; ``integer``: where a running quota grows."""
    total = F.lit(n).cast("long")
    retain = retain_count(total, rate, F.lit(base) - z)
    kept = keeps_even_rank(rank, total, retain) if rule == "even" else keeps_integer_rule(rank + 1, total, retain)
    return (z >= base) | kept


def keeps_area(west: Column, south: Column, east: Column, north: Column, rate: float, base: int, z: Column) -> Column:
    """Whether a line or polygon is large enough at ``z``, by its bounding box."""
    least = pixel_degrees(z) * pixel_degrees(z) * F.pow(F.lit(float(rate)), (F.lit(base) - z).cast("double"))
    return (z >= base) | ~((east - west) * (north - south) < least)
