"""Connected components of an edge table, without the driver holding any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.plans.store import forget, saved


def _compress(hooks: DataFrame) -> DataFrame:
    """Pointer jumping: follow ``node -> root`` until each root is final. Roots only get
    smaller, and each pass halves the longest path."""
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        new = saved(hooks.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        moved = new.where("moved").limit(1).count()
        forget(hooks)
        hooks = new.select("node", "root")
        hooks._saved_at = new._saved_at
        if not moved:
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)``, undirected. Returns ``(node, root)`` for each node of an edge, with root
    the smallest node of its component. Loops and repeated edges are harmless; no edges give no rows.

    Every round hooks each node to its smallest smaller neighbour, compresses the hooks to stars
    and contracts the edges, so that the edge table shrinks from round to round. Hubs are met
    only by map-side combined minima and by joins on the unique key of the hook table.
    """
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    labels = None
    while True:
        if not e.limit(1).count():
            break
        hooks = _compress(saved(e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))))
        h1 = hooks.select(F.col("node").alias("hi"), F.col("root").alias("hi_root"))
        h2 = hooks.select(F.col("node").alias("lo"), F.col("root").alias("lo_root"))
        ends = e.join(h1, "hi").join(h2, "lo", "left").select(F.col("hi_root").alias("x"), F.coalesce("lo_root", "lo").alias("y"))
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            moved = labels.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
            known = labels.select("node")
            labels2 = saved(moved.unionByName(hooks.join(known, "node", "left_anti")))
            forget(labels)
            labels = labels2
        nxt = saved(ends.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct())
        forget(e)
        e = nxt
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    roots = labels.select(F.col("root").alias("node"), "root").distinct()
    return labels.unionByName(roots)
