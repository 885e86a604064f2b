"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source has a target of words. Whole epochs come first: a source whose target is e times its size and a rest takes all its
documents e times. The rest is drawn without replacement: a document's key is exponential with its quality weight as
rate, documents are taken by ascending key, and a prefix sum of sizes stops at the rest; the document that crosses it is taken
up to the rest, so that each source meets its target to the word.

The prefix sum has three levels, so that no task holds a source: keys fall into buckets, buckets into spans; sums are added up over the spans of a source, over
the buckets of a span, and only within a bucket are documents sorted. The number of buckets follows the number of documents, and a bucket holds about ``BUCKET`` of
them whatever the weights: the map of a key to its bucket is the distribution function of all keys, a mixture of exponentials over the weights that occur (by eighths
of an octave, so at most 1,025 terms). Sources, too, may be many: their ranks and running sums come from a sorted written table, by partition.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating; all words are shared by weight; a target stops at 3 times its
source's size and the excess is shared again by weight. The fixpoint is ``min(3 size, level * weight)``, found in closed form
over sources sorted by 3 size / weight.

Defined cases: null and empty texts have size 0 and take 0; a null source is a source; repeated rows are documents of their own
with equal keys, in an order that cannot change the result; weights that are null, not finite or not positive count as 1; an empty
table gives no rows; columns of clashing names are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.llm.common import WORD, saved, table, text_of
from tilewright.plans.model import marked

CYCLE = (5, 2, 1)
LIMIT = 3
#: Documents in a bucket, about, and buckets in a span.
BUCKET, SPAN = 2000, 1000


def words(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def running(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """``df``, written in the global ``order``, with ``place`` (from 0) and the sums over all rows before. Partitions are added up apart; the broadcast has a row a partition."""
    table = saved(marked(df.orderBy(*order), "__m")).withColumn("__p", F.shiftright("__m", 33))
    sums = {"place": F.lit(1).cast("long"), **sums}
    parts = table.groupBy("__p").agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    starts = saved(parts.select("__p", *[F.coalesce(F.sum(f"__{k}").over(earlier(W.orderBy("__p"))), F.lit(0)).alias(f"__{k}") for k in sums]))
    inside = earlier(W.partitionBy("__p").orderBy("__m"))
    found = table.withColumns({f"__in_{k}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}).join(F.broadcast(starts), "__p")
    return found.select(*df.columns, *[(F.col(f"__{k}") + F.col(f"__in_{k}")).alias(k) for k in sums])


def targets(sources: DataFrame) -> DataFrame:
    """``(source, source_size)``, one row a source, with its ``target``."""
    cycle = F.array(*[F.lit(float(c)) for c in CYCLE])
    ranked = running(sources, [F.col("source").isNull(), "source"], {})
    weighed = ranked.select("source", "source_size", F.get(cycle, F.pmod("place", F.lit(len(CYCLE))).cast("int")).alias("weight"), (F.lit(float(LIMIT)) * F.col("source_size")).alias("cap"))
    added = saved(running(weighed, [F.col("cap") / F.col("weight"), F.col("source").isNull(), "source"], {"caps": F.col("cap"), "weights": F.col("weight")}))
    total = added.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    # sharing what earlier sources leave lifts the level as long as these are above their caps, then lowers it: its peak is the fixpoint
    level = (F.lit(float(total["size"] or 0)) - F.col("caps")) / (F.lit(float(total["weight"] or 1)) - F.col("weights"))
    peak = added.agg(F.max(level)).first()[0]
    return added.select("source", "source_size", F.least(F.col("cap"), F.lit(float(peak or 0)) * F.col("weight")).alias("target"))


def spread(rows: DataFrame, n: int) -> Column:
    """The part of all keys that lie below ``key``: the mixture of the exponentials of the weights that ``rows(key, weight)`` has."""
    octave = F.greatest(F.least(F.floor(F.log2("weight") * 8), F.lit(512)), F.lit(-512))
    found = rows.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("w")).orderBy("o").collect()
    if not found:
        return F.lit(0.0)
    terms = F.array(*[F.struct(F.lit(r["n"] / n).alias("n"), F.lit(r["w"]).alias("w")) for r in found])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["n"] * (1 - F.exp(-F.col("key") * t["w"])))


def mix(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """``(doc_id, source, tie, size, source_size, target, taken)``, with ``tie`` a hash of the text, of each row of ``docs(doc_id, text, source)``. ``quality(doc_id, weight)``: weights,
    ids unique; documents without one weigh 1."""
    sized = docs.select("doc_id", "source", words(text_of()).alias("size"), F.xxhash64("text").alias("tie"))
    if quality is not None:
        sized = sized.join(quality.select("doc_id", F.col("weight").cast("double").alias("weight")), "doc_id", "left")
    else:
        sized = sized.withColumn("weight", F.lit(1.0))
    usable = (F.col("weight") > 0) & (F.col("weight") < float("inf")) & ~F.isnan("weight")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit("mix")), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    sized = sized.withColumn("weight", F.when(usable, F.col("weight")).otherwise(1.0))
    rows = saved(sized.select("doc_id", "source", "size", "tie", (-F.log(uniform) / F.col("weight")).alias("key"), "weight"))
    n = rows.count()
    buckets = max(1, -(-n // BUCKET))
    rows = rows.withColumn("bucket", F.least(F.floor(spread(rows, n) * buckets), F.lit(buckets - 1)).cast("long")).drop("weight")
    span = F.floor(F.col("bucket") / SPAN).cast("long")
    sums = saved(rows.groupBy("source", "bucket").agg(F.sum("size").alias("held")).withColumn("span", span))
    spans = sums.groupBy("source", "span").agg(F.sum("held").alias("held"))
    goals = targets(spans.groupBy("source").agg(F.sum("held").alias("source_size"))).withColumnRenamed("source", "s")
    wide = spans.withColumn("earlier", F.sum("held").over(W.partitionBy("source").orderBy("span")) - F.col("held")).drop("held")
    wide = wide.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnsRenamed({"source": "s", "span": "p"})
    level = sums.withColumn("before", F.sum("held").over(W.partitionBy("source", "span").orderBy("bucket")) - F.col("held")).drop("held")
    level = level.join(wide, F.col("source").eqNullSafe(F.col("s")) & (F.col("span") == F.col("p"))).withColumn("before", F.col("before") + F.col("earlier"))
    level = level.drop("s", "p", "span", "earlier").withColumnsRenamed({"source": "s", "bucket": "b"})
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    found = placed.join(level, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    whole = F.col("source_size") > 0
    words_wanted = F.round("target").cast("long")
    epochs = F.when(whole, F.floor(words_wanted / F.col("source_size"))).otherwise(0)
    rest = words_wanted - epochs * F.col("source_size")
    drawn = F.least(F.greatest(rest - F.col("before") - F.col("within"), F.lit(0)), F.col("size"))
    return found.select("doc_id", "source", "tie", "size", "source_size", "target", (epochs * F.col("size") + drawn).cast("long").alias("taken"))


def keep_mixed(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """The documents of which the mix takes words, with ``size``, ``source_size``, ``target`` and ``taken`` after their own columns (which
    these replace, if so named). Rows that repeat id, source and text are told apart by their other columns, and get what the mix takes of them to the word, the
    first of them first."""
    key = ["doc_id", "source", "tie"]
    found = mix(docs, quality).groupBy(*key).agg(*[F.first(c).alias(c) for c in ("size", "source_size", "target")], F.sum("taken").alias("__all"), F.count(F.lit(1)).alias("__n"))
    found = saved(found.where("__all > 0").withColumnsRenamed({c: f"__{c}" for c in key}))
    docs = docs.drop("size", "source_size", "target", "taken")
    on = docs["doc_id"].eqNullSafe(found["__doc_id"]) & docs["source"].eqNullSafe(found["__source"]) & (F.xxhash64(docs["text"]) == found["__tie"])
    own, more = [docs[c] for c in docs.columns], ["size", "source_size", "target"]
    single = docs.join(found.where("__n = 1"), on).select(*own, *more, F.col("__all").alias("taken"))
    if not found.where("__n > 1").limit(1).count():
        return single
    # rows of a group have the same size: each gets whole epochs, and of the rest the first rows all they hold
    met = docs.join(found.where("__n > 1"), on).select(*own, *more, *[F.col(c) for c in ("__all", "__n", "__doc_id", "__source", "__tie")])
    met = met.withColumn("__at", F.row_number().over(W.partitionBy("__doc_id", "__source", "__tie").orderBy(F.to_json(F.struct(*docs.columns)))) - 1)
    epochs = F.expr("cast(round(target) as bigint) div source_size")
    rest = F.col("__all") - F.col("__n") * epochs * F.col("size")
    share = F.greatest(F.least(F.col("size"), rest - F.col("__at") * F.col("size")), F.lit(0))
    many = met.withColumn("taken", (epochs * F.col("size") + share).cast("long")).select(*docs.columns, *more, "taken").where("taken > 0")
    return single.unionByName(many)


def quality_weights(labels: DataFrame) -> DataFrame:
    """Weights from ``labels(doc_id, quality)``: 2 for good, 0.5 for bad, between for ids labelled both ways."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.pow(F.lit(4.0), F.avg("quality") - 0.5).alias("weight"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels")))
    return found.select("doc_id", "size", "source_size", "target", "taken")
