"""Document fingerprints by winnowing, in DataFrame operations only.

Every k-gram of code points has a rolling hash of 32 bits: the exclusive or of its symbols (a Murmur3 hash of each code point), each shifted by its distance from
the end. The next hash is the last one shifted by a bit, with the symbol that enters, and the one that leaves cancelled. Folds roll along pieces of ``ROLL``
hashes; the lowest bits, in which the first symbols have no part, are the last to decide an order. Of each ``WINDOW`` consecutive
hashes the least is chosen, the rightmost of equals; each choice is kept with its position. Two texts that share a passage of ``GRAM + WINDOW - 1`` code points thus share a
fingerprint. A hash and its position are packed into one long such that the order of longs is the order of choice.

Few hashes can be chosen at all: a window that holds a hash holds its whole piece of the roll, or the two whole pieces after or before it, so the hash is
the least of its piece or under the least of those two. These candidates (all equals among them) alone are packed, and a
fold over them holds the current minimum. It looks at a window again only when that minimum has left it, so the cost per code point is constant.

``edited``: the last quarter of a text is replaced by the beginning of the next document (by id). Rows are ordered in buckets of a
few hundred ids (more, once there are ``BUCKETS``; range boundaries from approximate quantiles); the last row of a bucket meets the first of the next bucket
through a side table with one row a bucket.

Defined cases: a null text is empty; an empty text has no fingerprints, and likeness 1 to another such text, else 0; a text shorter
than a k-gram has one fingerprint, of the whole text; one of fewer than ``WINDOW`` hashes has one, its least; repeated ids are ordered by
text; null ids come first; the next document of a lone row is itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.llm.common import table, text_of

GRAM = 12
WINDOW = 48
#: Rows in a bucket, about, and how many buckets there are at most: the bound of what is broadcast, a row of three numbers each.
BUCKET, BUCKETS = 256, 100_000
SEGMENTS = 64
LAST = (1 << 31) - 1
#: Bits of a hash that are kept, above the position, and hashes that are rolled in one piece.
MASK, ROLL = (1 << 31) - 1, 16
#: Pieces whose windows are looked at by one fold.
PIECES = 8


def choices(text: str) -> Column:
    """The packed choices of a text column, by position. ``let`` binds a value once: a column that a lambda names
    would be fetched anew, as a copy, at every element."""
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    symbols = "transform(sequence(1, octet_length(points) - 3, 4), i -> hash(substring(points, i, 4)))"
    hashed = lambda part: f"aggregate({part}, 0, (h, s) -> shiftleft(h, 1) ^ s) & {MASK}"
    pack = lambda h, place: f"shiftleft(cast({h} as bigint), 31) | ({place})"
    # what a step adds: the symbol that enters, and the symbol that leaves, which it cancels
    steps = f"zip_with(slice(symbols, 1, size(symbols) - {GRAM}), slice(symbols, {GRAM + 1}, size(symbols) - {GRAM}), (o, s) -> shiftleft(o, {GRAM}) ^ s)"
    rolled = f"aggregate(slice(steps, p * {ROLL} + 1, {ROLL - 1}), array({hashed(f'slice(symbols, p * {ROLL} + 1, {GRAM})')}), (a, d) -> array_append(a, (shiftleft(element_at(a, -1), 1) ^ d) & {MASK}))"
    pieces = let(steps, "steps", f"transform(sequence(0, (size(symbols) - {GRAM}) div {ROLL}), p -> {rolled})")
    # a window that holds a part of a piece only holds so many whole ones before it or after it
    whole_ones = min((WINDOW + 1) // ROLL - 1, 2)
    after, before = f"array_min(slice(lowest, p + 2, {whole_ones}))", f"array_min(slice(lowest, greatest(p - {whole_ones}, 0) + 1, least({whole_ones}, p)))"
    most = f"greatest(lowest[p], {after}, {before})" if whole_ones > 0 else f"{MASK}"
    low = f"transform(filter(sequence(0, {ROLL - 1}), i -> get(piece, i) <= most), i -> {pack('piece[i]', f'{LAST - 1}L - 4L * (p * {ROLL} + i)')})"
    lows = let("transform(pieces, x -> array_min(x))", "lowest", f"transform(pieces, (piece, p) -> {let(most, 'most', low)})")
    # a fold over the candidates of a few pieces; its state: the minimum, the choices. Before a candidate enters, what left since the last one is seen to
    place = lambda v: f"({v} & {LAST})"
    moved = lambda m, s: f"transform(array({m}), m -> named_struct('at', m, 'out', array_append({s}.out, m)))[0]"
    following = f"array_min(filter(part, v -> {place('v')} < {place('x')} and {place('v')} >= {place('x')} - {4 * WINDOW}))"
    left = f"aggregate(filter(part, v -> {place('v')} <= {place('s.at')} and {place('v')} >= {place('h')} + {4 * WINDOW}), s, (r, x) -> if(x = r.at, {moved(following, 'r')}, r))"
    enters = lambda s: f"if(h < {s}.at, {moved('h', s)}, {s})"
    opening = f"transform(array(array_min(filter(part, v -> {place('v')} > {LAST - 1}L - 4L * (g * {PIECES * ROLL} + {WINDOW})))), m -> named_struct('at', m, 'out', array(m)))[0]"
    reach = (ROLL + WINDOW - 2) // ROLL
    end = f"{MASK << 31}L | greatest({LAST - 1}L - 4L * (size(symbols) - {GRAM}), {LAST - 1}L - 4L * ((g * {PIECES} + {PIECES + reach}) * {ROLL} - 1))"
    fold = f"aggregate(array_append(part, {end}), {opening}, (s, h) -> if({place('h')} <= {place('s.at')} - {4 * WINDOW}, {let(left, 't', enters('t'))}, {enters('s')}), s -> s.out)"
    group = let(f"flatten(slice(lows, g * {PIECES} + 1, {PIECES + reach}))", "part", fold)
    chosen = f"array_distinct(flatten(transform(sequence(0, greatest(size(symbols) - {GRAM + WINDOW - 1}, 0) div {PIECES * ROLL}), g -> {group})))"
    whole = f"if(size(symbols) = 0, cast(array() as array<bigint>), array({pack(hashed('symbols'), f'{LAST - 1}L')}))"
    long = let(pieces, "pieces", let(lows, "lows", chosen))
    read = let(f"encode({text}, 'UTF-32')", "points", f"if(octet_length(points) = 0, cast(array() as array<int>), {symbols})")
    return F.expr(let(read, "symbols", f"if(size(symbols) < {GRAM}, {whole}, {long})"))


def choices_after_edit(known: str, head: str, edited: str) -> Column:
    """The choices of ``edited``, whose first ``head`` code points are those of a text with the choices ``known``. What windows within
    the head choose is known; only windows that reach beyond it are looked at."""
    last = f"({head} - {GRAM + WINDOW - 1})"  # the last window within the head
    first = f"({last} - {WINDOW - 1})"
    rest = choices(f"substring({edited}, cast(greatest({first}, 0) + 1 as int))")
    found = F.transform(rest, lambda v: v - F.expr(f"4 * {first}"))
    kept = F.expr(f"filter({known}, v -> v & {LAST} >= {LAST - 1} - 4 * {last})")
    return F.when(F.expr(f"{first} > 0"), F.array_distinct(F.concat(kept, found))).otherwise(rest)


def written(choices: Column) -> Column:
    """``hash:position`` of each choice, hashes as eight hex digits, comma-joined."""
    one = lambda v: F.concat(F.lower(F.lpad(F.hex(F.shiftrightunsigned(v, 31)), 8, "0")), F.lit(":"), F.shiftright(F.lit(LAST - 1) - v.bitwiseAND(F.lit(LAST)), 2).cast("string"))
    return F.array_join(F.transform(choices, one), ",")


def hashes_of(choices: Column) -> Column:
    return F.array_distinct(F.transform(choices, lambda v: F.shiftrightunsigned(v, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, 1.0).otherwise(shared / every)


def bucketed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``bucket``, a number that never falls as ``doc_id`` grows; null ids are in bucket -1."""
    n = docs.agg(F.count("doc_id").alias("n"), F.percentile_approx("doc_id", [i / SEGMENTS for i in range(SEGMENTS + 1)], 10_000).alias("q"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    if not n["n"]:
        return docs.withColumn("bucket", F.lit(-1).cast("long"))
    bounds = sorted({n["lo"], *n["q"], n["hi"] + 1})
    per = max(1, min(-(-n["n"] // BUCKET), BUCKETS) // SEGMENTS)
    number = None
    for at, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        own = F.lit(at * per) + F.floor((F.col("doc_id") - lo) * F.lit(float(per)) / float(hi - lo))
        own = F.least(own, F.lit(at * per + per - 1))
        number = F.when(F.col("doc_id") < hi, own) if number is None else number.when(F.col("doc_id") < hi, own)
    return docs.withColumn("bucket", F.coalesce(number, F.lit(-1)).cast("long"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Contract columns of each row of ``docs(doc_id, text)``."""
    base = bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("string").alias("text")))
    order = W.partitionBy("bucket").orderBy("doc_id", "text")
    rows = base.withColumn("choices", choices("text"))
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next_choices": F.lead("choices").over(order), "is_last": F.lead(F.lit(True)).over(order).isNull()})

    # the first row of each bucket, handed to the bucket before it; the very first goes to the last
    least = base.groupBy("bucket").agg(F.min("doc_id").alias("first_id"))
    around = W.orderBy("bucket")
    heads = least.withColumn("to", F.coalesce(F.lag("bucket").over(around), F.max("bucket").over(W.partitionBy(F.lit(0)))))
    named = heads.select(F.col("bucket").alias("b"), "first_id", "to")
    firsts = base.join(F.broadcast(named), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("bucket") == F.col("b"))).groupBy("to").agg(F.min("text").alias("text"))
    firsts = firsts.select("to", F.col("text").alias("first_text"), choices("text").alias("first_choices"))

    both = rows.join(firsts, (rows["bucket"] == firsts["to"]) & rows["is_last"], "left")
    both = both.withColumn("following", F.when(F.col("is_last"), F.col("first_text")).otherwise(F.col("next_text")))
    both = both.withColumn("following_choices", F.when(F.col("is_last"), F.col("first_choices")).otherwise(F.col("next_choices")))
    both = both.select("doc_id", "text", "choices", "following_choices", F.char_length("text").cast("long").alias("n_chars"), "following")
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 4 as int))"), F.expr("substring(following, 1, cast(n_chars div 4 as int))")))
    edited = both.withColumn("edited_choices", choices_after_edit("choices", "(n_chars - n_chars div 4)", "edited"))
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        written(F.col("choices")).alias("fingerprint"),
        written(F.col("edited_choices")).alias("edited_fingerprint"),
        likeness(hashes_of(F.col("choices")), hashes_of(F.col("edited_choices"))).alias("near_edited"),
        likeness(hashes_of(F.col("choices")), hashes_of(F.col("following_choices"))).alias("near_next"),
    )


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
