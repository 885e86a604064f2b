"""Near-duplicate linking by SimHash with bit-sliced comparison.

1. Each whole text gets a 64-bit fingerprint of its three-word shingles (Arrow batches).
2. Rows with equal fingerprints meet in a map-side combined group-by; only distinct
   fingerprints go on, so copies never form a group.
3. Two fingerprints that differ in at most two of 64 bits agree in at least two of four
   16-bit blocks. Six tables keyed by two blocks thus bring every link together (pigeonhole).
   A key that holds many fingerprints is dealt again by two of the four bytes of its other
   32 bits, by the same argument; no key can then hold more than 65,536 fingerprints.
4. In a bucket the fingerprints are sorted and stored in blocks of ``BLOCK``, as vertical bit planes. A query's distances to a
   block's members grow together in carry-save counters; the block is abandoned once all members exceed the
   radius or are linked already. The bucket gives a spanning forest, never all pairs.
5. Connected components of the forests' edges (see ``operators.graph``).

Defined cases: null and empty texts have fingerprint zero and link with each other; texts of one or
two words are hashed as a whole; repeated rows share a component; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import arrow_map, forget, fresh, saved, table
from tilewright.operators.graph import components

RADIUS = 2
SHINGLE = 3
#: Fingerprints of one key that are compared in one piece; larger keys are dealt again.
BUCKET = 16384
#: Members of a block of bit planes.
BLOCK = 1024
#: Rows of equal fingerprints that one task hands their component.
COPIES = 1_000_000
#: Bands of minhashes, and minhashes in a band, of ``cluster_alike``, the radius of its SimHashes, and texts of a band that are compared in one piece.
BANDS, ROWS, WIDE, CHUNK = 24, 4, 23, 4096
PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The SimHash of a text as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= k:
        hashes = digest(joined, 42)
    else:
        ends = list(accumulate(map(len, words)))
        ends = [e + i for i, e in enumerate(ends)]
        starts = [0] + [e + 1 for e in ends]
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :])])
    n = len(hashes) // 8
    ones = np.zeros(64, np.int64)
    raw = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 65536):
        ones += np.unpackbits(raw[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of each row of ``docs(doc_id, text)``."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), k) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def near_in_planes(planes: list[tuple[int, int]], every: int, query: int, radius: int, over: int = 0, base: int = 0) -> int:
    """Bit mask of the members within ``radius`` of ``query``, 0 as soon as there can be none. ``planes``: (bit, plane) of the bits in which members
    differ; ``base``: in how many other bits the query differs from all of them; ``over``: members that are not asked for. Distances are held
    as vertical counters that saturate past the radius."""
    if base > radius or over == every:
        return 0
    width = radius.bit_length() + 1
    counters = [every if base >> level & 1 else 0 for level in range(width)]
    top = 1 << (width - 1)
    if counters[-1]:
        return 0
    for bit, plane in planes:
        carry = plane ^ every if query >> bit & 1 else plane
        for level in range(width):
            counters[level], carry = counters[level] ^ carry, counters[level] & carry
            if not carry:
                break
        else:
            over |= carry
        if counters[-1]:
            over |= counters[-1]
        if radius == top - 1:
            if over == every:
                return 0
        elif bit & 3 == 0 and over | _beyond(counters, every, radius, top) == every:
            return 0
    return every & ~(over | _beyond(counters, every, radius, top))


def _beyond(counters: list[int], every: int, radius: int, top: int) -> int:
    """Members whose counter is over ``radius`` though its highest bit is not set."""
    out = 0
    for value in range(radius + 1, top):
        hit = every
        for level, counter in enumerate(counters):
            hit &= counter if value >> level & 1 else ~counter
        out |= hit
    return out


class Block:
    """Fingerprints, unsigned, as bit planes. ``asked`` and ``abandoned`` count queries."""

    asked = abandoned = 0

    def __init__(self, values: list[int]):
        n = len(values)
        self.every = (1 << n) - 1
        self.planes, self.common, self.shared = [], 0, 0
        matrix = np.unpackbits(np.array(values, ">u8").view(np.uint8).reshape(n, 8), axis=1)
        for column in range(64):
            plane = int.from_bytes(np.packbits(matrix[:, column], bitorder="little").tobytes(), "little")
            if plane in (0, self.every):
                self.shared |= 1 << (63 - column)
                self.common |= (1 << (63 - column)) * (plane != 0)
            else:
                self.planes.append((63 - column, plane))

    def near(self, query: int, radius: int, over: int = 0) -> int:
        found = near_in_planes(self.planes, self.every, query, radius, over, ((query ^ self.common) & self.shared).bit_count())
        Block.asked += 1
        Block.abandoned += not found
        return found


def _places(mask: int):
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def forest(members: list[int], radius: int = RADIUS, size: int | None = None) -> list[tuple[int, int]]:
    """Edges (member, smallest member) that join all of ``members`` which links within ``radius``
    connect. Members are distinct signed 64-bit fingerprints."""
    n, size = len(members), size or BLOCK
    values = [m & 0xFFFFFFFFFFFFFFFF for m in members]
    if n == 2:
        return [(max(members), min(members))] if (values[0] ^ values[1]).bit_count() <= radius else []
    blocks = [Block(values[a : a + size]) for a in range(0, n, size)]
    left = [b.every for b in blocks]
    edges = []
    for first in range(n):
        home, bit = divmod(first, size)
        if not left[home] >> bit & 1:
            continue
        left[home] ^= 1 << bit
        group, queue = [first], [first]
        while queue:
            query = values[queue.pop()]
            for k, block in enumerate(blocks):
                if left[k] and (near := block.near(query, radius, block.every & ~left[k])):
                    left[k] &= ~near
                    fresh_ = [k * size + at for at in _places(near)]
                    group += fresh_
                    queue += fresh_
        if len(group) > 1:
            root = min(members[i] for i in group)
            edges += [(members[i], root) for i in group if members[i] != root]
    return edges


def near_pairs(values: list[int], roots: list[int], radius: int, size: int | None = None):
    """Places (later, earlier) of all ``values`` within ``radius`` of each other whose ``roots`` differ."""
    size = size or BLOCK
    blocks = [Block(values[a : a + size]) for a in range(0, len(values), size)]
    same: list[dict[int, int]] = [{} for _ in blocks]
    for i, root in enumerate(roots):
        k, bit = divmod(i, size)
        same[k][root] = same[k].get(root, 0) | 1 << bit
    for i, value in enumerate(values):
        home, bit = divmod(i, size)
        for k in range(home + 1):
            over = same[k].get(roots[i], 0)
            if k == home:
                over |= blocks[k].every & ~((1 << bit) - 1)
            for at in _places(blocks[k].near(value, radius, over)):
                yield i, k * size + at


def _runs(batches, radius: int):
    """Buckets arrive sorted by key; one may go on in the next batch."""
    key, members = None, []
    out = ([], [])

    def close():
        if len(members) > 1:
            for a, b in forest(members, radius):
                out[0].append(a)
                out[1].append(b)

    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if a == b:
                continue
            if keys[a] != key:
                close()
                key, members = keys[a], []
            members.extend(fps[a:b].tolist())
        if len(out[0]) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])
            out = ([], [])
    close()
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints of ``fps(fp)`` whose components are those of
    all links within two bits."""
    part = lambda shift, mask: F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(mask))
    block = [part(16 * i, 0xFFFF) for i in range(4)]
    keys = F.array(*[F.lit(t << 32) + F.shiftleft(block[i], 16) + block[j] for t, (i, j) in enumerate(PAIRS)])
    rows = fps.select(F.explode(keys).alias("key"), "fp")
    shared = rows.groupBy("key").count().where("count > 1")
    met = rows.join(shared, "key")
    # the bytes of the two blocks that key's table leaves open
    split = None
    for t, (i, j) in enumerate(PAIRS):
        open_ = [part(8 * b, 0xFF) for x in range(4) if x not in (i, j) for b in (2 * x, 2 * x + 1)]
        subs = F.array(*[F.lit(1 << 62) + F.shiftleft(F.col("key"), 20) + F.lit(s << 16) + F.shiftleft(open_[a], 8) + open_[b] for s, (a, b) in enumerate(PAIRS)])
        split = F.when(F.shiftrightunsigned("key", 32) == t, subs) if split is None else split.when(F.shiftrightunsigned("key", 32) == t, subs)
    dealt = met.select(F.explode(F.when(F.col("count") <= bucket, F.array("key")).otherwise(split)).alias("key"), "fp")
    return dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lambda it: _runs(it, RADIUS), "a long, b long")


def cluster(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, root, component_id)`` of each row of ``docs(doc_id, text)``; ``root`` is the smallest fingerprint of the component."""
    fps = saved(fingerprints(docs))
    distinct = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    return _handed_out(fps, distinct, saved(links(distinct.select("fp"))))


def _handed_out(fps: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """Each row of ``fps(doc_id, fp)`` with its component under ``edges`` of fingerprints."""
    joined = components(edges)
    member = joined.withColumnRenamed("node", "fp").join(distinct, "fp")
    least = member.groupBy("root").agg(F.min("least").alias("component"))
    moved = saved(member.join(least, "root").select("fp", "root", "component"))
    forget(edges)
    own = distinct.join(moved, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component_id"))
    # groups of copies of more than COPIES rows are dealt to several tasks; there are fewer than rows / COPIES of them
    hot = distinct.where(F.col("n") > COPIES).select("fp", F.ceil(F.col("n") / COPIES).alias("shares"))
    share = F.pmod(F.xxhash64("doc_id"), F.coalesce("shares", F.lit(1)))
    dealt = fps.join(F.broadcast(hot), "fp", "left").select("doc_id", "fp", share.alias("share"))
    shares = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / COPIES) - 1)
    return dealt.join(own.withColumn("share", F.explode(shares)), ["fp", "share"]).select("doc_id", "fp", "root", "component_id")


# ---- five words and a similarity of 0.8, for the pipeline ------------------------------------------------------------------


def _word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64)


def text_key(text: str | None) -> int:
    """A hash of the sequence of words; 0 for a text without words."""
    hashes = _word_hashes(text)
    return int.from_bytes(xxhash.xxh64_digest(hashes.tobytes(), 42), "big", signed=True) if len(hashes) else 0


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes of the shingles, sorted; a text of fewer words is one shingle."""
    n = max(1, len(hashes) - k + 1) if len(hashes) else 0
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(hashes))):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _sim(grams: np.ndarray) -> int:
    """The SimHash of a set of shingles, signed."""
    ones, raw = np.zeros(64, np.int64), grams.byteswap().view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 65536):
        ones += np.unpackbits(raw[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(raw)).tobytes(), "big", signed=True)


_DRAWN = np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)


def _bands(grams: np.ndarray) -> list[int]:
    """A key for each band of ``ROWS`` minhashes; none for a text without words."""
    if not len(grams):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        np.minimum(least, (grams[at : at + 2048, None] * (_DRAWN[0] * 2 + 1) + _DRAWN[1]).min(axis=0), out=least)
    raw = least.tobytes()
    return [int.from_bytes(xxhash.xxh64_digest(raw[8 * ROWS * b : 8 * ROWS * (b + 1)], b), "big", signed=True) for b in range(BANDS)]


def jaccard_reaches(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sets, as sorted arrays, have a Jaccard similarity of ``least`` at least."""
    if min(len(x), len(y)) < least * max(len(x), len(y)) - 1e-9:
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared >= least * (len(x) + len(y) - shared) - 1e-9


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``pairs(a, b)`` whose sets of shingles have a Jaccard similarity of ``least`` at least."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                keep.append(jaccard_reaches(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("fp").alias(c), F.col("grams").alias(f"{c}_grams")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_grams", "b_grams")
    return arrow_map(both, run, "a long, b long")


def _open_links(open_: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links ``(a, b)`` between texts of one band in unlike components, of ``open_(band, n, fp, sim, root)``: pairs within ``WIDE`` bits are compared where they meet, unless links
    found before join them, so that only links leave a task, and no more than join its components. A band of more than ``CHUNK`` texts is dealt in chunks by hash, each pair of
    chunks to a task, so that a task holds two chunks at most."""
    chunks = F.ceil(F.col("n") / CHUNK)
    own = F.pmod(F.xxhash64("fp"), chunks)
    with_other = F.sequence(F.lit(0).cast("long"), chunks - 1)
    dealt = open_.withColumn("own", own).withColumn("other", F.explode(with_other)).join(sets, "fp")
    dealt = dealt.select("band", F.least("own", "other").alias("c"), F.greatest("own", "other").alias("d"), "fp", "sim", "root", "grams")

    def run(batches):
        key, held = None, []

        def close():
            if len(held) < 2:
                return
            held.sort(key=lambda r: r[1])
            parent = {r[2]: r[2] for r in held}

            def find(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            found = []
            for i, j in near_pairs([r[1] & 0xFFFFFFFFFFFFFFFF for r in held], [r[2] for r in held], WIDE):
                one, two = find(held[i][2]), find(held[j][2])
                if one != two and jaccard_reaches(held[i][3], held[j][3], least):
                    parent[max(one, two)] = min(one, two)
                    found.append((held[i][0], held[j][0]))
            yield pa.RecordBatch.from_arrays([pa.array([max(p) for p in found], pa.int64()), pa.array([min(p) for p in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for band, c, d, fp, sim, root, grams in zip(*(x.to_pylist() for x in batch.columns)):
                if (band, c, d) != key:
                    yield from close()
                    key, held = (band, c, d), []
                held.append((fp, sim, root, np.frombuffer(grams, np.uint64)))
        yield from close()

    return arrow_map(dealt.repartition("band", "c", "d").sortWithinPartitions("band", "c", "d"), run, "a long, b long").distinct()


def cluster_alike(docs: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """``(doc_id, fp, root, component_id)`` of components of texts whose sets of ``k``-word shingles have a Jaccard similarity of ``least``
    at least, verified exactly; ``fp`` is a hash of the whole text.

    At 0.8 two SimHashes of 64 bits differ in 9.7 bits on average (standard deviation 2.9), and a table of blocks that guarantees the 23 bits which leave out one pair in
    100,000 would bring all texts together. So the buckets are ``BANDS`` bands of ``ROWS`` minhashes (a pair of similarity 0.8 shares none with odds
    of 3 in a million), and within a band texts are compared by bit-sliced SimHash distance up to ``WIDE`` bits: first each text with the least and the
    greatest of its band, then, in bands that are not one component yet, all that lie in unlike components. Candidates are verified."""

    def described(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):  # one text at a time, as hashes take several times its memory
                hashes = _word_hashes(text.as_py())
                grams = _grams(hashes, k)
                key = int.from_bytes(xxhash.xxh64_digest(hashes.tobytes(), 42), "big", signed=True) if len(hashes) else 0
                rows.append((key, _sim(grams) if len(grams) else 0, _bands(grams)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()))))], ["doc_id", "fp", "sim", "bands"])

    def shingled(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                hashes = _word_hashes(batch.column(0)[at].as_py())
                key = int.from_bytes(xxhash.xxh64_digest(hashes.tobytes(), 42), "big", signed=True) if len(hashes) else 0
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([_grams(hashes, k).tobytes()], pa.binary())], ["fp", "grams"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = saved(arrow_map(docs, described, "doc_id long, fp long, sim long, bands array<long>"))
    fps = rows.select("doc_id", "fp")
    distinct = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    keyed = rows.select("fp", "sim", F.explode("bands").alias("band")).distinct()
    ends = keyed.groupBy("band").agg(F.min(F.struct("fp", "sim")).alias("lo"), F.max(F.struct("fp", "sim")).alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = saved(keyed.join(ends, "band").select("band", "fp", "sim", "lo", "hi", "n"))
    # of each text that meets another, the words once: read again by the id of one of its rows
    wanted = saved(distinct.join(met.select("fp").distinct(), "fp", "left_semi").select("fp", "least"))
    ids = wanted.select(F.col("least").alias("id")).distinct()
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi").select("text")
    sets = saved(arrow_map(texts, shingled, "fp long, grams binary").join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]))
    within = lambda c: F.bit_count(F.col("sim").bitwiseXOR(F.col(f"{c}.sim"))) <= WIDE
    first = None
    for c in ("lo", "hi"):
        one = met.where((F.col("fp") != F.col(f"{c}.fp")) & within(c)).select(F.greatest("fp", f"{c}.fp").alias("a"), F.least("fp", f"{c}.fp").alias("b"))
        first = one if first is None else first.unionByName(one)
    linked = saved(_alike(first.distinct(), sets, least))
    roots = components(linked).withColumnRenamed("node", "fp")
    placed = saved(met.join(roots, "fp", "left").select("band", "n", "fp", "sim", F.coalesce("root", "fp").alias("root")))
    # bands whose texts are all in one component are done
    open_ = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    second = saved(_open_links(placed.join(open_, "band", "left_semi"), sets, least))
    return _handed_out(fps, distinct, saved(linked.unionByName(second)))


cluster.key, cluster_alike.key = fingerprint, text_key


def drop_copies(docs: DataFrame, cluster=cluster) -> DataFrame:
    """Keep one row of each component; columns stay as they are. It is a row of the component's smallest id (null only where all are); if several
    rows have that id, the least of them as JSON. Rows of unlike components all stay, whatever their ids."""
    found = saved(cluster(docs.select("doc_id", "text")))
    own = fresh(docs, "id")
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("component_id").alias("component"))
    plain = F.col("doc_id").isNotNull() & (F.col("rows") == 1)
    copies = ids.where(plain & (F.col("doc_id") != F.col("component"))).select(F.col("doc_id").alias(own))
    odd = saved(ids.where(~plain).select(F.col("doc_id").alias(own)))
    if not odd.limit(1).count():
        return docs.join(copies, F.col("doc_id") == F.col(own), "left_anti")
    clean = docs.where(F.col("doc_id").isNotNull()).join(copies.unionByName(odd), F.col("doc_id") == F.col(own), "left_anti")
    # rows without an id of their own are told apart by their text
    at, name, key = docs.columns.index("text"), fresh(docs, "fp"), cluster.key

    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([key(t.as_py()) for t in batch.column(at)], pa.int64())], [*batch.schema.names, name])

    rest = docs.join(odd, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
    rest = arrow_map(rest, keyed, rest.select("*", F.lit(0).cast("long").alias(name)).schema)
    roots = found.select(F.col("fp").alias("f"), "root", "component_id").distinct()
    whole = F.struct(*[rest[c] for c in docs.columns])
    met = rest.join(roots, rest[name] == roots["f"]).where(rest["doc_id"].eqNullSafe(roots["component_id"])).select(roots["root"].alias("r"), whole.alias("row"))
    one = met.groupBy("r").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return clean.unionByName(one)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
