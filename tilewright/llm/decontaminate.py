"""Benchmark decontamination: documents that hold a passage like a benchmark item.

An item of m words is compared with every window of m words (the whole text, if shorter):

1. Only windows in which eight ninths of the shingles occur in some item of that size can reach a similarity of
   0.8; a running count over the text finds them without loss (two multisets of n shingles each, of
   which s are shared, have similarity s / (2n - s)).
2. Such a window gets a SimHash of its five-word shingles. The 64 bits are cut into eight bytes;
   fingerprints within ``RADIUS`` differ in at most RADIUS // 8 bits of one of them, so tables from each byte value
   to the items of near bytes give every item within the radius. Windows of fewer than ``FEW`` shingles, whose fingerprints spread wider, take
   all items of that size that share a shingle as well.
3. Candidates are verified: weighted Jaccard similarity of the shingles, at least ``SIMILARITY``.

Words are runs of letters, digits and underscores in lower case. Items of fewer than five words have one shingle,
the whole item. The benchmark is sent to the workers in slices of about ``SLICE`` items and ``SLICE_BYTES`` bytes at most: a larger one takes further
passes over the documents, so that the broadcast has a fixed bound. A text is read as a whole and in one pass,
and no rows are shuffled but the few findings.

Defined cases: null, empty and wordless texts or items match nothing; repeated documents each give
rows; of repeated items each counts under its own id; an item that occurs in several places gives one row, with the best window
(the first of equals); empty tables give no rows; other columns are left alone.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import arrow_map, table

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
#: Shingles from which fingerprints alone are trusted: at similarity 0.8 the odds of more than RADIUS bits are then under 1 in 10,000.
FEW = 16
#: Items, and bytes of their texts, that are sent to the workers at once, about.
SLICE, SLICE_BYTES = 20_000, 32 << 20
WORDS = re.compile(r"\w+")
#: Byte values that differ from 0 in at most RADIUS // 8 bits.
NEAR = [v for v in range(256) if v.bit_count() <= RADIUS // 8]


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def shingles(words: list[str], k: int) -> list[str]:
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def simhash(grams: list[str]) -> int:
    raw = np.frombuffer(b"".join([xxhash.xxh64_digest(g.encode("utf-8", "surrogatepass"), 42) for g in grams]), np.uint8).reshape(-1, 8)
    return int.from_bytes(np.packbits(np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64) * 2 > len(grams)).tobytes(), "big")


def similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


class Index:
    """One slice of the benchmark as the workers see it."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float = SIMILARITY):
        self.threshold = threshold
        self.items, self.by_size, self.vocabulary, grams = [], {}, {}, {}
        self.short: dict[int, dict[int, list[int]]] = {}  # by size, the items of each shingle hash, of items of few shingles
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            k = min(SHINGLE, len(words))
            own = shingles(words, k)
            at = len(self.items)
            self.items.append((item_id, Counter(own), simhash(own)))
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
            ids = np.array([self.vocabulary[w] for w in words], np.uint64)
            for h in self.rolled(ids, k).tolist():
                grams.setdefault(k, {}).setdefault(h, set()).add(len(words))
                if len(own) * self.threshold < FEW:
                    self.short.setdefault(len(words), {}).setdefault(h, []).append(at)
            self.by_size.setdefault(len(words), []).append(at)
        # shingle hashes, sorted, and the sizes of the items that each occurs in
        self.grams = {k: (np.array(sorted(v), np.uint64), [sorted(v[h]) for h in sorted(v)]) for k, v in grams.items()}
        self.tables = {}
        for size, members in self.by_size.items():
            tables = [{} for _ in range(8)]
            for at in members:
                for b in range(8):
                    byte = self.items[at][2] >> (8 * b) & 255
                    for change in NEAR:
                        tables[b].setdefault(byte ^ change, []).append(at)
            self.tables[size] = tables

    @staticmethod
    def rolled(ids: np.ndarray, k: int) -> np.ndarray:
        """A 64-bit hash of each k consecutive word numbers."""
        out = np.zeros(max(0, len(ids) - k + 1), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                out = (out ^ ids[i : len(ids) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        return out

    def candidates(self, fp: int, size: int) -> list[int]:
        found = set()
        for b, near in enumerate(self.tables[size]):
            found.update(near.get(fp >> (8 * b) & 255, ()))
        return [at for at in sorted(found) if (self.items[at][2] ^ fp).bit_count() <= RADIUS]

    def scan(self, text: str | None) -> dict[int, tuple[float, int, int]]:
        """Best (similarity, first word, words) of each item found, by its place in ``items``."""
        words = words_of(text)
        n = len(words)
        if not n:
            return {}
        known = self.vocabulary.get
        ids = np.fromiter(map(known, words, repeat(0)), np.uint64, n)
        hits: dict[int, list[int]] = {}  # by item size, the places of shingles of such items
        marks: dict[int, np.ndarray] = {}  # by shingle size, all hashes
        for k, (grams, sizes) in self.grams.items():
            if n < k:
                continue
            inside = ids != 0
            whole = inside[: n - k + 1].copy()
            for i in range(1, k):
                whole &= inside[i : n - k + 1 + i]
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            marks[k] = self.rolled(ids, k)
            hashed = marks[k][at]
            place = np.minimum(np.searchsorted(grams, hashed), len(grams) - 1)
            same = grams[place] == hashed
            for spot, gram in zip(at[same].tolist(), place[same].tolist()):
                for size in sizes[gram]:
                    hits.setdefault(size, []).append(spot)
        best: dict[int, tuple[float, int, int]] = {}
        for size, spots in hits.items():
            k = min(SHINGLE, size)
            span, t = min(size, n) - k + 1, self.threshold
            # s shared of `span` and `size - k + 1` shingles: s / (span + items' - s) >= t
            need = int(np.ceil(t * (span + size - k + 1) / (1 + t) - 1e-9))
            if len(spots) < need:
                continue
            hit = np.zeros(n - k + 2, np.int64)
            hit[np.array(spots) + 1] = 1
            cum = np.cumsum(hit)
            for start in np.flatnonzero(cum[span:] - cum[:-span] >= need).tolist():
                own = shingles(words[start : start + min(size, n)], k)
                counted = None
                found = self.candidates(simhash(own), size)
                if len(own) < FEW and size in self.short:
                    near = self.short[size]
                    found = sorted({*found, *(at for h in marks[k][start : start + len(own)].tolist() for at in near.get(h, ()))})
                for at in found:
                    counted = counted or Counter(own)
                    s = similarity(counted, self.items[at][1])
                    if s >= t and (at not in best or s > best[at][0]):
                        best[at] = (s, start, min(size, n))
        return best


_INDEXES: dict[str, Index] = {}


def index_of(name: str, items) -> Index:
    """The index of a broadcast, built once in a worker, which keeps the last."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = Index(items.value)
    return _INDEXES[name]


def slices(benchmark: DataFrame, slice_items: int) -> list[DataFrame]:
    """``(item_id, text)`` of the benchmark in pieces of bounded size, by a hash."""
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    passes = max(-(-size["n"] // slice_items), -(-size["bytes"] // SLICE_BYTES))
    return [wanted] if passes == 1 else [wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p) for p in range(passes)]


def find(docs: DataFrame, benchmark: DataFrame, slice_items: int = SLICE) -> DataFrame:
    """``(doc_id, item_id, similarity, first_word, n_words)`` of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    found = spark.createDataFrame([], schema)
    for own in slices(benchmark, slice_items):
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in own.collect()])

        def run(batches, shared=shared, name=uuid.uuid4().hex):
            index = index_of(name, shared)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for at, (s, start, size) in sorted(index.scan(text.as_py()).items()):
                        rows.append((doc_id, index.items[at][0], s, start, size))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        found = found.unionByName(arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema))
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, slice_items: int = SLICE) -> DataFrame:
    """``docs`` without those that hold an item; columns stay as they are. One map over the rows:
    nothing is shuffled and ids need not be unique."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    for own in slices(benchmark, slice_items):
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in own.collect()])

        def run(batches, shared=shared, name=uuid.uuid4().hex):
            index = index_of(name, shared)
            for batch in batches:
                yield batch.filter(pa.array([not index.scan(t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = arrow_map(docs, run, docs.schema)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
