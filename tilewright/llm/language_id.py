"""Language identification by hyperdimensional profiles.

Every letter owns a random bipolar vector, drawn by a generator that its code point seeds, whatever the script. A trigram binds (multiplies) the vectors of its letters,
each permuted (rotated) by its place; a text bundles (adds) its trigrams; a language prototype bundles
its training texts, each scaled to length one. A text takes the language of the prototype of largest cosine.

Blanks, digits, marks and signs are one common separator symbol; trigrams with a separator in the
middle carry nothing and are left out, so a lone letter still gives one trigram.

Training uses about ``PER_LANG`` labelled documents of each language, picked by a hash of the id, of the ``LANGS`` languages with most documents (the
documented bounds); prediction reads only the text. Of equal cosines the language that comes first by code point wins.

Defined cases: null texts and texts without letters give ``und`` with score 0; if nothing can be
learned, every text gives ``und``; texts of any length are read as a whole; repeated rows give repeated
rows; an empty table gives no rows; other columns are not read by ``predict``.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import arrow_map, table

DIMENSIONS = 1024
PER_LANG, LANGS = 1500, 512
UNKNOWN = "und"
#: Trigram vectors, and letter vectors, that a worker keeps; others are made again when needed.
KEPT, LETTERS = 16384, 8192
#: Distinct trigrams from which a text needs a cosine of so many standard deviations of noise (1 / sqrt(dimensions)). A text of fewer
#: trigrams than the last may miss every frequent one of its language. Texts of the tables' languages and random letters of
#: as many trigrams lie on either side.
FLOORS = ((400, 9.0), (64, 5.0), (32, 3.0))
#: Share of a language's letters from which a letter counts as its own.
RARE = 1e-4


def _symbol(point: int) -> int:
    """The code point of a letter's lower case, 0 for all that is no letter."""
    return ord(chr(point).lower()[0]) if chr(point).isalpha() else 0


class Profiles:
    """Text vectors. Built once in each worker."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.symbols = np.array([_symbol(p) for p in range(0x10000)], np.int64)
        self.letters: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.rows = np.empty((KEPT, dimensions), np.float32)

    def letter(self, symbol: int) -> np.ndarray:
        found = self.letters.get(symbol)
        if found is None:
            found = np.random.Generator(np.random.PCG64([20240607, symbol])).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
            if len(self.letters) < LETTERS:
                self.letters[symbol] = found
        return found

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigram codes, three symbols of 21 bits, and how often each occurs."""
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.symbols[np.minimum(points, 0xFFFF)]
        if len(points) and points.max() > 0xFFFF:
            astral = points > 0xFFFF
            s[astral] = [_symbol(int(p)) for p in points[astral]]
        p = np.zeros(len(s) + 2, np.int64)
        p[1:-1] = s
        codes = (p[:-2] << 42) | (p[1:-1] << 21) | p[2:]
        return np.unique(codes[p[1:-1] > 0], return_counts=True)

    def bind(self, code: int) -> np.ndarray:
        """The letters of a trigram, each rotated by its place, multiplied."""
        one, two, three = (self.letter(code >> shift & 0x1FFFFF) for shift in (42, 21, 0))
        return np.roll(one, 2) * np.roll(two, 1) * three

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), self.dimensions), np.float32)
        at = np.array([self.place.get(c, -1) for c in codes.tolist()], np.int64)
        known = at >= 0
        out[known] = self.rows[at[known]]
        for i in np.flatnonzero(~known).tolist():
            out[i] = self.bind(int(codes[i]))
            if len(self.place) < len(self.rows):
                self.rows[len(self.place)] = out[i]
                self.place[int(codes[i])] = len(self.place)
        return out

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text; zero for a text without letters."""
        found = [self.counts(t) for t in texts]
        every = np.unique(np.concatenate([c for c, _ in found])) if found else np.zeros(0, np.int64)
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for a in range(0, len(every), 4096):
            part = every[a : a + 4096]
            dense = np.zeros((len(texts), len(part)), np.float32)
            for i, (codes, n) in enumerate(found):
                lo, hi = np.searchsorted(codes, [part[0], part[-1] + 1])
                dense[i, np.searchsorted(part, codes[lo:hi])] = n[lo:hi]
            out += dense @ self.vectors(part)
        return out


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros(rows.shape), where=length > 0)


_PROFILES: dict[int, Profiles] = {}


def profiles(dimensions: int = DIMENSIONS) -> Profiles:
    if dimensions not in _PROFILES:
        _PROFILES[dimensions] = Profiles(dimensions)
    return _PROFILES[dimensions]


STEP = 64


def _slices(batch):
    for a in range(0, batch.num_rows, STEP):
        yield batch.slice(a, STEP)


def _sampled(labelled: DataFrame, per_lang: int):
    """The labels in use, and the rows of ``labelled`` to learn from; None if there are none."""
    known = labelled.where("lang is not null")
    total = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()}
    if not total:
        return [], None
    every = F.create_map(*[x for lang, n in sorted(total.items()) for x in (F.lit(lang), F.lit(max(1, -(-n // per_lang))))])
    return sorted(total), known.where(F.pmod(F.xxhash64("doc_id"), F.try_element_at(every, F.col("lang"))) == 0)


def train(labelled: DataFrame, per_lang: int = PER_LANG, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes from ``labelled(doc_id, text, lang)``. Sums meet by language and
    dimension in a map-side combined group-by; the driver gets one vector a language."""
    langs, sample = _sampled(labelled, per_lang)
    if not langs:
        return [], np.zeros((0, dimensions))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in _slices(batch):
                rows = _unit(profiles(dimensions).bundle(part.column(0).to_pylist()))
                for lang, row in zip(part.column(1).to_pylist(), rows):
                    sums[lang] = sums[lang] + row if lang in sums else row
        for lang, row in sums.items():
            # in fixed point, so that the sum does not depend on the order of addition
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(np.round(row * 2**32).astype(np.int64))], ["lang", "at", "v"])

    parts = arrow_map(sample.select(F.col("text").cast("string"), F.col("lang").cast("string")), run, "lang string, at int, v long")
    out = np.zeros((len(langs), dimensions))
    for r in parts.groupBy("lang", "at").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("v")).collect():
        out[langs.index(r["lang"])] = [x["v"] for x in r["v"]]
    return langs, _unit(out)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` after its own columns (replacing any of these names)."""
    langs, prototypes = model
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")
    dimensions = prototypes.shape[1]

    def run(batches):
        for batch in batches:
            names, scores = [], []
            for part in _slices(batch):
                rows = profiles(dimensions).bundle(part.column(at).to_pylist())
                cosines = _unit(rows) @ prototypes.T
                for row, cosine in zip(rows, cosines):
                    if not langs or not row.any():
                        names.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        best = int(cosine.argmax())
                        names.append(langs[best])
                        scores.append(float(min(1.0, max(0.0, cosine[best]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return arrow_map(docs, run, schema)


def letters_of(text: str | None) -> Counter:
    return Counter({c: n for c, n in Counter((text or "").lower()).items() if c.isalpha()})


def alphabet(labelled: DataFrame, per_lang: int = PER_LANG) -> frozenset[str]:
    """The letters that make up at least ``RARE`` of some language's training texts."""
    langs, sample = _sampled(labelled, per_lang)
    if not langs:
        return frozenset()

    def run(batches):
        sums: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums.setdefault(lang, Counter()).update(letters_of(text))
        rows = [(lang, c, n) for lang, own in sums.items() for c, n in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "letter", "n"])

    parts = arrow_map(sample.select(F.col("text").cast("string"), F.col("lang").cast("string")), run, "lang string, letter string, n long")
    found = [(r["lang"], r["letter"], r["n"]) for r in parts.groupBy("lang", "letter").agg(F.sum("n").alias("n")).collect()]
    total = Counter()
    for lang, _, n in found:
        total[lang] += n
    return frozenset(c for lang, c, n in found if n >= RARE * total[lang])


def least_score(distinct: int, dimensions: int) -> float:
    """The cosine that a text of so many distinct trigrams must reach: a multiple, by ``FLOORS``, of the noise of a chance cosine."""
    return next((noise for least, noise in FLOORS if distinct >= least), 0.0) / dimensions**0.5


def keep_known(docs: DataFrame, model: tuple[list[str], np.ndarray], letters: frozenset[str]) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language: at least half of its letters are learned, and its profile is like
    a prototype. Texts of too few trigrams to tell are judged by their letters alone. Texts without letters go."""
    langs, prototypes = model
    at = docs.columns.index("text")
    dimensions = prototypes.shape[1]

    def known(texts):
        rows = _unit(profiles(dimensions).bundle(texts))
        best = (rows @ prototypes.T).max(axis=1)
        for text, score in zip(texts, best):
            own = letters_of(text)
            learned = sum(n for c, n in own.items() if c in letters)
            yield learned > 0 and 2 * learned >= own.total() and score >= least_score(len(profiles(dimensions).counts(text)[0]), dimensions) or False

    def run(batches):
        for batch in batches:
            kept = [k for part in _slices(batch) for k in known(part.column(at).to_pylist())] if langs else [False] * batch.num_rows
            yield batch.filter(pa.array(map(bool, kept), pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def held_out():
    """Documents that training may not see."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out()).select("doc_id", "text", "lang")


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    return train(training(docs))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), learn(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score")
