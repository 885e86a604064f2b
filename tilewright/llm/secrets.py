"""Secret scan: fixed patterns, and password guess cost in credential contexts.

Base spans come from three patterns (``assign``, ``access``, ``hex``). The method adds spans of kind ``guess``:
a value in a credential context (a key word, then ``:``, ``=``, ``=>`` or ``is``) is a secret if guessing it is
dear enough. Its cost is the least sum, in bits, over all ways to cut it into dictionary words (rank, capitals, digits for letters),
dates, repeats (of a character or a block of up to ``PERIODS``, which copy what stands before them), keyboard walks and brute-force spans (over the kinds of characters that the
value uses); each segment costs one bit more. Repeats and walks may start and end anywhere: their cost is that of the longest run around them plus a share
for each character, so the best start is a running minimum, and the dynamic programming passes over the value once.

The dictionary is a short list of common passwords, then the ``TOP`` words of the corpus itself that most documents have (words in credential contexts are not counted,
so that a secret that is copied often does not become one). The threshold is that which tells apart, with the fewest errors, labelled values: random
ones, and ones made of dictionary words, dates, walks and repeats.

Base spans always stay; a value that lies within a base span gives no span of its own. Positions are
code points, ends exclusive.

Defined cases: null and empty texts have no spans; texts and values of any length are read as a whole; repeated
rows give repeated rows; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import random
import re
import uuid
from bisect import bisect_right
from collections import Counter
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import arrow_map, table

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credential|bearer|(?:api|access|auth|private|secret)[_\- ]?key)s?["']?\x20{0,3}(=>|[:=]{1,2}|is\b)\x20{0,3}["']?([^\s"'<>,;]+)""",
    re.A | re.I,
)
#: Words, one of which any match of ASSIGN or CONTEXT holds, in lower case.
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer")
#: Bits from which a value counts as a secret by the short list alone, and code points that it has at least.
BITS = 36.0
SHORTEST = 8
#: Words of the corpus in the dictionary, documents that a word has at least, its letters, and words that a worker counts before it hands them on.
TOP, DOCUMENTS, HELD = 20_000, 5, 200_000
WORD = re.compile(r"[a-z]{3,20}")
PERIODS = 16

# Common password words, by falling frequency.
COMMON = """password qwerty dragon monkey letmein master login welcome princess sunshine shadow football baseball superman
batman trustno hello freedom whatever admin administrator root user guest test default changeme secret token key access
pass passwd iloveyou starwars michael jennifer jordan hunter ranger charlie thomas robert daniel andrew joshua summer winter
spring autumn monday friday january december love money computer internet server system service public private sample example
placeholder value string none null true false your here this that the and with from enter insert redacted hidden xxxx todo
demo temp data base code name mail account bank home work school company office team project""".split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
LEET = str.maketrans("013457@$!", "oieastasi")
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SPOT = {c: (x + 0.5 * y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d", re.A)


def _beside(a: str, b: str) -> bool:
    if a not in SPOT or b not in SPOT or a == b:
        return False
    (x, y), (u, v) = SPOT[a], SPOT[b]
    return abs(x - u) <= 1 and abs(y - v) <= 1


def _brute(c: str) -> float:
    if c.isdigit():
        return log2(10)
    if c.isascii() and c.isalpha():
        return log2(26)
    return log2(33) if c.isascii() else log2(1000)


def _capitals(word: str) -> float:
    upper = sum(c.isupper() for c in word)
    return 0.0 if not upper else 1.0 if word[0].isupper() and upper == 1 or upper == len(word) else float(len(word))


def alphabet_bits(value: str) -> float:
    """Bits of a letter or digit of ``value`` when it is guessed over all the kinds (small, capital, digit) that the value uses:
    which kind stands where has to be guessed too."""
    plain = [c for c in value if c.isascii()]
    size = 26 * any(c.islower() for c in plain) + 26 * any(c.isupper() for c in plain) + 10 * any(c.isdigit() for c in plain)
    return log2(size) if size else 0.0


def _folded(value: str) -> str:
    """Lower case by code point: one that has none of a single code point stays, so that places do not move."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in value)


def _runs(same: list[bool]) -> list[tuple[int, int]]:
    """For each place the bounds of the run of true around it, (0, 0) outside."""
    out, at, n = [(0, 0)] * len(same), 0, len(same)
    while at < n:
        if not same[at]:
            at += 1
            continue
        end = at
        while end < n and same[end]:
            end += 1
        out[at:end] = [(at, end)] * (end - at)
        at = end
    return out


class Guesser:
    """Costs of values by a dictionary, ``words`` by falling frequency after the common ones."""

    def __init__(self, words=(), bits: float = BITS):
        self.rank = dict(RANK)
        for w in words:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest, self.bits = max(map(len, self.rank)), bits
        self.known: dict[tuple[str, float], float] = {}

    def word_bits(self, low: str, leet: str, own: str) -> float | None:
        at = self.rank.get(low)
        if at is not None:
            return log2(at) + 1 + _capitals(own)
        at = self.rank.get(leet)
        return None if at is None else log2(at) + 3 + _capitals(own)

    def cost(self, value: str, least: float = 0.0) -> float:
        """Bits of the cheapest way to guess ``value``; 0 for the empty value. Brute force costs ``least`` bits at least for a
        letter or digit. Time grows in proportion to the length."""
        if (value, least) not in self.known:
            if len(self.known) >= 50_000:
                self.known.clear()
            self.known[value, least] = self._cost(value, least)
        return self.known[value, least]

    def _cost(self, value: str, least: float) -> float:
        n, inf = len(value), float("inf")
        if not n:
            return 0.0
        low = _folded(value)
        plain = low.translate(LEET)
        single = [max(_brute(c), least) if c.isascii() and c.isalnum() else _brute(c) for c in value]
        best = [0.0] + [inf] * n  # cost of value[:i] whose last segment is closed
        brute = inf  # cost of value[:i] that ends within a brute-force span
        # places that begin a step of a walk; places that equal the one a period before
        walks = _runs([_beside(a, b) for a, b in zip(low, low[1:])])
        periods = []
        for p in range(1, min(PERIODS, n // 2) + 1):
            same = [False] * p + [value[i] == value[i - p] for i in range(p, n)]
            if any(same):
                periods.append((p, _runs(same)))
        copied = [inf] * (PERIODS + 1)  # by period, cheapest opening of a copy in the run at hand
        walk_best = inf  # cheapest opening of a walk, less its share for each character
        for i in range(n):
            here = best[i] + 1
            brute = min(here, brute) + single[i]
            end = i + 1
            cheapest = min(best[end], brute)
            for p, runs in periods:
                start, stop = runs[i]
                if stop:
                    if i == start:
                        copied[p] = inf
                    copied[p] = min(copied[p], here + log2(PERIODS) + log2(stop - start + 1))
                    cheapest = min(cheapest, copied[p])
            # a walk of the characters k to i (three at least) needs the steps k to i - 1
            if i and walks[i - 1][1]:
                start, stop = walks[i - 1]
                if i - 1 == start:
                    walk_best = inf
                if i - 2 >= start:
                    walk_best = min(walk_best, best[i - 2] + 1 - 0.5 * (i - 2))
                    cheapest = min(cheapest, walk_best + log2(47) + log2(stop - start + 1) + 0.5 * end)
            best[end] = cheapest
            for stop in range(i + 3, min(n, i + self.longest) + 1):
                bits = self.word_bits(low[i:stop], plain[i:stop], value[i:stop])
                if bits is not None and here + bits < best[stop]:
                    best[stop] = here + bits
            found = DATE.match(value, i)
            if found:
                bits = here + (log2(200) if found.end() - i == 4 else log2(200 * 365))
                best[found.end()] = min(best[found.end()], bits)
        return best[n]


DEFAULT = Guesser()


def guess_bits(value: str, least: float = 0.0) -> float:
    """The cost by the common words alone."""
    return DEFAULT.cost(value, least)


def labelled_values(words, n: int = 600, seed: int = 11) -> list[tuple[str, bool]]:
    """Values with whether they are secrets: random ones of eight to 20 characters, and ones that people and placeholders have."""
    rng, words = random.Random(seed), [w for w in words if w.isascii()] or COMMON
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    secret = ["".join(rng.choice(kind) for _ in range(rng.choice((8, 8, 10, 12, 16, 20)))) for kind in (small + digits, small + small.upper() + digits, small + small.upper() + digits + "+/_-") for _ in range(n // 3)]
    weak = []
    for _ in range(n):
        a, b = (rng.choice(words) for _ in range(2))
        year, run = str(rng.randrange(1960, 2030)), rng.choice(("qwerty", "asdfgh", "zxcvbn", "123456", "aaaaaa", "ababab"))
        weak.append(rng.choice((a + b, a.title() + year, a + run, run + year, f"{a}-{b}", a.upper() + b, a * 2 + year[2:], f"{a}_{rng.randrange(100)}", year + run)))
    return [(v, True) for v in secret] + [(v, False) for v in weak if len(v) >= SHORTEST]


def calibrated(guesser: Guesser) -> float:
    """The bits that part labelled values with the fewest errors, secrets that are missed counted by their share as well as others that are found."""
    values = [(guesser.cost(v, alphabet_bits(v)), secret) for v, secret in labelled_values(sorted(guesser.rank, key=guesser.rank.get))]
    kinds = [sum(s == kind for _, s in values) for kind in (False, True)]
    errors = lambda t: sum(s and c < t for c, s in values) / kinds[1] + sum(not s and c >= t for c, s in values) / kinds[0]
    return min((t / 2 for t in range(40, 101)), key=lambda t: (errors(t), t))


def frequent_words(docs: DataFrame, top: int = TOP) -> list[str]:
    """The ``top`` words that most texts have, over all documents, with ``DOCUMENTS`` texts at least. Counts are summed in workers and by a map-side combined group-by."""

    def run(batches):
        counted: Counter = Counter()

        def made():
            words = list(counted)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counted[w] for w in words], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                low = (text.as_py() or "").lower()
                if any(h in low for h in HINTS):
                    low = CONTEXT.sub(" ", ASSIGN.sub(" ", low))
                counted.update(set(WORD.findall(low)))
                if len(counted) > HELD:
                    yield made()
                    counted.clear()
        yield made()

    parts = arrow_map(docs.select(F.col("text").cast("string")), run, "word string, n long")
    found = parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= DOCUMENTS)
    return [r["word"] for r in found.orderBy(F.desc("n"), "word").limit(top).collect()]


def learned(docs: DataFrame, top: int = TOP) -> tuple[list[str], float]:
    """Dictionary and threshold for ``docs``, of bounded size."""
    words = frequent_words(docs, top)
    return words, calibrated(Guesser(words))


_GUESSERS: dict[str, Guesser] = {}


def _guesser(name: str, model) -> Guesser:
    """That of a model, made once in a worker, which keeps the last."""
    if model is None:
        return DEFAULT
    if name not in _GUESSERS:
        _GUESSERS.clear()
        _GUESSERS[name] = Guesser(*model.value)
    return _GUESSERS[name]


def find_spans(text: str | None, guesser: Guesser = DEFAULT) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted."""
    text = text or ""
    spans = []
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    if hinted:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if hinted:
        spans.sort()
        starts, reach = [s for s, _, _ in spans], []
        for _, _, e in spans:
            reach.append(max(e, reach[-1]) if reach else e)
        added = []
        for m in CONTEXT.finditer(text):
            value = m.group(2).rstrip(".)]}!?:`*")
            a, b = m.start(2), m.start(2) + len(value)
            k = bisect_right(starts, a)
            if m.group(1)[0] in "iI" and value.isalpha():
                continue  # prose: "the token is ..."
            if len(value) >= SHORTEST and not (k and reach[k - 1] >= b) and guesser.cost(value, alphabet_bits(value)) >= guesser.bits:
                added.append((a, 3, b))
        spans += added
    return sorted(spans)


def named(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, model: tuple[list[str], float] | None = None) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess)`` of ``docs(doc_id, text)``. ``model``: see ``learned``."""
    shared, name = model and docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        guesser = _guesser(name, shared)
        for batch in batches:
            found = [find_spans(t.as_py(), guesser) for t in batch.column(1)]
            count = lambda kind, found=found: pa.array([sum(k == kind for _, k, _ in s) for s in found], pa.int64())
            base = [hashlib.sha256(named(x for x in s if x[1] < 3).encode()).hexdigest() for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), count(0), count(1), count(2), pa.array(base, pa.string()), pa.array(map(named, found), pa.string()), count(3)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def masked(text: str | None, mask: str = "[secret]", guesser: Guesser = DEFAULT) -> str | None:
    """The text with every span, overlapping ones as one, replaced."""
    spans = find_spans(text, guesser)
    if not spans:
        return text
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end:
            if end >= 0:
                at = end
            out += [text[at:a], mask]
        end = max(end, b)
    return "".join([*out, text[end:]])


def mask_secrets(docs: DataFrame, model: tuple[list[str], float] | None = None) -> DataFrame:
    """``docs`` with all secrets masked in ``text``, and ``n_chars``, where there is one, counted anew. ``model``: see ``learned``."""
    shared, name = model and docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        guesser = _guesser(name, shared)
        for batch in batches:
            texts = [masked(t.as_py(), guesser=guesser) for t in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            if counted is not None:
                was = batch.column(at).to_pylist()
                columns[counted] = pa.array([n if t == w else len(t) for n, t, w in zip(batch.column(counted).to_pylist(), texts, was)], columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return arrow_map(docs, run, docs.schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, learned(docs))
