import functools
import hashlib
import random

import pytest

from tests.llm.helpers import no_documents, odd_documents
from tilewright.llm import winnowing as m


def murmur3(four):
    """Murmur3 of four bytes with seed 42, as Spark's ``hash`` has it."""
    rot = lambda v, r: (v << r | v >> 32 - r) & 0xFFFFFFFF
    k = rot(int.from_bytes(four, "little") * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h = (rot(42 ^ k, 13) * 5 + 0xE6546B64 & 0xFFFFFFFF) ^ 4
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def brute(text):
    """hash:position of the rightmost least hash of every window."""
    text = text or ""
    symbol = {c: murmur3(c.encode("utf-32-be")) for c in set(text)}
    code = lambda s: functools.reduce(lambda h, c: (h << 1 ^ symbol[c]) & 0xFFFFFFFF, s, 0) & m.MASK
    if not text:
        return ""
    hashes = [code(text[i : i + m.GRAM]) for i in range(len(text) - m.GRAM + 1)] or [code(text)]
    chosen = set()
    for s in range(max(1, len(hashes) - m.WINDOW + 1)):
        window = hashes[s : s + m.WINDOW]
        chosen.add(s + max(i for i, h in enumerate(window) if h == min(window)))
    return ",".join(f"{hashes[p]:08x}:{p}" for p in sorted(chosen))


def hashes(fingerprint):
    return {x.split(":")[0] for x in fingerprint.split(",") if x}


def likeness(a, b):
    a, b = hashes(a), hashes(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def want(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        f, e, n = brute(text), brute(edited), brute(after)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), f, e, round(likeness(f, e), 9), round(likeness(f, n), 9)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(m.op4_winnowing(spark, sf)) == want(rows)


@pytest.mark.parametrize("bucket", [1, 3, 256])
def test_repeats_ties_and_pieces(spark, monkeypatch, bucket):
    monkeypatch.setattr(m, "BUCKET", bucket)
    rng = random.Random(bucket)
    texts = ["a" * n for n in (0, 1, 11, 12, 13, 74, 75, 76, 400, 900)] + ["ab" * 300, "".join(rng.choice("ab") for _ in range(1500)), "\U0001f600é" * 200, "".join(rng.choice("abcdef ") for _ in range(700)), None]
    rows = [(i * 1000 if i % 2 else i, t) for i, t in enumerate(texts)]
    assert found(m.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"))) == want(rows)


@pytest.mark.parametrize("roll", [2, 7, 64])
def test_pieces_of_the_roll_do_not_matter(spark, monkeypatch, roll):
    monkeypatch.setattr(m, "ROLL", roll)
    rng = random.Random(roll)
    rows = [(i, "".join(rng.choice("abc é\U0001f600") for _ in range(n))) for i, n in enumerate((11, 12, 13, 63, 64, 75, 76, 77, 139, 400))]
    assert found(m.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"))) == want(rows)


def test_shared_passage_is_met(spark):
    """Texts that share GRAM + WINDOW - 1 code points share a fingerprint."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = []
    for i in range(0, 40, 2):
        passage = word(m.GRAM + m.WINDOW - 1)
        rows += [(i, word(rng.randrange(300)) + passage + word(rng.randrange(300))), (i + 1, word(rng.randrange(300)) + passage + word(rng.randrange(300)))]
    by = {r.doc_id: r.fingerprint for r in m.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(hashes(by[i]) & hashes(by[i + 1]) for i in range(0, 40, 2))


def test_passage_of_59_code_points_is_met(spark):
    """The guarantee as a fixed number, so that it cannot change with the window."""
    rng = random.Random(48)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = []
    for i in range(0, 200, 2):
        passage = word(59)
        rows += [(i, word(300) + passage + word(300)), (i + 1, word(300) + passage + word(300))]
    by = {r.doc_id: r.fingerprint for r in m.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(hashes(by[i]) & hashes(by[i + 1]) for i in range(0, 200, 2))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    assert found(m.fingerprint_edits(docs)) == want([(r.doc_id, r.text) for r in docs.collect()])
    assert m.fingerprint_edits(no_documents(spark)).count() == 0
    assert found(m.fingerprint_edits(docs.where("doc_id = 4"))) == want([(4, docs.where("doc_id = 4").first().text)])


def test_stays_in_the_jvm(spark, sf):
    plan = m.op4_winnowing(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_memory_passed_through_for_a_code_point(spark):
    """What the fold allocates fills an executor's heap as fast as it is computed (1,933 bytes a code point when all hashes were packed and folded, 1,540 since; planning included)."""
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcdefghij klmnop") for _ in range(2000))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    work = lambda: docs.agg(m.F.sum(m.F.size(m.choices("text")))).first()
    work()
    java = spark._jvm.java.lang
    threads = java.management.ManagementFactory.getPlatformMXBean(java.Class.forName("com.sun.management.ThreadMXBean"))
    held = lambda: {i: b for i, b in ((i, threads.getThreadAllocatedBytes(i)) for i in threads.getAllThreadIds()) if b > 0}
    before = held()
    work()
    assert sum(b - before.get(i, 0) for i, b in held().items() if i in before) < 1750 * 200_000
