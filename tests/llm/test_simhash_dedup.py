import random

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import no_documents, odd_documents
from tilewright.llm import simhash_dedup as m


def brute_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(pairs, radius=2):
    """doc id -> smallest id reachable, for (id, fingerprint) rows."""
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted({f for _, f in pairs})
    for f in fps:
        parent[f] = f
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for d, f in pairs:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted((d if d is not None else -1, least.get(find(f), -1)) for d, f in pairs)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = m.op8_simhash_dedup(spark, sf).collect()
    want = {d.doc_id: brute_fingerprint(d.text) for d in docs}
    assert {r.doc_id: r.fingerprint for r in found} == {k: f"{v:016x}" for k, v in want.items()}
    assert sorted((r.doc_id, r.component_id) for r in found) == brute_components(list(want.items()))


def near_fingerprints(seed, n=400):
    """Fingerprints of which many are a few bits from another, in chains."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(5)]
    while len(out) < n:
        f = rng.choice(out)
        for _ in range(rng.choice([1, 2, 2, 3, 40])):
            f ^= 1 << rng.randrange(64)
        out.append(f)
    return out


@pytest.mark.parametrize("bucket", [1, 3, 16384])
def test_links_equal_brute_force(spark, bucket):
    fps = sorted(set(near_fingerprints(bucket)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = m.links(spark.createDataFrame([(s,) for s in signed], "fp long"), bucket).collect()
    parent = {s: s for s in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[max(find(e.a), find(e.b))] = min(find(e.a), find(e.b))
    mine = sorted({tuple(sorted(s for s in signed if find(s) == r)) for r in {find(s) for s in signed}})
    parent2 = {s: s for s in signed}

    def find2(x):
        while parent2[x] != x:
            x = parent2[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                parent2[max(find2(a), find2(b))] = min(find2(a), find2(b))
    assert mine == sorted({tuple(sorted(s for s in signed if find2(s) == r)) for r in {find2(s) for s in signed}})


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_distances(radius):
    rng = random.Random(radius)
    members = list({rng.getrandbits(8) << 3 for _ in range(70)})
    every = (1 << len(members)) - 1
    planes = [(b, sum((v >> b & 1) << i for i, v in enumerate(members))) for b in range(64)]
    for q in members:
        near = m.near_in_planes(planes, every, q, radius)
        assert near == sum(1 << i for i, v in enumerate(members) if (v ^ q).bit_count() <= radius)


def test_long_text_in_pieces():
    text = " ".join(f"w{i}" for i in range(70_000))
    words = text.split()
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)], np.uint64)
    bits = [(hashes >> np.uint64(b) & np.uint64(1)).sum() * 2 > len(hashes) for b in range(64)]
    assert m.fingerprint(text) & (1 << 64) - 1 == sum(1 << b for b in range(64) if bits[b])


@pytest.mark.parametrize("copies", [1, 2, 1_000_000])
def test_odd_rows(spark, monkeypatch, copies):
    monkeypatch.setattr(m, "COPIES", copies)
    docs = odd_documents(spark)
    found = m.cluster(docs).collect()
    want = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1) for r in found) == brute_components(want)
    assert {r.component_id for r in found if r.doc_id in (2, 3, 8)} == {2}
    assert m.cluster(no_documents(spark)).count() == 0


def test_one_of_each_component_stays(spark):
    docs = odd_documents(spark)
    kept = m.drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    # of rows with an id that repeats, unlike texts are no copies
    assert sorted((d or -1, (t or "")[:3]) for d, t in texts) == [(-1, "no "), (1, "The"), (1, "sam"), (2, ""), (4, "Lor"), (5, "123"), (6, "Ünï"), (7, "wor")]
    clean = docs.where("doc_id in (4, 5, 7)")
    assert m.drop_copies(clean).count() == 3
    assert m.drop_copies(no_documents(spark)).count() == 0


@pytest.mark.parametrize("cluster", [m.cluster, m.cluster_alike])
def test_distinct_texts_of_null_and_repeated_ids_stay(spark, cluster):
    words = [" ".join(f"{w}{i}" for i in range(30)) for w in "abcdefg"]
    rows = [(None, words[0]), (None, words[1]), (5, words[2]), (5, words[3]), (7, words[4])]
    rows += [(None, words[0]), (5, words[2]), (9, words[2]), (None, words[4]), (3, words[5]), (3, words[5]), (None, words[6]), (None, words[6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "map('a', doc_id) AS fp", "1 AS id", "doc_id AS root")
    kept = [(r.doc_id, r.text) for r in m.drop_copies(docs, cluster).collect()]
    assert sorted(kept, key=str) == sorted([(None, words[0]), (None, words[1]), (5, words[2]), (5, words[3]), (7, words[4]), (3, words[5]), (None, words[6])], key=str)
    assert m.drop_copies(docs, cluster).columns == docs.columns


def test_blocks_are_abandoned():
    """Among unlike fingerprints nearly every block is left before its last plane."""
    rng = random.Random(2)
    members = [v - (1 << 64) if v >> 63 else v for v in {rng.getrandbits(64) for _ in range(2000)}]
    m.Block.asked = m.Block.abandoned = 0
    assert m.forest(members, size=512) == []
    assert m.Block.asked > 2000 and m.Block.abandoned == m.Block.asked
    planes_seen = 0

    class Counted(list):
        def __iter__(self):
            nonlocal planes_seen
            for x in super().__iter__():
                planes_seen += 1
                yield x

    block = m.Block([v & (1 << 64) - 1 for v in members[:512]])
    block.planes = Counted(block.planes)
    assert block.near(rng.getrandbits(64), 2) == 0 and planes_seen < 40


@pytest.mark.parametrize("size", [3, 64, 1024])
def test_blocks_do_not_change_the_forest(size):
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in near_fingerprints(size)})
    parts = lambda edges: sorted(edges)
    assert parts(m.forest(fps, size=size)) == parts(m.forest(fps, size=10**6))


@pytest.mark.parametrize("radius", [2, 9, 23])
def test_near_pairs_equal_brute_force(radius):
    rng = random.Random(radius)
    values = sorted(set(near_fingerprints(radius, 150)))
    roots = [rng.randrange(30) for _ in values]
    want = {(i, j) for i in range(len(values)) for j in range(i) if roots[i] != roots[j] and (values[i] ^ values[j]).bit_count() <= radius}
    assert set(m.near_pairs(values, roots, radius, size=16)) == want


@pytest.mark.parametrize("chunk", [2, 10_000])
def test_chunks_of_a_band_do_not_matter(spark, monkeypatch, chunk):
    monkeypatch.setattr(m, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(rng.randrange(2), 0, i, v, rng.randrange(20)) for i, v in enumerate(v - (1 << 64) if v >> 63 else v for v in sorted(set(near_fingerprints(5, 80))))]
    sizes = {b: sum(r[0] == b for r in rows) for b in (0, 1)}
    df = spark.createDataFrame([(b, sizes[b], f, s, r) for b, _, f, s, r in rows], "band long, n long, fp long, sim long, root long")
    sets = spark.createDataFrame([(f, bytearray(np.array([1], np.uint64).tobytes())) for f in {r[2] for r in rows}], "fp long, grams binary")

    def parts(pairs):
        """Components of the roots under pairs of texts."""
        root = {r[2]: r[4] for r in rows}
        parent = {r: r for r in root.values()}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[max(find(root[a]), find(root[b]))] = min(find(root[a]), find(root[b]))
        return {r: find(r) for r in parent}

    want = [(p[2], q[2]) for p in rows for q in rows if p[0] == q[0] and p[2] > q[2] and p[4] != q[4] and ((p[3] ^ q[3]) & (1 << 64) - 1).bit_count() <= m.WIDE]
    found = [(r.a, r.b) for r in m._open_links(df, sets, 0.8).collect()]
    assert set(found) <= set(want) and parts(found) == parts(want)


def test_large_group_of_near_copies(spark):
    """A hub of thousands of fingerprints gives a forest, not all pairs."""
    base = random.Random(1).getrandbits(63)
    fps = {base ^ (1 << a) ^ (1 << b) for a in range(63) for b in range(a)} | {base}
    edges = m.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 200)
    assert edges.count() < 40 * len(fps)
    from tilewright.operators.graph import components

    assert components(edges).select("root").distinct().count() == 1


def test_edited_copies_equal_brute_force(spark, sf):
    """Components of five-word Jaccard of 0.8, over the table, edited copies in chains, and a large group of near copies."""
    import corpus_pipeline

    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(300))
    for i in range(150):
        words = (base if i < 75 else rng.choice(rows)[1] or "").split()
        for _ in range(rng.choice([1, 1, 2, 3, 6])):
            if words:
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((10**6 + i, " ".join(words)))
    rows += [(None, "no id"), (2 * 10**6, None), (2 * 10**6 + 1, ""), (2 * 10**6 + 2, "no  ID")]
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) - 1e-9 and (n := len(a & b)) >= 0.8 * (len(a) + len(b) - n) - 1e-9:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in m.cluster_alike(docs).collect()}
    assert found == {(d, least.get(find(i))) for i, (d, _) in enumerate(rows)}
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
    assert kept == set(least.values()) and len(kept) < len({r.fp for r in m.fingerprints(docs).collect()})
