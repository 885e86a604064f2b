from collections import Counter

import pytest

from tests.llm.helpers import no_documents, odd_documents
from tilewright.llm import decontaminate as m

ITEM = "when the long winter had passed the old miller walked down to the river and counted every stone that the flood had left behind on his field"


def brute(docs, items, threshold=0.8):
    """Best similarity of any item-sized window, for each pair that reaches the threshold."""
    out = {}
    for d, text in docs:
        words = m.words_of(text)
        for i, item in items:
            own = m.words_of(item)
            if not own or not words:
                continue
            k, size = min(5, len(own)), min(len(own), len(words))
            want = Counter(m.shingles(own, k))
            best = max((m.similarity(Counter(m.shingles(words[s : s + size], k)), want) for s in range(len(words) - size + 1) if size >= k), default=0)
            if best >= threshold:
                out[d, i] = round(best, 9)
    return out


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in m.op2_decontaminate(spark, sf).collect()}
    assert found == brute(docs, items) and found


@pytest.mark.parametrize("slice_items", [1, 2, 100])
def test_edited_passages(spark, slice_items):
    words = ITEM.split()
    changed = " ".join([*words[:-1], "garden"])
    two = " ".join([*words[:13], "XXX", *words[14:]])
    filler = " ".join(f"f{i}" for i in range(300))
    docs = [(1, f"{filler} {ITEM} {filler}"), (2, f"{filler}, {changed.upper()}!"), (3, filler), (4, two), (5, ITEM.replace(" ", "\n")), (6, " ".join(words[:12]) + filler)]
    items = [(10, ITEM), (11, "only four words here"), (12, ITEM), (13, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in m.find(df, benchmark(spark, items), slice_items).collect()}
    assert found == brute(docs, items)
    assert {d for d, _ in found} == {1, 2, 5}
    assert sorted(r.doc_id for r in m.drop_leaks(df, benchmark(spark, items), slice_items).collect()) == [3, 4, 6]


def test_radius_is_guaranteed():
    """Tables give every item within the radius, whatever the bits."""
    import random

    rng = random.Random(3)
    index = m.Index([(i, f"{i} a b c d e f g") for i in range(30)])
    for at, (_, _, fp) in enumerate(index.items):
        near = fp
        for b in rng.sample(range(64), m.RADIUS):
            near ^= 1 << b
        assert at in index.candidates(near, 8)


@pytest.mark.parametrize("size", [5, 6, 8, 9, 12, 16, 20, 30, 60])
def test_no_window_of_similarity_is_missed(size):
    """Items of any size, whole, edited and cut, against brute force: few shingles are compared directly, of more a fingerprint beyond the radius is rare."""
    import random

    rng = random.Random(size)
    items = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(size))) for i in range(60)]
    docs = []
    for i, text in items:
        words = text.split()
        for cut in (0, 1, 2):
            own = words[cut:] if rng.random() < 0.5 else words[: len(words) - cut]
            if rng.random() < 0.5 and len(own) > 1:
                own[rng.choice([0, -1])] = "zz"
            docs.append((len(docs), " ".join(own)))
    index = m.Index(items)
    found = {(d, index.items[at][0]) for d, text in docs for at in index.scan(text)}
    assert found == set(brute(docs, items))


def test_a_worker_builds_an_index_once(monkeypatch):
    built = []
    monkeypatch.setattr(m, "Index", lambda items: built.append(1) or object())
    monkeypatch.setattr(m, "_INDEXES", {})

    class Shared:
        value = []

    assert m.index_of("a", Shared) is m.index_of("a", Shared) and m.index_of("b", Shared) and len(built) == 2 and len(m._INDEXES) == 1


def test_odd_rows(spark):
    docs = odd_documents(spark)
    items = [(1, None), (2, ""), (3, "The quick brown fox jumps over the lazy dog and runs away from it"), (3, "The quick brown fox jumps over the lazy dog and runs away from it"), (None, "word")]
    found = m.find(docs, benchmark(spark, items)).collect()
    assert sorted((r.doc_id, r.item_id or -1) for r in found) == [(1, 3)] * 4 + [(7, -1)]
    kept = m.drop_leaks(docs, benchmark(spark, items))
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert m.find(no_documents(spark), benchmark(spark, items)).count() == 0
    assert m.find(docs, benchmark(spark, [])).count() == 0 and m.drop_leaks(docs, benchmark(spark, [])).count() == docs.count()
