import re

import pytest

from tests.llm.helpers import no_documents, odd_documents
from tilewright.llm import mixing as m


def fill(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    done, free, total = {}, set(order), sum(sizes.values())
    while free:
        left, w = total - sum(done.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            done |= {s: left * weight[s] / w for s in free}
            break
        for s in over:
            done[s] = 3.0 * sizes[s]
            free.discard(s)
    return done


def check(docs, rows):
    """Rows of a mix of ``docs`` (id, text, source)."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in docs]
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in rows) == sorted((d is None, d or 0, n) for (d, _, _), n in zip(docs, sizes))
    by = {}
    for (_, _, s), n in zip(docs, sizes):
        by[s] = by.get(s, 0) + n
    want = fill(by)
    assert sum(r.taken for r in rows) == pytest.approx(sum(want.values()), abs=len(by))
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    for r in rows:
        assert r.target in [pytest.approx(want[s], abs=1e-6) for s in by if by[s] == r.source_size]


def test_query(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = m.op7_mixing(spark, sf).collect()
    check(docs, rows)
    assert sorted(rows) == sorted(m.op7_mixing(spark, sf).collect())
    source = {d: s for d, _, s in docs}
    taken, target = {}, {}
    for r in rows:
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


@pytest.mark.parametrize("sizes", [[1, 100, 100], [500, 1, 1], [1, 1, 500], [7], [0, 5, 0, 9], [3, 3, 3, 3, 3, 3, 900]])
def test_targets(spark, sizes):
    names = [*("abcdefg"[: len(sizes) - 1]), None]
    df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    want = fill(dict(zip(names, sizes)))
    for r in m.targets(df).collect():
        assert r.target == pytest.approx(want[r.source])


@pytest.mark.parametrize("bucket", [1, 5, 10_000])
def test_buckets_do_not_matter(spark, monkeypatch, bucket):
    rows = [(i, "w " * (i % 17), "s" if i % 3 else "t", None, None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    monkeypatch.setattr(m, "BUCKET", bucket)
    found = sorted((r.doc_id, r.taken) for r in m.mix(docs).collect())
    monkeypatch.setattr(m, "BUCKET", 77)
    assert found == sorted((r.doc_id, r.taken) for r in m.mix(docs).collect())


def test_epochs_before_fractions(spark):
    docs = spark.createDataFrame([(i, "w w w", s) for i in range(40) for s in "abc"], "doc_id long, text string, source string")
    by = {}
    for r in m.mix(docs).collect():
        by.setdefault(r.source, []).append(r.taken)
    assert all(max(v) - min(v) <= 3 for v in by.values())
    assert min(by["a"]) >= 3 and sum(by["c"]) == 45


def test_quality_draws_more(spark):
    docs = spark.createDataFrame([(i, "w", "abc"[i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, (i // 3) % 2, 0) for i in range(3000)] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [r for r in m.mix(docs, m.quality_weights(labels)).collect() if r.source == "c"]
    good, bad = (sum(r.taken for r in rows if (r.doc_id // 3) % 2 == q) for q in (1, 0))
    assert good > 1.5 * bad


@pytest.mark.parametrize("weights", [[1000.0], [0.001], [1000.0, 0.001, 1.0], [3.0 + i / 100 for i in range(60)]])
def test_buckets_hold_alike_whatever_the_weights(spark, monkeypatch, weights):
    from pyspark.sql import functions as F

    monkeypatch.setattr(m, "BUCKET", 100)
    rows = spark.range(20_000).selectExpr("id", f"element_at(array({', '.join(map(repr, weights))}), cast(id % {len(weights)} as int) + 1) * 1D AS weight")
    rows = rows.withColumn("key", -F.log((F.shiftrightunsigned(F.xxhash64("id"), 11) + 0.5) * 2.0**-53) / F.col("weight"))
    held = [r["count"] for r in rows.withColumn("b", F.least(F.floor(m.spread(rows, 20_000) * 200), F.lit(199))).groupBy("b").count().collect()]
    assert len(held) > 180 and max(held) < 250


def test_many_sources(spark):
    """As many sources as documents: ranks and levels come from partitions of a sorted table."""
    rng = __import__("random").Random(3)
    sizes = {f"host{i}": rng.randrange(1, 400) for i in range(3000)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)
    want = fill(sizes)
    assert all(r.target == pytest.approx(want[r.source]) for r in m.targets(df).collect())


def test_repeated_rows_get_what_the_mix_takes(spark):
    """To the word, however often a row repeats, with and without other columns that differ."""
    rows = [(1, "a b c d e f g", "s", k) for k in range(3)] + [(2, "a b c", "s", 0)] * 2 + [(3, "x " * 5, "t", 0), (None, "p q", "t", 1), (None, "p q", "t", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k int")
    mixed, kept = m.mix(docs).collect(), m.keep_mixed(docs).collect()
    assert sum(r.taken for r in kept) == sum(r.taken for r in mixed)
    assert all(0 < r.taken <= 3 * r["size"] for r in kept) and sorted(r.taken for r in kept) != []
    assert sorted(map(str, kept)) == sorted(map(str, m.keep_mixed(docs).collect()))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], m.mix(docs).collect())
    kept = m.keep_mixed(docs)
    assert kept.columns == [*(c for c in docs.columns if c != "size"), "size", "source_size", "target", "taken"]
    assert all(r.taken > 0 for r in kept.collect())
    assert m.mix(no_documents(spark)).count() == 0 and m.keep_mixed(no_documents(spark)).count() == 0


def test_stays_in_the_jvm(spark, sf):
    plan = m.op7_mixing(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
