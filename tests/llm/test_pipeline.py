import random

import corpus_pipeline
from tests.llm.helpers import no_documents, odd_documents
from tilewright.llm import decontaminate, mixing, secrets
from tilewright.llm.queries import ORACLES, QUERIES
from tilewright.llm.simhash_dedup import fingerprint


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 11)) and "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontaminate", "secret_scan", "mixing"]


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, outs = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).persist()
        outs.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns[: len(names)] == names and (len(docs.columns) == len(names) or k == 4)
    known, single, clean, masked, mixed = outs
    assert len(known) >= 0.99 * spark.read.parquet(f"{sf}/documents.parquet").count()
    fps = [fingerprint(r.text) for r in single.values()]
    assert len(set(fps)) == len(fps)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = decontaminate.Index(items)
    assert {d for d, r in single.items() if index.scan(r.text)} == set(single) - set(clean)
    assert set(masked) == set(clean)
    model = secrets.learned(spark.createDataFrame([(r.text,) for r in clean.values()], "text string"))
    told = secrets.Guesser(*model)
    assert all(r.text == secrets.masked(clean[d].text, guesser=told) and not any(k < 3 for _, k, _ in secrets.find_spans(r.text)) for d, r in masked.items())
    sizes = {d: len((r.text or "").encode().split()) for d, r in masked.items()}
    assert all(r["size"] == sizes[d] and 0 < r.taken <= 3 * sizes[d] for d, r in mixed.items())
    assert abs(sum(r.taken for r in mixed.values()) - sum(sizes.values())) <= 50


def test_foreign_texts_go(spark, sf):
    """Unlearned scripts, other languages and letter junk go; every labelled document stays."""
    rng = random.Random(7)
    spans = {"cyrillic": (0x430, 0x450), "arabic": (0x627, 0x64A), "kana": (0x3041, 0x3090), "cjk": (0x4E00, 0x9FA5), "greek": (0x3B1, 0x3C9), "junk": (97, 123)}
    texts = []
    for name, (a, b) in spans.items():
        for words in (60, 300, 3000) if name == "junk" else (1, 3, 8, 60, 300):
            texts += [" ".join("".join(chr(rng.randrange(a, b)) for _ in range(rng.randrange(2, 9))) for _ in range(words)) for _ in range(20)]
    texts += ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1000)) for _ in range(20)]
    texts += [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "人人生而自由,在尊严和权利上一律平等。",
    ]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    foreign = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = corpus_pipeline.known_language(spark, docs.unionByName(foreign, allowMissingColumns=True), sf)
    ids = {r.doc_id for r in kept.collect()}
    assert {r.doc_id for r in docs.where("lang is not null").collect()} <= ids
    assert [texts[i - 10**9][:40] for i in sorted(ids) if i >= 10**9] == []


def test_run_equals_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, sf).collect()))


def test_odd_rows_through_all_stages(spark, sf):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_documents(spark), no_documents(spark)):
            out = stage(spark, docs, sf)
            assert out.count() <= docs.count(), name
            if name != "mixing":
                assert out.columns == docs.columns
                if name != "secret_scan":
                    assert set(map(str, out.collect())) <= set(map(str, docs.collect()))
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf)
    assert mixing.mix(docs).count() == docs.count() > 0
