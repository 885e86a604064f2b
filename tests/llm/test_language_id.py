import zlib

import numpy as np
import pytest

from tests.llm.helpers import no_documents, odd_documents
from tilewright.llm import language_id as m


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = m.op3_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    for flag in (True, False):
        own = [r for r in rows if r.held_out == flag]
        assert np.mean([r.lang_pred == r.lang for r in own]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_prediction_reads_only_the_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = m.learn(docs)
    a = m.predict(docs.select("doc_id", "text"), model).select("doc_id", "lang_pred", "score")
    b = m.predict(docs.selectExpr("doc_id + 7 AS k", "doc_id", "text", "'en' AS lang", "'s' AS source"), model).select("doc_id", "lang_pred", "score")
    assert sorted(a.collect()) == sorted(b.collect())


def test_held_out_rows_teach_nothing(spark):
    ids = range(60)
    held = [i for i in ids if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "aaaa bbbb aaaa" if i not in held else "zzzz yyyy zzzz", "x" if i not in held else "y", "s", 1) for i in ids]
    langs, _ = m.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert langs == ["x"]


def test_brute_force_profile():
    """A text's vector is the sum of bound, rotated letter vectors."""
    p = m.Profiles(256)
    text = "Hé, la bas!"
    want = np.zeros(256)
    symbols = [0, *(int(p.symbols[ord(c)]) for c in text), 0]
    letters = {x: p.letter(x).astype(float) for x in symbols}
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        if b:
            want += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    assert np.array_equal(p.bundle([text])[0], want.astype(np.float32))


def test_every_letter_has_a_vector_of_its_own():
    """Of any script: no two letters share one, and unlike ones are nearly orthogonal."""
    p = m.Profiles()
    letters = "abcdefghijklmnopqrstuvwxyzабвгдеёжзийклмнопрстуфхцчшщъыьэюяαβγδεζηθικλμνξοπρστυφχψωあいうえおかきくけこ人生而自由在尊严和权利上一律平等\U00020000\U00020001"
    symbols = [m._symbol(ord(c)) for c in letters]
    assert len(set(symbols)) == len(letters) and m._symbol(ord("Я")) == ord("я") and m._symbol(ord("7")) == m._symbol(ord(" ")) == 0
    rows = np.array([p.letter(s) for s in symbols], float) / m.DIMENSIONS**0.5
    assert np.abs(rows @ rows.T - np.eye(len(rows))).max() < 0.2


def test_languages_of_one_script_are_told_apart(spark):
    """Two alphabets that a shared pool of symbols would mix."""
    import random

    rng = random.Random(1)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(60))
    kinds = {"ru": "абвгдежзиклмн", "uk": "опрстуфхцчшщь", "zh": "人生而自由在尊严和权利"}
    rows = [(i, text(kinds[lang]), lang, "s", 1) for i in range(240) for lang in [list(kinds)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert all(r.lang == r.lang_pred for r in m.predict(docs, m.learn(docs)).collect())


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(m, "LANGS", 2)
    rows = [(i, "aaa bbb" if i % 3 else "zzz", f"l{i % 3}" if i < 30 else f"junk{i}", "s", 1) for i in range(60)]
    langs, _ = m.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert langs == ["l0", "l1"]


def test_batches_and_cache_do_not_matter(monkeypatch):
    texts = ["abc def", "", "xyz " * 50, None, "\U00020000 漢字 слово"]
    whole = m.Profiles(128).bundle(texts)
    monkeypatch.setattr(m, "KEPT", 3)
    small = m.Profiles(128)
    assert np.array_equal(whole, np.vstack([small.bundle([t]) for t in texts]))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = m.predict(docs, m.learn(docs)).collect()
    assert len(found) == docs.count()
    by = {r.text: r for r in found}
    for blank in (None, "", " \t\n ", "12345 67890 !!! ???"):
        assert (by[blank].lang_pred, by[blank].score) == ("und", 0.0)
    assert by["word"].lang_pred in ("en", "de", "la", "fr")


def test_nothing_to_learn_from(spark):
    docs = odd_documents(spark)
    model = m.learn(no_documents(spark))
    assert {r.lang_pred for r in m.predict(docs, model).collect()} == {"und"}
    assert m.predict(no_documents(spark), model).count() == 0


@pytest.mark.parametrize("per_lang", [1, 10])
def test_bound_of_training(spark, sf, per_lang):
    langs, prototypes = m.train(spark.read.parquet(f"{sf}/documents.parquet"), per_lang)
    assert prototypes.shape == (len(langs), m.DIMENSIONS)
