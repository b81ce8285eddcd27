import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from larder.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.where(langid.fold(F.col("doc_id"), 5) != 0))
    rows = docs.where(langid.fold(F.col("doc_id"), 5) == 0).select("lang", langid.predict(F.col("text"), model).alias("p")).collect()
    assert sum(r.lang == r.p.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.p.score <= 1 for r in rows)
    assert sum(r.p.ambiguous for r in rows) < 0.02 * len(rows)


def test_codewords_keep_apart():
    for n in (2, 3, 4, 5, 9, 30):
        code = langid.codewords(n)
        assert code.shape[0] == n and len({tuple(c) for c in code.tolist()}) == n
    assert langid.codewords(4).shape == (4, 7)
    apart = (code.shape[1] - code @ code.T) / 2 + np.eye(30) * 100
    assert apart.min() >= 0.25 * code.shape[1]


def test_features_of_slices(monkeypatch):
    text = "Straße und Gäßchen, ÀÉ 日本語 " * 50
    whole = langid.features(text)
    monkeypatch.setattr(langid, "SLICE", 17)
    assert np.allclose(whole, langid.features(text))


def test_odd_rows(odd, none):
    model = langid.train(odd)
    rows = odd.select("text", langid.predict(F.col("text"), model).alias("p")).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert r.p.lang_pred == ("en" if letters else "und")
        assert letters or r.p.score == 0
    nothing = langid.train(none)
    assert {r.p.lang_pred for r in odd.select(langid.predict(F.col("text"), nothing).alias("p")).collect()} == {"und"}


def test_texts_without_letters():
    assert not any(map(langid.has_letter, ["", "²³", "½ ¼", "①②", "Ⅷ", "12_ 3!", "\u0301"]))
    assert all(map(langid.has_letter, ["² a", "ª", "日", "ʰ"]))


def test_unclear_texts_are_flagged(spark):
    rows = [(i, ("abab " if i % 2 else "xyxy ") * 20, "one" if i % 2 else "two") for i in range(200)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [p[0] for p in model.predict(["abab abab", "xyxy xyxy"])] == ["one", "two"]
    assert [p[2] for p in model.predict(["abab abab", "qqqq mmmm"])][0] is False
    assert model.predict(["12 34"])[0] == ("und", 0.0, True)


def test_training_holds_one_matrix_on_the_driver(spark):
    words = F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 256), F.md5(F.col("id").cast("string").cast("binary")))
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), words.alias("text"), F.concat(F.lit("l"), F.col("id") % 4).alias("lang"))
    tracemalloc.start()
    model = langid.train(docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.languages) == 4
    # A row of the matrix takes 4 bytes a bucket; about SAMPLE rows are drawn.
    assert most < 1.5 * langid.SAMPLE * langid.BUCKETS * 4


def test_fit_in_place():
    rng = np.random.default_rng(7)
    for n in (40, 300):
        rows, labels = rng.random((n, langid.BUCKETS), np.float32) / 64, np.arange(n) // 3 % 3
        rows[np.arange(n), labels] += 1
        out = np.arange(n) % 5 == 0 if n >= 50 else np.zeros(n, bool)
        assert out.sum() == langid.weighing(n)
        order = np.concatenate((np.flatnonzero(out), np.flatnonzero(~out)))
        middle, x = rows[~out].mean(axis=0), rows[~out] - rows[~out].mean(axis=0)
        model = langid.fit(rows[order], labels[order], ["a", "b", "c"])
        held, known = (rows[out] - middle, labels[out]) if out.any() else (x, labels)
        wrong = ((held @ model.weights + model.bias + middle @ model.weights > 0) != (model.code[known] > 0)).mean(axis=0)
        trust = np.log((1.01 - wrong) / (wrong + 0.01)).clip(0.05)
        assert np.allclose(model.trust, trust / trust.sum(), atol=1e-5)
        assert ((rows @ model.weights + model.bias > 0) == (model.code[labels] > 0)).mean() > 0.9
