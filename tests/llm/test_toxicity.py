import random

import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from larder.llm import toxicity as tx

CLEAN = "the people of this town are kind and read many books about rivers birds and old stones with care".split()
BAD = ["grumble", "blockhead", "nitwit"]


def disguise(word, rng):
    kind = rng.randrange(4)
    if kind == 0:
        return "".join({"o": "0", "i": "1", "e": "3", "a": "4"}.get(c, c) for c in word)
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        return word[0] + word[1] * 4 + word[2:]
    return ".".join(word)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(1500):
        words = rng.choices(CLEAN, k=rng.randrange(5, 60))
        toxic = int(i % 6 == 0)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return tx.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_restores_and_scores(model):
    rng = random.Random(3)
    for word in BAD:
        assert model.score(f"read {word} books") > 0.9
        for _ in range(12):
            hidden = disguise(word, rng)
            assert model.score(f"the people read {hidden} of old stones") > 0.5, hidden
    for _ in range(50):
        assert model.score(" ".join(rng.choices(CLEAN, k=30))) < 0.3
    assert tx.restore("the gr0mble", model.characters).startswith("the gr")
    assert tx.restore("n i t w i t", model.characters) == "nitwit"
    assert tx.restore("B1ockhe4d!!", model.characters) == "blockhead"


def test_words_without_disguise_stay(model):
    for word in ("stones", "year2024", "ciónllll", "3.14", "a"):
        assert isinstance(tx.restore_word(word, model.characters)[0], str)
    assert tx.restore_word("stones,", model.characters) == ("stones", False)
    assert tx.restore_word("thoner$$$", model.characters) == ("thoner", False)


def test_trigram_counts_over_slices(monkeypatch):
    text = "Ça va bien, merci!  ok"
    whole = tx.trigrams(text)
    assert whole.sum() > 10
    monkeypatch.setattr(tx, "SLICE", 1 << 30)
    assert (tx.trigrams(text) == whole).all()


def test_odd_rows(odd, none, model):
    rows = odd.select("text", tx.score(F.col("text"), model).alias("s"), tx.restored(F.col("text"), model).alias("r")).collect()
    assert len(rows) == len(ODD) and all(0 <= r.s <= 1 for r in rows)
    assert all((r.text is None) == (r.r is None) for r in rows)
    assert none.select(tx.score(F.col("text"), model)).count() == 0
    nothing = tx.train(odd, none.select("doc_id", F.lit(1).alias("toxic")))
    assert all(r.s < 0.01 for r in odd.select(tx.score(F.col("text"), nothing).alias("s")).collect())
    untaught = tx.train(none, odd.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert untaught.score("anything") < 0.01


def test_curve_rises_where_evidence_parts_the_rows():
    import numpy as np

    for heavy in (2.0, 5.0, 20.0):
        x = np.array([(0.0, 0.0)] * 900 + [(heavy, heavy)] * 100)
        y = np.array([0.0] * 900 + [1.0] * 100)
        bias, a, b = tx._curve(x, y)
        scores = 1 / (1 + np.exp(-(bias + x @ [a, b])))
        assert scores[0] < 0.05 and scores[-1] > 0.9
    bias, a, b = tx._curve(np.zeros((10, 2)), np.array([0.0] * 9 + [1.0]))
    assert abs(1 / (1 + np.exp(-bias)) - 0.1) < 0.01


def test_toxic_word_at_the_end_of_long_stretches(model):
    rng = random.Random(4)
    clean = "".join(rng.choices(CLEAN, k=1200))[:4990]
    spaced = " ".join(clean + "nitwit")
    assert len(spaced) > 9_900
    assert tx.restore(spaced, model.characters).endswith("nitwit")
    assert model.evidence(spaced)[0] > 0 and model.score(spaced) > 0.5
    joined = "/".join([*rng.choices(CLEAN, k=60), "gr0mbl3", "n1tw1t"])
    assert len(joined) > 200 and model.score(joined) > 0.5
    assert tx.restore_word("i" * 250 + "diot", model.characters)[1]
