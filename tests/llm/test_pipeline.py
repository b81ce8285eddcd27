from pathlib import Path

import corpus_pipeline
import numpy as np
import plain
import pytest
from odd_rows import ODD
from test_nearcopies import kept_plain

from larder.llm import langid, secrets
from larder.llm.vocabularies import path_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SF = "/root/testdata/sf0.001"


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages_on_odd_rows(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, "")
        assert name == "packing" or out.columns == COLUMNS
        out.collect()
        assert stage(spark, none, "").count() == 0


def test_language_stage(spark, odd):
    kept = corpus_pipeline.language_id(spark, odd, "")
    letters = [(i, t) for i, t in ODD if any(c.isalpha() for c in t or "")]
    assert pairs(kept) == sorted(letters, key=repr)
    assert {(r.lang, r.n_chars == len(r.text)) for r in kept.collect()} == {("en", True)}


def test_line_stage(spark, odd):
    clean = plain.line_dedup(ODD)
    expected = []
    for i, t in ODD:
        parts = plain.elements(t or "")
        left = None if t is None else clean[i, t]
        if t is None or left or not any(p.strip(" \t\r\n") for p in parts):
            expected.append((i, left))
    assert pairs(corpus_pipeline.line_dedup(spark, odd, "")) == sorted(expected, key=repr)


def test_near_duplicate_stage(spark):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join(words[:399] + ["x"]), " ".join(words[:300] + ["x"] * 100), " ".join(words[::-1]), "other text of its own", " ".join(words)]
    rows = [(10 - i, t, "en", "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == kept_plain([(i, t) for i, t, *_ in rows])


def test_secret_stage(spark, odd):
    ranks = path_of("byte_bpe_50k.tiktoken")
    out = {(r.doc_id, r.text) for r in corpus_pipeline.secret_scan(spark, odd, "").collect()}
    assert all(not secrets.spans_of(t, ranks) for _, t in out)
    assert out >= {(i, t) for i, t in ODD if not secrets.spans_of(t, ranks)}
    assert any("[SECRET]" in (t or "") for _, t in out)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_whole_run(spark):
    """All stages by plain versions; only the language model and the tokenizer are shared."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = langid.train(docs)
    rows = [(i, t) for (i, t), p in zip(rows, model.predict([t for _, t in rows]), strict=True) if p[0] != "und" and not p[2]]
    clean = plain.line_dedup(rows)
    rows = [(i, clean[i, t]) for i, t in rows if clean[i, t] or not any(p.strip(" \t\r\n") for p in plain.elements(t))]
    stay = set(kept_plain(rows))
    rows = [(i, t) for i, t in rows if i in stay]
    ranks = path_of("byte_bpe_50k.tiktoken")
    redacted = []
    for i, t in rows:
        done, parts = 0, []
        for start, _, end in secrets.spans_of(t, ranks):
            if start >= done:
                parts += [t[done:start], "[SECRET]"]
            done = max(done, end)
        redacted.append((i, "".join([*parts, t[done:]]) if parts else t))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path_of("word_bpe_49k.json"))
    expected = {i: np.array([*e.ids, 1], "<u4") for (i, _), e in zip(redacted, tokenizer.encode_batch([t for _, t in redacted], add_special_tokens=False), strict=True)}
    import zlib

    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        ids = expected[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(expected[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids.tobytes()) and len(ids) == r.length
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: len(ids) for i, ids in expected.items()}


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "secret_scan", "packing"]

