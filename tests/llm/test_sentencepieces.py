import struct

import numpy as np
import sentencepiece
from odd_rows import ODD
from pyspark.sql import functions as F

from larder.llm import sentencepieces as sp
from larder.llm.vocabularies import path_of

TEXTS = [t or "" for _, t in ODD] + ["  two  blanks ", "▁marks ▁▁", "日本語 テスト", "<s></s><unk> <0x41>", "a\tb\r\nc", " ", " x y", "😀 é é"]


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def message(*fields):
    """Protobuf of (number, value); str and bytes are prefixed by their length, floats fixed."""
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            data = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(data)) + data
    return out


def unigram_file(tmp_path, squeeze):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = ["▁", "▁the", "▁th", "e", "t", "h", "a", "▁a", "n", "d", "▁and", "an", "s", "re", "r", "▁re", "ad", "o", "on", "i"]
    pieces += [(w, -1.0 - 0.37 * i, 1) for i, w in enumerate(words)]
    trainer = message((3, 1), (35, 1), (40, 0), (41, 1), (42, 2))
    normaliser = message((1, "identity"), (3, 1), (4, squeeze), (5, 1))
    data = b"".join(message((1, message((1, p), (2, s), (3, k)))) for p, s, k in pieces) + message((2, trainer), (3, normaliser))
    path = tmp_path / f"unigram{squeeze}.model"
    path.write_bytes(data)
    return str(path)


def check(path, texts):
    codec, reference = sp.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    coded = codec.encode(texts)
    for text, ids in zip(texts, coded, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode(text), text
    return codec, reference, coded


def test_bpe_parity_and_decoding():
    codec, _, coded = check(path_of("piece_bpe_32k.model"), TEXTS)
    assert codec.by_word
    for text, back in zip(TEXTS, codec.decode(coded), strict=True):
        assert back == text.replace("▁", " ")
    whole = sp.build(codec.model).encode_batch_fast(TEXTS, add_special_tokens=False)
    assert [np.array(e.ids, "<u4").tobytes() for e in whole] == coded
    assert codec.parity(TEXTS, coded) == [True] * len(TEXTS)
    # A word that comes out otherwise is found in the texts that hold it.
    other = sp.Codec(path_of("piece_bpe_32k.model"))
    real = other.tokenizer

    class Off:
        def encode_batch_fast(self, texts, add_special_tokens):
            return real.encode_batch_fast([t.replace("line", "lime") for t in texts], add_special_tokens=False)

    other.tokenizer = Off()
    wrong = other.encode(TEXTS)
    assert other.parity(TEXTS, wrong) == [a == b for a, b in zip(coded, wrong, strict=True)] and wrong != coded


def test_decoding_of_any_ids():
    codec = sp.Codec(path_of("piece_bpe_32k.model"))
    ids = [np.array(i, "<u4").tobytes() for i in ([], [300, 5000, 29871, 29871, 350], [3 + 0xC3], [3 + 0xC3, 3 + 0xA9], [29871, 450])]
    assert codec.decode(ids) == codec._by_library(ids)


def test_unigram_parity(tmp_path):
    texts = ["the reason", "and the thread", "", "read on and on", "xyz the é", "the  and"]
    for squeeze in (0, 1):
        codec, reference, coded = check(unigram_file(tmp_path, squeeze), texts)
        assert codec.model.kind == sp.UNIGRAM
        assert codec.decode(coded) == [reference.decode(np.frombuffer(c, "<u4").tolist()) for c in coded]


def test_columns(odd, none):
    df = odd.select("text", sp.encode(F.col("text")).alias("ids"))
    rows = df.select("text", "ids", sp.decode(F.col("ids")).alias("back"), sp.transcode(F.col("text")).alias("t")).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.back == r.text and (r.ids is None) == (r.text is None)
        assert tuple(r.t) == (r.ids, r.back, True)
    assert none.select(sp.encode(F.col("text"))).count() == 0
