import random

import numpy as np
from odd_rows import ODD
from tokenizers import Tokenizer

from larder.llm import packing
from larder.llm.vocabularies import path_of

PATH = path_of("word_bpe_49k.json")


def whole_ids(text):
    tokenizer = Tokenizer.from_file(PATH)
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_pieces_hold_every_id_once(odd):
    length = 64
    rows = packing.pack(odd, length=length).collect()
    texts = sorted((whole_ids(t) for _, t in ODD), key=repr)
    docs, begun = [], {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length and r.offset + r.length <= length
        if r.start == 0:
            begun = {"left": r.doc_tokens, "ids": []}
            docs.append(begun)
        assert r.start == len(begun["ids"])
        begun["ids"] += ids
    assert sorted((d["ids"] for d in docs), key=repr) == texts
    assert all(len(d["ids"]) == d["left"] for d in docs)
    total = sum(map(len, texts))
    by_sequence = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by_sequence.get(r.sequence_id, 0)
        by_sequence[r.sequence_id] = r.offset + r.length
    assert len(by_sequence) == -(-total // length) and sorted(by_sequence) == list(range(len(by_sequence)))


def test_empty_table(none):
    assert packing.pack(none).count() == 0


def test_word_cache_gives_the_ids_of_whole_texts():
    tokenizer = packing.WordTokenizer(PATH)
    assert tokenizer.by_word
    texts = [t or "" for _, t in ODD] + ["a\x1cb c", "x y z \x85 q", " ", "ΑΣ Σ İı", "<|startoftext|> a"]
    for text, ids in zip(texts, tokenizer.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole_ids(text)[:-1]


def test_odd_strings_have_the_ids_of_the_file():
    rng, tokenizer, file = random.Random(6), packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    signs = [*"abc İIıßﬁﬀŒÅé.!?,%*#:;'12 \t\n\x1c\x85", "i\u0307", "e\u0301", "\u0307", "\u0301", "\u0327", "Å", "İ.", "*İ%", "'s", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "text|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 14))) for _ in range(20_000)]
    wanted = file.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, ids, w in zip(texts, tokenizer.encode(texts), wanted, strict=True) if np.frombuffer(ids, "<u4").tolist() != w.ids] == []


def test_curve_visits_neighbours():
    side = 4
    cells = np.stack(np.meshgrid(*[np.arange(side)] * packing.DIMS, indexing="ij"), -1).reshape(-1, packing.DIMS)
    keys = packing.hilbert_key(cells)
    order = np.argsort(keys)
    assert sorted(keys.tolist()) == list(range(side**packing.DIMS))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_like_documents_are_near_on_the_curve():
    rng = np.random.default_rng(1)
    topics = [rng.integers(0, 40_000, 300) for _ in range(12)]
    docs = [(k, rng.choice(t, 400)) for t_id, t in enumerate(topics) for k in [t_id] * 20 for _ in [0]]
    keys = packing.hilbert_key(np.array([packing.cell_of(ids) for _, ids in docs]))
    order = [docs[i][0] for i in np.argsort(keys)]
    same = sum(a == b for a, b in zip(order, order[1:], strict=False)) / (len(order) - 1)
    assert same > 3 / len(topics)
