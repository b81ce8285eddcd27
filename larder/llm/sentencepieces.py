"""SentencePiece encoding and decoding by the tokenizers library.

The model file's protobuf is read field by field; its normaliser, the white-space marker, its scores (unigram)
or the merges they imply (BPE) and byte fallback are rebuilt as a tokenizers pipeline. Batches are encoded by
the library's threads. Where no piece goes on past a marker, a text is the sequence of its marked words, so a
worker keeps the ids of words it has seen and hands only new ones to the library; otherwise whole texts go.
Parity with the sentencepiece library is verified on every text: by each of its words where words are
independent, on the whole text elsewhere.

A null text has null ids, an empty one none. Repeated rows and extra columns do not matter.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from larder.llm.vocabularies import joined_ids, packed, path_of

MARK = "▁"
# Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
REMEMBERED, NEW_WORDS, TOGETHER = 400_000, 8192, 256
#: Characters of texts that are encoded at once.
BATCH_CHARS = 1 << 21


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}[wire] if wire in (1, 5) else varint()
        yield number, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parse(data: bytes) -> PieceModel:
    """Model of the protobuf: pieces (field 1), trainer (2) and normaliser (3)."""
    model = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            found = dict(_fields(value))
            model.pieces.append((found[1].decode(), struct.unpack("<f", found.get(2, b"\0\0\0\0"))[0], found.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind, model.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(spec.get(i, 1)) for i in (3, 4, 5))
    return model


def _merges(model: PieceModel) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, the best scored piece first."""
    place = {piece: i for i, (piece, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    ranked = sorted(((-score, i, piece) for i, (piece, score, kind) in enumerate(model.pieces) if kind == NORMAL and len(piece) > 1))
    merges = []
    for _, _, piece in ranked:
        cuts = [(piece[:n], piece[n:]) for n in range(1, len(piece)) if piece[:n] in place and piece[n:] in place]
        merges += sorted(cuts, key=lambda c: (place[c[0]], place[c[1]]))
    return merges


def build(model: PieceModel, normalise: bool = True) -> Tokenizer:
    unknown = model.pieces[model.unknown][0]
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocabulary, _merges(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(left=True, right=True)]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps and normalise:
        tokenizer.normalizer = normalizers.Sequence(steps)
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence([*parts, decoders.Strip(" ", 1 if model.dummy_prefix else 0, 0)])
    return tokenizer


class Codec:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        with open(path, "rb") as f:
            self.model = parse(f.read())
        # Words are independent if no piece goes on past a marker and the normaliser only marks blanks.
        inner = any(MARK in p.lstrip(MARK) for p, _, kind in self.model.pieces if kind not in (CONTROL, UNKNOWN))
        simple = not self.model.charsmap and not self.model.squeeze and self.model.dummy_prefix and self.model.escape
        self.by_word = not inner and simple
        self.tokenizer = build(self.model, normalise=not self.by_word)
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        spelled = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        self.sizes = np.array([len(b) for b in spelled], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.words: dict[str, bytes] = {}
        self.wrong: set[str] = set()
        self.marked = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            return [packed(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        plain = [t for t in texts if self._is_plain(t)]
        words = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        coded = iter(joined_ids(words, lambda some: self._ids([MARK + w for w in some])))
        return [next(coded) if self._is_plain(t) else b"".join(self._ids(self._marked(t))) for t in texts]

    @staticmethod
    def _is_plain(text: str) -> bool:
        """Single blanks between words, and no markers."""
        return text != "" and "  " not in text and MARK not in text and text[0] != " " and text[-1] != " "

    def _marked(self, text: str) -> list[str]:
        """Words with the markers before them."""
        return self.marked.findall(MARK + text.replace(" ", MARK)) if text else []

    def _ids(self, words: list[str]) -> list[bytes]:
        known = self.words
        if len(known) > REMEMBERED:
            known.clear()
        found = list(map(known.get, words))
        if None in found:
            self._learn(list({w for w, ids in zip(words, found, strict=True) if ids is None}))
            found = [known[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return found

    def _learn(self, new: list[str]) -> None:
        """Encode new words, many at a time: a word begins at the piece that begins with a marker."""
        single = [w for w in new if w.count(MARK) == 1 and len(w) > 1]
        groups = [single[at : at + TOGETHER] for at in range(0, len(single), TOGETHER)]
        for some, coded in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = packed(coded)
            first = (np.nonzero(self.begins[np.frombuffer(ids, "<u4")])[0] * 4).tolist()
            if len(first) == len(some):
                self.words.update(zip(some, [ids[i:j] for i, j in zip(first, [*first[1:], len(ids)], strict=True)], strict=True))
        rest = [w for w in new if w not in self.words]
        self.words.update(zip(rest, map(packed, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        self._compare(groups, rest)

    def _compare(self, groups: list[list[str]], rest: list[str]) -> None:
        """Note the new words that the sentencepiece library encodes otherwise: many at a time, then one by one."""
        plain = lambda w: w.replace(MARK, " ")[1:]  # noqa: E731  the library puts the first marker
        for some, theirs in zip(groups, self.reference.encode(["".join(map(plain, g[:1])) + "".join(w.replace(MARK, " ") for w in g[1:]) for g in groups], num_threads=1), strict=True):
            if _bytes(theirs) != b"".join(map(self.words.__getitem__, some)):
                rest = rest + some
        for word, theirs in zip(rest, self.reference.encode(list(map(plain, rest)), num_threads=1), strict=True):
            if plain(word) and _bytes(theirs) != self.words[word]:
                self.wrong.add(word)

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of ids: the bytes of their pieces, put together by place; by the library where that is no text."""
        if not self.by_word:
            return self._by_library(ids)
        flat = np.frombuffer(b"".join(ids), "<u4")
        each = self.sizes[flat]
        ends = np.concatenate(([0], np.cumsum(each)))
        data = self.spelled[np.repeat(self.offsets[flat] - ends[:-1], each) + np.arange(ends[-1])].tobytes()
        borders = ends[np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids], dtype=np.int64)))].tolist()
        out = []
        for i, j, own in zip(borders, borders[1:], ids, strict=False):
            try:
                out.append(data[i:j].decode().removeprefix(" "))
            except UnicodeDecodeError:
                out += self._by_library([own])
        return out

    def _by_library(self, ids: list[bytes]) -> list[str]:
        return self.tokenizer.decode_batch([np.frombuffer(i, "<u4").tolist() for i in ids], skip_special_tokens=False)

    def parity(self, texts: list[str], ids: list[bytes]) -> list[bool]:
        """Whether the ids are those of the sentencepiece library.

        Where texts are sequences of independent words, for both libraries alike, every word was compared when
        it was learnt, in running text; other texts, and those with a word that differs, are compared whole.
        """
        if not self.by_word:
            return [self._same(t, i) for t, i in zip(texts, ids, strict=True)]
        return [self._same(t, i) if self.wrong and not self.wrong.isdisjoint(self._marked(t)) else True for t, i in zip(texts, ids, strict=True)]

    def _same(self, text: str, ids: bytes) -> bool:
        return _bytes(self.reference.encode(text, num_threads=1)) == ids


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _slices(sizes: list[int]) -> Iterator[slice]:
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= BATCH_CHARS:
            yield slice(begin, i + 1)
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def encode(text: Column, path: str | None = None) -> Column:
    """Ids of a text column as binary: little-endian unsigned 32-bit."""
    path = path or path_of("piece_bpe_32k.model")

    def run(texts: pa.Array) -> pa.Array:
        values, out = texts.to_pylist(), []
        for part in _slices([len(v or "") for v in values]):
            out += codec(path).encode([v or "" for v in values[part]])
        return pa.array([None if v is None else o for v, o in zip(values, out, strict=True)], pa.binary())

    return F.arrow_udf(run, "binary")(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """Text of ids as `encode` gives them."""
    path = path or path_of("piece_bpe_32k.model")

    def run(coded: pa.Array) -> pa.Array:
        values, out = coded.to_pylist(), []
        for part in _slices([len(v or b"") for v in values]):
            out += codec(path).decode([v or b"" for v in values[part]])
        return pa.array([None if v is None else o for v, o in zip(values, out, strict=True)], pa.string())

    return F.arrow_udf(run, "string")(ids)


TRANSCODED = "struct<ids:binary,back:string,parity:boolean>"


def transcode(text: Column, path: str | None = None) -> Column:
    """Struct (ids, back, parity): a text encoded, decoded again, and compared with the sentencepiece library."""
    path = path or path_of("piece_bpe_32k.model")
    kind = pa.struct([("ids", pa.binary()), ("back", pa.string()), ("parity", pa.bool_())])

    def run(texts: pa.Array) -> pa.Array:
        values, out = texts.to_pylist(), []
        for part in _slices([len(v or "") for v in values]):
            some = [v or "" for v in values[part]]
            ids = codec(path).encode(some)
            out += zip(ids, codec(path).decode(ids), codec(path).parity(some, ids), strict=True)
        rows = [{"ids": None, "back": None, "parity": p} if v is None else {"ids": i, "back": b, "parity": p} for v, (i, b, p) in zip(values, out, strict=True)]
        return pa.array(rows, kind)

    return F.arrow_udf(run, TRANSCODED)(text)
