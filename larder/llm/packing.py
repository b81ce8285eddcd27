"""Packing documents into sequences along a space-filling curve.

A document becomes token ids and an end id. Its ids are hashed into a vector of HASHED signed counts, which is
projected to DIMS dimensions; the cell it falls into has a place on a Hilbert curve. Documents are sorted by
that place and laid end to end, and the line is cut every `length` ids: neighbours on the curve share
sequences, and only the last sequence of all can be short.

Rows are (doc_id, text); a null text is empty and has the end id alone. Repeated rows are packed each. Ties
on the curve are ordered by doc_id, then by where the row was read. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from larder.llm.components import _kept
from larder.llm.vocabularies import joined_ids, packed, path_of

LENGTH, END = 2048, 1
#: Hashed dimensions, dimensions of the curve, bits of each.
HASHED, DIMS, BITS = 256, 4, 12
#: Words a worker remembers with their ids; characters and words it hands to the tokenizer at once.
REMEMBERED, BATCH_CHARS, BATCH_WORDS, TOGETHER = 500_000, 5_000_000, 4096, 256
# White space as Unicode has it; Arrow also splits at four control characters.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_OTHER_SPACE = re.compile("[\x1c-\x1f]")
#: Marks that end words and are no part of a contraction.
STOPS = ".,;:!?|*#%&$"


class WordTokenizer:
    """Ids of texts under a tokenizer that drops white space and joins nothing across it.

    Under such a tokenizer the ids of a text are those of its words one after the other, so a word that was
    seen is not tokenized again. Tokenizers that keep case, or join marks to letters, are asked for whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        #: Texts that hold an added token, once in lower case, go to the tokenizer whole, since it cuts them there.
        self.added = re.compile("|".join(map(re.escape, added)) or r"\b\B", re.I)
        self.words: dict[str, bytes] = {}
        self.by_word = self._splits()
        self.lean = self._lean() if self.by_word else None

    def _splits(self) -> bool:
        a, b = "Été It's 3km", "№２ don't!"
        whole = [self.tokenizer.encode(a + s + b, add_special_tokens=False).ids for s in (" ", "\n\t", "\u3000")]
        parts = [i for w in (*a.split(" "), *b.split(" ")) for i in self.tokenizer.encode(w, add_special_tokens=False).ids]
        lower = self.tokenizer.encode(a.lower(), add_special_tokens=False).ids == self.tokenizer.encode(a, add_special_tokens=False).ids
        marks = ["It", "3"], [".", "?!", "|,"]
        apart = all(self._raw(w + m) == self._raw(w) + self._raw(m) for w in marks[0] for m in marks[1])
        return lower and apart and all(ids == parts for ids in whole)

    def _lean(self) -> Tokenizer | None:
        """The same model without the patterns that lower-case words of letters pass unchanged.

        None if the vocabulary does not mark the ends of words or the words of a sample come out otherwise.
        """
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        lean = Tokenizer(self.tokenizer.model)
        lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        sample = "the été straße ñandú àéîõü þæð ÿ µ º internationalization zzz x"
        return lean if lean.encode(sample, add_special_tokens=False).ids == self._raw(sample) else None

    def _raw(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            return [packed(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        whole = [self.added.search(t) is not None for t in texts]
        odd = [_OTHER_SPACE.search(t) is not None for t in texts]
        coded = iter(self._by_word([t for t, w, o in zip(texts, whole, odd, strict=True) if not w and not o]))
        return [packed(self.tokenizer.encode(t, add_special_tokens=False)) if w else b"".join(self._ids(_SPACE.split(t))) if o else next(coded) for t, w, o in zip(texts, whole, odd, strict=True)]

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word, looked up or made."""
        known = self.words
        if len(known) > REMEMBERED:
            known.clear()
        found = list(map(known.get, words))
        if None in found:
            self._learn({w for w, ids in zip(words, found, strict=True) if ids is None})
            found = [known[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return found

    def _by_word(self, texts: list[str]) -> list[bytes]:
        """Texts are split and their distinct words found by Arrow; ids are put together by place."""
        words = pc.utf8_split_whitespace(pa.array(list(map(self._lower, texts)), pa.large_string()))
        return joined_ids(words, self._ids)

    def _learn(self, new: set[str]) -> None:
        """Add words; a word and the marks behind it are tokenized apart, words of letters many at a time."""
        cut, bare = {}, set()
        for w in new:
            n = len(w.rstrip(STOPS))
            if 0 < n < len(w) and w[n - 1].isalnum() and normalize("NFC", w[:n]).lower()[-1].isalnum():
                cut[w] = n
                bare.update((w[:n], w[n:]))
            else:
                bare.add(w)
        bare.difference_update(self.words)
        letters = [w for w in bare if w.isalpha() and w == w.lower() and (w.isascii() or max(w) <= "\u00ff")] if self.lean else []
        for at in range(0, len(letters), TOGETHER):
            some = letters[at : at + TOGETHER]
            ids = packed(self.lean.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0])
            last = (np.nonzero(self.ends[np.frombuffer(ids, "<u4")])[0] * 4 + 4).tolist()
            if len(last) == len(some):
                self.words.update(zip(some, [ids[i:j] for i, j in zip([0, *last], last, strict=False)], strict=True))
        rest = list(bare.difference(self.words))
        for at in range(0, len(rest), BATCH_WORDS):
            some = rest[at : at + BATCH_WORDS]
            self.words.update(zip(some, map(packed, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        for word, n in cut.items():
            self.words[word] = self.words[word[:n]] + self.words[word[n:]]

    @staticmethod
    def _lower(text: str) -> str:
        """Latin-1 texts in lower case, as the tokenizer's own lower-casing has them; others as they are."""
        try:
            text.encode("latin-1")
            return text.lower()
        except UnicodeEncodeError:
            return text


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def batches_of(texts: Iterable[str]) -> Iterator[list[str]]:
    """Consecutive texts, up to a number of characters together."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= BATCH_CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


@lru_cache(maxsize=2)
def _projection(ids: int) -> np.ndarray:
    """Coordinates that one occurrence of each id adds: its hashed dimension's row, with its hashed sign."""
    mixed = (np.arange(ids, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    axes = np.random.default_rng(42).standard_normal((HASHED, DIMS))
    return axes[mixed % HASHED] * np.where(mixed >> np.uint64(12) & np.uint64(1), 1.0, -1.0)[:, None]


def cell_of(ids: np.ndarray) -> np.ndarray:
    """Whole coordinates of a document, each of BITS bits."""
    if not len(ids):
        return np.full(DIMS, 1 << (BITS - 1), np.int64)
    table = _projection(1 << 17)
    place = np.zeros(DIMS)
    for at in range(0, len(ids), 1 << 16):
        place += table[ids[at : at + (1 << 16)] & (1 << 17) - 1].sum(axis=0)
    # A logistic curve spreads what is near the middle over most cells.
    spread = 1 / (1 + np.exp(-4 * place / len(ids) ** 0.5 / DIMS**0.5))
    return np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_key(cells: np.ndarray) -> np.ndarray:
    """Place on the Hilbert curve of each row of coordinates: Gray-code rotation of the bit planes."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (BITS - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, bit = np.zeros_like(x[0]), 1 << (BITS - 1)
    while bit > 1:
        flip ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for plane in range(BITS - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> plane) & 1)
    return key


def tokenized(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(row, doc_id, key, n, ids) of each row of (doc_id, text): ids as little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, row = word_tokenizer(path), TaskContext.get().partitionId() << 33
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            doc_ids, at = batch.column(0), 0
            for some in batches_of(t.as_py() or "" for t in batch.column(1)):
                coded = tokenizer.encode(some)
                keys = hilbert_key(np.array([cell_of(np.frombuffer(c, "<u4")) for c in coded]))
                n = len(coded)
                yield pa.record_batch(
                    [
                        pa.array(np.arange(row, row + n)),
                        doc_ids.slice(at, n),
                        pa.array(keys),
                        pa.array([len(c) // 4 + 1 for c in coded], pa.int64()),
                        pa.array([c + last for c in coded], pa.binary()),
                    ],
                    names=["row", "doc_id", "key", "n", "ids"],
                )
                row, at = row + n, at + n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "row long, doc_id long, key long, n long, ids binary")


def _starts(rows: DataFrame) -> DataFrame:
    """(row, begin): ids before each row along the curve.

    Rows are dealt to ranges of the curve; a range is summed in order by the task that holds it, and the
    totals of the ranges, one row each, are summed by a window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = before + np.cumsum(n)
            yield pa.record_batch([pa.array(np.full(len(n), part)), batch.column(0), pa.array(ends - n), pa.array(ends)], names=["part", "row", "begin", "end"])
            before = int(ends[-1]) if len(ends) else before

    ordered = rows.repartitionByRange("key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row").select("row", "n")
    placed = _kept(ordered.mapInArrow(run, "part long, row long, begin long, end long"), "places")
    totals = placed.groupBy("part").agg(F.max("end").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = totals.select(F.col("part").alias("_part"), before.alias("_before"))
    return placed.join(parts, F.col("part") == F.col("_part")).select(F.col("row").alias("_row"), (F.col("begin") + F.col("_before")).alias("begin"))


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of all rows of (doc_id, text).

    `path` names a tokenizers file. Ids are kept as a table between tokenizing and cutting, so nothing is
    tokenized twice, and shuffled once, by row.
    """
    rows = _kept(tokenized(docs, path or path_of("word_bpe_49k.json"), end), "tokens")
    begins = _starts(rows.select("row", "doc_id", "key", "n"))
    placed = rows.join(begins, F.col("row") == F.col("_row")).select("doc_id", "n", "begin", "ids")
    # A piece for each sequence that the document reaches into.
    reached = F.sequence(F.floor(F.col("begin") / length), F.floor((F.col("begin") + F.col("n") - 1) / length))
    pieces = placed.withColumn("sequence_id", F.explode(reached))
    first = F.greatest(F.col("sequence_id") * length, "begin")
    until = F.least((F.col("sequence_id") + 1) * length, F.col("begin") + F.col("n"))
    pieces = pieces.withColumns({"start": first - F.col("begin"), "length": until - first, "offset": first - F.col("sequence_id") * length})
    cut = F.col("ids").substr((F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return pieces.select("doc_id", "start", "length", F.col("n").alias("doc_tokens"), "sequence_id", "offset", cut.alias("ids"))
