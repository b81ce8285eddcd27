"""Language identification by error-correcting output codes.

Each language has a codeword of bits, and each bit a logistic classifier on hashed character n-grams. A text
gets the language whose codeword has the least loss, where a bit counts by how reliable it was on sampled
rows left out of the fit; a text whose two best codewords are nearly as close is flagged as ambiguous.

The classifiers are fitted on a sample of about `sample` labelled rows (a parameter, divided evenly among the
languages, by hash of doc_id), whose features are made on the executors and sent to the driver, packed; there they are
one matrix, which the fit changes in place. Every text is predicted, over all its characters. Null texts and
texts without a letter are `und` with score 0, and so is everything if there is no labelled row; with one
language that is the only answer. Repeated rows, extra columns and empty tables need nothing special, as
prediction is a function of the text alone.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import groupby, product
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UND = "und"
BUCKETS, ORDERS = 4096, 3
SAMPLE, ROUNDS = 4000, 120
#: Characters that are turned into n-grams at once; texts that are scored at once.
SLICE, TEXTS = 1 << 20, 128
#: Codewords whose mean losses of a bit differ by less are too close to tell.
CLOSE = 0.02
#: Letters, and digits and numbers that are no decimals.
_MAYBE_LETTER = re.compile(r"[^\W\d_]")
# Odd multipliers of the n-gram hash, one for each place.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
PREDICTION = "struct<lang_pred:string,score:double,ambiguous:boolean>"


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed n-grams of one to three characters, of length 1."""
    counts = np.zeros(BUCKETS, np.int64)
    lower = text.lower()
    for at in range(0, len(lower), SLICE):
        codes = np.frombuffer(lower[at : at + SLICE + ORDERS - 1].encode("utf-32-le", "surrogatepass"), "<u4")
        here = min(SLICE, len(lower) - at)
        mixed = np.zeros(len(codes), np.uint32)
        for order in range(ORDERS):
            mixed = mixed[: len(codes) - order] + (codes[order:] + np.uint32(order)) * _MIX[order]
            counts += np.bincount(((mixed ^ mixed >> np.uint32(15)) * _MIX[0] >> np.uint32(20))[:here], minlength=BUCKETS)
    root = np.sqrt(counts, dtype=np.float32)
    return root / max(1e-9, float(np.sqrt(counts.sum())))


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all distinct splits of few languages, else the best of seeded random codes."""
    if n <= 5:
        columns = [c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, np.float32).T.reshape(n, -1)
    rng, best, most = np.random.default_rng(42), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(100):
        code = rng.choice(np.array([1, -1], np.float32), (n, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if apart.min() > most:
            best, most = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [(UND, 0.0, True)] * len(texts)
        some = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        for at in range(0, len(some), TEXTS):
            rows = some[at : at + TEXTS]
            margins = np.stack([features(texts[i]) for i in rows]) @ self.weights + self.bias
            losses = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
            shares = np.exp(-(losses - losses.min(axis=1, keepdims=True)) * max(1, self.code.shape[1]))
            shares /= shares.sum(axis=1, keepdims=True)
            best = losses.argmin(axis=1)
            ranked = np.sort(losses, axis=1)
            for k, i in enumerate(rows):
                close = len(self.languages) > 1 and float(ranked[k, 1] - ranked[k, 0]) < CLOSE
                out[i] = (self.languages[best[k]], float(shares[k, best[k]]), close)
        return out


def weighing(n: int) -> int:
    """How many of n rows weigh the bits: every fifth, none of few rows."""
    return -(-n // 5) if n >= 50 else 0


def fit(rows: np.ndarray, labels: np.ndarray, languages: list[str]) -> Model:
    """Logistic classifiers of the bits by accelerated gradient steps; the first rows weigh the bits. Changes `rows`."""
    code = codewords(len(languages))
    bits = code.shape[1]
    if not bits:
        return Model(languages, code, np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), np.zeros(0, np.float32))
    out = weighing(len(rows))
    x, y = rows[out:], code[labels[out:]]
    middle = x.mean(axis=0)
    rows -= middle
    squares = np.concatenate([(x[at : at + TEXTS] ** 2).sum(axis=1) for at in range(0, len(x), TEXTS)])
    step = 4 / max(1e-3, float(squares.mean()))
    w = ahead = np.zeros((BUCKETS, bits), np.float32)
    b = b_ahead = np.zeros(bits, np.float32)
    for k in range(ROUNDS):
        pull = -y / (1 + np.exp(np.clip(y * (x @ ahead + b_ahead), -30, 30))) / len(x)
        w_next, b_next = ahead - step * (x.T @ pull + 1e-5 * ahead), b_ahead - pull.sum(axis=0)
        push = k / (k + 3)
        ahead, b_ahead = w_next + push * (w_next - w), b_next + push * (b_next - b)
        w, b = w_next, b_next
    held = (rows[:out] if out else x) @ w + b
    wrong = ((held > 0) != (code[labels[:out] if out else labels] > 0)).mean(axis=0)
    trust = np.log((1.01 - wrong) / (wrong + 0.01)).clip(0.05)
    return Model(languages, code, w.astype(np.float32), (b - middle @ w).astype(np.float32), (trust / trust.sum()).astype(np.float32))


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Model of rows (doc_id, text, lang); rows without lang, text or doc_id teach nothing."""
    known = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row for each language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 0), np.float32), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), np.zeros(0, np.float32))
    each = sample / len(languages)
    limit = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(int(min(1.0, each / n) * (1 << 31)))) for lang, n in sizes.items()])
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < limit)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([zlib.compress(features(t.as_py()).astype("<f2").tobytes(), 1) for t in texts], pa.binary())

    rows = drawn.select("doc_id", "lang", F.arrow_udf(run, "binary")(F.col("text")).alias("x")).collect()
    if not rows:
        return train(labelled, sample * 2)
    by = itemgetter("doc_id", "lang")
    rows = [r for _, same in groupby(sorted(rows, key=by), by) for r in sorted(same, key=lambda r: zlib.decompress(r["x"]))]
    if weighing(len(rows)):
        rows = rows[::5] + [r for k, r in enumerate(rows) if k % 5]
    place = {lang: i for i, lang in enumerate(languages)}
    x = np.empty((len(rows), BUCKETS), np.float32)
    for k, r in enumerate(rows):
        x[k] = np.frombuffer(zlib.decompress(r["x"]), "<f2")
    return fit(x, np.array([place[r["lang"]] for r in rows], np.int64), languages)


def predict(text: Column, model: Model) -> Column:
    """Struct (lang_pred, score, ambiguous) of a text column."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(texts: pa.Array) -> pa.Array:
        rows = [row for at in range(0, len(texts), TEXTS) for row in model.predict(texts.slice(at, TEXTS).to_pylist())]
        return pa.array([{"lang_pred": lang, "score": score, "ambiguous": close} for lang, score, close in rows], kind)

    # Marked so that a filter on the prediction does not make it a second time.
    return F.arrow_udf(run, PREDICTION).asNondeterministic()(text)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
