"""Toxicity: a noisy channel undoes disguises, then the restored text is scored.

Writers disguise a word by digits and signs for letters, by gaps between letters and by repeated letters.
For a disguised stretch the channel spans a lattice: each sign stands for some letters, a gap or a repeated
letter may be dropped. The best path under a trigram model of characters (Viterbi) is the restored word. The
character model is counted over the whole corpus. Words without a disguise have one path and stay as they are.

A word's features are the word and its first four and five letters, hashed. How many toxic and other labelled
rows hold a feature is counted over the rows to learn from, a bounded sample of the labelled ones (`LEARNED`,
drawn by hash of doc_id), so that their ids can be sent to the texts and no text is shuffled; features that lean to toxic rows beyond chance
(G-test) get their log odds as weight. A word weighs as much as its heaviest feature, and a logistic curve
over the heaviest word and the capped sum, fitted on a fifth of these rows that was kept out of the counts,
turns weights into a score.

Null and empty texts score as a text without evidence. Without labelled rows of both kinds every score is the
share of toxic rows (0 if none). Repeated rows score alike, extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of characters: 0 for all that is no letter of the Latin alphabet, then a to z.
CLASSES = 27
FEATURES = 1 << 20
#: Labelled rows to learn from (about), and of these the share that the logistic curve is fitted on.
LEARNED, KEPT_OUT = 50_000, 5
#: Least G statistic and rows of a feature; most that all words of a text add up to.
G_LEAST, ROWS_LEAST, CAP = 20.0, 3, 20.0
#: Words a worker remembers.
REMEMBERED = 1 << 20
SLICE = 1 << 20

# Signs and the letters they stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i",
}
# Log costs of the channel: a sign for a letter, a masked letter, a dropped sign, a dropped repetition.
SIGN, MASK, DROP, REPEAT = -0.7, -3.5, -7.0, -0.4

_GAPS = re.compile(r"(?<!\w)[^\W\d_](?:[ .*_\-]{1,2}[^\W\d_](?!\w)){2,}")
_EDGES = " \t\r\n.,;:?\"'()[]{}<>#%&/\\=~^`“”«»¿…-_"
_THRICE = re.compile(r"([^\W\d_])\1\1")
_LETTER = re.compile(r"[^\W\d_]")
_HOLDS_SIGN = re.compile("[" + re.escape("".join(LEET)) + "*]")


def _class_table() -> np.ndarray:
    table = np.zeros(1 << 16, np.uint16)
    for code in range(0x250):
        base = fold(chr(code).lower())[:1]
        if base and "a" <= base <= "z":
            table[code] = ord(base) - 96
    return table


def fold(word: str) -> str:
    """Lower case without accents."""
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFKD", word.replace("ß", "ss")) if not unicodedata.combining(c))


_TABLE = _class_table()


def trigrams(text: str) -> np.ndarray:
    """Counts of trigrams of character classes; runs of other characters count as one."""
    counts = np.zeros(CLASSES**3, np.int64)
    for at in range(0, len(text), SLICE):
        kinds = _TABLE[np.frombuffer(("  " + text[at : at + SLICE] + " ").encode("utf-16-le", "surrogatepass"), "<u2")]
        kinds = kinds[(kinds > 0) | np.concatenate(([True], kinds[:-1] > 0))].astype(np.int32)
        if len(kinds) > 2:
            counts += np.bincount(kinds[:-2] * CLASSES**2 + kinds[1:-1] * CLASSES + kinds[2:], minlength=CLASSES**3)
    return counts


def character_model(texts: DataFrame) -> list[float]:
    """Log probability of each class after two others, counted over the column text of all rows.

    A task sends one row for each trigram it has seen, 27 ** 3 at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts += trigrams(text.as_py() or "")
        seen = np.nonzero(counts)[0]
        yield pa.record_batch([pa.array(seen), pa.array(counts[seen])], names=["trigram", "n"])

    counts = np.zeros(CLASSES**3)
    for row in texts.select("text").mapInArrow(run, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        counts[row["trigram"]] = row["n"]
    cube = counts.reshape(CLASSES, CLASSES, CLASSES)
    two, one = cube.sum(axis=0), cube.sum(axis=(0, 1)) + 1
    lower = (two + 5 * one / one.sum()) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((cube + 5 * lower[None]) / (cube.sum(axis=2, keepdims=True) + 5)).ravel().tolist()


def decode(observed: str, model: list[float]) -> str:
    """Best letters for a disguised stretch of any length: Viterbi over (last two classes).

    A path is its last letter and the path before, so a step costs the same at any length.
    """
    paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    before = ""
    for sign in observed:
        if "a" <= sign <= "z":
            options = [(sign, 0.0)]
            drop = REPEAT if sign == before else None
        elif sign in LEET:
            options, drop = [(letter, SIGN - math.log(len(LEET[sign]))) for letter in LEET[sign]], DROP
        elif sign == "*":
            options, drop = [(chr(97 + i), MASK) for i in range(26)], DROP
        elif _LETTER.match(sign):
            options, drop = [(sign, 0.0)], None
        else:
            options, drop = [], 0.0
        grown: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, word) in paths.items():
            if drop is not None and (score + drop > grown.get((a, b), (-math.inf,))[0]):
                grown[a, b] = (score + drop, word)
            for letter, cost in options:
                c = ord(letter) - 96 if "a" <= letter <= "z" else 0
                reached = score + cost + model[(a * CLASSES + b) * CLASSES + c]
                if reached > grown.get((b, c), (-math.inf,))[0]:
                    grown[b, c] = (reached, (word, letter))
        paths, before = grown or paths, sign
    ends = [(score + model[(a * CLASSES + b) * CLASSES], word) for (a, b), (score, word) in paths.items()]
    most = max(score for score, _ in ends)
    return max(_spelled(word) for score, word in ends if score == most)


def _spelled(word: tuple) -> str:
    letters = []
    while word:
        word, letter = word
        letters.append(letter)
    return "".join(reversed(letters))


def restore_word(token: str, model: list[float]) -> tuple[str, bool]:
    """Folded letters of a token between white space, and whether the channel was needed."""
    core = fold(token.strip(_EDGES).rstrip("!*"))
    signs = len(_HOLDS_SIGN.findall(core))
    if signs:  # three or more equal signs at the end are decoration
        core = re.sub(r"([$@!|+*])\1\1+$", "", core)
        signs = len(_HOLDS_SIGN.findall(core))
    letters = len(_LETTER.findall(core))
    if signs and letters >= 1 and letters + signs >= 3 and 3 * signs <= 2 * (letters + signs):
        return decode(core, model), True
    if _THRICE.search(core):
        return decode(core, model), True
    return core, False


def restore(text: str, model: list[float]) -> str:
    """The text with disguised stretches restored, in lower case."""
    lower = _GAPS.sub(lambda m: decode(fold(m[0]), model), text.lower())
    return " ".join(restore_word(token, model)[0] for token in lower.split())


def _ids(word: str) -> list[int]:
    whole = word.encode()
    return [zlib.crc32(b"w" + whole) % FEATURES, *(zlib.crc32(b"p" + word[:n].encode()) % FEATURES for n in (4, 5) if len(word) > n)]


def _tokens(text: str, model: list[float]) -> set[str]:
    """Distinct tokens, gaps already closed; a closed one is marked by a leading blank."""
    lower = text.lower()
    if _GAPS.search(lower):
        lower = _GAPS.sub(lambda m: " \x00" + decode(fold(m[0]), model) + " ", lower)
    return set(lower.split())


def _parts(token: str, model: list[float]) -> Iterator[str]:
    """Words to look up for a token: a restored one may be glued to its neighbours, so all its windows are."""
    word, undone = (token[1:], True) if token[:1] == "\x00" else restore_word(token, model)
    yield word
    if undone:
        yield from (word[i : i + n] for n in range(4, 13) for i in range(len(word) - n + 1))


@dataclass
class Model:
    characters: list[float]
    weights: dict[int, float]
    curve: tuple[float, float, float]
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def _weight(self, token: str) -> float:
        return max((self.weights.get(i, 0.0) for part in _parts(token, self.characters) for i in _ids(part)), default=0.0)

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Weight of the heaviest word and of all words together, both capped."""
        if not text or not self.weights:
            return 0.0, 0.0
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, found = self.known, []
        for token in _tokens(text, self.characters):
            weight = known.get(token)
            if weight is None:
                weight = known[token] = self._weight(token)
            if weight:
                found.append(weight)
        return (min(CAP, max(found)), min(CAP, math.fsum(sorted(found)))) if found else (0.0, 0.0)

    def score(self, text: str | None) -> float:
        most, total = self.evidence(text)
        bias, a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + a * most + b * total))))


def _counted(rows: DataFrame, characters: list[float]) -> dict[int, tuple[int, int]]:
    """{feature: (other rows, toxic rows)} of the features that lean to toxic rows.

    Features are counted in each task before the shuffle; what is collected has passed the test.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = np.zeros((2, FEATURES), np.int32), {}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                held: set[int] = set()
                for token in _tokens(text.as_py(), characters):
                    ids = known.get(token)
                    if ids is None:
                        if len(known) > REMEMBERED // 4:
                            known.clear()
                        ids = known[token] = tuple(_ids(token[1:] if token[:1] == "\x00" else restore_word(token, characters)[0]))
                    held.update(ids)
                counts[toxic.as_py(), list(held)] += 1
        seen = np.nonzero(counts.any(axis=0))[0]
        for at in range(0, len(seen), 1 << 16):
            some = seen[at : at + (1 << 16)]
            yield pa.record_batch([pa.array(some), pa.array(counts[0, some], pa.int64()), pa.array(counts[1, some], pa.int64())], names=["f", "c0", "c1"])

    sizes = rows.agg(F.count_if(F.col("toxic") == 0).alias("n0"), F.count_if(F.col("toxic") == 1).alias("n1")).first()
    if not sizes["n0"] or not sizes["n1"]:
        return {}
    counts = rows.select("text", "toxic").mapInArrow(run, "f long, c0 long, c1 long").groupBy("f").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    share = sizes["n1"] / (sizes["n0"] + sizes["n1"])
    n = F.col("c0") + F.col("c1")
    part = lambda c, p: F.when(c > 0, c * F.log(c / (n * p))).otherwise(0.0)
    g = 2 * (part(F.col("c1"), share) + part(F.col("c0"), 1 - share))
    leaning = counts.where((F.col("c1") >= ROWS_LEAST) & (F.col("c1") > n * share) & (g >= G_LEAST)).orderBy(g.desc(), "f").limit(FEATURES >> 4)
    return {
        r["f"]: math.log((r["c1"] + 0.5) / (sizes["n1"] + 1)) - math.log((r["c0"] + 0.5) / (sizes["n0"] + 1)) for r in leaning.collect()
    }


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a ridge: Newton steps, halved until the loss falls.

    The ridge keeps the curve finite where evidence parts the rows without a mistake.
    """
    if not len(y):
        return (-30.0, 0.0, 0.0)
    x, w = np.column_stack((np.ones(len(x)), x / CAP)), np.zeros(3)
    ridge = np.array([1e-6, 0.005, 0.005])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -(2 * y - 1) * (x @ w)).sum() + 0.5 * (ridge * w * w).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge) + 1e-9 * np.eye(3), slope)
        scale, before = 1.0, loss(w)
        while scale > 1e-6 and loss(w + scale * step) > before:
            scale /= 2
        w = w + scale * step if scale > 1e-6 else w
        if np.abs(scale * step).max() < 1e-6 or scale <= 1e-6:
            break
    return (float(w[0]), float(w[1] / CAP), float(w[2] / CAP))


def train(docs: DataFrame, labels: DataFrame, learned: int = LEARNED) -> Model:
    """Model from the texts of all documents (doc_id, text) and labels (doc_id, toxic) to learn from.

    A doc_id with several labels is toxic if one of them says so. About `learned` labels are drawn; their ids
    are broadcast to the texts, a table whose size this parameter bounds.
    """
    characters = character_model(docs)
    given = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and _id is not null")
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 31))
    share = int(min(1.0, learned / max(1, given.count())) * (1 << 31))
    drawn = given.where(place < share).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")
    draw, bound = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 31)), (1 << 31) // KEPT_OUT
    weights = _counted(known.where(draw >= bound), characters)
    model = Model(characters, weights, (0.0, 0.0, 0.0))

    def run(texts: pa.Array) -> pa.Array:
        pairs = [model.evidence(t.as_py()) for t in texts]
        return pa.array([{"most": m, "total": t} for m, t in pairs], pa.struct([("most", pa.float64()), ("total", pa.float64())]))

    kept = known.where(draw < bound).select("toxic", F.arrow_udf(run, "struct<most:double,total:double>")(F.col("text")).alias("e"))
    sample = sorted(tuple(r) for r in kept.select("toxic", "e.most", "e.total").collect())
    x, y = np.array([r[1:] for r in sample], float).reshape(len(sample), 2), np.array([r[0] for r in sample], float)
    return Model(characters, weights, _curve(x, y))


def score(text: Column, model: Model) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return F.arrow_udf(run, "double")(text)


def restored(text: Column, model: Model) -> Column:
    """The restored text itself; null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t.as_py() is None else restore(t.as_py(), model.characters) for t in texts], pa.string())

    return F.arrow_udf(run, "string")(text)
