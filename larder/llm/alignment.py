"""Alignment of two tokenizers' tokens: groups of tokens that overlap, and how often token ids meet.

A side is a byte-level BPE on the text behind a space, B side a SentencePiece model that puts that space itself. In
the order of their ends (B behind A on ties) every token points to its farthest-right overlapping token, which may be
itself: an A token to the B token that holds its last byte, a B token to the A token that does if that one ends
later. Squaring the pointers doubles the steps, until each token points to the terminal token of its component,
which names its group; so all tokens of a batch of texts are grouped in as many vector operations as the longest
chain has binary digits. Links are the overlapping pairs: one for each stretch between neighbouring ends.

Neither tokenizer lets a token reach over a single blank between visible characters, so texts are cut there and a
worker groups each different piece once while it remembers it. Texts are handled in blocks of about BLOCK_CHARS
characters. A block keeps one row with its pieces, its links and how often it holds each pair of ids; pairs are counted
over all blocks, and each block asks only for the counts of its own pairs. So no text is moved.

Null and empty texts have no tokens, nor have texts whose tokens do not spell their bytes (a text that holds U+2581):
all counts are zero, the digest is ''. Rows are independent: repeated rows and null ids stay as they are, further
columns are ignored, an empty table has an empty result. No text is cut short; a very long one is a block of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larder.llm.components import _kept, _release
from larder.llm.vocabularies import path_of

BLOCK_CHARS = 1 << 20
#: Characters of pieces that a worker remembers, pieces that are encoded in a row.
REMEMBERED, TOGETHER = 1 << 20, 256
#: A block's row has megabytes: files are cut by bytes, looked at after each row, as a reader holds the rows of a cut at once.
ROW_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}
SPACE = "▁"
#: Where texts can be cut: at a blank before a visible character and behind anything but a blank.
CUT = re.compile(r"(?<=[^ ]) (?=[\w!-~])")
VISIBLE = re.compile(r"[\w!-~]")
#: A blank that is no such place.
UNCUT = re.compile(r"\A | (?:[^\w!-~]|\Z)")


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest for U+0100 onwards."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


def successors(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Place of each token's farthest-right overlapping token; A tokens come first, then B tokens."""
    n = len(ends_a)
    holder_of_a = np.searchsorted(ends_b, ends_a)
    holder_of_b = np.searchsorted(ends_a, ends_b)
    later = ends_a[np.minimum(holder_of_b, n - 1)] > ends_b if n else np.zeros(len(ends_b), bool)
    return np.concatenate((n + holder_of_a, np.where(later, holder_of_b, n + np.arange(len(ends_b)))))


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Place of the terminal token of each token's component, by doubling the successors."""
    to = successors(ends_a, ends_b)
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


def links_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and the B token of each overlapping pair, from left to right."""
    cuts = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)


def _gathered(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of stretches one behind the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Aligner:
    """Both tokenizers and what is known of pieces: counts, the written groups, the links' pairs of ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        tokens = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        if any(SPACE in p.lstrip(SPACE) for i, p in enumerate(pieces) if not self.b.is_control(i) and not self.b.is_unknown(i)):
            raise ValueError("pieces must not go on past a blank")
        self.sizes_a = np.array([len(b) for b in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(b) for b in self.bytes_b], np.int64)
        #: Ids in decimal digits, each with room for what comes behind it.
        decimals = [f"{i} ".encode() for i in range(max(len(tokens), len(pieces)))]
        self.decimal_sizes = np.array([len(d) for d in decimals], np.int64)
        self.decimal_begins = np.cumsum(self.decimal_sizes) - self.decimal_sizes
        self.decimals = np.frombuffer(b"".join(decimals), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        #: n_a, n_b, n_groups, n_links, valid of each piece; its written groups; where its links' pairs begin.
        self.figures = np.empty((0, 5), np.int64)
        self.written: list[bytes] = []
        self.begins = np.empty(0, np.int64)
        self.pairs = np.empty(0, np.int64)

    def _spelt(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of a text, or none if they do not spell it."""
        return self._all_spelt([text])[0]

    def _all_spelt(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        out, name_a, name_b = [], self.bytes_a.__getitem__, self.bytes_b.__getitem__
        coded_a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        for text, a, b in zip(texts, coded_a, self.b.encode(texts, num_threads=1), strict=True):
            a, own = a.ids, (" " + text).encode()
            out.append((a, b) if b"".join(map(name_a, a)) == own == b"".join(map(name_b, b)) else None)
        return out

    def learn(self, pieces: list[str]) -> None:
        """Encode, group and link some new pieces at once; many are encoded in a row, with the blanks between them."""
        plain = [p for p in pieces if VISIBLE.match(p) and p[-1] != " "]
        rows = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        coded = self._all_spelt([" ".join(row) for row in rows])
        single = [p for p in pieces if not VISIBLE.match(p) or p[-1] == " "] + [p for row, ids in zip(rows, coded, strict=True) if ids is None for p in row]
        alone = self._all_spelt(single)
        wrong = [p for p, ids in zip(single, alone, strict=True) if ids is None]
        good = [p for row, ids in zip(rows, coded, strict=True) if ids for p in row] + [p for p, ids in zip(single, alone, strict=True) if ids]
        found = [ids for ids in [*coded, *alone] if ids]
        ids_a, ids_b = (np.fromiter(chain.from_iterable(ids[side] for ids in found), np.int64) for side in (0, 1))
        ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        ends = np.cumsum(pc.binary_length(pa.array(good, pa.string())).to_numpy().astype(np.int64) + 1)
        group = terminals(ends_a, ends_b) - len(ids_a)
        group_a, group_b = group[: len(ids_a)], group[len(ids_a) :]
        last = np.flatnonzero(group_b == np.arange(len(ids_b)))  # a group ends with its terminal B token
        link_a, link_b = links_of(ends_a, ends_b)
        cuts = np.maximum(ends_a[link_a] - self.sizes_a[ids_a[link_a]], ends_b[link_b] - self.sizes_b[ids_b[link_b]])
        of_links = np.searchsorted(cuts, ends)
        upto = np.column_stack([np.searchsorted(ends_a, ends, "right"), np.searchsorted(ends_b, ends, "right"), np.searchsorted(ends_b[last], ends, "right"), of_links])
        figures = np.column_stack([np.diff(upto, axis=0, prepend=0), np.ones(len(good), np.int64)])
        # Written: in each group the A ids, then the B ids.
        at_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
        ids, behind = np.empty(len(at_a) + len(at_b), np.int64), np.full(len(at_a) + len(at_b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = ids_a, ids_b
        behind[at_a[np.searchsorted(group_a, last, "right") - 1]] = ord("|")
        behind[at_b[last]] = ord(";")
        sizes = self.decimal_sizes[ids]
        letters, borders = self.decimals[_gathered(self.decimal_begins[ids], sizes)], np.cumsum(sizes)
        letters[borders - 1] = behind
        tokens = np.cumsum(figures[:, 0] + figures[:, 1])
        written, borders = letters.tobytes(), np.concatenate(([0], borders))[np.concatenate(([0], tokens))].tolist()
        self.known.update(zip(good, range(len(self.written), len(self.written) + len(good)), strict=True))
        self.written += [written[i:j] for i, j in zip(borders, borders[1:], strict=False)]
        self.begins = np.concatenate((self.begins, len(self.pairs) + of_links - figures[:, 3], np.zeros(len(wrong), np.int64)))
        self.pairs = np.concatenate((self.pairs, ids_a[link_a] << 32 | ids_b[link_b]))
        self.known.update(zip(wrong, range(len(self.written), len(self.written) + len(wrong)), strict=True))
        self.written += [b""] * len(wrong)
        self.figures = np.concatenate((self.figures, figures, np.zeros((len(wrong), 5), np.int64)))
        self.chars += sum(map(len, pieces))

    def places(self, pieces: list[str]) -> np.ndarray:
        """Places of different pieces among what is known; new ones are learnt."""
        found = list(map(self.known.get, pieces))
        if None in found:
            self.learn([p for p, at in zip(pieces, found, strict=True) if at is None])
            found = map(self.known.__getitem__, pieces)
        return np.fromiter(found, np.int64, len(pieces))


def pieces_of(text: str) -> list[str]:
    """The pieces of a text that no token of either side reaches over; each is encoded behind a blank."""
    if not text:
        return []
    return text.split(" ") if UNCUT.search(text) is None else CUT.split(text)


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("figures", pa.list_(pa.int64())),
        ("groups", pa.list_(pa.string())),
        ("sizes", pa.list_(pa.int32())),
        ("pieces", pa.list_(pa.int32())),
        ("link_sizes", pa.list_(pa.int32())),
        ("links", pa.list_(pa.int32())),
        ("pairs", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())),
    ]
)
BLOCK_TYPE = (
    "block long, doc_ids array<long>, figures array<long>, groups array<string>, sizes array<int>, pieces array<int>, "
    "link_sizes array<int>, links array<int>, pairs array<long>, counts array<long>"
)


def describe(tool: Aligner, block: int, doc_ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    """One row for a block of texts.

    figures holds n_a, n_b, n_groups, n_links of each text; sizes and pieces its pieces, as places among those of the
    block; link_sizes and links the links of each of these, as places in pairs; counts how often the block has a pair.
    """
    if tool.chars > REMEMBERED:
        tool.forget()
    parts = [pieces_of(t or "") for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    coded = pa.array(chain.from_iterable(parts), pa.string()).dictionary_encode()
    parts = None
    own = coded.dictionary.to_pylist()
    found = tool.places(own)
    at = coded.indices.to_numpy().astype(np.int64)
    per = tool.figures[found]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    sums = np.concatenate((np.zeros((1, 5), np.int64), np.cumsum(per[at], axis=0)))
    totals = sums[ends[1:]] - sums[ends[:-1]]
    good = (sizes > 0) & (totals[:, 4] == sizes)
    for k in np.flatnonzero((sizes > 0) & ~good).tolist():
        if tool._spelt(texts[k]):
            raise ValueError("a text is spelt by its tokens, but not by those of its pieces")
    written, digests = [tool.written[i] for i in found.tolist()], []
    for i, j, has in zip(ends[:-1].tolist(), ends[1:].tolist(), good.tolist(), strict=True):
        digests.append(hashlib.sha256(b"".join([written[p] for p in at[i:j].tolist()])[:-1]).hexdigest() if has else "")
    totals[~good] = 0
    at, sizes = at[np.repeat(good, sizes)], np.where(good, sizes, 0)
    # Links only of pieces in texts that have tokens.
    times = np.bincount(at, minlength=len(own))
    link_sizes = np.where(times > 0, per[:, 3], 0)
    pairs, links = np.unique(tool.pairs[_gathered(tool.begins[found], link_sizes)], return_inverse=True)
    counts = np.bincount(links, weights=np.repeat(times, link_sizes), minlength=len(pairs)).astype(np.int64)
    lists = [doc_ids, pa.array(totals[:, :4].ravel()), pa.array(digests, pa.string()), *(pa.array(x.astype(np.int32)) for x in (sizes, at, link_sizes, links)), pa.array(pairs), pa.array(counts)]
    wrapped = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
    return pa.record_batch([pa.array([block]), *wrapped], schema=BLOCK)


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _joined(made: pa.Table, known: pa.Table) -> pa.Table:
    """Rows of the texts of a block from its row and the counts it asked for, as (place, count, is the highest of its B id)."""
    one = {n: made.column(n)[0].values for n in ("doc_ids", "figures", "groups", "sizes", "pieces", "link_sizes", "links")}
    count, best = (np.zeros(made.column("n_pairs")[0].as_py(), np.int64) for _ in range(2))
    place = known.column("place").to_numpy()
    count[place] = known.column("count").to_numpy()
    best[place] = known.column("best").to_numpy()
    links, link_sizes = one["links"].to_numpy(), one["link_sizes"].to_numpy().astype(np.int64)
    pieces, sizes = one["pieces"].to_numpy(), one["sizes"].to_numpy().astype(np.int64)

    def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total, ends = np.concatenate(([0], np.cumsum(values))), np.concatenate(([0], np.cumsum(sizes)))
        return total[ends[1:]] - total[ends[:-1]]

    n_best, count_sum = (summed(summed(v[links], link_sizes)[pieces], sizes) for v in (best, count))
    figures = one["figures"].to_numpy().reshape(len(one["doc_ids"]), 4)
    columns = [one["doc_ids"], *(pa.array(figures[:, i]) for i in range(4)), pa.array(n_best), pa.array(count_sum), one["groups"]]
    return pa.table(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each block of texts of (doc_id, text); kept, since a block is named by the task that made it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, made = aligner(path_a, path_b), 0
        for batch in batches:
            begin = chars = 0
            for i, size in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
                chars += size or 0
                if chars >= BLOCK_CHARS or i == batch.num_rows - 1:
                    block, rows = TaskContext.get().partitionId() << 32 | made, batch.slice(begin, i + 1 - begin)
                    yield describe(tool, block, rows.column(0), rows.column(1).to_pylist())
                    begin, chars, made = i + 1, 0, made + 1
        tool.forget()
        _release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _kept(rows.mapInArrow(run, BLOCK_TYPE), "blocks", **ROW_GROUPS)


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, count, best): links of all texts by pair (A id << 32 | B id), best where no other A id has more with the B id."""
    asked = made.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    counts = _kept(asked.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    highest = counts.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("count").alias("highest"))
    same = counts.join(highest, F.col("pair").bitwiseAND(0xFFFFFFFF) == F.col("b"))
    return same.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs (doc_id, text)."""
    made = blocks(docs, path_a or path_of("byte_bpe_50k.json"), path_b or path_of("piece_bpe_32k.model"))
    counts = pair_counts(made)
    asked = made.select("block", F.posexplode("pairs").alias("place", "pair"))
    known = asked.join(counts.withColumnRenamed("pair", "_pair"), F.col("pair") == F.col("_pair")).select(F.col("block").alias("_block"), "place", "count", "best")
    own = made.select(*[c for c in made.columns if c not in ("pairs", "counts")], F.size("pairs").alias("n_pairs"))
    return own.groupBy("block").cogroup(known.groupBy("_block")).applyInArrow(_joined, RESULT)
