import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from odd_rows import ODD

from larder.llm import alignment as al
from larder.llm.vocabularies import path_of

ALPHABET = [*"abc ABC  '’s.!?\n\t0123▁_-<|>é日本ﬁİ́ 　\x1c\x00\x85²½", " the", " end", "of", "text|>", "<|endoftext|>", "</s>", "<s>", "<0x41>", "'re", " 's", "  "]


@pytest.fixture(scope="module")
def tool():
    return al.aligner(path_of("byte_bpe_50k.json"), path_of("piece_bpe_32k.model"))


def whole(tool, text):
    """(A ids, B ids, groups, links) of a text encoded whole, by comparing all tokens; None without tokens."""
    if not text:
        return None
    own = b" " + text.encode()
    a, b = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text, num_threads=1)
    spelt_a, spelt_b = [tool.bytes_a[i] for i in a], [tool.bytes_b[i] for i in b]
    if b"".join(spelt_a) != own or b"".join(spelt_b) != own:
        return None
    ends_a, ends_b = np.cumsum([0, *map(len, spelt_a)]), np.cumsum([0, *map(len, spelt_b)])
    cuts = sorted(set(ends_a[1:].tolist()) & set(ends_b[1:].tolist()))
    places = [(np.searchsorted(ends_a[1:], c, "right"), np.searchsorted(ends_b[1:], c, "right")) for c in [0, *cuts]]
    groups = ";".join(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])) for (i, j), (k, m) in zip(places, places[1:], strict=False))
    links = [(a[x], b[y]) for x, y in zip(*np.nonzero((ends_a[:-1, None] < ends_b[None, 1:]) & (ends_b[None, :-1] < ends_a[1:, None])), strict=True)]
    return a, b, groups, links


def expected(tool, rows):
    found = [(i, whole(tool, t)) for i, t in rows]
    counts = Counter(link for _, w in found if w for link in w[3])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    out = []
    for i, w in found:
        if w is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = w
        best = sum(counts[link] == highest[link[1]] for link in links)
        out.append((i, len(a), len(b), groups.count(";") + 1, len(links), best, sum(counts[link] for link in links), hashlib.sha256(groups.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_pointers():
    ends_a, ends_b = np.array([2, 5, 6, 9]), np.array([1, 3, 6, 9])
    assert al.terminals(ends_a, ends_b).tolist() == [6, 6, 6, 7, 6, 6, 6, 7]
    assert al.terminals(np.array([], np.int64), np.array([], np.int64)).tolist() == []
    chain_a, chain_b = np.array([*range(2, 2001, 2), 2001]), np.arange(1, 2002, 2)
    assert set(al.terminals(chain_a, chain_b).tolist()) == {2001}


def test_pieces_join_to_texts_encoded_whole(tool):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    row = al.describe(tool, 0, pa.array(range(len(texts))), texts)
    figures, groups = np.array(row.column("figures")[0].as_py()).reshape(-1, 4), row.column("groups")[0].as_py()
    some = 0
    for own, digest, text in zip(figures.tolist(), groups, texts, strict=True):
        w = whole(tool, text)
        some += w is not None
        assert own == ([len(w[0]), len(w[1]), w[2].count(";") + 1, len(w[3])] if w else [0] * 4), text
        assert digest == (hashlib.sha256(w[2].encode()).hexdigest() if w else "")
    assert some > 1000


def test_counts_over_blocks(spark, tool, monkeypatch):
    monkeypatch.setattr(al, "BLOCK_CHARS", 200)
    rng = random.Random(8)
    words = ["the", "tokens", "alignment", "überall", "日本語", "x1y2", "don't", "a\nb", "▁"]
    rows = [(k, " ".join(rng.choice(words[: 8 + (k % 9 == 0)]) for _ in range(rng.randrange(1, 30)))) for k in range(120)]
    got = al.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(tool, rows)


def test_odd_rows(tool, odd, none):
    assert sorted(map(tuple, al.align(odd).collect()), key=repr) == expected(tool, ODD)
    assert al.align(none).count() == 0


def test_no_value_holds_what_a_block_asks_for_and_files_are_cut_by_bytes(spark, tool, monkeypatch):
    """Counts reach a block as rows, and a reader never holds all rows of a file of blocks at once."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(al, "BLOCK_CHARS", 2000)
    monkeypatch.setitem(al.ROW_GROUPS, "parquet.block.size", "20000")
    monkeypatch.setattr(F, "collect_list", None)
    rng = random.Random(3)
    rows = [(k, " ".join(f"{rng.randrange(10**6)} token{rng.randrange(99)}" for _ in range(60))) for k in range(120)]
    made, real = [], al.blocks
    monkeypatch.setattr(al, "blocks", lambda *a: made.append(real(*a)) or made[0])
    got = al.align(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(tool, rows)
    import pyarrow.parquet as pq

    files = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")).metadata for f in made[0].inputFiles()]
    cuts = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(cuts) > 30 and max(cuts) <= 8
