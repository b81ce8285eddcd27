from itertools import combinations
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from odd_rows import ODD

from larder.llm import nearcopies, simhash

SF = "/root/testdata/sf0.01"
KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def held(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept_plain(rows):
    """Places of the rows that stay, by comparing every pair that shares a shingle."""
    sets = [held(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by, seen = {}, {}
    for k, s in enumerate(sets):
        first = seen.setdefault(s, k)
        if first != k:
            root[find(k)] = find(first)
        else:
            for shingle in s:
                by.setdefault(shingle, []).append(k)
    for a, b in {p for some in by.values() for p in combinations(some, 2)}:
        if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            root[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(rows):
        best.setdefault(find(k), []).append(i)
    return sorted((min((i for i in ids if i is not None), default=None) for ids in best.values()), key=repr)


def near_dedup(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], KINDS)
    return sorted((r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()), key=repr)


def test_every_pair_of_the_similarity(spark):
    """Words exchanged here and there, from far above to just below 0.8, in texts of 1 to 900 words."""
    rng, rows = np.random.default_rng(5), []
    for n in (1, 3, 5, 6, 9, 40, 41, 200, 900):
        base = [f"w{x}" for x in rng.integers(0, 5000, n)]
        for changes in sorted({0, 1, 2, n // 60, n // 45, n // 40, n // 20}):
            copy = list(base)
            for at in rng.choice(n, min(n, changes), replace=False):
                copy[at] = f"x{rng.integers(0, 1 << 30)}"
            rows.append((len(rows), " ".join(copy)))
        rows.append((len(rows), " ".join(base[n // 5 :])))
        rows.append((len(rows), " ".join(base[n // 10 :])))
    expected = kept_plain(rows)
    assert len(expected) < len({t for _, t in rows})
    assert near_dedup(spark, rows) == expected


def test_chain_and_odd_rows(spark):
    words = [f"w{k}" for k in range(300)]
    rows = [*ODD, *((100 + k, " ".join(words[10 * k : 10 * k + 100])) for k in range(20))]
    assert near_dedup(spark, rows) == kept_plain(rows)


def test_sketch_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for n, m, common in ((10, 12, 9), (100, 100, 90), (500, 620, 480), (3000, 2500, 0), (1, 900, 1)):
        pool = np.unique(rng.integers(0, 1 << 63, n + m, np.uint64))
        a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:common], pool[n : n + m - common])))
        assert nearcopies.apart(nearcopies.sketch(a), nearcopies.sketch(b)) <= len(np.setxor1d(a, b))


def test_forest_spans_the_groups_of_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 3000)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 6, replace=False).astype(np.uint64)) for _ in range(500)])
    prints, sizes = base[rng.integers(0, 60, 500)] ^ flips, rng.integers(50, 90, 500)
    places = np.arange(500)
    a, b = simhash.near_forest(prints, sizes, places, places, 10, lambda a, b: (a + b) % 5 / 3)

    def roots(a, b):
        groups = simhash._Groups(500)
        groups.link(a, b)
        return groups.least.tolist()

    x, y = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 10)
    fits = (x != y) & (5 * np.minimum(sizes[x], sizes[y]) >= 4 * np.maximum(sizes[x], sizes[y])) & ((x + y) % 5 <= 3)
    x, y = x[fits], y[fits]
    assert set(zip(a.tolist(), b.tolist(), strict=True)) <= set(zip(x.tolist(), y.tolist(), strict=True))
    assert roots(a, b) == roots(x, y) and len(a) == 500 - len(set(roots(x, y)))


def test_a_refused_pair_does_not_stand_for_others(monkeypatch):
    """Sets 0..29 look alike in sketches, but only pairs of the same third are near: later forests give those, none twice."""
    monkeypatch.setattr(simhash, "PAIRS", 2000)
    prints, sizes, places = np.zeros(30, np.uint64), np.full(30, 50), np.arange(30)
    seen = []

    def unlike(a, b):
        return np.where(a % 3 == b % 3, 0.6, 0.5)

    def confirmed(forests):
        a, b = simhash.near_forest(prints, sizes, places, places, 14, unlike, forests)
        seen.append(sorted({(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}))
        assert len(seen[-1]) == len(a) <= forests * 29
        groups, near = simhash._Groups(30), a % 3 == b % 3
        groups.link(a[near], b[near])
        return len(set(groups.least.tolist()))

    assert confirmed(1) == 30 and confirmed(8) < 30 and confirmed(30) == 3
    assert set(seen[0]) <= set(seen[1]) <= set(seen[2])


def test_fingerprints_and_shards_find_near_copies(spark, monkeypatch):
    """Without the exact way for what they let pass, over several shards."""
    rng, rows = np.random.default_rng(8), []
    for k in range(120):
        base = [f"w{x}" for x in rng.integers(0, 5000, 240)]
        rows.append((2 * k, " ".join(base)))
        base[int(rng.integers(0, 240))] = "other"
        rows.append((2 * k + 1, " ".join(base)))
    monkeypatch.setattr(nearcopies, "SHARD_SETS", 40)
    assert near_dedup(spark, rows) == kept_plain(rows) == sorted(range(0, 240, 2), key=repr)
    monkeypatch.setattr(nearcopies, "by_shingles", lambda near, *_: near.where("false"))
    kept = near_dedup(spark, rows)
    assert set(kept) >= {2 * k for k in range(120)} and len(kept) <= 132


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert near_dedup(spark, rows) == kept_plain(rows)
