import random

import numpy as np
import plain
from odd_rows import ODD

from larder.llm import simhash as sh
from larder.llm.components import components


def near_prints(n, seed=1):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = rng.getrandbits(64)
        out.append(base)
        for _ in range(rng.randrange(6)):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
            out.append(base)
    return sorted({p - (1 << 64) * (p >> 63) for p in out[:n]})


def pairs(prints):
    roots = plain.groups([p % 2**64 for p in prints])
    return {(p, prints[r]) for p, r in zip(prints, roots, strict=True)}


def test_fingerprints():
    for _, text in ODD:
        assert sh.simhash(text, 3) % 2**64 == plain.simhash(text)
    assert sh.simhash("a b", 3) % 2**64 == plain.simhash("a b")


def test_shard_search_finds_all_links():
    prints = np.array(near_prints(700), np.int64)
    places = np.arange(len(prints))
    roots = sh.search_shard(prints.view(np.uint64), places, places, 2)
    assert {(int(prints[i]), int(prints[r])) for i, r in enumerate(roots)} == pairs(prints.tolist())


def test_dense_shard_looks_up_flips(monkeypatch):
    rng = random.Random(3)
    dense = sorted({(1 << 60) ^ sum(1 << b for b in rng.sample(range(40), rng.randrange(5))) for _ in range(25_000)})
    prints = np.array(dense, np.int64)
    places = np.arange(len(prints))
    monkeypatch.setattr(sh, "PAIRS", 1 << 16)
    flips = sh.search_shard(prints.view(np.uint64), places, places, 2)
    monkeypatch.undo()
    assert len(set(flips.tolist())) == 1  # all hang together by steps of two bits


def test_links_over_shards(spark, monkeypatch):
    monkeypatch.setattr(sh, "SHARD_ROWS", 40)
    monkeypatch.setattr(sh, "HOME_BLOCK", 16)
    monkeypatch.setattr(sh, "QUERY_BLOCK", 50)
    prints = near_prints(900, 5)
    found = components(sh.links(spark.createDataFrame([(p,) for p in prints], "fp long")))
    roots = {r.node: r.root for r in found.collect()}
    assert {(p, roots.get(p, p)) for p in prints} == pairs(prints)


def test_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    least = {n: n for link in links for n in link}
    for _ in range(len(least)):
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: m for n, m in least.items() if any(n in link and link[0] != link[1] for link in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def grouped(rows):
    prints = sorted({plain.simhash(t) for _, t in rows})
    root = dict(zip(prints, plain.groups(prints), strict=True))
    least = {}
    for i, t in rows:
        r = root[plain.simhash(t)]
        least[r] = min(least.get(r, i) if least.get(r) is not None else i, i) if i is not None else least.get(r)
    return [(i, plain.simhash(t), least[root[plain.simhash(t)]]) for i, t in rows]


def test_odd_rows(odd, none):
    found = sh.near_duplicates(odd)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in found.collect()), key=repr) == sorted(grouped(ODD), key=repr)
    assert sh.near_duplicates(none).count() == 0


def test_one_of_each(odd, none):
    kept = sh.one_of_each(odd)
    assert kept.columns == odd.columns
    expected = {(i, t or "") for (i, t), (_, _, c) in zip(ODD, grouped(ODD), strict=True) if i == c}
    got = [(r.doc_id, r.text or "") for r in kept.collect()]
    # Null, empty and blank texts are one group; the smallest id has the null text.
    assert len(got) == len(set(got)) and set(got) <= expected
    assert {plain.simhash(t) for _, t in got} <= {plain.simhash(t) for _, t in ODD}
    assert len(got) == len({c if c is not None else p for _, p, c in grouped(ODD)}) + 1  # id 3 has two different texts
    assert sh.one_of_each(none).count() == 0
