import math

import numpy as np
import pytest

from larder.llm import capfilters as cf

KIND = "vec_id long, embedding array<float>, label int, class string, shard string, copies string, a string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, *["z"] * 5) for i, v, label in rows], KIND)


def expected(rows, least=0.93):
    """By all pairs."""
    good = lambda v, label: label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    kept = [k for k, (_, v, label) in enumerate(rows) if good(v, label)]
    unit = {k: np.float32(rows[k][1]).astype(np.float64) for k in kept}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for at, i in enumerate(kept):
        for j in kept[:at]:
            if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    out = []
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[m][0] for m in kept if find(m) == find(k) and rows[m][0] is not None] if k in unit else [i]
        component = min(ids, default=None)
        out.append((i, links[k], component, i == component))
    return sorted(out, key=repr)


def pairs_at(rng, n, dims, cosine):
    x, z = rng.normal(size=(2, n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    return x, cosine * x + math.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize("share", [cf.MOST, 1e-3, 1e-5])
@pytest.mark.parametrize("dims", [2, 64, 100])
def test_recall_at_the_threshold(dims, share):
    x, y = pairs_at(np.random.default_rng(3), 400, dims, 0.93)
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(cf.decode(x, share), cf.decode(y, share), strict=True)]
    assert np.mean(met) >= 0.99


def test_decoding_finds_all_filters_beyond_the_threshold():
    x = pairs_at(np.random.default_rng(4), 60, 16, 0.5)[0]
    limit, words, codes = cf.directions(16, 0.002)
    for own, v in zip(cf.decode(x, 0.002), x, strict=True):
        sums = np.concatenate([((v @ a)[:, None] + (v @ b)[None, :]).ravel() for a, b in codes])
        level = min(limit, np.sort(sums)[-cf.LEAST])
        assert own.tolist() == np.flatnonzero(sums >= level).tolist()
    wide = cf.decode(np.concatenate([codes[0][0][:, :1].T, x]), 0.002)  # one vector near many directions
    assert len(wide[0]) >= cf.LEAST


def clusters(seed, groups=12, dims=24, most=40):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dims)
        for _ in range(rng.integers(1, most)):
            rows.append((len(rows), (centre + rng.normal(size=dims) * rng.choice([0.0, 0.2, 0.26, 0.4])).tolist(), int(g % 3)))
    return rows


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(cf, "BLOCK", 25)  # shards in blocks
    monkeypatch.setattr(cf, "PAIRS", 64)
    rows = clusters(1)
    assert sorted(map(tuple, cf.near_vectors(frame(spark, rows)).collect()), key=repr) == expected(rows)


def test_pairs_that_rounding_leaves_open(spark, monkeypatch):
    monkeypatch.setattr(cf, "SLACK", 0.03)
    rows = clusters(2, groups=6, most=25)
    assert sorted(map(tuple, cf.near_vectors(frame(spark, rows)).collect()), key=repr) == expected(rows)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, [2.0, 4.0, 6.0], 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1)]
    rows += [(9, [1.0, float("nan"), 3.0], 1), (10, [1.0, float("inf"), 3.0], 1), (None, v, 1), (None, v, 3), (11, [1.0, 2.0], 1), (12, [1e30, 2e30, 3e30], 1), (13, [-0.0, 0.0, 5.0], 4), (14, [0.0, 0.0, 1e-30], 4), (15, [4.0], 1), (16, [-4.0], 1), (17, [3.0], 1)]
    assert sorted(map(tuple, cf.near_vectors(frame(spark, rows)).collect()), key=repr) == expected(rows)
    assert cf.near_vectors(frame(spark, rows).where("false")).count() == 0
