"""Near duplicates of embeddings with equal labels by spherical-cap filters.

A filter is a direction; it takes the vectors in the cap around it. Directions are structured: after a random rotation
the space is cut in two halves with a random code of B words each, and a direction is a word of the first half beside
one of the second. CODES such products hold CODES * B * B directions, and all of them that a vector exceeds are decoded
from two sorted lists of B numbers, without going through the product. The threshold lets a share SHARE / rows of all
directions pass (a share of at most MOST), and a vector that passes fewer than LEAST takes its LEAST best, so that
vectors which the halves cut unevenly are not lost. None of 1,600 simulated pairs at cosine 0.93 failed to share a direction; the tests
ask for 99 of 100 there and for every pair of their tables.

Equal vectors are one class. Classes are joined on filters by shards, one for each word of the first half; a shard gets
vectors once, rounded to 16 bits, and joins them on the second word. A pair is verified where it shares its first
filter, so it counts once however many filters it shares; the rounding's error is known, and the few pairs it leaves
open are verified from the vectors themselves. A shard emits counts and one link per class to the smallest of its local
group, never pairs. Shards of many rows (a group of near copies) are dealt out in pairs of blocks of BLOCK rows.

Vectors that are null, zero or hold null or non-finite components, and those without a label, link with nothing; vectors of
different lengths do not either. Repeated rows are different vectors that link. Rows without vec_id count as links and
take the smallest vec_id of their component, null if it has none. Further columns are ignored, an empty table has an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.components import _kept, components
from larder.llm.simhash import _Groups

CODES, FILTERS, LEAST = 8, 32, 24
#: Vectors in a cap aimed at; largest and smallest share of a cap; least dimensions (shorter vectors are filled up).
SHARE, MOST, FEWEST, DIMS = 64, 0.005, 2.0**-27, 64
#: Cells of a sorted product that are looked at first, rows of a shard's block, rows decoded at once.
CELLS, BLOCK, AT_ONCE = 64, 2048, 256
#: Slack for arithmetic in 32 bits.
SLACK = 1e-5
PAIRS = 1 << 14


def cap_share(rows: int) -> float:
    """Share of the sphere in a cap, for a label with so many vectors."""
    return min(MOST, max(FEWEST, SHARE / max(1, rows)))


@lru_cache(maxsize=4)
def directions(dims: int, share: float) -> tuple[float, int, list[tuple[np.ndarray, np.ndarray]]]:
    """(threshold, words, codes): each code as both halves' words, already rotated back, as columns."""
    whole = max(dims, DIMS)
    words = int(np.ceil(np.sqrt(FILTERS / share / CODES)))
    codes = []
    for n in range(CODES):
        rng = np.random.default_rng((whole, n))
        rotation = np.linalg.qr(rng.normal(size=(whole, whole)))[0][:dims]
        halves = []
        for part in np.array_split(np.arange(whole), 2):
            code = rng.normal(size=(words, len(part)))
            code *= np.sqrt(0.5) / np.linalg.norm(code, axis=1)[:, None]
            halves.append(rotation[:, part] @ code.T)
        codes.append(tuple(halves))
    return NormalDist().inv_cdf(1 - share) / np.sqrt(whole), words, codes


@lru_cache(maxsize=4)
def _cells(words: int, most: int) -> tuple[np.ndarray, ...]:
    """Cells (r, s) with (r + 1)(s + 1) <= most, where the best `most` sums of two falling lists lie, and those just outside."""
    inside = [(r, s) for r in range(min(words, most)) for s in range(min(words, most // (r + 1)))]
    outside = [(r, most // (r + 1)) for r in range(min(words, most + 1)) if most // (r + 1) < words]
    return tuple(np.array(x, np.int64).reshape(-1, 2).T for x in (inside, outside))


def decode(unit: np.ndarray, share: float) -> list[np.ndarray]:
    """Sorted filters of each unit vector: code, word of the first half and of the second as one number."""
    limit, words, codes = directions(unit.shape[1], share)
    sums, names = [], []
    over = np.zeros(len(unit), bool)
    inside, outside = _cells(words, CELLS)
    for n, (first, second) in enumerate(codes):
        a, b = unit @ first, unit @ second
        by_a, by_b = np.argsort(-a, axis=1, kind="stable"), np.argsort(-b, axis=1, kind="stable")
        a, b = np.take_along_axis(a, by_a, 1), np.take_along_axis(b, by_b, 1)
        sums.append(a[:, inside[0]] + b[:, inside[1]])
        names.append((n * words + by_a[:, inside[0]]) * words + by_b[:, inside[1]])
        if outside.size:
            over |= (a[:, outside[0]] + b[:, outside[1]] >= limit).any(axis=1)
    total, name = np.concatenate(sums, axis=1), np.concatenate(names, axis=1)
    least = min(LEAST, total.shape[1])
    own = np.minimum(limit, np.partition(total, total.shape[1] - least, axis=1)[:, total.shape[1] - least])
    out = [np.sort(name[k, total[k] >= own[k]]) for k in range(len(unit))]
    for k in np.flatnonzero(over):  # more than the first cells: the whole product
        out[k] = np.concatenate([n * words * words + np.flatnonzero((unit[k] @ first)[:, None] + (unit[k] @ second)[None, :] >= limit) for n, (first, second) in enumerate(codes)])
    return out


def rounded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """16-bit components, their scale and the length of what rounding left of each unit vector."""
    scale = np.abs(unit).max(axis=1) / 32767
    short = np.rint(unit / scale[:, None]).astype("<i2")
    return short, scale, np.linalg.norm(unit - short * scale[:, None], axis=1)


def unit_vectors(lists: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision; all lists have the same length."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    values = values / np.abs(values).max(axis=1)[:, None]
    return values / np.linalg.norm(values, axis=1)[:, None]


ROUTED = "label {label}, dims int, shard int, class long, copies long, short binary, scale double, rest double, filters binary"


def _route(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for size in np.unique(dims):
                rows = np.flatnonzero(dims == size)
                for at in range(0, len(rows), AT_ONCE):
                    some = batch.take(pa.array(rows[at : at + AT_ONCE]))
                    unit = unit_vectors(some.column("embedding"))
                    words = directions(int(size), share)[1]
                    short, scale, rest = rounded(unit)
                    place, shards, filters = [], [], []
                    for k, own in enumerate(decode(unit, share)):
                        shard = own // words
                        for one in np.unique(shard):
                            place.append(k)
                            shards.append(one)
                            filters.append(own[: np.searchsorted(shard, one, "right")].astype("<u4").tobytes())
                    take = pa.array(place, pa.int64())
                    binary = pa.array([s.tobytes() for s in short], pa.binary())
                    columns = [some.column("label").take(take), some.column("dims").take(take), pa.array(shards, pa.int32()), some.column("class").take(take), some.column("copies").take(take)]
                    columns += [binary.take(take), pa.array(scale).take(take), pa.array(rest).take(take), pa.array(filters, pa.binary())]
                    yield pa.record_batch(columns, names=["label", "dims", "shard", "class", "copies", "short", "scale", "rest", "filters"])

    return run


def _met_before(earlier: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether rows p and q of `earlier` (filters, filled up with -1) share a filter."""
    if len(p) <= 8 * len(earlier):
        out = np.zeros(len(p), bool)
        for at in range(0, len(p), PAIRS):
            a, b = earlier[p[at : at + PAIRS]], earlier[q[at : at + PAIRS]]
            out[at : at + PAIRS] = ((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]).any(axis=(1, 2))
        return out
    held, times = np.unique(earlier[earlier >= 0], return_counts=True)
    held = held[times > 1]
    shared = np.zeros((len(earlier), len(earlier)), np.float32)
    for at in range(0, len(held), BLOCK):
        some = held[at : at + BLOCK]
        place = np.searchsorted(some, earlier)
        row, col = np.nonzero((place < len(some)) & (some[np.minimum(place, len(some) - 1)] == earlier))
        marks = np.zeros((len(earlier), len(some)), np.float32)
        marks[row, place[row, col]] = 1
        shared += marks @ marks.T
    return shared[p, q] > 0


def search_shard(vectors: np.ndarray, rest: np.ndarray, filters: list[np.ndarray], own: np.ndarray, shard: int, words: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(p, q, sure) of the pairs of rows that share their first filter here and may reach the cosine; own is a row's block."""
    width = max(map(len, filters))
    table = np.full((len(filters), width), -1, np.int64)
    for k, one in enumerate(filters):
        table[k, : len(one)] = one
    row, col = np.nonzero(table // words == shard)
    held = table[row, col]
    by = np.argsort(held, kind="stable")
    row, held = row[by], held[by]
    begins = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    across = len(np.unique(own)) > 1
    for i, j in zip(begins, [*begins[1:], len(held)], strict=True):
        some = row[i:j]
        if len(some) < 2:
            continue
        cosine = vectors[some] @ vectors[some].T
        loose = rest[some][:, None] + rest[some][None, :] * (1 + rest[some][:, None]) + SLACK
        p, q = np.nonzero(np.triu(cosine >= least - loose, 1))
        if across:
            apart = own[some[p]] != own[some[q]]
            p, q = p[apart], q[apart]
        if not len(p):
            continue
        before = table[some]
        new = ~_met_before(np.where(before < held[i], before, -1), p, q)
        p, q = p[new], q[new]
        yield some[p], some[q], cosine[p, q] >= least + loose[p, q]


def _search(share: float, least: float):
    def run(table: pa.Table) -> pa.Table:
        classes, copies = table.column("class").to_numpy(), table.column("copies").to_numpy()
        short = np.frombuffer(b"".join(table.column("short").to_pylist()), "<i2").reshape(len(classes), -1)
        vectors = (short * table.column("scale").to_numpy()[:, None]).astype(np.float32)
        filters = [np.frombuffer(b, "<u4").astype(np.int64) for b in table.column("filters").to_pylist()]
        words = directions(short.shape[1], share)[1]
        count, groups = np.zeros(len(classes), np.int64), _Groups(len(classes))
        open_a, open_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for p, q, sure in search_shard(vectors, table.column("rest").to_numpy(), filters, table.column("own").to_numpy(), table.column("shard")[0].as_py(), words, least):
            np.add.at(count, p[sure], copies[q[sure]])
            np.add.at(count, q[sure], copies[p[sure]])
            groups.link(p[sure], q[sure])
            open_a.append(classes[p[~sure]])
            open_b.append(classes[q[~sure]])
        met = np.flatnonzero(count)
        a = np.concatenate([classes[met], *open_a])
        b = np.concatenate([classes[groups.least[met]], *open_b])
        n = pa.array(np.concatenate([count[met], np.zeros(len(a) - len(met), np.int64)]), mask=np.arange(len(a)) >= len(met))
        return pa.table({"a": a, "b": b, "n": n})

    return run


def _usable(vector: str) -> F.Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _classes(rows: DataFrame) -> DataFrame:
    """(label, h1, h2, class, copies, first_id, embedding, dims) of the different vectors of each label."""
    one = rows.groupBy("label", "h1", "h2").agg(F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    one = one.select("*", F.size("embedding").alias("dims"), F.monotonically_increasing_id().alias("class"))
    return _kept(one, "vectors")  # kept, since the number depends on the order of rows


def _links(classes: DataFrame, least: float) -> DataFrame:
    """(a, b, n): classes with a link and how many vectors of other classes a adds (null n: b adds none)."""
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    share = cap_share(most)
    kind = classes.schema["label"].dataType.simpleString()
    routed = classes.select("label", "dims", "class", "copies", "embedding").mapInArrow(_route(share), ROUTED.format(label=kind))
    routed = _kept(routed, "filters")
    sizes = routed.groupBy("label", "dims", "shard").count().where(F.col("count") > BLOCK)
    sizes = sizes.select(F.col("label").alias("_l"), F.col("dims").alias("_d"), F.col("shard").alias("_s"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    # Row k of a shard in blocks goes to every pair of blocks that holds its own.
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    dealt = routed.join(sizes, (F.col("label") == F.col("_l")) & (F.col("dims") == F.col("_d")) & (F.col("shard") == F.col("_s")), "left").drop("_l", "_d", "_s")
    dealt = dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("blocks", "other")
    found = _kept(dealt.groupBy("label", "dims", "shard", "low", "high").applyInArrow(_search(share, least), "a long, b long, n long"), "found")
    return found.where("n IS NOT NULL").unionByName(_verified(found.where("n IS NULL"), classes, least))


def _verified(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Links, in both directions, of the pairs (a, b) that reach the cosine in double precision."""

    def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([float(unit_vectors(a[i : i + 1])[0] @ unit_vectors(b[i : i + 1])[0]) for i in range(len(a))], pa.float64())

    for side in ("a", "b"):
        own = classes.select(F.col("class").alias("_c"), F.col("embedding").alias(f"v_{side}"), F.col("copies").alias(f"copies_{side}"))
        pairs = pairs.join(own, F.col(side) == F.col("_c")).drop("_c")
    near = _kept(pairs.where(F.arrow_udf(cosine, "double")("v_a", "v_b") >= least).select("a", "b", "copies_a", "copies_b"), "verified")
    return near.select("a", "b", F.col("copies_b").alias("n")).unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("copies_a").alias("n")))


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of (vec_id, embedding, label); links have cosine >= least."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    usable = F.col("label").isNotNull() & _usable("embedding")
    # Two hashes with different beginnings name a vector.
    rows = rows.withColumns({"h1": F.when(usable, F.xxhash64("embedding")), "h2": F.when(usable, F.xxhash64(F.lit(1), "embedding"))})
    classes = _classes(rows.where("h1 IS NOT NULL"))
    links = _kept(_links(classes, least), "vector-links")
    roots = components(links.select("a", "b"))
    added = links.groupBy("a").agg(F.sum("n").alias("n"))
    known = classes.select("label", "h1", "h2", "class", "copies", "first_id").join(added, F.col("class") == F.col("a"), "left")
    known = known.join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    known = _kept(known.select("label", "h1", "h2", "root", "first_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-groups")
    least_id = known.groupBy(F.col("root").alias("_root")).agg(F.min("first_id").alias("component_id"))
    known = known.join(least_id, F.col("root") == F.col("_root")).select(F.col("label").alias("_l"), F.col("h1").alias("_1"), F.col("h2").alias("_2"), "n_links", "component_id")
    known = _kept(known, "vector-results")  # so that adaptive execution can split a vector with many copies
    out = rows.select("vec_id", "label", "h1", "h2").join(known, (F.col("label") == F.col("_l")) & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")), "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
