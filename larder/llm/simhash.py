"""SimHash fingerprints and near-duplicate groups through vantage-point trees.

Words are what lies between ASCII white space after lower-casing A-Z; a shingle is `width` words joined by
spaces, a shorter text is one shingle, a text without words has fingerprint zero. A bit is set if it is set
in over half of the XXH64 hashes (seed 42) of the shingles, repeats included.

Distinct fingerprints are routed through a vantage-point tree fitted on a bounded sample: at a node those
within `mu` bits of its vantage point go inside, the others outside, to one home shard each. One outside that
is no more than `radius` beyond the border may have neighbours inside and is also sent there as a query, and
a query goes to every shard that the triangle inequality does not rule out. So each pair within the radius
meets in a shard. There the search goes on with vantage points of the shard's own. Shards emit for each
fingerprint one link to the smallest of its local group, never all pairs, and the links of all shards are
contracted to components. A shard that is too dense to be halved looks up the neighbours of a fingerprint
by flipping bits, which is linear, and large shards are dealt out in blocks.

Null texts count as empty. Repeated rows share a group. Rows without doc_id get the smallest doc_id of their
group, null if it has none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.components import _kept, components

SEED = 42
#: Fingerprints the routing tree is fitted on, home rows aimed at in a shard, most shards.
SAMPLE, SHARD_ROWS, MOST_SHARDS = 16_384, 4_096, 2_048
#: Home rows and query rows of a shard that are searched together at most.
HOME_BLOCK, QUERY_BLOCK = 65_536, 262_144
PAIRS = 1 << 21


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PAIRS >> 6):
        some = np.array(hashes[at : at + (PAIRS >> 6)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def simhash(text: str | None, width: int) -> int:
    """Fingerprint of one text, as a signed 64-bit number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    return majority(hashes)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of (doc_id, text); fp is a long, text_hash tells rows with equal doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(text.as_py(), width) for text in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(prints, pa.int64())], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _distance(some: np.ndarray, one: np.uint64) -> np.ndarray:
    return np.bitwise_count(some ^ one).astype(np.int64)


def fit_tree(sample: np.ndarray, leaves: int) -> list[tuple]:
    """Nodes (vantage, mu, inside, outside), children as places in the list; ('leaf', number)."""
    nodes: list[tuple] = []
    shards = 0

    def grow(points: np.ndarray, wanted: int) -> int:
        nonlocal shards
        at = len(nodes)
        nodes.append(())
        if wanted > 1 and len(points) > 1:
            vantage = points[0]
            far = _distance(points, vantage)
            mu = int(np.median(far))
            mu = mu if (far > mu).any() else mu - 1
            inside = far <= mu
            if inside.any() and not inside.all():
                nodes[at] = (int(vantage), mu, grow(points[inside], wanted // 2), grow(points[~inside], wanted - wanted // 2))
                return at
        nodes[at] = ("leaf", shards)
        shards += 1
        return at

    grow(sample, leaves)
    return nodes


def _routes(nodes: list[tuple], prints: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, rows at home there, rows that ask there)."""
    todo = [(0, np.arange(len(prints)), np.empty(0, np.int64))]
    while todo:
        at, home, ask = todo.pop()
        if not len(home) and not len(ask):
            continue
        if nodes[at][0] == "leaf":
            yield nodes[at][1], home, np.concatenate((home, ask))
            continue
        vantage, mu, inside, outside = nodes[at]
        d, e = _distance(prints[home], np.uint64(vantage)), _distance(prints[ask], np.uint64(vantage))
        todo.append((inside, home[d <= mu], np.concatenate((ask[e <= mu + radius], home[(d > mu) & (d <= mu + radius)]))))
        todo.append((outside, home[d > mu], ask[e + radius > mu]))


class _Groups:
    """Union of places by repeated minimum; links come as arrays."""

    def __init__(self, n: int):
        self.least = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.least[a], self.least[b]
        while len(a):
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                return
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.least, high, low)
            while not np.array_equal(self.least, again := self.least[self.least]):
                self.least = again
            a, b = self.least[low], self.least[high]


def search_shard(prints: np.ndarray, home: np.ndarray, ask: np.ndarray, radius: int) -> np.ndarray:
    """Root place of each place of `prints` under links between home rows and rows that ask."""
    groups = _Groups(len(prints))
    flips = [0, *(1 << i for i in range(64))]
    flips += [sum(1 << i for i in some) for n in range(2, radius + 1) for some in combinations(range(64), n)] if radius <= 2 else []
    todo = [(home, ask, 0)]
    while todo:
        home, ask, depth = todo.pop()
        if not len(home) or not len(ask):
            continue
        if len(home) * len(ask) > PAIRS // 8 and len(home) > 64 and depth < 40:
            vantage = prints[home[depth * 7919 % len(home)]]
            d, e = _distance(prints[home], vantage), _distance(prints[ask], vantage)
            mu = int(np.median(d))
            mu = mu if (d > mu).any() else mu - 1
            inside = d <= mu
            near, beyond = ask[e <= mu + radius], ask[e + radius > mu]
            work = inside.sum() * len(near) + (~inside).sum() * len(beyond)
            if work < 0.9 * len(home) * len(ask):
                todo += [(home[inside], near, depth + 1), (home[~inside], beyond, depth + 1)]
                continue
        if radius <= 2 and len(home) > 8 * len(flips):
            order = home[np.argsort(prints[home], kind="stable")]
            sorted_prints, masks = prints[order], np.array(flips, np.uint64)
            step = max(1, PAIRS // len(masks))
            for at in range(0, len(ask), step):
                some = ask[at : at + step]
                wanted = prints[some][:, None] ^ masks[None, :]
                place = np.minimum(np.searchsorted(sorted_prints, wanted), len(order) - 1)
                row, col = np.nonzero(sorted_prints[place] == wanted)
                groups.link(some[row], order[place[row, col]])
            continue
        step = max(1, PAIRS // len(home))
        for at in range(0, len(ask), step):
            some = ask[at : at + step]
            row, col = np.nonzero(np.bitwise_count(prints[some][:, None] ^ prints[home][None, :]) <= radius)
            groups.link(some[row], home[col])
    return groups.least


def near_forest(
    prints: np.ndarray, sizes: np.ndarray, home: np.ndarray, ask: np.ndarray, radius: int, unlike: Callable[[np.ndarray, np.ndarray], np.ndarray], forests: int = 1
) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) that span the groups of all pairs within the radius, of sizes at most a fifth apart and `unlike` by 1 at most; the least unlike first.

    With more forests, what one leaves is spanned by the next, so a pair that turns out not to be near does not stand for others.
    """
    spanned, found = [_Groups(len(prints)) for _ in range(forests)], [np.empty((2, 0), np.int64)]
    home, ask = home[np.argsort(sizes[home], kind="stable")], ask[np.argsort(sizes[ask], kind="stable")]
    at_home = np.zeros(len(prints), bool)
    at_home[home] = True
    step = max(1, PAIRS // max(1, len(home)))
    for at in range(0, len(ask), step):
        some = ask[at : at + step]
        low, high = np.searchsorted(5 * sizes[home], 4 * sizes[some[0]]), np.searchsorted(4 * sizes[home], 5 * sizes[some[-1]], "right")
        here = home[low:high]
        far = np.bitwise_count(prints[some][:, None] ^ prints[here][None, :])
        row, col = np.nonzero(far <= radius)
        a, b = some[row], here[col]
        last = spanned[-1].least
        new = (last[a] != last[b]) & ((a < b) | ~at_home[a]) & (5 * np.minimum(sizes[a], sizes[b]) >= 4 * np.maximum(sizes[a], sizes[b]))
        a, b = a[new], b[new]
        share = np.concatenate([unlike(a[i : i + PAIRS // 8], b[i : i + PAIRS // 8]) for i in range(0, max(1, len(a)), PAIRS // 8)])
        order = np.flatnonzero(share <= 1)
        order = order[np.argsort(share[order], kind="stable")]
        a, b = a[order], b[order]
        for groups in spanned:
            chosen, left = np.zeros(len(a), bool), np.arange(len(a))
            while len(left):
                one, other = groups.least[a[left]], groups.least[b[left]]
                apart = one != other
                left, later = left[apart], np.maximum(one, other)[apart]
                # The first pair, the least unlike, of each group that can join one with a smaller root.
                first = np.full(len(prints), -1)
                first[later[::-1]] = left[::-1]
                first = first[first >= 0]
                chosen[first] = True
                groups.link(a[first], b[first])
            found.append(np.stack((a[chosen], b[chosen])))
            a, b = a[~chosen], b[~chosen]
    a, b = np.concatenate(found, axis=1)
    return a, b


def shards(points: DataFrame, fp: str, radius: int, rows: int, home_block: int, query_block: int) -> DataFrame:
    """(shard, h, q, asks, columns of `points`): homes and queries that meet by (shard, h, q); `fp` holds fingerprints."""
    n = points.count()
    sample = points.select(fp).orderBy(F.xxhash64(fp), fp).limit(SAMPLE).collect()
    prints = np.array([r[fp] for r in sample], np.int64).view(np.uint64)
    nodes = fit_tree(prints, max(1, min(MOST_SHARDS, len(prints) // 4, -(-n // rows))))
    columns = points.columns

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(columns.index(fp)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for shard, home, ask in _routes(nodes, prints, radius):
                places = np.concatenate((home, ask))
                yield pa.record_batch(
                    [pa.array(np.full(len(places), shard, np.int32)), pa.array(np.arange(len(places)) >= len(home)), *batch.take(pa.array(places)).columns],
                    names=["shard", "asks", *columns],
                )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    routed = _kept(points.mapInArrow(route, f"shard int, asks boolean, {kinds}"), "routed")
    # One row for each shard and role: as many as the tree has leaves.
    sizes = {(r["shard"], r["asks"]): r["count"] for r in routed.groupBy("shard", "asks").count().collect()}
    blocks = {s: (-(-rows // home_block), -(-sizes[s, True] // query_block)) for (s, asks), rows in sizes.items() if not asks}
    most = {s: b for s, b in blocks.items() if b != (1, 1)}
    deal = F.pmod(F.xxhash64(fp), F.lit(1)).cast("int")
    homes, asking = F.array(F.struct(deal.alias("h"), deal.alias("q"))), F.array(F.struct(deal.alias("h"), deal.alias("q")))
    for s, (h, q) in most.items():
        own_h, own_q = (F.pmod(F.xxhash64(*columns), F.lit(k)).cast("int") for k in (h, q))
        homes = F.when(F.col("shard") == s, F.array(*[F.struct(own_h.alias("h"), F.lit(i).alias("q")) for i in range(q)])).otherwise(homes)
        asking = F.when(F.col("shard") == s, F.array(*[F.struct(F.lit(i).alias("h"), own_q.alias("q")) for i in range(h)])).otherwise(asking)
    return routed.withColumn("_b", F.explode(F.when(F.col("asks"), asking).otherwise(homes))).select("shard", "_b.h", "_b.q", "asks", *columns)


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): each fingerprint of the column fp with the root of its group in a shard."""
    dealt = shards(distinct.select("fp"), "fp", radius, SHARD_ROWS, HOME_BLOCK, QUERY_BLOCK)

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        prints, place = np.unique(table.column("fp").to_numpy().astype(np.int64), return_inverse=True)
        root = search_shard(prints.view(np.uint64), place[~asks], place[asks], radius)
        moved = root != np.arange(len(prints))
        return pa.table({"a": prints[moved], "b": prints[root[moved]]})

    return dealt.groupBy("shard", "h", "q").applyInArrow(search, "a long, b long")


def grouped(prints: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, fp) with root and component_id over links; distinct has (fp, first_id)."""
    roots = components(links)
    linked = distinct.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "first_id")
    least = linked.groupBy("root").agg(F.min("first_id").alias("least")).select(F.col("root").alias("_root"), "least")
    groups = linked.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "root", "least")
    classes = distinct.join(groups, F.col("fp") == F.col("_fp"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first_id").alias("component_id")
    )
    # Kept, so that both sides of the join come straight from an exchange and a hot fingerprint can be split.
    classes = _kept(classes, "classes")
    return prints.join(classes, F.col("fp") == F.col("_fp")).select("doc_id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id): the group of each row over links of at most `radius` bits.

    `root` is the smallest fingerprint of the group, component_id its smallest doc_id.
    """
    prints = _kept(fingerprints(docs, width), "simhash")
    distinct = _kept(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    return grouped(prints, distinct, links(distinct, radius))


def first_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of `docs` without near duplicates: of each group the one with the smallest doc_id stays.

    Where rows share that id, the one with the smallest hash of its text stays, and one of equal rows.
    """
    groups = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = groups.groupBy("root").agg(F.min(F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("text_hash").alias("_hash"))).alias("k"))
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("_id"), F.xxhash64("text").alias("_hash"))
    copy = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.xxhash64("_row")))
    stay = rows.join(kept.select("k._id", "k._hash").distinct(), ["_id", "_hash"], "left_semi").withColumn("_copy", copy).where("_copy = 1")
    return stay.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def one_of_each(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """One row of each group of `near_duplicates`."""
    return first_of_each(docs, near_duplicates(docs, width, radius))
