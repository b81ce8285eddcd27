"""Exact top-k search by inner product in an M-tree.

Vectors are whole numbers. With an added coordinate that brings all stored vectors to one length, a larger
inner product is a smaller Euclidean distance, so a metric tree finds it: distance(q, x)^2 =
|q|^2 + M^2 - 2 <q, x>, where M is the length of the longest stored vector and a query's added coordinate is 0.

The tree has routing objects, pages and entries. Routing objects are a bounded sample of the vectors; each
stored vector goes to the nearest one and keeps its distance to it. The vectors of a routing object are cut
into groups of about `GROUP` rows at most, at random, so that a vector that is repeated millions of times
fills many groups; a group is cut into pages of `PAGE` entries with an object, its distance
to the routing object, a covering radius and each entry's distance to the object.

Groups are dealt to buckets of about equal size, in the order of their routing objects. A task reads a bucket as
rows, first its entries, sorted by group, then the queries that ask it; it holds one bucket and `BLOCK` queries,
however many rows there are of either. A query is sent once to a bucket, whatever number of its groups it meets.

A query starts with its k best among the routing objects: they are stored vectors, so no answer can be worse.
Queries travel only to buckets where the triangle inequality does not rule out all groups. In a group pages are
ordered by their least possible distance to the query and read, the best one first, then twice as many each time,
until none can hold a better one; the queries that read a page together are one product. Stored distances spare the
computation of those that cannot matter. Scores are whole numbers and exact; bounds have a margin for rounding.
Buckets return their k best, which are ranked once more.

Vectors that are null or hold null or non-finite components take no part. A shorter vector counts as filled
up with zeros. Ties go to the smaller id; of rows with the same id each is a candidate of its own
and, if it differs, a query of its own. Rows without an id are candidates, ordered after all others, and are no queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.components import _kept

ROUTING, GROUP, PAGE, BLOCK = 256, 4096, 64, 256
#: Buckets that groups are dealt to, more of them where one would hold more bytes of vectors.
BUCKETS, BUCKET_BYTES = 48, 1 << 26
SCALE = 1024


def whole_vectors(df: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of every component, as an array of longs."""
    x = F.col(vector_column).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    put = lambda c: F.floor(c * F.lit(float(scale))).cast("long")
    return df.select(F.col(id_column).cast("long").alias("id"), x.alias("x")).where(x.isNotNull() & fine).select("id", F.transform("x", put).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.float64)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: floats where all sums are below 2**53, longs below 2**63."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if most >= (1 << 63) - (1 << 53) or max(np.abs(a).max(), np.abs(b).max()) > 1 << 53:
        raise OverflowError("inner products of these vectors do not fit into 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _apart(q_square: np.ndarray, m_square: float, products: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, q_square + m_square - 2.0 * products))


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in x.astype("<f8")], pa.binary())


def _read(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dims)


class Group:
    """Entries of one routing object, in pages."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m_square: float):
        self.ids, self.vectors, self.m_square = ids, vectors, m_square
        lift = np.sqrt(np.maximum(0.0, m_square - (vectors**2).sum(axis=1)))
        self.pages = []
        for at in range(0, len(ids), PAGE):
            rows = slice(at, min(len(ids), at + PAGE))
            parents = np.sqrt(((vectors[rows] - vectors[at]) ** 2).sum(axis=1) + (lift[rows] - lift[at]) ** 2)
            self.pages.append((rows, at, parents, float(parents.max())))


class Best:
    """The k best of each of some queries so far: places of queries, ids and scores, sorted, best first."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.place, self.ids, self.scores = (np.empty(0, np.int64) for _ in range(3))
        #: Score of the last of a query that has k.
        self.least = np.full(queries, np.iinfo(np.int64).min)

    def add(self, place: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        fits = scores >= self.least[place]
        if not fits.any():
            return
        place, ids, scores = (np.concatenate(c) for c in ((self.place, place[fits]), (self.ids, ids[fits]), (self.scores, scores[fits])))
        by = np.lexsort((ids, ~scores, place))  # ~ turns the order of all longs
        place = place[by]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        by, place, rank = by[rank < self.k], place[rank < self.k], rank[rank < self.k]
        self.place, self.ids, self.scores = place, ids[by], scores[by]
        last = rank == self.k - 1
        self.least[place[last]] = self.scores[last]


def search_group(group: Group, to_routing: np.ndarray, queries: np.ndarray, q_ids: np.ndarray, bounds: np.ndarray, routed: np.ndarray, k: int, best: Best | None = None) -> list[tuple[int, int, int]]:
    """(place of the query, id, score) of the k best of each query in a group, and in `best`, best first over its pages.

    `to_routing` holds each entry's distance to the routing object, `routed` each query's; `bounds` is the
    distance beyond which a query needs nothing.
    """
    best = Best(len(queries), k) if best is None else best
    squares = (queries**2).sum(axis=1)
    objects = np.array([at for _, at, _, _ in group.pages])
    radii = np.array([r for _, _, _, r in group.pages])
    margin = 1e-6 * (1 + np.sqrt(group.m_square) + np.sqrt(squares.max(initial=0)))

    def limits() -> np.ndarray:
        full = best.least > np.iinfo(np.int64).min
        return np.minimum(bounds, np.where(full, _apart(squares, group.m_square, best.least.astype(np.float64)), np.inf)) + margin

    limit = limits()
    # The page object's distance to the routing object is stored: no computation yet.
    near = np.abs(routed[:, None] - to_routing[objects]) - radii <= limit[:, None]
    asks, used = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(asks):
        return []
    distances = np.full(near.shape, np.inf)
    distances[np.ix_(asks, used)] = _apart(squares[asks, None], group.m_square, _products(queries[asks], group.vectors[objects[used]]))
    least = np.where(near, np.maximum(0.0, distances - radii), np.inf)
    order = np.argsort(least, axis=1, kind="stable")
    begin, stride = 0, 1
    while begin < len(objects):
        ahead = order[:, begin : begin + stride]
        asked = np.take_along_axis(least, ahead, axis=1) <= limit[:, None]
        if not asked.any():
            break
        query, page = np.nonzero(asked)[0], ahead[asked]
        query, page = query[by := np.argsort(page, kind="stable")], page[by]
        cuts = np.flatnonzero(np.diff(page, prepend=-1, append=-1))
        found = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            here, (rows, _, parents, _) = query[i:j], group.pages[page[i]]
            may = np.abs(distances[here, page[i]][:, None] - parents) <= limit[here, None]
            some = np.flatnonzero(may.any(axis=0))
            if not len(some):
                continue
            scores, ids = _products(queries[here], group.vectors[some + rows.start]), group.ids[some + rows.start]
            row, col = np.nonzero(may[:, some] & (scores >= best.least[here, None]) & (ids != q_ids[here, None]))
            found.append((here[row], ids[col], scores[row, col]))
        if found:
            best.add(*(np.concatenate(c) for c in zip(*found, strict=True)))
        limit = limits()
        begin, stride = begin + stride, 2 * stride
    return list(zip(best.place.tolist(), best.ids.tolist(), best.scores.tolist(), strict=True))


class Bucket:
    """Groups that one task searches: their routing objects, stored distances and pages."""

    def __init__(self, routing: np.ndarray, part: np.ndarray, distances: np.ndarray, ids: np.ndarray, vectors: np.ndarray, centres: np.ndarray, m_square: float):
        borders = np.flatnonzero((np.diff(routing, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        self.groups = [(distances[i:j], Group(ids[i:j], vectors[i:j], m_square)) for i, j in zip(borders, [*borders[1:], len(ids)], strict=True)]
        self.centres, self.m_square = centres[routing[borders]], m_square

    def search(self, queries: np.ndarray, q_ids: np.ndarray, bounds: np.ndarray, k: int) -> Best:
        """The k best of each query in the bucket; groups with the nearest routing objects first."""
        best = Best(len(queries), k)
        squares = (queries**2).sum(axis=1)
        routed = _apart(squares[:, None], self.m_square, _products(queries, self.centres))
        margin = 1e-6 * (1 + np.sqrt(self.m_square) + np.sqrt(squares))
        for g in np.argsort(routed.mean(axis=0), kind="stable"):
            to_routing, group = self.groups[g]
            full = best.least > np.iinfo(np.int64).min
            limit = np.minimum(bounds, np.where(full, _apart(squares, self.m_square, best.least.astype(np.float64)), np.inf)) + margin
            d = routed[:, g]
            if ((d - to_routing[-1] <= limit) & (to_routing[0] - d <= limit)).any():
                search_group(group, to_routing, queries, q_ids, bounds, d, k, best)
        return best


def _dealt(counts: dict[int, int], dims: int) -> tuple[Column, Column]:
    """Group of a row of a routing object, and its bucket, from the number of rows of each routing object."""
    most = max(1, min(-(-sum(counts.values()) // BUCKETS), BUCKET_BYTES // (8 * dims)))
    rows = np.array([counts.get(r, 0) for r in range(max(counts) + 1)])
    parts = np.maximum(1, -(-rows // min(GROUP, most)))
    of = lambda values: F.get(F.lit(values.tolist()), F.col("routing"))
    part = F.pmod(F.xxhash64("place"), of(parts)).cast("int")
    return part, F.floor((of(np.cumsum(rows) - rows) + F.col("part") * of(rows / parts)) / most).cast("int")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, routing: int = ROUTING) -> DataFrame:
    """(query_id, rank, id, score): for each row (id, v) that is a query, its k best other rows."""
    none = (1 << 63) - 1  # rows without id: after all others
    rows = _kept(vectors.select(F.coalesce("id", F.lit(none)).alias("id"), "v", F.coalesce(is_query & F.col("id").isNotNull(), F.lit(False)).alias("asks")), "vectors")
    spark = rows.sparkSession
    square = F.aggregate("v", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x)
    sizes = rows.agg(F.max(F.size("v")).alias("dims"), F.max(square).alias("m")).first()
    schema = "query_id long, rank int, id long, score long"
    if not sizes["dims"]:
        return spark.createDataFrame([], schema)
    dims, m_square = sizes["dims"], float(sizes["m"])
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(routing).select("id", "v").collect()
    centres, centre_ids = np.zeros((len(sample), dims)), np.array([r["id"] for r in sample])
    for i, r in enumerate(sample):
        centres[i, : len(r["v"])] = r["v"]
    centre_squares = (centres**2).sum(axis=1)
    centre_lift = np.sqrt(np.maximum(0.0, m_square - centre_squares))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 33
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            own = (x**2).sum(axis=1)
            lift = np.sqrt(np.maximum(0.0, m_square - own))
            squared = own[:, None] + centre_squares - 2 * (x @ centres.T) + (lift[:, None] - centre_lift) ** 2
            at = squared.argmin(axis=1)
            to = np.sqrt(((x - centres[at]) ** 2).sum(axis=1) + (lift - centre_lift[at]) ** 2)
            places = np.arange(place, place + len(x))
            place += len(x)
            yield pa.record_batch([batch.column("id"), pa.array(places), pa.array(at, pa.int32()), pa.array(to), _packed(x)], names=["id", "place", "routing", "distance", "x"])

    routed = _kept(rows.select("id", "v").mapInArrow(route, "id long, place long, routing int, distance double, x binary"), "routed")
    counts = {r["routing"]: r["count"] for r in routed.groupBy("routing").count().collect()}  # one row for each routing object
    part, bucket = _dealt(counts, dims)
    entries = routed.withColumn("part", part).withColumn("bucket", bucket)
    # Distances of a routing object's rows in a bucket: somewhat more rows than there are buckets and routing objects.
    spans = entries.groupBy("bucket", "routing").agg(F.min("distance").alias("nearest"), F.max("distance").alias("farthest")).orderBy("bucket").collect()
    span_bucket, span_routing = (np.array([r[c] for r in spans], np.int64) for c in ("bucket", "routing"))
    nearest, farthest = (np.array([r[c] for r in spans]) for c in ("nearest", "farthest"))
    begins = np.flatnonzero(np.diff(span_bucket, prepend=-1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                ids, x = some.column("id").to_numpy(), _matrix(some.column("v"), dims)
                products = _products(x, centres)
                squares = (x**2).sum(axis=1)
                distance = _apart(squares[:, None], m_square, products)
                others = np.where(ids[:, None] == centre_ids[None], np.inf, distance)
                bounds = np.partition(others, k - 1, axis=1)[:, k - 1] if len(centre_ids) > k else np.full(len(ids), np.inf)
                bounds = np.where(np.isfinite(bounds), bounds, np.inf)
                slack = (bounds + 1e-6 * (1 + m_square**0.5 + np.sqrt(squares)))[:, None]
                d = distance[:, span_routing]
                meets = np.logical_or.reduceat((d - farthest <= slack) & (nearest - d <= slack), begins, axis=1)
                bound, packed = pa.array(bounds), _packed(x)
                for b in np.flatnonzero(meets.any(axis=0)):
                    here = pa.array(np.flatnonzero(meets[:, b]))
                    columns = [c.take(here) for c in (some.column("id"), some.column("hash"), bound, packed)]
                    yield pa.record_batch([pa.array(np.full(len(here), span_bucket[begins[b]], np.int32)), *columns], names=["bucket", "id", "hash", "distance", "x"])

    asking = rows.where("asks").select("id", "v", F.xxhash64("v").alias("hash")).distinct().mapInArrow(ask, "bucket int, id long, hash long, distance double, x binary")
    columns = ["bucket", "asks", "routing", "part", "distance", "id", "hash", "x"]
    stored = entries.withColumns({"asks": F.lit(False), "hash": F.lit(0).cast("long")}).select(columns)
    asking = asking.withColumns({"asks": F.lit(True), "routing": F.lit(0), "part": F.lit(0)}).select(columns)
    # A bucket's entries by group, then its queries.
    dealt = stored.unionByName(asking).repartition("bucket").sortWithinPartitions("bucket", "asks", "routing", "part", "distance", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, bucket = -1, [], None
        for batch in batches:
            kinds = np.column_stack((batch.column("bucket").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)))
            borders = np.flatnonzero((np.diff(kinds, axis=0, prepend=-1) != 0).any(axis=1)).tolist()
            for i, j in zip(borders, [*borders[1:], batch.num_rows], strict=True):
                some = batch.slice(i, j - i)
                if kinds[i, 0] != now:
                    now, held, bucket = kinds[i, 0], [], None
                if not kinds[i, 1]:
                    held.append([*(some.column(c).to_numpy() for c in ("routing", "part", "distance", "id")), _read(some.column("x"), dims)])
                    continue
                if bucket is None:
                    bucket, held = Bucket(*(np.concatenate(c) for c in zip(*held, strict=True)), centres, m_square), []
                for at in range(0, some.num_rows, BLOCK):
                    block = some.slice(at, BLOCK)
                    ids, hashes = block.column("id").to_numpy(), block.column("hash").to_numpy()
                    best = bucket.search(_read(block.column("x"), dims), ids, block.column("distance").to_numpy(), k)
                    yield pa.record_batch([pa.array(c) for c in (ids[best.place], hashes[best.place], best.ids, best.scores)], names=["query_id", "hash", "id", "score"])

    found = dealt.mapInArrow(search, "query_id long, hash long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "hash").orderBy(F.col("score").desc(), F.col("id").asc()))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), F.when(F.col("id") != none, F.col("id")).alias("id"), "score")
