"""Near copies: all texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, exactly.

Words are those of `simhash`; a shorter text is one shingle, texts without words are copies of each other. Equal
sets are one set.

Candidates come by operator 9's method: a set's fingerprint has the bits that over half of its shingles' hashes have, and
fingerprints are routed through its vantage-point tree to shards. Each shard gives pairs that are at most RADIUS bits apart
and whose sizes and folded sketches allow the similarity, the likest first: FORESTS forests that span its groups, one of what
the others leave, since a pair that is not confirmed must not stand for others; never all. The shingles themselves confirm
them. Sets of that similarity are usually, not always, that near and usually meet: the way to a shard crosses borders by
CROSSED bits only, since a border that all pairs within RADIUS cross would send every set to every shard.

What fingerprints let pass is found exactly by shared shingles of sets in different components. Shingles get one order for
all texts: by how often a share of the texts holds them, then by hash. Two sets of that similarity share one of the first
n - ceil(0.8 n) + 1 shingles of each, whatever the order is, so the share decides the cost and not the result. Each set
meets at most two hubs first. A hub of a shingle is its most central set, the one whose shingles of the prefix most sets
hold, be it of all or of those of about one size: edits bring shingles of their own, so that is the text the others were
made of, where it is there. Then all pairs that share a shingle and are still in different components are compared, by
shingle and size. The joins themselves drop a pair by its sizes, by the places of the shared shingle (what stands behind it
bounds what can be shared) or by folded sketches (parities of hashed shingles: the bits that differ are never more than the
shingles that only one of two sets has). Wider sketches are compared next, and what is left is confirmed by the shingles
themselves. Joins by shingle have one row a shingle on one side or are cut by size, so adaptive execution can split a
frequent shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.components import _dropped, _kept, _release, components
from larder.llm.simhash import SEED, first_of_each, grouped, majority, near_forest, shards

WIDTH = 5
#: Share of the texts whose shingles are counted for the order, of small tables so many texts; least count and most
#: shingles that are kept of them.
SHARE, SAMPLE, COUNT_LEAST, FREQUENT = 1 / 8, 16_384, 2, 1 << 18
#: Bits of a sketch for each shingle, least bits.
SKETCH, SKETCH_LEAST = 1, 256
#: Columns of a sketch folded to its least size.
FOLDED = [f"s{i}" for i in range(SKETCH_LEAST // 64)]
#: What a set is known by where shingles are joined.
SET = ["central", "fp", "n", "at", *FOLDED]
#: Bits in which fingerprints of near sets differ at most, bits by which a vantage point's border is crossed on the way to a
#: shard, sets aimed at in a shard, most of a shard that are searched and that ask together. What they let pass, the shared
#: shingles find.
RADIUS, CROSSED, SHARD_SETS, HOME_SETS, ASKING_SETS = 14, 2, 32_768, 65_536, 65_536
#: Forests of pairs that a shard gives, each spanning what the ones before leave: at most so many pairs a set and shard.
FORESTS = 8
#: Texts that are described together.
TEXTS = 512
#: Least size of different sets with the similarity.
LEAST = 4
#: Sizes of a class are within this factor, somewhat more than 1 / 0.8, so similar sets are at most one class apart.
SIZES = 1.26


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the shingles of a text, sorted."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w, SEED) for w in words], np.uint64)
    width = min(width, len(words))
    n = len(words) - width + 1
    joined = np.full(n, width, np.uint64)
    for i in range(width):
        joined = _mixed(joined * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return np.unique(joined)


def prefix(held: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of a set, rare ones first; `frequent` is sorted."""
    often = np.zeros(len(held), np.int64)
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, held), len(frequent) - 1)
        often = np.where(frequent[place] == held, counts[place], 0)
    return held[np.lexsort((held, often))][: len(held) - (4 * len(held) + 4) // 5 + 1] if len(held) else held


def sketch(held: np.ndarray) -> bytes:
    bits = max(SKETCH_LEAST, 1 << (SKETCH * len(held)).bit_length())
    return np.packbits(np.bincount((held & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(bits: bytes) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.int64).reshape(-1, len(FOLDED)), axis=0)


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the shingles that only one of two sets has."""
    if len(a) < len(b):
        a, b = b, a
    narrow = np.bitwise_xor.reduce(np.frombuffer(a, np.uint8).reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(narrow ^ np.frombuffer(b, np.uint8)).sum())


def _order(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a share hold, and their counts; at most FREQUENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.record_batch([pa.array(shingles(text.as_py()).view(np.int64))], names=["shingle"])
        _release()

    share = int(min(1.0, max(SHARE, SAMPLE / max(1, texts.count()))) * (1 << 31))
    drawn = texts.where(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 31)) < share).select("text")
    counted = drawn.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= COUNT_LEAST)
    most = counted.orderBy(F.col("n").desc(), "shingle").limit(FREQUENT).toArrow()
    found, counts = most.column("shingle").to_numpy().view(np.uint64), most.column("n").to_numpy()
    by = np.argsort(found)
    return found[by], counts[by]


def _described(texts: DataFrame, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, fp, print, n, prefix, sketch, FOLDED): fp names a set, 0 the empty one; print is its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some.slice(at, TEXTS) for some in batches for at in range(0, some.num_rows, TEXTS)):
            names, prints, sizes, firsts, sketches = [], [], [], [], []
            for text in batch.column(2):
                held = shingles(text.as_py())
                names.append(xxhash.xxh64_intdigest(held.tobytes(), SEED) if len(held) else 0)
                prints.append(majority(held))
                sizes.append(len(held))
                firsts.append(prefix(held, frequent, counts).view(np.int64))
                sketches.append(sketch(held))
            narrow = np.array([folded(bits) for bits in sketches], np.int64).reshape(-1, len(FOLDED))
            columns = [pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            columns += [pa.array(narrow[:, i]) for i in range(len(FOLDED))]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=["doc_id", "text_hash", "fp", "print", "n", "prefix", "sketch", *FOLDED])
        _release()

    kinds = "doc_id long, text_hash long, fp long, print long, n long, prefix array<long>, sketch binary"
    return texts.mapInArrow(run, f"{kinds}, {', '.join(f'{c} long' for c in FOLDED)}")


def _may_be_near(a: str, b: str) -> Column:
    """Whether sizes, places of a shared shingle and folded sketches allow the similarity; a and b are prefixes of SET."""
    n_a, n_b, at_a, at_b = (F.col(f"{side}{c}") for c in ("n", "at") for side in (a, b))
    most = F.least(at_a, at_b) + 1 + F.least(n_a - at_a - 1, n_b - at_b - 1)
    differ = reduce(add, [F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in FOLDED])
    # |a xor b| <= (|a| + |b|) / 9 is a similarity of 0.8 or more, and so is 9 |a and b| >= 4 (|a| + |b|).
    return (5 * F.least(n_a, n_b) >= 4 * F.greatest(n_a, n_b)) & (9 * most >= 4 * (n_a + n_b)) & (9 * differ <= n_a + n_b)


def _near(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, n_a, n_b) whose sets have the similarity."""

    def bound(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([apart(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pa.array([shingles(t.as_py()).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), held], names=["fp", "held"])
        _release()

    def both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        for side in ("a", "b"):
            own = table.select(F.col("fp").alias("_fp"), F.col(column).alias(f"{column}_{side}"))
            pairs = pairs.join(own, F.col(side) == F.col("_fp")).drop("_fp")
        return pairs

    all_n = F.col("n_a") + F.col("n_b")
    likely = _kept(both(pairs, sets, "sketch").where(9 * F.arrow_udf(bound, "long")("sketch_a", "sketch_b") <= all_n).select("a", "b", "n_a", "n_b"), "likely")
    wanted = likely.select(F.col("a").alias("_fp")).unionByName(likely.select(F.col("b").alias("_fp"))).distinct()
    places = sets.join(wanted, F.col("fp") == F.col("_fp"), "left_semi").select("fp", F.col("place.text_hash").alias("_hash"), F.col("place.doc_id").alias("_id"))
    found = texts.join(places, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_hash").eqNullSafe(F.col("_hash"))).select("fp", "text")
    held = _kept(found.mapInArrow(run, "fp long, held array<long>").dropDuplicates(["fp"]), "held")
    shared = F.size(F.array_intersect("held_a", "held_b"))
    near = _kept(both(likely, held, "held").where(9 * shared >= 4 * all_n).select("a", "b"), "near")
    _dropped(likely, held)
    return near


def _keys(described: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, fp, at) of the shingles of each set's prefix, from one of its texts."""
    places = sets.select(F.col("fp").alias("_fp"), "place")
    here = F.col("doc_id").eqNullSafe(F.col("place.doc_id")) & (F.col("text_hash") == F.col("place.text_hash"))
    return described.join(places, F.col("fp") == F.col("_fp")).where(here).select("fp", F.posexplode("prefix").alias("at", "key"))


def _shared(described: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, SET, size) of the shingles of prefixes that several sets hold."""
    keys = _keys(described, sets)
    several = keys.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("held")).where("held > 1")
    shared = _kept(keys.join(several, F.col("key") == F.col("_key")).select("key", "fp", "at", "held"), "held")
    central = shared.groupBy(F.col("fp").alias("_fp")).agg(F.sum("held").alias("central"))
    central = central.join(sets.select("fp", "n", *FOLDED), F.col("_fp") == F.col("fp")).drop("fp")
    size = F.floor(F.log("n") / F.log(F.lit(SIZES))).cast("int").alias("size")
    ranked = _kept(shared.join(central, F.col("fp") == F.col("_fp")).select("key", *SET, size), "shared")
    _dropped(shared)
    return ranked


def _met(sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b) of sets whose fingerprints are near, from the shards of vantage points."""

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        names, first, place = np.unique(table.column("fp").to_numpy(), return_index=True, return_inverse=True)
        prints, sizes, *narrow = (table.column(c).to_numpy()[first] for c in ("print", "n", *FOLDED))

        def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return 9 * sum(np.bitwise_count((c[a] ^ c[b]).view(np.uint64)).astype(np.int64) for c in narrow) / (sizes[a] + sizes[b])

        a, b = near_forest(prints.view(np.uint64), sizes, place[~asks], place[asks], RADIUS, unlike, FORESTS)
        a, b = np.minimum(a, b), np.maximum(a, b)
        return pa.table({"a": names[a], "b": names[b], "n_a": sizes[a], "n_b": sizes[b]})

    dealt = shards(sets.where(F.col("n") >= LEAST).select("fp", "print", "n", *FOLDED), "print", CROSSED, SHARD_SETS, HOME_SETS, ASKING_SETS)
    met = _kept(dealt.groupBy("shard", "h", "q").applyInArrow(search, "a long, b long, n_a long, n_b long").distinct(), "met")
    _dropped(dealt)
    return met


def _apart(shared: DataFrame, near: DataFrame) -> DataFrame:
    """(key, SET, size, root) of the shingles that sets of several components of `near` hold."""
    roots = _kept(components(near), "roots")
    known = shared.join(roots, F.col("fp") == F.col("node"), "left").select(*shared.columns, F.coalesce("root", "fp").alias("root"))
    mixed = known.groupBy(F.col("key").alias("_key")).agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    return _kept(known.join(mixed, F.col("key") == F.col("_key")).select(*shared.columns, "root"), "mixed")


def _stars(mixed: DataFrame, by: list[str]) -> DataFrame:
    """(a, b, n_a, n_b): each set b with the most central a of the hubs of its groups that it may be near to."""
    hubs = mixed.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.max(F.struct(*SET, "root")).alias("hub"))
    met = mixed.join(hubs, [F.col(c) == F.col(f"_{c}") for c in by]).where((F.col("root") != F.col("hub.root")) & _may_be_near("", "hub."))
    best = met.groupBy("fp").agg(F.max(F.struct("hub.central", "hub.fp", "hub.n")).alias("hub"), F.first("n").alias("n"))
    return best.select(F.col("hub.fp").alias("a"), F.col("fp").alias("b"), F.col("hub.n").alias("n_a"), F.col("n").alias("n_b"))


def by_fingerprints(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of sets with the similarity that met in the shards of vantage points."""
    return _near(_met(sets), sets, texts)


def by_shingles(near: DataFrame, described: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of sets with the similarity that join the components of `near` to those of all such pairs."""
    shared = _shared(described, sets)
    mixed = _apart(shared, near)
    _dropped(shared)
    stars = _near(_stars(mixed, ["key"]).unionByName(_stars(mixed, ["key", "size"])).distinct(), sets, texts)
    rest = _apart(mixed.drop("root"), near.unionByName(stars))
    _dropped(mixed)
    # The larger set of a pair is of the same class of sizes or one above.
    other = rest.select(*[F.col(c).alias(f"o_{c}") for c in ("key", *SET[1:], "root")], F.explode(F.array("size", F.col("size") - 1)).alias("o_size"))
    order = (F.col("n") < F.col("o_n")) | ((F.col("n") == F.col("o_n")) & (F.col("fp") < F.col("o_fp")))
    met = rest.join(other, (F.col("key") == F.col("o_key")) & (F.col("size") == F.col("o_size")) & order & (F.col("root") != F.col("o_root")) & _may_be_near("", "o_"))
    met = met.select(F.col("fp").alias("a"), F.col("o_fp").alias("b"), F.col("n").alias("n_a"), F.col("o_n").alias("n_b")).distinct()
    return stars.unionByName(_near(met, sets, texts))


def links(described: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) whose components are those of all pairs of sets with the similarity."""
    near = by_fingerprints(sets, texts)
    return near.unionByName(by_shingles(near, described, sets, texts))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) as `simhash.near_duplicates` has them; fp names a set of shingles."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    described = _kept(_described(texts, *_order(texts)), "described")
    one = [F.first(c).alias(c) for c in ("print", "n", "sketch", *FOLDED)]
    sets = _kept(described.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash")).alias("place"), *one), "sets")
    found = links(described, sets, texts)
    rows = _kept(described.select("doc_id", "text_hash", "fp"), "set-rows")
    _dropped(described)
    return grouped(rows, sets.select("fp", "first_id"), found)


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near copies, as `simhash.one_of_each` keeps them."""
    return first_of_each(docs, near_copies(docs))
