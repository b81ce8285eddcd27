"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph is a line that holds more than blanks, tabs and carriage returns. It is hashed to a wide
vector, and a document is the sum of the vectors of its paragraphs, lane by lane, modulo a power of two.
The order of paragraphs does not matter, and a paragraph is inserted or deleted by adding or subtracting
its vector (`insert`, `delete`).

The vector has three parts, kept in one array `lanes`:

* one lane modulo 2**32: the number of phrases (runs between punctuation marks) of the paragraph;
* eight lanes modulo 2**32: the SHA-256 of the paragraph, for equality;
* 128 lanes modulo 2**16: for each phrase +1 or -1 by a bit of its MD5, summed. Two such sums differ by
  the phrases that only one document has, so their squared distance estimates how many those are, and a
  paragraph that is cut in the middle still resembles itself.

Null, empty and blank texts are the empty multiset: all lanes are zero. Repeated rows get the same lanes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EQUALITY_LANES = 8
SIGN_LANES = 128
PRINTABLE = "[^ \\t\\r]"
PUNCTUATION = "[.,!?;:|]+"

#: Paragraphs and phrases of a paragraph that are counted together: less than 2**16.
BLOCK = (63, 1024)

#: Documents that share a window, and the most windows there are; bounds of windows pass through the driver.
WINDOW_ROWS = 512
MOST_WINDOWS = 65_536
STEP = 64


def _filled(parts: Column) -> Column:
    return F.filter(parts, lambda p: p.rlike(PRINTABLE))


def _whole(digits: Column, at: int) -> Column:
    return F.conv(F.substring(digits, at, 8), 16, 10).cast("bigint")


def with_lanes(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, lanes) of each distinct value of `keys`; texts of equal keys are taken together.

    Partial sums are made where the text is read, so that only lanes are shuffled, and nothing at all
    if `df` is already partitioned by some of the keys.
    """
    at = ["_paragraphs", "_phrases"]
    paragraphs = df.select(*keys, F.posexplode_outer(_filled(F.split(F.col(text), "\n"))).alias("_p", "_paragraph"))
    hashed = paragraphs.withColumn("_sha", F.sha2("_paragraph", 256))
    wide = [f"_e{i}" for i in range(EQUALITY_LANES)]
    hashed = hashed.select(*keys, "_p", "_paragraph", *[_whole(F.col("_sha"), 8 * i + 1).alias(e) for i, e in enumerate(wide)])
    phrases = hashed.select(*keys, "_p", *wide, F.posexplode_outer(_filled(F.split("_paragraph", PUNCTUATION))).alias("_at", "_phrase"))
    phrases = phrases.withColumn("_md5", F.md5("_phrase"))
    words = [f"_w{w}" for w in range(SIGN_LANES // 64)]
    signs = phrases.select(
        *keys,
        F.floor(F.col("_p") / BLOCK[0]).alias(at[0]),
        F.floor(F.col("_at") / BLOCK[1]).alias(at[1]),
        *[F.when(F.coalesce("_at", F.lit(0)) == 0, F.col(e)).alias(e) for e in wide],
        "_phrase",
        *[F.shiftleft(_whole(F.col("_md5"), 16 * i + 1), 32).bitwiseOR(_whole(F.col("_md5"), 16 * i + 9)).alias(w) for i, w in enumerate(words)],
    )
    # Four bits of a word are counted in one long. A block has less than 2**16 phrases, so they never meet;
    # blocks are then added with two counts in a long.
    four, two = F.lit(sum(1 << 16 * i for i in range(4))), F.lit((1 << 16) - 1 + ((1 << 16) - 1 << 32))
    quarters = [(f"{w}_{i}", F.shiftrightunsigned(w, i).bitwiseAND(four)) for w in words for i in range(16)]
    blocks = signs.groupBy(*keys, *at).agg(
        F.count("_phrase").alias("_n"),
        *[F.coalesce(F.sum(e), F.lit(0)).alias(e) for e in wide],
        *[F.coalesce(F.sum(bits), F.lit(0)).alias(name) for name, bits in quarters],
    )
    sums = blocks.groupBy(*keys).agg(
        F.sum("_n").alias("_n"),
        *[F.sum(e).alias(e) for e in wide],
        *[F.sum(F.shiftrightunsigned(name, s).bitwiseAND(two)).alias(f"{name}_{s}") for name, _ in quarters for s in (0, 16)],
    )
    # Bit b of a word is counted in field b div 16 of the long for b mod 16.
    count = lambda w, b: F.shiftrightunsigned(f"{w}_{b % 16}_{b // 16 % 2 * 16}", b // 32 * 32).bitwiseAND(F.lit(0xFFFFFFFF))
    ones = [count(w, b) for w in words for b in range(64)]
    lanes = F.concat(
        F.array(F.col("_n").bitwiseAND(F.lit(0xFFFFFFFF)), *[F.col(e).bitwiseAND(F.lit(0xFFFFFFFF)) for e in wide]),
        F.transform(F.array(*ones), lambda x: (x * 2 - F.col("_n")).bitwiseAND(F.lit(0xFFFF))),
    )
    return sums.select(*keys, lanes.alias("lanes"))


def _folded(lanes: Column) -> Column:
    narrow = F.lit(EQUALITY_LANES)
    return F.transform(lanes, lambda x, i: F.when(i <= narrow, x.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(x.bitwiseAND(F.lit(0xFFFF))))


def insert(lanes: Column, more: Column) -> Column:
    """Lanes of both multisets together."""
    return _folded(F.zip_with(lanes, more, lambda a, b: a + b))


def delete(lanes: Column, less: Column) -> Column:
    """Lanes of what is left when the paragraphs of `less` are taken out."""
    return _folded(F.zip_with(lanes, less, lambda a, b: a - b))


def as_text(lanes: Column) -> Column:
    """Lowercase hex: eight digits for the lanes modulo 2**32, four for those modulo 2**16."""
    wide = F.transform(F.slice(lanes, 1, EQUALITY_LANES + 1), lambda x: F.lpad(F.hex(x), 8, "0"))
    narrow = F.transform(F.slice(lanes, EQUALITY_LANES + 2, SIGN_LANES), lambda x: F.lpad(F.hex(x), 4, "0"))
    return F.lower(F.array_join(F.concat(wide, narrow), ""))


def _square(x: Column) -> Column:
    signed = (x + F.lit(0x8000)).bitwiseAND(F.lit(0xFFFF)) - F.lit(0x8000)
    return signed * signed


def likeness(a: Column, b: Column) -> Column:
    """1 - |A - B|^2 / (|A|^2 + |B|^2) of the sign lanes, not below 0: about the share of common phrases.

    Two empty multisets are alike (1).
    """
    signs = lambda lanes: F.slice(lanes, EQUALITY_LANES + 2, SIGN_LANES)
    total = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + _square(x))
    apart = total(F.zip_with(signs(a), signs(b), lambda x, y: x - y))
    both = total(signs(a)) + total(signs(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - apart.cast("double") / both.cast("double")))


def _windows(df: DataFrame, key: str) -> list:
    """Highest key of each window, ascending; every bound is a key that occurs."""
    rows = df.count()
    n = max(1, min(MOST_WINDOWS, -(-rows // WINDOW_ROWS)))
    shares = [F.lit((i + 1) / n) for i in range(n)]
    bounds = df.agg(F.percentile_approx(key, F.array(*shares), F.lit(max(10_000, 4 * n))).alias("b")).first()["b"]
    return sorted(set(bounds or []))


def _window_of(key: Column, bounds: list) -> Column:
    """Number of bounds below the key, in two steps."""
    below = lambda some: F.size(F.filter(some, lambda b: b < key))
    if not bounds:
        return F.lit(0)
    coarse = F.greatest(F.lit(1), below(F.lit(bounds[::STEP])))
    fine = F.slice(F.lit(bounds), (coarse - 1) * STEP + 1, F.lit(STEP))
    return F.coalesce((coarse - 1) * STEP + below(fine), F.lit(0))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text of (doc_id, text) and of the text with its last half replaced.

    The last floor(n_chars / 2) code points give way to the first as many (or all) of the next document
    in descending doc_id, after the last to those of the first. Rows with equal doc_id follow each other
    in the order of their texts; a null doc_id comes after all others.

    Texts are shuffled once, to windows of neighbouring ids. The highest document of a window is also
    sent to the window above, whose last row it follows, so that no window looks into another.

    Returns doc_id, n_chars, edited_sha256, lanes, edited_lanes, next_lanes.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = _windows(rows, "doc_id")
    window = _window_of(F.col("doc_id"), bounds)
    above = F.pmod(window + 1, F.lit(max(1, len(bounds))))
    is_bound = F.col("doc_id") == F.element_at(F.lit(bounds or [0]), F.least(window, F.lit(max(0, len(bounds) - 1))) + 1)
    own = F.struct(window.alias("window"), F.lit(False).alias("guest"))
    guest = F.struct(above.alias("window"), F.lit(True).alias("guest"))
    sent = rows.withColumn("_to", F.explode(F.when(F.coalesce(is_bound, F.lit(False)), F.array(own, guest)).otherwise(F.array(own))))
    sent = sent.select("_to.window", "_to.guest", "doc_id", "text")

    order = Window.partitionBy("window").orderBy(F.col("guest").asc(), F.col("doc_id").desc_nulls_last(), F.col("text").asc())
    placed = sent.select(
        "*",
        F.row_number().over(order).alias("at"),
        F.coalesce(F.lead("text").over(order), F.lit("")).alias("_next"),
    )
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    keys = ["window", "at", "guest", "doc_id", "n_chars", "edited_sha256"]
    edited = F.concat(F.expr("left(text, char_length(text) - char_length(text) div 2)"), F.expr("left(_next, char_length(text) div 2)"))
    texts = placed.withColumn("_edited", F.when(~F.col("guest"), edited)).select(
        "window",
        "at",
        "guest",
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")), F.struct(F.lit(1).alias("side"), F.col("_edited").alias("body")))).alias("_b"),
    )
    lanes = with_lanes(texts.select(*keys, "_b.side", "_b.body"), [*keys, "side"], "body")
    sides = lanes.groupBy(*keys).agg(
        F.max(F.when(F.col("side") == 0, F.col("lanes"))).alias("lanes"),
        F.max(F.when(F.col("side") == 1, F.col("lanes"))).alias("edited_lanes"),
    )
    along = Window.partitionBy("window").orderBy("at")
    return (
        sides.withColumn("next_lanes", F.lead("lanes").over(along))
        .where(~F.col("guest"))
        .select("doc_id", "n_chars", "edited_sha256", "lanes", "edited_lanes", F.coalesce("next_lanes", "lanes").alias("next_lanes"))
    )
