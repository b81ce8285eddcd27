"""Line dedup: a suffix array over line ids finds repeated runs of lines, and later copies are deleted.

A line is what stands between line feeds, without blanks at its end; lines of blanks go with the line before
them and count for nothing. The corpus is the sequence of lines of all documents in the order of doc_id; runs
do not reach over the end of a document. A run is repeated if the same lines stand elsewhere in the corpus, it
is a later copy if they also stand earlier, and every line of a later copy of at least `min_words` words (parted by
blanks and tabs; ten characters count as one word at least) is deleted. A run that repeats inside itself is cut to its first period.

Lines get ids in sorted order. Lines that occur once end every run, so only the others are kept. Prefix
doubling ranks the suffixes by 1, 2, 4, ... lines: the pair (rank of a suffix, rank of the one that many lines
on) is sorted, and its place is the rank of twice the length. Suffixes with equal rank share that many lines;
an interval of the array with a common prefix of L lines is the suffixes with equal ranks at both ends of it,
as two blocks of the largest power of two up to L cover it. The first position of an interval is the original.

A line is in a later copy of enough words if it is in one that falls short without its first line, or is as
short as it can be. Such a run has at most `min_words` lines, so doubling stops at that depth and nothing
grows with the length of a copy. Runs that follow each other with the same original are joined to maximal ones.

Rows with equal doc_id are ordered by a hash of their texts; equal rows are one document and get equal results.
A null doc_id comes last, a null text has no lines and stays null. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.components import _kept

MIN_WORDS = 10
#: A line has at least as many words as it has stretches of so many characters: for other white space, and scripts without.
WORD_CHARS = 10
LAST = (1 << 63) - 1
KEY = ["doc", "hash"]
#: A line feed before a line that is not blank.
BREAK = "\n(?=[ \t\r]*[^ \t\r\n])"


def _elements(text: Column) -> Column:
    """Lines with the blank lines after them."""
    return F.split(text, BREAK)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "hash": F.xxhash64("text")})


def line_table(docs: DataFrame) -> DataFrame:
    """(doc, hash, n, line, words) of every line that is not blank; `line` is its MD5, as binary."""
    lines = _keyed(docs.select("doc_id", "text")).select(*KEY, F.posexplode(_elements(F.col("text"))).alias("n", "_element"))
    lines = lines.withColumn("_line", F.regexp_replace("_element", "[ \t\r\n]+$", "")).where("_line <> ''")
    words = F.greatest(F.size(F.split(F.trim("_line"), "[ \t]+")), F.floor(F.char_length("_line") / WORD_CHARS).cast("int"))
    return lines.select(*KEY, "n", F.unhex(F.md5("_line")).alias("line"), words.alias("words"))


def _ranked(pairs: DataFrame, *by: str) -> DataFrame:
    """A rank for each distinct pair, in sorted order: the place a range-partitioned sort gives it."""
    return _kept(pairs.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def suffix_ranks(lines: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """Positions of repeated lines with ranks r0, r1, ... by 1, 2, 4, ... lines, and the number of ranks.

    The last rank orders the suffixes by their first lines, as many as the power of two that first reaches
    `depth` has; a suffix that ends before sorts ahead of its continuations.
    """
    repeated = lines.groupBy("line").agg(F.count("*").alias("_n")).where("_n > 1").select("line")
    ranks = _ranked(repeated, "line").withColumnRenamed("rank", "r0")
    positions = _kept(lines.join(ranks, "line").select(*KEY, "n", "words", "r0"), "positions")
    levels = 1
    while 1 << (levels - 1) < depth:
        step, last = 1 << (levels - 1), f"r{levels - 1}"
        on = Window.partitionBy(*KEY).orderBy("n").rangeBetween(step, step)
        paired = positions.withColumn("_next", F.coalesce(F.first(last).over(on), F.lit(-1)))
        ranks = _ranked(paired.where("_next >= 0").select(last, "_next").distinct(), last, "_next")
        if not ranks.head(1):  # no run is that long
            break
        ranks = ranks.select(F.col(last).alias("_a"), F.col("_next").alias("_b"), F.col("rank").alias(f"r{levels}"))
        joined = paired.join(ranks, (F.col(last) == F.col("_a")) & (F.col("_next") == F.col("_b")), "left")
        positions = _kept(joined.select(*positions.columns, f"r{levels}"), "positions")
        levels += 1
    return positions, levels


def _runs(positions: DataFrame, levels: int, min_words: int) -> DataFrame:
    """(doc, hash, n, size, a, b): runs of enough words that fall short without their first line, or are
    as short as they can be, with the ranks of the blocks at their two ends."""
    ahead = Window.partitionBy(*KEY).orderBy("n").rowsBetween(0, min_words - 1)
    fields = ["n", "words", *[f"r{k}" for k in range(levels)]]
    seen = positions.distinct().withColumn("_s", F.collect_list(F.struct(*fields)).over(ahead))
    # Lines that follow each other without a gap, and the words up to each.
    whole = F.filter("_s", lambda s, i: s["n"] == F.col("n") + i)
    sums = F.aggregate(F.col("_s"), F.array().cast("array<long>"), lambda t, s: F.concat(t, F.array(F.coalesce(F.element_at(F.when(F.size(t) > 0, t), -1), F.lit(0)) + s["words"])))
    sized = seen.withColumn("_s", whole).withColumn("_t", sums)
    fits = F.filter(
        F.sequence(F.lit(1), F.size("_s")),
        lambda size: (F.get("_t", size - 1) >= min_words) & ((size == 1) | (F.get("_t", size - 1) - F.col("words") < min_words) | (F.get("_t", size - 2) < min_words)),
    )
    runs = sized.withColumn("size", F.explode(fits))
    level = F.floor(F.log2("size") + 1e-9).cast("int")
    at = lambda k, place: F.get(F.col("_s"), place)[f"r{k}"]
    a = F.coalesce(*[F.when(level == k, at(k, F.lit(0))) for k in range(levels)])
    b = F.coalesce(*[F.when(level == k, at(k, F.col("size") - (1 << k))) for k in range(levels)])
    return runs.select(*KEY, "n", "size", a.alias("a"), b.alias("b"))


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, hash, n, size, first): runs that stand earlier as well; `first` is (doc, hash, n) of the original."""
    lines = _kept(line_table(docs), "lines")
    positions, levels = suffix_ranks(lines, min_words)
    runs = _kept(_runs(positions, levels, min_words), "runs")
    place = F.struct("doc", "hash", "n")
    firsts = runs.groupBy("size", "a", "b").agg(F.min(place).alias("first"), F.max(place).alias("_last")).where("first <> _last")
    return runs.join(firsts, ["size", "a", "b"]).where(place > F.col("first")).select(*KEY, "n", "size", "first")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line, lines, first_doc_id, first_line): maximal runs that are later copies of one original."""
    copies = later_copies(docs, min_words).withColumns({"_doc": F.col("first.doc"), "_hash": F.col("first.hash"), "_shift": F.col("n") - F.col("first.n")})
    same = Window.partitionBy(*KEY, "_doc", "_hash", "_shift").orderBy("n")
    reach = F.max(F.col("n") + F.col("size")).over(same.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("n") <= reach, 0).otherwise(1)).over(same)
    whole = copies.withColumn("_run", run).groupBy(*KEY, "_doc", "_hash", "_shift", "_run").agg(F.min("n").alias("line"), F.max(F.col("n") + F.col("size")).alias("_end"))
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return whole.select(known("doc").alias("doc_id"), "line", (F.col("_end") - F.col("line")).alias("lines"), known("_doc").alias("first_doc_id"), (F.col("line") - F.col("_shift")).alias("first_line"))


def without_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of `docs` with later copies deleted from `text`, and the number of lines before and after.

    `docs` must have doc_id and text; `n_lines` and `n_deleted` are put behind its columns.
    """
    gone = later_copies(docs, min_words).select("doc", "hash", F.explode(F.sequence(F.col("n"), F.col("n") + F.col("size") - 1)).alias("n"))
    gone = gone.groupBy("doc", "hash").agg(F.array_sort(F.collect_set("n")).alias("_gone"))
    gone = gone.select(F.col("doc").alias("_doc"), F.col("hash").alias("_hash"), "_gone")
    # One flag for each line up to the last that goes, so that a line is looked up by its place.
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("_gone", i - 1))
    flags = F.flatten(F.transform("_gone", lambda n, i: F.concat(F.array_repeat(F.lit(False), n - before(i) - 1), F.array(F.lit(True)))))
    own_doc, own_hash = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64("text")
    keyed = docs.select(F.struct("*").alias("_row"), own_doc.alias("_doc"), own_hash.alias("_hash"))
    marked = keyed.join(gone, ["_doc", "_hash"], "left").withColumn("_flags", flags)
    elements = _elements(F.col("_row.text"))
    kept = F.array_join(F.filter(elements, lambda x, i: ~F.coalesce(F.get("_flags", i), F.lit(False))), "\n")
    blank = F.col("_row.text").rlike("^[ \t\r\n]*$")
    n_lines = F.when(blank, 0).otherwise(F.size(elements) - F.get(elements, F.lit(0)).rlike("^[ \t\r\n]*$").cast("int"))
    columns = [F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(kept).alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return marked.select(*columns, F.coalesce(n_lines, F.lit(0)).alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).alias("n_deleted"))
