"""Does a candidate result equal a reference result?

Columns may be extra, rows may not. Tables are compared where they are, any number of questions in one
plan; a verdict is a row like any other. Ordered comparison needs a position column, since a
distributed table has no order of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.numbers import round_even
from larder.functions.text import cell_text
from larder.session import cut_lineage

ROUND_DIGITS = 2

# Result columns that are decoration in every question.
OPTIONAL_COLUMNS = ["unit"]

OVERLAP_ENOUGH = 0.8

#: All columns have partners of equal values, but not in the same rows.
MISALIGNED = "values exist but rows do not line up"


@dataclass(frozen=True)
class Verdict:
    passed: bool
    reason: str


def _kind(field: T.StructField) -> str:
    if isinstance(field.dataType, T.IntegralType):
        return "whole"
    if isinstance(field.dataType, T.NumericType):
        return "number"
    if isinstance(field.dataType, T.StringType):
        return "text"
    return field.dataType.simpleString()


def _is_numeric(field: T.StructField) -> bool:
    return _kind(field) in ("whole", "number")


def _normal_cell(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "number":
        # Adding zero turns -0.0 into 0.0; NaN stands for a missing value.
        return F.nanvl(round_even(c, ROUND_DIGITS) + 0.0, F.lit(None).cast("double"))
    if kind == "text":
        return cell_text(c)
    return c


def _columns(df: DataFrame, position: str | None) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name != position]


def normalize_table(df: DataFrame, position: str | None = None) -> DataFrame:
    """Columns by name, fractions rounded, text trimmed and lower-cased."""
    fields = sorted(_columns(df, position), key=lambda f: f.name)
    cells = [_normal_cell(f.name, _kind(f)).alias(f.name) for f in fields]
    return df.select(*([F.col(position)] if position else []), *cells)


def _signed_rows(
    gold: DataFrame, cand: DataFrame, pairs: Sequence[tuple[str, str]], position: str | None
) -> DataFrame:
    """Both tables as one, gold rows counting +1 and candidate rows -1, over paired columns."""

    def side(df: DataFrame, other: DataFrame, mine: int, sign: int) -> DataFrame:
        cells = []
        for i, pair in enumerate(pairs):
            kind = _kind(df.schema[pair[mine]])
            if {kind, _kind(other.schema[pair[1 - mine]])} == {"whole", "number"}:
                kind = "number"
            cells.append(_normal_cell(pair[mine], kind).alias(f"v{i}"))
        place = [F.col(position).cast("long").alias("_at")] if position else []
        return df.select(*place, *cells, F.lit(sign).cast("long").alias("_sign"))

    return side(gold, cand, 0, 1).unionAll(side(cand, gold, 1, -1))


def _same_kinds(gold: DataFrame, cand: DataFrame, pairs: Sequence[tuple[str, str]]) -> bool:
    for g, c in pairs:
        a, b = gold.schema[g], cand.schema[c]
        if _kind(a) != _kind(b) and not (_is_numeric(a) and _is_numeric(b)):
            return False
    return True


def row_differences(
    gold: DataFrame, cand: DataFrame, pairs: Sequence[tuple[str, str]], position: str | None = None
) -> DataFrame:
    """One row: sizes of both tables and how many distinct rows differ in count.

    The counts of equal rows meet in one shuffle with partial sums. With a position, the place of a
    row is part of the row.
    """
    signed = _signed_rows(gold, cand, pairs, position)
    keys = [c for c in signed.columns if c != "_sign"]
    per_row = signed.groupBy(*keys).agg(
        F.sum("_sign").alias("_net"),
        F.count_if(F.col("_sign") > 0).alias("_gold"),
        F.count_if(F.col("_sign") < 0).alias("_cand"),
    )
    zero = F.lit(0)
    return per_row.agg(
        F.coalesce(F.sum("_gold"), zero).alias("gold_rows"),
        F.coalesce(F.sum("_cand"), zero).alias("cand_rows"),
        F.count_if(F.col("_net") != 0).alias("differing"),
    )


# Digests are summed modulo this, so that sums stay exact in a long up to 8.7e12 rows.
DIGEST_MODULUS = 1048573

# Most questions that are named in a plan; most columns whose marks are broadcast.
FEW, SMALL = 256, 1 << 16


# ---------------------------------------------------------------- many answers at once


def answer_rows(
    df: DataFrame, question: Column, columns: Sequence[str] | None = None, position: str | None = None
) -> DataFrame:
    """(question, pos, cells): a row's cells as (name, kind, h); h hashes the normalised value, NULL stays NULL.

    ``df`` may hold the results of any number of questions. ``pos`` is NULL where order is free.
    """
    fields = [f for f in _columns(df, position) if columns is None or f.name in columns]
    cells = []
    for f in fields:
        kind = "number" if _is_numeric(f) else _kind(f)
        value = _normal_cell(f.name, kind)
        value = value if kind in ("number", "text") else value.cast("string")
        cells.append(F.struct(F.lit(f.name).alias("name"), F.lit(kind).alias("kind"), F.when(value.isNotNull(), F.xxhash64(value)).alias("h")))
    place = F.col(position).cast("long") if position else F.lit(None).cast("long")
    empty = F.array().cast("array<struct<name:string,kind:string,h:bigint>>")
    return df.select(question.cast("string").alias("question"), place.alias("pos"), (F.array(*cells) if cells else empty).alias("cells"))


def pair_columns(gold: Sequence, cand: Sequence) -> list[tuple[str, str]]:
    """Pairs of columns (at, name, values, rows) with equal values, the surest first.

    ``values`` is a digest of a column's values, ``rows`` one of its values with what stands beside them.
    """
    levels = [("values", "rows", "name"), ("values", "rows"), ("values", "name"), ("values",)]
    free, pairs = sorted(cand, key=lambda c: c["at"]), {}
    for level in levels:
        for g in sorted(gold, key=lambda c: c["at"]):
            fits = [c for c in free if all(c[k] == g[k] for k in level)]
            if g["name"] not in pairs and fits:
                pairs[g["name"]] = fits[0]["name"]
                free.remove(fits[0])
    return list(pairs.items())


def _sums(hashed: Column) -> list[Column]:
    return [F.count(hashed), F.sum(F.pmod(hashed, F.lit(DIGEST_MODULUS))), F.bit_xor(hashed)]


def _digest(hashed: Column) -> Column:
    return F.concat_ws("|", *_sums(hashed))


def _row_hash(names: Column, width: int) -> Column:
    """Sum of the hashes of a row's up to `width` cells under the numbers a map gives their names; others do not count.

    Written out cell by cell, as a function over the array would be interpreted for each row.
    """
    total = F.lit(0).cast("long")
    for i in range(width):
        cell = F.get("cells", F.lit(i))
        own = names[cell["name"]]
        total += F.when(own.isNotNull(), F.pmod(F.xxhash64(own, cell["h"].isNull(), cell["h"]), F.lit(1 << 48))).otherwise(F.lit(0).cast("long"))
    return total


def _both(gold: DataFrame, cand: DataFrame) -> DataFrame:
    return gold.withColumn("side", F.lit("gold")).unionByName(cand.withColumn("side", F.lit("cand")))


def _only(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """The rows of some questions. Up to FEW are named in the plan, so the cells of others are never made."""
    names = [r["question"] for r in questions.select("question").limit(FEW + 1).collect()]
    if len(names) <= FEW:
        return rows.where(F.col("question").isin(names))
    return rows.join(questions.select("question"), "question", "left_semi")


def _small(marks: DataFrame, count: int) -> DataFrame:
    """Marks of columns, sent to the rows if there are at most SMALL of them; rows of few questions would meet in few tasks."""
    return F.broadcast(marks) if count <= SMALL else marks


def _column_digests(rows: DataFrame, cells: Column, hashed: Column, out: str) -> DataFrame:
    """(question, side, name, kind, at, n, held, out): a digest of each column's hashed cells ``c`` that are not NULL.

    Keys and sums are such that partial sums are hashed; a text among the sums would sort all cells.
    """
    found = rows.select("question", "side", "pos", "beside", F.posexplode(cells).alias("at", "c"))
    cell = F.when(F.col("c.h").isNotNull(), hashed)
    found = found.groupBy("question", "side", "c.name", "c.kind").agg(F.min("at").alias("at"), F.count("*").alias("n"), F.count(cell).alias("held"), _digest(cell).alias(out))
    return found.withColumn(out, F.concat_ws("|", "kind", out))


def _among(both: DataFrame, columns: DataFrame, by: str) -> DataFrame:
    """(question, side, name, rows): a digest of each column's cells with a hash of what stands beside them.

    That hash is the same whichever of the columns of a class ``by`` a cell stands in.
    Classes with more columns on one side than on the other do not count.
    """
    even = columns.groupBy("question", by).agg(F.count_if(F.col("side") == "gold").alias("g"), F.count_if(F.col("side") == "cand").alias("c")).where("g = c")
    marks = columns.join(even, ["question", by]).groupBy("question", "side")
    marks = marks.agg(F.map_from_entries(F.collect_list(F.struct("name", F.xxhash64(by)))).alias("marks"))
    count, width = columns.agg(F.count("*"), F.max("at") + 1).first()
    marked = both.join(_small(marks, count), ["question", "side"], "left")
    cells = [F.get("cells", F.lit(i)) for i in range(width)]
    flat = [F.xxhash64(c["name"]).alias(f"name{i}") for i, c in enumerate(cells)] + [c["h"].alias(f"h{i}") for i, c in enumerate(cells)]
    marked = marked.select("question", "side", "pos", _row_hash(F.col("marks"), width).alias("beside"), *flat)
    # A row for each order of columns; a question has one on each side if all its rows come from one table.
    sums = [(F.max(f"name{i}"), *_sums(F.when(F.col(f"h{i}").isNotNull(), F.xxhash64(f"h{i}", "pos", "beside")))) for i in range(width)]
    found = marked.groupBy("question", "side", F.xxhash64(*[f"name{i}" for i in range(width)]).alias("layout"))
    found = found.agg(*[F.struct(*[c.alias(n) for n, c in zip(("named", "n", "s", "x"), s, strict=True)]).alias(f"d{i}") for i, s in enumerate(sums)])
    found = found.select("question", "side", F.inline(F.array(*[f"d{i}" for i in range(width)])))
    merged = found.groupBy("question", "side", "named").agg(F.concat_ws("|", F.sum("n"), F.sum("s"), F.bit_xor("x")).alias("rows"))
    return merged.join(columns.select("question", "side", "name", F.xxhash64("name").alias("named")), ["question", "side", "named"]).drop("named")


def _line_up(both: DataFrame, pairs: DataFrame, columns: DataFrame) -> DataFrame:
    """(question, line_up): whether the rows are equal over the pairs (question, gold, cand) of columns."""
    named = pairs.select(
        "question",
        F.inline(
            F.array(
                F.struct(F.lit("gold").alias("side"), F.col("gold").alias("name"), F.col("gold").alias("as")),
                F.struct(F.lit("cand").alias("side"), F.col("cand").alias("name"), F.col("gold").alias("as")),
            )
        ),
    )
    names = named.groupBy("question", "side").agg(F.map_from_entries(F.collect_list(F.struct("name", F.xxhash64("as")))).alias("names"))
    count, width = columns.agg(F.count("*"), F.coalesce(F.max("at") + 1, F.lit(0))).first()
    hashed = both.join(_small(names, count), ["question", "side"]).select("question", "side", F.xxhash64(_row_hash(F.col("names"), width), "pos").alias("_h"))
    of = lambda side: _digest(F.when(F.col("side") == side, F.col("_h")))
    return hashed.groupBy("question").agg((of("gold") == of("cand")).alias("line_up"))


def _looked(both: DataFrame, mode: str) -> DataFrame:
    """Digests of columns, and of each side as a whole under no name, from one reading of the rows."""
    value = F.lit(None).cast("long")
    if mode == "values":
        first = F.filter("cells", lambda c: c["kind"] == "number")
        value = F.when(F.size(first) > 0, F.xxhash64(F.coalesce(F.get(first, F.lit(0))["h"], F.lit(0)), "pos"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit("row").alias("kind"), value.alias("h")))
    return _column_digests(both.withColumn("beside", F.lit(0)), F.concat(whole, "cells"), F.col("c.h"), "values")


def _judged(both: DataFrame, optional: Sequence[str], mode: str) -> tuple[DataFrame, DataFrame]:
    """Verdicts of ``judge``, and the digests (question, side, name, at, values, rows) of columns that some share."""
    of = lambda side: F.col("side") == side
    looked = cut_lineage(_looked(both, mode))
    side = lambda s, c, none: F.coalesce(F.max(F.when(of(s), F.col(c))), F.lit(none))
    sizes = looked.where("name is null").groupBy("question").agg(
        side("gold", "n", 0).alias("n_gold"),
        side("cand", "n", 0).alias("n_cand"),
        side("gold", "held", 0).alias("gold_numbers"),
        side("cand", "held", 0).alias("cand_numbers"),
        (side("gold", "values", "row|0") == side("cand", "values", "row|0")).alias("same_values"),
    )
    # Only answers of equal sizes are looked at again, and columns only where some share their values.
    todo = sizes.where("n_gold = n_cand and n_cand > 0" + (" and gold_numbers = 0" if mode == "values" else "")).select("question")
    plain = cut_lineage(looked.where("name is not null").join(todo, "question").select("question", "side", "name", "at", "values"))
    classes = plain.groupBy("question", "values").agg(F.count_if(of("gold")).alias("g"), F.count_if(of("cand")).alias("c"))
    shared = plain.join(classes.where("g > 0 and c > 0 and g + c > 2").select("question").distinct(), "question")
    shared = cut_lineage(shared)
    if not shared.isEmpty():
        among = _among(_only(both, shared.select("question").distinct()), shared, "values")
        shared = cut_lineage(shared.join(among, ["question", "side", "name"]))
    else:
        shared = shared.withColumn("rows", F.lit(None).cast("string"))
    known = plain.join(shared.select("question", "side", "name", "rows"), ["question", "side", "name"], "left")
    column = F.struct("at", "name", "values", "rows")
    lists = known.groupBy("question").agg(
        F.collect_list(F.when(of("gold"), column)).alias("gold"), F.collect_list(F.when(of("cand"), column)).alias("cand")
    )
    pairing = F.udf(pair_columns, "array<struct<gold:string,cand:string>>", useArrow=False)
    paired = lists.withColumn("pairs", pairing("gold", "cand"))
    may_miss = F.array(*[F.lit(c.lower()) for c in [*OPTIONAL_COLUMNS, *optional]])
    unmatched = F.filter(F.array_sort("gold"), lambda c: ~F.array_contains(F.col("pairs.gold"), c["name"]))
    missing = F.filter(unmatched, lambda c: ~F.array_contains(may_miss, F.lower(c["name"])))
    lacks = F.when(F.size(missing) > 0, F.get(missing, F.lit(0))["name"]).when(F.size("pairs") == 0, F.get(unmatched, F.lit(0))["name"])
    paired = cut_lineage(paired.select("question", "pairs", lacks.alias("lacks")))
    whole = paired.where("lacks is null")
    lined = _line_up(_only(both, whole), whole.select("question", F.explode("pairs").alias("p")).select("question", "p.gold", "p.cand"), plain)

    rows = sizes.join(paired.drop("pairs"), "question", "left").join(lined, "question", "left")
    count = F.concat(F.lit("cardinality: candidate "), F.col("n_cand").cast("string"), F.lit(" vs gold "), F.col("n_gold").cast("string"))
    subset = (
        F.when(F.col("n_cand") == 0, "candidate is empty")
        .when(F.col("n_gold") != F.col("n_cand"), count)
        .when(F.col("lacks").isNotNull(), F.concat(F.lit("no candidate column matches '"), "lacks", F.lit("'")))
        .when(F.col("line_up"), "column subset")
        .otherwise(MISALIGNED)
    )
    values = (
        F.when(F.col("n_gold") != F.col("n_cand"), count)
        .when(F.col("cand_numbers") == 0, "candidate has no numeric column")
        .when(F.col("same_values"), "value sequence")
        .otherwise("values differ")
    )
    reason = F.when(F.col("gold_numbers") == 0, subset).otherwise(values) if mode == "values" else subset
    judged = rows.select("question", reason.alias("reason"))
    return judged.select("question", F.col("reason").isin("column subset", "value sequence").alias("passed"), "reason"), shared


def judge(gold: DataFrame, cand: DataFrame, optional: Sequence[str] = (), mode: str = "rows") -> DataFrame:
    """(question, passed, reason) for each question in the ``answer_rows`` of references and candidates.

    Any number of questions at once; what is shuffled are digests of columns and rows. All answers are read once,
    those of equal sizes a second time, those with columns that share their values a third time. Such columns are
    told apart by the rows they stand in, then by name, then by order. A question in neither table has no verdict.
    """
    return _judged(_both(gold, cand), optional, mode)[0]


def _settled(both: DataFrame, known: DataFrame) -> DataFrame:
    """(question, side, name, at, class) with at most one column a side in each class that both sides have.

    A class starts as the columns of equal values. In each round it is split by the rows its columns stand in,
    seen through the classes of the round before. Where a round splits nothing, a pair of the smallest open
    class gets a class of its own, columns of one name first, then in their order; what stands beside the pair
    follows in the next round. Every round makes a new class in each open question, so there are at most as many
    rounds as columns, and a round reads the rows of open questions only. The digests of the first round are known.
    """
    of = lambda side: F.col("side") == side
    split_by = lambda df: df.withColumn("finer", F.md5(F.concat_ws("/", "class", "rows"))).select("question", "side", "name", "at", "class", "finer")
    finer, closed = cut_lineage(split_by(known.withColumnRenamed("values", "class"))), []
    while True:
        split = finer.groupBy("question").agg((F.count_distinct("finer") > F.count_distinct("class")).alias("split"))
        finer = finer.drop("class").withColumnRenamed("finer", "class")
        first = F.min_by(F.when(of("gold"), F.col("name")), F.when(of("gold"), F.col("at"))).alias("gold")
        sizes = finer.groupBy("question", "class").agg(F.count_if(of("gold")).alias("g"), F.count_if(of("cand")).alias("c"), first)
        still = sizes.where("g > 0 and c > 0 and g + c > 2")
        fit = F.struct(F.col("g") + F.col("c"), "class", F.col("name") != F.col("gold"), "at")
        pick = still.join(finer.where(of("cand")), ["question", "class"]).groupBy("question").agg(F.min_by(F.struct("class", "gold", "name"), fit).alias("pick"))
        marked = finer.join(pick, "question", "left").join(split, "question")
        chosen = (of("gold") & (F.col("name") == F.col("pick.gold"))) | (of("cand") & (F.col("name") == F.col("pick.name")))
        own = F.when(~F.col("split") & chosen, F.md5(F.concat(F.lit("pair/"), "class"))).otherwise(F.col("class"))
        marked = cut_lineage(marked.select("question", "side", "name", "at", own.alias("class"), F.col("pick").isNotNull().alias("open")))
        closed.append(marked.where("not open").drop("open"))
        classes = marked.where("open").drop("open")
        if classes.isEmpty():
            return reduce(DataFrame.unionByName, closed)
        among = _among(_only(both, classes.select("question").distinct()), classes, "class")
        finer = cut_lineage(split_by(classes.join(among, ["question", "side", "name"])))


def refine(judged: DataFrame, both: DataFrame, known: DataFrame, optional: Sequence[str] = ()) -> DataFrame:
    """Verdicts of ``judge`` with another look at the answers whose rows did not line up and whose columns share values.

    One round of marks leaves columns alike that differ only by what stands beside them in columns that are
    themselves told apart later. Here classes are refined until nothing splits and then paired one by one. A
    pass is proved by equal rows over the pairs. Pairs are not taken back, so an answer can still fail where columns
    that no refinement tells apart are no mirror images of each other. Runs jobs, none of them over other answers.
    """
    known = cut_lineage(known.join(judged.where(F.col("reason") == MISALIGNED).select("question"), "question"))
    if known.isEmpty():
        return judged
    classes = cut_lineage(_settled(both, known))
    side = lambda s: classes.where(F.col("side") == s).select("question", "class", F.col("name").alias(s))
    pairs = side("gold").join(side("cand"), ["question", "class"], "left")
    may_miss = F.lower("gold").isin([c.lower() for c in [*OPTIONAL_COLUMNS, *optional]])
    whole = cut_lineage(pairs.groupBy("question").agg((F.count_if(F.col("cand").isNull() & ~may_miss) == 0).alias("whole")).where("whole").select("question"))
    pairs = pairs.where("cand is not null").join(whole, "question")
    lined = _line_up(_only(both, whole), pairs, known).where("line_up").select("question", F.lit(True).alias("settled"))
    settled = F.coalesce("settled", F.lit(False))
    reason = F.when(settled, "column subset").otherwise(F.col("reason"))
    return judged.join(lined, "question", "left").select("question", (F.col("passed") | settled).alias("passed"), reason.alias("reason"))


def judge_refined(gold: DataFrame, cand: DataFrame, optional: Sequence[str] = (), mode: str = "rows") -> DataFrame:
    """``judge``, then ``refine``."""
    both = _both(gold, cand)
    judged, known = _judged(both, optional, mode)
    return refine(cut_lineage(judged), both, known, optional)


def judge_any(golds: Sequence[tuple[str, DataFrame]], cand: DataFrame, optional: Sequence[str] = (), mode: str = "rows") -> DataFrame:
    """The same against several references: the first that passes, else the reason of the first."""
    parts = [judge(gold, cand, optional, mode).withColumns({"_at": F.lit(i), "_name": F.lit(name)}) for i, (name, gold) in enumerate(golds)]
    every = reduce(DataFrame.unionByName, parts)
    best = every.groupBy("question").agg(F.min_by(F.struct("passed", "reason", "_name"), F.struct(~F.col("passed"), "_at")).alias("b"))
    reason = F.when(F.col("b.passed"), F.concat("b.reason", F.lit(" ["), "b._name", F.lit("]"))).otherwise(F.col("b.reason"))
    return best.select("question", F.col("b.passed").alias("passed"), reason.alias("reason"))


def exact_verdict(gold: DataFrame, cand: DataFrame, position: str | None = None) -> DataFrame:
    """One row (passed): same shape, same values; columns are paired in the order of their names."""
    left = sorted(f.name for f in _columns(gold, position))
    right = sorted(f.name for f in _columns(cand, position))
    pairs = list(zip(left, right, strict=False))
    differing = row_differences(gold, cand, pairs, position) if _same_kinds(gold, cand, pairs) else gold.agg(F.lit(1).alias("differing"))
    return differing.select(((F.col("differing") == 0) & F.lit(len(left) == len(right))).alias("passed"))


def _one(verdicts: DataFrame) -> Verdict:
    found = verdicts.first()
    return Verdict(found["passed"], found["reason"]) if found else Verdict(True, "both empty")


def compare_exact(gold: DataFrame, cand: DataFrame, position: str | None = None) -> bool:
    return exact_verdict(gold, cand, position).first()["passed"]


def compare(
    gold: DataFrame,
    cand: DataFrame,
    position: str | None = None,
    mode: str = "rows",
    optional: Sequence[str] = (),
) -> Verdict:
    """Verdict on one pair of tables."""
    rows = [answer_rows(df, F.lit("one"), position=position) for df in (gold, cand)]
    return _one(judge_refined(*rows, optional, mode))


def compare_subset(gold: DataFrame, cand: DataFrame, position: str | None = None, optional: Sequence[str] = ()) -> Verdict:
    """Every gold column has a candidate column with the same values, and the rows line up."""
    return compare(gold, cand, position, "rows", optional)


def compare_values(gold: DataFrame, cand: DataFrame, position: str | None = None, optional: Sequence[str] = ()) -> Verdict:
    """Only the first numeric column of each: tolerant to which of several tied rows made the cut."""
    return compare(gold, cand, position, "values", optional)


def compare_any(
    references: Sequence[tuple[str, DataFrame]],
    cand: DataFrame,
    position: str | None = None,
    mode: str = "rows",
    optional: Sequence[str] = (),
) -> Verdict:
    """Passes on the first reference that matches, else gives the reason of the first."""
    if not references:
        return Verdict(False, "no reference")
    golds = [(name, answer_rows(gold, F.lit("one"), position=position)) for name, gold in references]
    return _one(judge_any(golds, answer_rows(cand, F.lit("one"), position=position), optional, mode))


def name_overlap(ref: DataFrame, cand: DataFrame, column: str) -> DataFrame:
    """Old lenient score: share of the reference's names that the candidate also has."""
    ref_names = ref.select(cell_text(column).alias("name")).distinct()
    cand_names = cand.select(cell_text(column).alias("name"), F.lit(1).alias("hit")).distinct()
    both = ref_names.join(cand_names, "name", "left")
    share = F.count("hit") / F.count("*")
    return both.agg(
        F.count("*").alias("ref_names"),
        F.count("hit").alias("shared_names"),
        (F.coalesce(share, F.lit(0.0)) >= OVERLAP_ENOUGH).alias("passed"),
    )


def values_contained(ref: DataFrame, cand: DataFrame, ref_column: str, cand_column: str) -> DataFrame:
    """Old lenient test: every rounded number of the reference occurs somewhere in the candidate."""
    wanted = ref.select(_normal_cell(ref_column, "number").alias("v")).dropna().distinct()
    there = cand.select(_normal_cell(cand_column, "number").alias("v")).dropna().distinct()
    missing = wanted.join(there, "v", "left_anti")
    return missing.agg(F.count("*").alias("missing_values"), (F.count("*") == 0).alias("passed"))
