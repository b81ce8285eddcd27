import functools
import itertools

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.compare import (
    MISALIGNED,
    _both,
    _looked,
    _only,
    answer_rows,
    compare,
    compare_any,
    compare_exact,
    compare_subset,
    compare_values,
    judge_refined,
    name_overlap,
    normalize_table,
    values_contained,
)
from larder.operators.star import star_rows
from larder.plans import food
from larder.sources.tables import read_references, write_references

ROWS = [("Frango, fígado, cru", 9.54), ("Carne, bovina, fígado, cru", 5.626667)]


@pytest.fixture(scope="module")
def gold(spark):
    return table(spark, ROWS)


def table(spark, rows, names=("food_name", "value")):
    schema = f"pos int, {names[0]} string, {names[1]} double"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def test_must_pass(spark, gold):
    swapped = table(spark, ROWS[::-1])
    assert compare_subset(gold, gold, "pos").passed
    assert compare_subset(gold.drop("pos"), swapped.drop("pos")).passed
    assert compare_subset(gold.drop("pos"), swapped.drop("pos").withColumn("unit", F.lit("mg"))).passed
    close = table(spark, [(ROWS[0][0], 9.5401), (ROWS[1][0], 5.6266)])
    assert compare_subset(gold.drop("pos"), close.drop("pos")).passed
    renamed = table(spark, [(ROWS[0][0].upper() + " ", 9.54), ROWS[1]], ("a", "b"))
    assert compare_subset(gold, renamed, "pos").passed


def test_must_fail(spark, gold):
    free = gold.drop("pos")
    assert not compare_subset(gold, table(spark, ROWS[::-1]), "pos").passed
    assert not compare_subset(free, table(spark, [(ROWS[0][0], 1.0), (ROWS[1][0], 2.0)]).drop("pos")).passed
    assert compare_subset(free, free.filter(F.lit(False))).reason == "candidate is empty"
    assert compare_subset(free, free.limit(1)).reason == "cardinality: candidate 1 vs gold 2"
    crossed = table(spark, [(ROWS[0][0], ROWS[1][1]), (ROWS[1][0], ROWS[0][1])]).drop("pos")
    assert compare_subset(free, crossed).reason == "values exist but rows do not line up"
    assert not compare_subset(free, free.drop("value")).passed
    assert compare_subset(free.limit(0), free.limit(0)).passed


def test_optional_columns(spark, gold):
    free = gold.drop("pos")
    assert compare_subset(free.withColumn("unit", F.lit("mg")), free).passed
    grouped = free.withColumn("group_name", F.lit("Carnes"))
    assert not compare_subset(grouped, free).passed
    assert compare_subset(grouped, free, optional=["Group_Name"]).passed
    assert not compare_subset(free.select(F.lit("mg").alias("unit")), free).passed


def test_columns_of_equal_values_are_told_apart(spark):
    gold = spark.createDataFrame([(1, 2.0, 3.0), (2, 3.0, 2.0)], "id int, a double, b double")
    assert compare_subset(gold, gold.select("b", "a", "id")).passed
    assert compare_subset(gold, gold.select("id", F.col("a").alias("x"), F.col("b").alias("y"))).passed


# Columns a and b of these rows are told apart only after both are told apart from the third.
PERMUTED = [(0, 1, 2), (1, 2, 2), (2, 1, 1), (1, 2, 0), (2, 0, 1)]


# Rows that stay the same when the two pairs of columns trade places.
LINKED = [(x, -x, y, -y) for x, y in [(1, 5), (2, 4), (3, 3), (4, 2), (5, 1)]]


def test_columns_are_told_apart_in_several_rounds_and_pair_by_pair(spark):
    gold = spark.createDataFrame(PERMUTED, "a int, b int, c int")
    rename = lambda df, order, names: df.select(*[F.col(c).alias(n) for c, n in zip(order, names, strict=True)])
    cases = {f"{''.join(o)} {names}": (gold, rename(gold, o, names)) for o in itertools.permutations("abc") for names in ("xyz", "bca")}
    linked = spark.createDataFrame(LINKED, "a int, b int, c int, d int")
    crossed = rename(linked, "adcb", "wxyz")
    cases |= {"crossed": (linked, crossed), "optional": (linked.withColumn("unit", F.lit("g")), crossed), "part": (gold.select("a", "b"), rename(gold, "cab", "xyz"))}
    good = set(cases)
    # Cells of one column trade rows, so columns keep their values.
    apart = spark.createDataFrame([(1, *PERMUTED[0][1:]), (0, *PERMUTED[1][1:]), *PERMUTED[2:]], "x int, y int, z int")
    torn = spark.createDataFrame([(a, d, c, b) if a in (1, 5) else (a, b, c, d) for a, b, c, d in LINKED], "w int, x int, y int, z int")
    cases |= {"apart": (gold, apart), "torn": (linked, torn), "fewer": (gold, gold.limit(2))}
    sides = [functools.reduce(DataFrame.unionByName, [answer_rows(pair[i], F.lit(name)) for name, pair in cases.items()]) for i in (0, 1)]
    got = {r.question: (r.passed, r.reason) for r in judge_refined(*sides).collect()}
    assert got.keys() == cases.keys()
    assert {name for name, (passed, _) in got.items() if passed} == good
    assert got["apart"] == got["torn"] == (False, MISALIGNED)
    assert got["fewer"] == (False, "cardinality: candidate 2 vs gold 5")
    assert compare_subset(linked, crossed).passed


def test_nulls_are_equal_and_not_a_number(spark):
    gold = spark.createDataFrame([("a", None), ("b", -99999.0)], "n string, v double")
    assert compare_subset(gold, gold).passed
    assert compare_exact(gold, gold)
    other = spark.createDataFrame([("a", -99999.0), ("b", None)], "n string, v double")
    assert not compare_subset(gold, other).passed


def test_exact_pairs_columns_by_name_order(spark, gold):
    free = gold.drop("pos")
    assert compare_exact(free, free.withColumnsRenamed({"food_name": "a", "value": "b"}))
    assert not compare_exact(free, free.withColumn("unit", F.lit("mg")))
    assert not compare_exact(free, free.withColumnsRenamed({"food_name": "z", "value": "b"}))
    whole = spark.createDataFrame([(1,), (2,)], "v int")
    assert compare_exact(whole, whole.withColumn("v", F.col("v").cast("double")))


def test_row_counts_matter(spark):
    twice = spark.createDataFrame([("a",), ("a",), ("b",)], "v string")
    other = spark.createDataFrame([("a",), ("b",), ("b",)], "v string")
    assert not compare_exact(twice, other)
    assert not compare_subset(twice, other).passed


def test_values_mode_is_tolerant_to_ties(spark):
    gold = table(spark, [("a", 1.0), ("b", 2.0), ("c", 2.0)])
    cand = table(spark, [("a", 1.0), ("x", 2.0), ("y", 2.0)])
    assert not compare(gold, cand, "pos").passed
    assert compare(gold, cand, "pos", mode="values").passed
    assert not compare_values(gold, table(spark, [("x", 2.0), ("a", 1.0), ("y", 2.0)]), "pos").passed
    assert compare_values(gold.drop("pos"), table(spark, [("x", 2.0), ("a", 1.0), ("y", 2.0)]).drop("pos")).passed
    assert not compare_values(gold, cand.limit(2), "pos").passed
    assert compare_values(gold, cand.drop("value"), "pos").reason == "candidate has no numeric column"
    assert compare_values(gold.drop("value"), gold, "pos").passed


def test_any_reference(spark, gold, tmp_path):
    best = gold.limit(1)
    write_references({"Q1": gold, "Q1_alt0": best}, str(tmp_path))
    references = read_references(spark, str(tmp_path), "Q1")
    assert [n for n, _ in references] == ["Q1", "Q1_alt0"]
    assert compare_any(references, best, "pos").reason == "column subset [Q1_alt0]"
    assert compare_any(references, gold.filter(F.lit(False)), "pos").reason == "candidate is empty"
    assert read_references(spark, str(tmp_path), "Q2") == []
    assert not compare_any([], best).passed


def test_every_question_equals_itself_and_no_dump(star):
    dump = star_rows(star, [m[1] for m in food.MEASURES]).select("item_name", "value", "unit")
    questions = food.questions(star)
    for name in ("Q002", "Q003", "Q005", "Q007", "Q017"):
        result = questions[name]
        assert compare_subset(result, result).passed, name
        assert not compare_subset(result, dump).passed, name
        assert not compare_subset(result, dump.limit(0)).passed, name


def test_lenient_scores(spark):
    ref = spark.createDataFrame([(f" N{i}", float(i)) for i in range(5)], "n string, v double")
    cand = spark.createDataFrame([(f"n{i}", float(i)) for i in range(1, 9)], "n string, v double")
    assert tuple(name_overlap(ref, cand, "n").first()) == (5, 4, True)
    assert tuple(values_contained(ref, cand, "v", "v").first()) == (1, False)
    assert tuple(values_contained(ref.filter("v > 0"), cand, "v", "v").first()) == (0, True)


def test_normalize_table(spark):
    df = spark.createDataFrame([(" A b ", 1.006, 3)], "z string, a double, m int")
    assert normalize_table(df).columns == ["a", "m", "z"]
    assert tuple(normalize_table(df).first()) == (1.01, 3, "a b")


def test_cells_are_not_sorted_and_settled_answers_not_read_again(spark, gold):
    free = gold.drop("pos")
    rows = functools.reduce(DataFrame.unionByName, [answer_rows(free, F.lit(name)) for name in ("right", "short")])
    short = answer_rows(free, F.lit("right")).unionByName(answer_rows(free.limit(1), F.lit("short")))
    both = _both(rows, short)
    assert "Sort" not in _looked(both, "rows")._jdf.queryExecution().executedPlan().toString()
    plan = _only(both, spark.createDataFrame([("short",)], "question string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "short" in plan and "right" not in plan
    verdicts = {r.question: r.reason for r in judge_refined(rows, short).collect()}
    assert verdicts == {"right": "column subset", "short": "cardinality: candidate 1 vs gold 2"}
