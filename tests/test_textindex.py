import pytest
from pyspark.sql import functions as F

from larder.sources import textindex

TEXTS = [
    "red widget", "red  widgets ring", "a blue ring", "ring", "ri", "", None, "Red Ring", "100% sure", "100 sure", "a_b_c",
    "aXbXc", "back\\slash", "😀😁😂 faces", "é accents ée", "line\nbreak", "ring ring ring", "rarest word: zyx",
]
PATTERNS = [
    "%ring%", "ring", "red%", "%re%ring%", "%100\\%%", "a\\_b\\_c", "a_b_c", "%", "%r_", "%😀😁😂%", "%é acc%", "line_break",
    "%zyx%", "%absent%", "", "%ri%", "%\\\\sla%",
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    rows = [*enumerate(TEXTS), (3, "ring"), (3, "other text"), (None, "ring without id"), (None, None)]
    table = spark.createDataFrame(rows, "id long, text string")
    textindex.build(table, folder, "id", "text")
    return folder, table


@pytest.mark.parametrize("pattern", PATTERNS)
def test_search_finds_what_like_finds(spark, index, pattern):
    folder, table = index
    found = textindex.search(spark, folder, pattern).select("id", "text").collect()
    expected = table.where(F.col("text").like(pattern)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_required():
    assert textindex.required("%re%ring%") == ["ing", "rin"]
    assert textindex.required("a\\%b%") == ["a%b"]
    assert textindex.required("%ab_cd%") == []


def test_only_parts_with_candidates_are_read(spark, index):
    folder, _ = index
    assert textindex.candidates(spark, folder, "%r_") is None
    assert textindex.candidates(spark, folder, "%zyx%").collect() == [(TEXTS.index("rarest word: zyx"),)]
    plan = textindex._postings(spark, folder, ["zyx"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "EqualTo(gram,zyx)" in plan
    scan = textindex.search(spark, folder, "%zyx%")._jdf.queryExecution().toString()
    assert "PartitionFilters" in scan and "part#" in scan.split("PartitionFilters")[1].split("]")[0]


def test_empty_table(spark, tmp_path):
    textindex.build(spark.createDataFrame([], "id long, text string"), str(tmp_path), "id", "text")
    for pattern in ("%ring%", "%"):
        assert textindex.search(spark, str(tmp_path), pattern).collect() == []


def test_trigrams_are_code_points_and_not_interpreted(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", textindex.trigrams("text").alias("grams"))
    for text, grams in df.collect():
        expected = None if text is None else {text[i : i + 3] for i in range(len(text) - 2)}
        assert grams == expected if text is None else (set(grams) == expected and len(grams) == len(expected))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
