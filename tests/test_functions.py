import unicodedata

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.functions import numbers, replies, text


def values(spark, cells, expression):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[1] for r in df.select("i", expression(F.col("c"))).orderBy("i").collect()]


def test_to_number_takes_plain_numbers_only(spark):
    cells = ["1", " 2.5 ", "-3.", ".5", "1e3", "1d", "NaN", "inf", "Infinity", "0x10", "", "abc", None, "1,5"]
    got = values(spark, cells, numbers.to_number)
    assert got == [1.0, 2.5, -3.0, 0.5, 1000.0] + [None] * 9


def test_marks_match_exactly(spark):
    got = values(spark, ["Tr", "Tr ", "tr", "NA", "*", "7", None], numbers.sentinel_number)
    assert got == [0.0, None, None, None, None, 7.0, None]


def test_key_is_cut_to_whole(spark):
    assert values(spark, ["12.0", "12.9", "x", None], numbers.to_key) == [12, 12, None, None]


def test_rounding_is_that_of_arrays(spark):
    cells = [0.125, 0.375, 2.675, 1.005, -0.125, 9.5401, 1e9 + 0.125]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c double")
    got = [r[1] for r in df.select("i", numbers.round_even("c")).orderBy("i").collect()]
    assert got == list(np.round(cells, 2))


def test_value_state(spark):
    assert values(spark, ["0", None, "3"], lambda c: numbers.value_state(c.cast("double"))) == [
        "zero", "missing", "present",
    ]


def test_accents_like_the_warehouse(spark):
    cells = ["Fígado", "PÊRA", "Maçã", "ßøłđ", "ﬁ", "Ǻ", "é", "한국", "Ω", "İstanbul"]
    expected = [duckdb.execute("SELECT strip_accents(lower(?))", [c]).fetchone()[0] for c in cells]
    assert values(spark, cells, text.strip_accents_lower) == expected


def question_key(question):
    folded = unicodedata.normalize("NFKD", question)
    folded = "".join(c for c in folded if not unicodedata.combining(c))
    return " ".join(folded.lower().strip().rstrip("?!. ").split())


def test_question_key(spark):
    cells = [
        "Qual  fruta tem\tmais vitamina C ?!. ", "ÔMEGA-3…", "½ xícara", "ﬁbra alimentar?", "Σίσυφος ΟΔΟΣ.", "",
        " ? \n ? ", "Ǆ ŉ ¨ ´", "한국 음식?", "a b", "\x1cq\x1c", "İ", "¿Qué?", "１２㎏", "²",
    ]
    assert values(spark, cells, text.normalize_question) == [question_key(c) for c in cells]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cn"), blacklist_characters="\x00"), max_size=30), min_size=30, max_size=60))
def test_question_key_on_any_text(spark, cells):
    assert values(spark, cells, text.normalize_question) == [question_key(c) for c in cells]


def test_latin_letters_need_no_python(spark):
    letters = [chr(p) for p in [*range(1, 0x250), *range(0x1E00, 0x1F00)]]
    cells = [f"x{c}y" for c in letters]
    assert values(spark, cells, text.normalize_question) == [question_key(c) for c in cells]


def test_preview_and_refusal(spark):
    assert values(spark, ["a" * 100, "b" * 101], text.preview) == ["a" * 100, "b" * 100 + "…"]
    replies_ = ["Há uma LIMITAÇÃO na base", "a TACO não tem", "100 g de arroz", None]
    assert values(spark, replies_, text.refuses) == [True, True, False, None]


def parsed(spark, reply):
    from larder.operators.sqlaudit import parse_replies

    row = parse_replies(spark.createDataFrame([(reply,)], "reply string")).first()
    return row["sql"], row["reject_reason"]


@pytest.mark.parametrize(
    ("reply", "sql", "reason"),
    [
        ("SELECT 1;", "SELECT 1", None),
        ("Sure:\n```sql\nSELECT a\nFROM t;\n```\nand ```SELECT 2```", "SELECT a\nFROM t", None),
        ("```\nwith x as (select 1) select * from x\n```", "with x as (select 1) select * from x", None),
        ("The answer: Select a from t", "Select a from t", None),
        ("``````  SELECT 3", "SELECT 3", None),
        ("```no query``` SELECT 1", None, "not_a_read"),
        ("selection only", None, "no_statement"),
        ("DROP TABLE t", None, "no_statement"),
        ("  \n ", None, "empty"),
        (None, None, "empty"),
    ],
)
def test_statement_in_a_reply(spark, reply, sql, reason):
    assert parsed(spark, reply) == (sql, reason)


@pytest.mark.parametrize(
    ("sql", "verb", "several", "bare"),
    [
        ("SELECT 'drop table x; delete' AS a FROM t", None, False, 0),
        ("SELECT 1; DROP TABLE t", "drop", True, 0),
        ("WITH x AS (SELECT 1) DELETE FROM t", "delete", False, 0),
        ("SELECT a FROM t -- ; drop\n", None, False, 0),
        ("SELECT a /* ; drop */ FROM t;;", None, False, 0),
        ("SELECT * FROM a JOIN b ON a.x = b.x JOIN c USING (y) CROSS JOIN d", None, False, 1),
        ("CREATE TABLE t AS SELECT 1", "create", False, 0),
        ("SELECT update_at, 'it''s; x' FROM created", None, False, 0),
    ],
)
def test_statement_checks(spark, sql, verb, several, bare):
    df = spark.createDataFrame([(sql,)], "sql string").withColumn("code", replies.code_only("sql"))
    row = df.select(
        replies.change_verb("code").alias("verb"),
        replies.several_statements("code").alias("several"),
        replies.joins_without_condition("code").alias("bare"),
    ).first()
    assert (row["verb"], row["several"], row["bare"]) == (verb, several, bare)


def test_retry_after(spark):
    cells = [
        "try again in 8.412s", "Please try again in 27m23.328s. Need more", "TRY AGAIN IN 1h2m3.5s", "try again in 2h",
        "try again in a bit", "no hint", None,
    ]
    assert values(spark, cells, replies.retry_after_seconds) == [8.412, 27 * 60 + 23.328, 3723.5, 7200.0, None, None, None]
    assert values(spark, ["HTTP 429", "Rate Limit reached", "boom"], replies.rate_limited) == [True, True, False]


def test_long_literals_and_comments_do_not_need_a_stack(spark):
    from larder.functions import replies

    long = "x''y " * 40_000
    cells = [(0, f"SELECT '{long}' AS a FROM t"), (1, f"SELECT a /* {'* / ' * 50_000} */ FROM t"), (2, "SELECT a -- " + "z" * 200_000)]
    df = spark.createDataFrame(cells, "k int, sql string").withColumn("code", replies.code_only("sql"))
    got = {r.k: " ".join(r.code.split()) for r in df.collect()}
    assert len(got[0]) < 300_000 and got[0].startswith("select '") and got[0].endswith("as a from t")
    assert (got[1], got[2]) == ("select a from t", "select a")


def test_names_with_schema_and_quotes(spark):
    from larder.operators.sqlaudit import axis_verdicts

    catalog = {"orders": ["o_orderkey"], "customer": ["c_name"]}
    cells = [
        (0, 'SELECT "c_name" FROM db.orders JOIN a . b."customer" c ON o_orderkey = c.c_name'),
        (1, "WITH d AS (DELETE FROM orders RETURNING *) SELECT * FROM d"),
        (2, "SELECT x FROM db.nothing"),
    ]
    rows = {r.stmt_id: r for r in axis_verdicts(spark.createDataFrame(cells, "stmt_id int, sql string"), catalog).collect()}
    assert (rows[0].schema, rows[0].unknown_names) == ("ok", None)
    assert rows[1].seguranca == "escrita: delete"
    assert (rows[2].schema, rows[2].unknown_names) == ("alucinou", "nothing, x")
