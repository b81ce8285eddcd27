import datetime
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from larder.functions.numbers import ratio
from larder.operators import cache, evalruns
from larder.operators.conversation import history_window, render_history, thread_preview
from larder.operators.sqlaudit import axis_verdicts, unknown_columns, unknown_tables
from larder.sources.reports import files_fingerprint, read_questions, read_reports, report_details, write_reports

OK = {a: "ok" for a in evalruns.AXES}
OLD_RUN = {
    "run_at": "2026-06-26T17:21:47.1", "total": 2, "passed": 1, "accuracy": 0.5,
    "by_difficulty": {"easy": {"total": 2, "passed": 1}},
    "details": [
        {"id": "Q1", "difficulty": "easy", "status": "pass", "passed": True, "sql_gerado": "SELECT 1"},
        {"id": "Q2", "difficulty": "easy", "status": "agent_error", "passed": False, "sql_gerado": "", "error": "boom"},
    ],
}
NEW_RUN = {
    "run_at": "2026-07-22T09:17:04.1", "prompt_fingerprint": "0f0f", "total": 3, "passed": 2, "skipped": 1,
    "skipped_ids": ["Q4"], "complete": False, "accuracy": 0.6667,
    "metricas": {"seguranca": {"ok": 2, "total": 3, "taxa": 0.6667}}, "cache": {"hits_nesta_rodada": 2},
    "details": [
        {"id": "Q1", "difficulty": "easy", "status": "pass", "passed": True, "sql_gerado": "SELECT 1", "checks": OK},
        {"id": "Q2", "difficulty": "easy", "status": "fail", "passed": False, "sql_gerado": "SELECT 2", "motivo": "rows",
         "checks": {**OK, "seguranca": "escrita: drop"}},
        {"id": "Q3", "difficulty": "hard", "status": "regra11_ok", "passed": True, "sql_gerado": "SELECT 3",
         "resposta": "dados insuficientes", "checks": OK},
        {"id": "Q4", "difficulty": "hard", "status": "skipped_rate_limit", "passed": False, "skipped": True,
         "sql_gerado": "", "error": "429"},
    ],
}


@pytest.fixture(scope="module")
def details(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("reports")
    for i, run in enumerate((OLD_RUN, NEW_RUN)):
        (folder / f"eval_{i}.json").write_text(json.dumps(run, indent=2, ensure_ascii=False), encoding="utf-8")
    reports = read_reports(spark, str(folder / "eval_*.json"))
    assert {r.run_at: r.skipped_ids for r in reports.collect()} == {OLD_RUN["run_at"]: None, NEW_RUN["run_at"]: ["Q4"]}
    return report_details(reports)


@pytest.fixture(scope="module")
def questions(spark):
    rows = [("Q1", "easy", "one?", False), ("Q2", "easy", "two?", False), ("Q3", "hard", "three?", True), ("Q4", "hard", "four?", False), ("Q5", "hard", "new?", False)]
    return spark.createDataFrame(rows, "id string, difficulty string, question string, expects_refusal boolean")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


NEW, OLD = NEW_RUN["run_at"], OLD_RUN["run_at"]


def test_accuracy_of_reports(details):
    assert rows(evalruns.accuracy(details), "run_at", "passed", "total", "accuracy") == [(OLD, 1, 2, 0.5), (NEW, 2, 3, 0.6667)]
    tiers = rows(evalruns.accuracy(details, ["run_at", "difficulty"]), "run_at", "difficulty", "passed", "total")
    assert tiers == [(OLD, "easy", 1, 2), (NEW, "easy", 1, 2), (NEW, "hard", 1, 1)]
    rates = {(r.run_at, r.axis): (r.ok, r.total, r.rate) for r in evalruns.axis_rates(details).collect()}
    assert rates[NEW, "seguranca"] == (2, 3, 0.6667)
    assert rates[OLD, "sintaxe"] == (0, 0, None)
    assert rows(evalruns.run_coverage(details), "run_at", "evaluated", "skipped", "complete") == [(OLD, 2, 0, True), (NEW, 3, 1, False)]
    assert rows(evalruns.skipped_ids(details), "run_at", "id") == [(NEW, "Q4")]


def test_latest_run(details, questions):
    assert rows(evalruns.latest_failures(details, questions), "id", "status", "reason", "question") == [("Q2", "fail", "rows", "two?")]
    assert rows(evalruns.latest_violations(details), "id", "axis", "violation") == [("Q2", "seguranca", "escrita: drop")]


def test_rescore_and_history(spark, details, questions):
    verdicts = spark.createDataFrame(
        [(OLD, "Q1", True, True, True, None), (NEW, "Q1", True, True, False, None), (NEW, "Q2", False, True, None, None), (NEW, "Q3", None, None, None, True)],
        "run_at string, id string, executes boolean, has_gold boolean, matches boolean, refuses boolean",
    )
    scored = evalruns.rescore(details, questions, verdicts)
    assert rows(scored, "run_at", "id", "status") == [
        (OLD, "Q1", "pass"), (OLD, "Q2", "sem_orcamento"),
        (NEW, "Q1", "fail"), (NEW, "Q2", "sql_error"), (NEW, "Q3", "pass"), (NEW, "Q4", "sem_orcamento"),
    ]
    assert rows(evalruns.run_summary(details, scored), "run_at", "evaluated", "hits", "rescored", "reported") == [
        (OLD, 1, 1, 1.0, 0.5), (NEW, 3, 1, 0.3333, 0.6667),
    ]
    assert rows(evalruns.common_base(scored), "id") == [("Q1",)]
    assert rows(evalruns.common_base_accuracy(scored), "run_at", "hits", "total") == [(OLD, 1, 1), (NEW, 0, 1)]
    matrix = evalruns.status_matrix(scored, questions, [OLD, NEW])
    assert rows(matrix, "id", OLD, NEW) == [
        ("Q1", "✅", "❌"), ("Q2", "·", "💥"), ("Q3", "·", "✅"), ("Q4", "·", "·"), ("Q5", "·", "·"),
    ]


def test_plan_rerun(details, questions):
    last = evalruns.latest_run(details)

    def reused(now, before):
        plan = evalruns.plan_rerun(questions, last, F.lit(now), F.lit(before).cast("string"))
        return [r.id for r in plan.orderBy("id").collect() if r.action == "reuse"]

    assert reused("0f0f", "0f0f") == ["Q1", "Q3"]
    assert reused("0f0f", None) == ["Q1", "Q3"]
    assert reused("beef", "0f0f") == []


def test_report_round_trip(spark, details, tmp_path):
    write_reports(details.select("run_at", "id", "difficulty", "status", "passed", "skipped"), str(tmp_path))
    heads = {r.run_at: r for r in spark.read.json(str(tmp_path / "runs")).collect()}
    assert heads[NEW]["accuracy"] == 0.6667
    assert heads[NEW]["by_difficulty"]["hard"]["total"] == 1
    assert spark.read.json(str(tmp_path / "details")).count() == 6


def test_question_set(spark, tmp_path):
    path = tmp_path / "set.json"
    path.write_text(json.dumps({"version": "2.0", "questions": [{"id": "Q1", "order_matters": True, "tags": ["a"]}, {"id": "Q2"}]}))
    got = rows(read_questions(spark, str(path)), "version", "id", "order_matters")
    assert got == [("2.0", "Q1", True), ("2.0", "Q2", None)]


def test_fingerprint_of_files(spark, tmp_path):
    for name, text in (("a", "one"), ("b", "zwei\n")):
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / n) for n in "ab"]
    assert files_fingerprint(spark, paths) == hashlib.sha256(b"onezwei\n").hexdigest()[:16]
    assert files_fingerprint(spark, paths[::-1]) == hashlib.sha256(b"zwei\none").hexdigest()[:16]


def test_errors(spark):
    df = spark.createDataFrame([("429 slow down",), ("boom",), (None,)], "e string")
    got = [r[0] for r in df.select(evalruns.classify_error(F.col("e"))).collect()]
    assert got == ["skipped_rate_limit", "agent_error", None]
    assert spark.range(1).select(ratio(F.lit(1), F.lit(0))).first()[0] is None


# ---------------------------------------------------------------- cache


def at(i):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=i // 2)


def test_upsert_is_the_calls_one_by_one(spark):
    rng = random.Random(11)
    asked = ["Quanto ferro?", "quanto  FERRO", "Ômega-3?", "zinco", "zinco!"]
    calls = [
        (rng.choice(asked), f"s{i}", rng.choice([None, f"r{i}"]), rng.choice([None, None, f"p{i}"]), at(i), i)
        for i in range(40)
    ]
    keys = {"Quanto ferro?": "quanto ferro", "quanto  FERRO": "quanto ferro", "Ômega-3?": "omega-3", "zinco": "zinco", "zinco!": "zinco"}
    table = {}
    for q, sql, result, response, when, _ in calls:
        old = table.get(keys[q])
        if old is None:
            table[keys[q]] = [q, sql, result, response, 0, when, when]
        else:
            old[1], old[2], old[6] = sql, result, when
            old[3] = response if response is not None else old[3]

    schema = "question string, sql string, result string, response string, at timestamp_ntz, seq long"
    stored = spark.createDataFrame([], cache.CACHE_SCHEMA)
    for part in (calls[:13], calls[13:14], calls[14:]):
        stored = cache.cache_upsert(stored, cache.with_key(spark.createDataFrame(part, schema)))
    got = {r.question_key: list(r)[1:] for r in stored.collect()}
    assert got == table


def test_hits_lookup_and_reuse(spark):
    stored = spark.createDataFrame(
        [("a", "A", "s", "r", "p", 3, at(0), at(1)), ("b", "B", "s", None, None, 0, at(0), at(1))], cache.CACHE_SCHEMA
    )
    reuses = spark.createDataFrame([("a",), ("a",), ("zz",)], "question_key string")
    hit = cache.cache_hits(stored, reuses)
    assert rows(hit, "question_key", "hits") == [("a", 5), ("b", 0)]
    assert tuple(cache.cache_stats(hit).first()) == (2, 5)
    assert tuple(cache.cache_stats(hit.limit(0)).first()) == (0, 0)
    assert evalruns.hits_delta(stored, hit).first()[0] == 2

    questions = cache.with_key(spark.createDataFrame([(1, " Á?"), (2, "c")], "id int, question string"))
    assert rows(cache.cache_lookup(questions, stored), "id", "sql", "response", "found") == [(1, "s", "p", True), (2, None, None, False)]

    fresh = spark.createDataFrame(
        [("a", "s", "r"), ("a", "s", "r2"), ("a", "s2", "r"), ("b", "s", None), ("c", "s", "r")],
        "question_key string, sql string, result string",
    )
    assert [r.reuse for r in cache.valid_reuse(stored, fresh).orderBy("question_key", "sql", "result").collect()] == [True, False, False, False, False]


# ---------------------------------------------------------------- conversation


@pytest.fixture(scope="module")
def messages(spark):
    made = []
    for turn in range(9):
        user = turn % 2 == 0
        made.append((1, turn, "user" if user else "ai", f"m{turn}", None if user else f"SELECT  {turn}\n FROM t"))
    made.append((2, 0, "system", "x" * 120, None))
    return spark.createDataFrame(made, "conv_id int, turn long, role string, text string, sql string")


def test_history(messages):
    window = history_window(messages, columns=("role", "text", "sql"), chunk_rows=4)
    got = {(r.conv_id, r.turn): r for r in window.withColumn("said", render_history(F.col("history"), has_sql=True)).collect()}
    assert [m.turn for m in got[1, 8].history] == [2, 3, 4, 5, 6, 7]
    assert got[1, 0].said == ""
    assert got[1, 2].said == "Usuário: m0\nSQL usado: SELECT 1 FROM t\nAssistente: m1"
    assert got[2, 0].history == []


def test_thread_preview(messages):
    got = rows(thread_preview(messages), "conv_id", "turn", "n_messages")
    assert got == [(1, 5, 9), (1, 6, 9), (1, 7, 9), (1, 8, 9), (2, 0, 1)]
    assert [r.preview for r in thread_preview(messages).filter("conv_id = 2").collect()] == ["x" * 100 + "…"]


def test_only_lone_questions_use_the_cache(messages):
    window = history_window(messages).withColumn("error", F.when(F.col("conv_id") == 2, "boom"))
    assert rows(cache.cache_eligible(window), "conv_id", "turn") == [(1, 0)]


# ---------------------------------------------------------------- audit

CATALOG = {"dim_food": ["food_id", "food_name", "food_name_normalized"], "fact_values": ["food_id", "nutrient_id", "value"], "dim_nutrient": ["nutrient_id", "unit"]}


@pytest.mark.parametrize(
    ("sql", "tables", "columns", "axes"),
    [
        ("SELECT f.food_name FROM dim_food f WHERE f.food_name_normalized LIKE '%figado%'", [], [], "ok ok ok ok"),
        ("SELECT SUM(fv.value) AS total_mg FROM fact_values fv", [], [], "ok ok ok ok"),
        ("WITH ranked AS (SELECT f.food_name, ROW_NUMBER() OVER (ORDER BY fv.value DESC) AS row_num FROM fact_values fv "
         "JOIN dim_food f ON fv.food_id = f.food_id) SELECT food_name FROM ranked WHERE row_num <= 5", [], [], "ok ok ok ok"),
        ("SELECT vitamin_z FROM dim_food", [], ["vitamin_z"], "ok alucinou ok ok"),
        ("SELECT * FROM no_such_table", ["no_such_table"], [], "ok alucinou ok ok"),
        ("DROP TABLE dim_food", [], [], "ok ok escrita ok"),
        ("SELECT unit FROM dim_nutrient; SELECT unit FROM dim_nutrient", [], [], "ok ok multi_statement ok"),
        ("SELECT * FROM dim_food f CROSS JOIN dim_nutrient n", [], [], "ok ok ok 1 JOIN sem ON"),
        ("SELECT FROM WHERE", None, None, "nao_parseia n/a n/a n/a"),
    ],
)
def test_audit(spark, sql, tables, columns, axes):
    df = spark.createDataFrame([(1, sql)], "stmt_id int, sql string")
    if tables is not None:
        assert [r.table_name for r in unknown_tables(df, CATALOG).collect()] == tables
        if "DROP" not in sql:
            assert [r.column_name for r in unknown_columns(df, CATALOG).collect()] == columns
    row = axis_verdicts(df, CATALOG).first()
    if "DROP" in sql:
        assert row.seguranca == "escrita: drop"
    else:
        assert " ".join([row.sintaxe, row.schema, row.seguranca, row.eficiencia]) == axes
