"""Result comparison, run metrics, cache, conversation, statement audit and terms on the given tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.replies import (
    change_verb,
    joins_without_condition,
    rate_limited,
    retry_after_seconds,
    several_statements,
)
from larder.functions.text import REFUSAL_WORDS, day_label, file_stamp, minute_label, refuses
from larder.operators import evalruns
from larder.operators.cache import (
    cache_eligible,
    cache_hits,
    cache_lookup,
    cache_of,
    cache_stats,
    cache_upsert,
    valid_reuse,
    with_key,
)
from larder.operators.compare import answer_rows, exact_verdict, judge, judge_any, judge_refined, name_overlap, values_contained
from larder.operators.compose import total_by_group
from larder.operators.conversation import history_window, render_history, thread_preview
from larder.operators.rank import rank_items, top_k
from larder.operators.sqlaudit import axis_verdicts, parse_replies, unknown_columns, unknown_tables, with_code
from larder.operators.terms import resolve_terms, resolve_totals
from larder.plans.registry import register
from larder.plans.testdata import PARTS_SQL, SCALE, parts
from larder.plans.warehouse_queries import QUESTION_KEY_SQL, TABLES
from larder.session import new_path
from larder.sources import cachebuckets, textindex
from larder.sources.grid import read_grid
from larder.sources.reports import read_reports, report_details, run_heads, write_reports
from larder.sources.snapshots import commit, read_snapshot, write_data
from larder.sources.tables import catalog_of, read_references, read_table, write_references, write_table

# ---------------------------------------------------------------- result comparison

_GOLD = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
_GOLD_SQL = "g AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders)"


def _same_sql(a: str, b: str) -> str:
    """Whether two selects give the same rows, as an expression."""
    return (
        f"((SELECT COUNT(*) FROM (({a}) EXCEPT ALL ({b}))) = 0 "
        f"AND (SELECT COUNT(*) FROM (({b}) EXCEPT ALL ({a}))) = 0)"
    )


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").select(*_GOLD)


def _case(name: str, df: DataFrame, position: str | None = None) -> DataFrame:
    return answer_rows(df, F.lit(name), position=position)


def _all(rows: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def _wrong_value(gold: DataFrame) -> DataFrame:
    off = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return gold.withColumn("o_totalprice", off)


def _untidy(gold: DataFrame) -> DataFrame:
    """Same answer in other clothes: names, column order, case, blanks, tiny fractions, a column more."""
    return gold.select(
        F.lit("money").alias("currency"),
        F.concat(F.lit("  "), F.lower("o_orderpriority")).alias("prio"),
        (F.col("o_totalprice") + 0.0001).alias("total"),
        F.col("o_custkey").cast("double").alias("customer"),
        F.col("o_orderkey").alias("id"),
    )


def _swapped(gold: DataFrame) -> DataFrame:
    """Right values on the wrong rows: customers in reverse."""
    most = gold.agg(F.max("o_orderkey")).scalar()
    back = gold.select((most - F.col("o_orderkey")).alias("o_orderkey"), "o_custkey")
    return gold.drop("o_custkey").join(back, "o_orderkey")


@register(
    "cmp_exact",
    f"""WITH {_GOLD_SQL}
    SELECT 'identical' AS case_name, {_same_sql("SELECT * FROM g", "SELECT * FROM g")} AS passed
    UNION ALL SELECT 'wrong_value', {_same_sql("SELECT * FROM g", "SELECT * REPLACE (CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM g")}
    UNION ALL SELECT 'fewer_rows', {_same_sql("SELECT * FROM g", "SELECT * FROM g WHERE o_orderpriority <> '1-URGENT'")}
    UNION ALL SELECT 'more_columns', (SELECT COUNT(*) FROM g) < 0
    UNION ALL SELECT 'same_order', {_same_sql("SELECT * FROM g", "SELECT * FROM g")}""",
)
def q_cmp_exact(spark, sf):
    gold = _gold(spark, sf)
    cases = {
        "identical": (gold, gold),
        "wrong_value": (gold, _wrong_value(gold)),
        "fewer_rows": (gold, gold.filter("o_orderpriority <> '1-URGENT'")),
        "more_columns": (gold, gold.withColumn("unit", F.lit("money"))),
    }
    verdicts = [exact_verdict(g, c).withColumn("case_name", F.lit(name)) for name, (g, c) in cases.items()]
    verdicts.append(exact_verdict(gold, gold, "o_orderkey").withColumn("case_name", F.lit("same_order")))
    return _all(verdicts).select("case_name", "passed")


_URGENT_SQL = "SELECT * FROM g WHERE o_orderpriority = '1-URGENT'"
_SWAPPED_SQL = """SELECT g.o_orderkey, b.o_custkey, g.o_totalprice, g.o_orderpriority FROM g
    JOIN g b ON g.o_orderkey = (SELECT MAX(o_orderkey) FROM g) - b.o_orderkey"""


_DIFFERENT = "values exist but rows do not line up"


def _subset_sql(name: str, gold: str, cand: str, why: str) -> str:
    same = _same_sql(gold, cand)
    return f"SELECT '{name}' AS case_name, {same} AS passed, CASE WHEN {same} THEN 'column subset' ELSE {why} END AS reason"


def _count_sql(gold: str, cand: str) -> str:
    return f"'cardinality: candidate ' || (SELECT COUNT(*) FROM ({cand})) || ' vs gold ' || (SELECT COUNT(*) FROM ({gold}))"


_WRONG_SQL = "SELECT * REPLACE (CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM g"


@register(
    "cmp_subset",
    f"""WITH {_GOLD_SQL},
    u AS (SELECT 'money' AS currency, '  ' || lower(o_orderpriority) AS prio, o_totalprice + 0.0001 AS total,
          CAST(o_custkey AS DOUBLE) AS customer, o_orderkey AS id FROM g) """
    + " UNION ALL ".join(
        [
            _subset_sql("identical", "SELECT * FROM g", "SELECT * FROM g ORDER BY o_totalprice", "''"),
            _subset_sql(
                "untidy",
                "SELECT o_orderkey, CAST(o_custkey AS DOUBLE), round(o_totalprice, 2), lower(o_orderpriority) FROM g",
                "SELECT id, customer, round(total, 2), trim(prio) FROM u",
                "''",
            ),
            _subset_sql("wrong_value", "SELECT * FROM g", _WRONG_SQL, "'no candidate column matches ' || chr(39) || 'o_totalprice' || chr(39)"),
            _subset_sql("fewer_rows", "SELECT * FROM g", _URGENT_SQL, _count_sql("SELECT * FROM g", _URGENT_SQL)),
            _subset_sql("whole_dump", _URGENT_SQL, "SELECT * FROM g", _count_sql(_URGENT_SQL, "SELECT * FROM g")),
            _subset_sql("swapped_rows", "SELECT * FROM g", _SWAPPED_SQL, f"'{_DIFFERENT}'"),
            _subset_sql("empty", "SELECT * FROM g", "SELECT * FROM g WHERE o_orderkey < 0", "'candidate is empty'"),
            _subset_sql("optional_missing", "SELECT o_orderkey, o_custkey FROM g", "SELECT id, CAST(customer AS BIGINT) FROM u", "''"),
            _subset_sql("crossed_names", "SELECT o_orderkey, -o_orderkey FROM g", "SELECT -(-o_orderkey), -o_orderkey FROM g", "''"),
        ]
    ),
)
def q_cmp_subset(spark, sf):
    """Nine answers to nine questions, judged in one plan."""
    gold = _gold(spark, sf)
    urgent = gold.filter("o_orderpriority = '1-URGENT'")
    labelled = gold.select("o_orderkey", "o_custkey", F.lit("piece").alias("unit"), F.lit("x").alias("note"))
    most = gold.agg(F.max("o_orderkey")).scalar()
    back = gold.select("o_orderkey", F.col("o_orderkey").alias("a"), (most - F.col("o_orderkey")).alias("b"))
    cases = {
        "identical": (gold, gold),
        "untidy": (gold, _untidy(gold)),
        "wrong_value": (gold, _wrong_value(gold)),
        "fewer_rows": (gold, urgent),
        "whole_dump": (urgent, gold),
        "swapped_rows": (gold, _swapped(gold)),
        "empty": (gold, gold.filter("o_orderkey < 0")),
        "optional_missing": (labelled, _untidy(gold)),
        "crossed_names": (back, back.select("o_orderkey", F.col("b").alias("x"), F.col("a").alias("y"))),
    }
    golds = _all(_case(name, g) for name, (g, _) in cases.items())
    cands = _all(_case(name, c) for name, (_, c) in cases.items())
    return judge(golds, cands, optional=["note"]).withColumnRenamed("question", "case_name")


# Per order five rows whose columns have the same values, and are told apart in two rounds.
_TURNS = [(0, 1, 2), (1, 2, 2), (2, 1, 1), (1, 2, 0), (2, 0, 1)]
_TURNS_SQL = f"""t AS (SELECT 3 * o_orderkey + a AS a, 3 * o_orderkey + b AS b, 3 * o_orderkey + c AS c
    FROM orders, (VALUES {", ".join(map(str, _TURNS))}) AS p(a, b, c)),
    l AS (SELECT x AS a, -x AS b, y AS c, -y AS d, k FROM (
        SELECT o_orderkey AS k, 2 * o_orderkey AS x, 2 * o_orderkey + 1 AS y FROM orders
        UNION ALL SELECT o_orderkey, 2 * o_orderkey + 1, 2 * o_orderkey FROM orders))"""
_TORN_SQL = "SELECT a, CASE WHEN k % 2 = 0 THEN d ELSE b END, c, CASE WHEN k % 2 = 0 THEN b ELSE d END FROM l"


@register(
    "cmp_permuted",
    f"WITH {_TURNS_SQL} "
    + " UNION ALL ".join(
        [
            _subset_sql("turned", "SELECT a, b, c FROM t", "SELECT x, y, z FROM (SELECT c AS z, a AS x, b AS y FROM t)", "''"),
            _subset_sql("misnamed", "SELECT a, b, c FROM t", "SELECT b, c, a FROM (SELECT a AS b, b AS c, c AS a FROM t)", "''"),
            _subset_sql("crossed", "SELECT a, b, c, d FROM l", "SELECT w, z, y, x FROM (SELECT a AS w, d AS x, c AS y, b AS z FROM l)", "''"),
            _subset_sql("torn", "SELECT a, b, c, d FROM l", _TORN_SQL, f"'{_DIFFERENT}'"),
        ]
    ),
)
def q_cmp_permuted(spark, sf):
    """Answers whose columns share their values and are paired by refinement."""
    orders = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    turns = F.array(*[F.struct(*[(3 * F.col("k") + v).alias(n) for n, v in zip("abc", row, strict=True)]) for row in _TURNS])
    gold = orders.select(F.inline(turns))
    x, y = 2 * F.col("k"), 2 * F.col("k") + 1
    both = F.array(*[F.struct(p.alias("a"), (-p).alias("b"), q.alias("c"), (-q).alias("d")) for p, q in ((x, y), (y, x))])
    rows = orders.select("k", F.inline(both))
    linked, even = rows.drop("k"), F.col("k") % 2 == 0
    torn = [F.when(even, F.col(p)).otherwise(F.col(q)).alias(n) for p, q, n in (("d", "b", "x"), ("b", "d", "z"))]
    cases = {
        "turned": (gold, gold.select(F.col("c").alias("z"), F.col("a").alias("x"), F.col("b").alias("y"))),
        "misnamed": (gold, gold.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("c").alias("a"))),
        "crossed": (linked, linked.select(F.col("a").alias("w"), F.col("d").alias("x"), F.col("c").alias("y"), F.col("b").alias("z"))),
        "torn": (linked, rows.select(F.col("a").alias("w"), torn[0], F.col("c").alias("y"), torn[1])),
    }
    golds = _all(_case(name, g) for name, (g, _) in cases.items())
    cands = _all(_case(name, c) for name, (_, c) in cases.items())
    return judge_refined(golds, cands).withColumnRenamed("question", "case_name")


_RANKED = f"""r AS (SELECT item_id, item_name, value, row_number() OVER (ORDER BY value DESC, item_name, item_id) AS a,
    row_number() OVER (ORDER BY value DESC, item_name DESC, item_id DESC) AS b
    FROM star WHERE measure_name = 'p_size' AND value IS NOT NULL)"""


@register(
    "cmp_values",
    f"""WITH {PARTS_SQL}, {_RANKED}
    SELECT 'rows' AS case_name, {_same_sql("SELECT item_id, a FROM r WHERE a <= 10", "SELECT item_id, b FROM r WHERE b <= 10")} AS passed
    UNION ALL SELECT 'values', {_same_sql("SELECT value, a FROM r WHERE a <= 10", "SELECT value, b FROM r WHERE b <= 10")}""",
)
def q_cmp_values(spark, sf):
    star = parts(spark, sf)
    gold = top_k(star, "p_size", 10).select("item_name", "value", "item_id", "row_num")
    other_way = [F.col("value").desc(), F.col("item_name").desc(), F.col("item_id").desc()]
    rows = rank_items(star, "p_size", None).orderBy(*other_way).limit(10)
    cand = rows.withColumn("row_num", F.row_number().over(Window.orderBy(*other_way)))
    cand = cand.select("item_name", "value", "item_id", "row_num")
    by_rows = judge(_case("rows", gold, "row_num"), _case("rows", cand, "row_num"))
    by_values = judge(_case("values", gold, "row_num"), _case("values", cand, "row_num"), mode="values")
    return by_rows.unionByName(by_values).select(F.col("question").alias("case_name"), "passed")


@register(
    "cmp_any",
    f"""WITH {PARTS_SQL}, t AS (SELECT group_name, SUM(CAST(value AS DECIMAL(18,4))) AS total FROM star
        WHERE measure_name = 'qty_total' GROUP BY group_name),
    top AS (SELECT * FROM t ORDER BY total DESC, group_name LIMIT 1)
    SELECT 'all_groups' AS case_name, {_same_sql("SELECT * FROM t", "SELECT * FROM t")} AS passed
    UNION ALL SELECT 'top_group', {_same_sql("SELECT * FROM t", "SELECT * FROM top")} OR {_same_sql("SELECT * FROM top", "SELECT * FROM top")}
    UNION ALL SELECT 'no_alternative', {_same_sql("SELECT * FROM t", "SELECT * FROM top")}""",
)
def q_cmp_any(spark, sf):
    star = parts(spark, sf)
    totals = total_by_group(star, "qty_total", scale=SCALE)
    best = total_by_group(star, "qty_total", 1, scale=SCALE)
    folder = new_path(spark, "references")
    write_references({"total_by_group": totals, "total_by_group_alt0": best}, folder)
    references = read_references(spark, folder, "total_by_group")
    cands = {"all_groups": totals, "top_group": best, "no_alternative": best}
    golds = []
    for i, (name, df) in enumerate(references):
        known = [c for c in cands if i == 0 or c != "no_alternative"]
        golds.append((name, _all(_case(c, df) for c in known)))
    answers = _all(_case(name, df) for name, df in cands.items())
    return judge_any(golds, answers).select(F.col("question").alias("case_name"), "passed")


@register(
    "cmp_overlap",
    """WITH ref AS (SELECT DISTINCT lower(trim(p_name)) AS name FROM part WHERE p_type = 'PROMO'),
    cand AS (SELECT DISTINCT lower(trim(p_name)) AS name FROM part WHERE p_type = 'SMALL'),
    both_names AS (SELECT COUNT(*) AS r, COUNT(cand.name) AS s FROM ref LEFT JOIN cand USING (name))
    SELECT r AS ref_names, s AS shared_names, s / r >= 0.8 AS passed FROM both_names""",
)
def q_cmp_overlap(spark, sf):
    part = read_table(spark, sf, "part")
    return name_overlap(part.filter("p_type = 'PROMO'"), part.filter("p_type = 'SMALL'"), "p_name")


@register(
    "cmp_contained",
    """WITH v AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS v FROM part),
    d AS (SELECT DISTINCT l_quantity AS v FROM lineitem)
    SELECT COUNT(*) AS missing_values, COUNT(*) = 0 AS passed FROM v WHERE v NOT IN (SELECT v FROM d)""",
)
def q_cmp_contained(spark, sf):
    return values_contained(read_table(spark, sf, "part"), read_table(spark, sf, "lineitem"), "p_size", "l_quantity")


# ---------------------------------------------------------------- evaluation runs
# Run = day of an event, question = its user, and the last event of the day is the outcome.

_RUNS_SQL = """
last_event AS (SELECT strftime(ts, '%Y-%m-%d') AS run_at, user_id,
    arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value,
    arg_max(CAST(json_extract_string(props, '$.k') AS INTEGER), (ts, event_id)) AS k
    FROM events GROUP BY ALL),
questions AS (SELECT c_custkey AS id, c_mktsegment AS difficulty, c_name AS question, c_acctbal < 0 AS expects_refusal
    FROM customer),
details AS (SELECT run_at, user_id AS id, difficulty, event_type AS reason, k, value,
    CASE event_type WHEN 'view' THEN 'pass' WHEN 'purchase' THEN 'pass' WHEN 'signup' THEN 'fail'
         WHEN 'click' THEN 'sql_error' ELSE 'skipped_rate_limit' END AS status,
    event_type IN ('view', 'purchase') AS passed, event_type = 'error' AS skipped,
    CASE WHEN event_type <> 'error' THEN 'SELECT ' || k END AS sql,
    CASE WHEN event_type <> 'error' THEN CASE WHEN value >= 2 THEN 'ok' ELSE 'nao_parseia' END END AS sintaxe,
    CASE WHEN event_type <> 'error' THEN CASE WHEN value < 2 THEN 'n/a' WHEN k < 20 THEN 'alucinou' ELSE 'ok' END END AS "schema",
    CASE WHEN event_type <> 'error' THEN CASE WHEN k > 85 THEN 'multi_statement' ELSE 'ok' END END AS seguranca,
    CASE WHEN event_type <> 'error' THEN 'ok' END AS eficiencia
    FROM last_event JOIN questions ON user_id = id),
verdicts AS (SELECT run_at, id, status <> 'sql_error' AS executes, k >= 10 AS has_gold, value > 10 AS matches,
    value > 30 AS refuses FROM details WHERE sql IS NOT NULL),
scored AS (SELECT d.run_at, d.id, q.difficulty, CASE WHEN sql IS NULL THEN 'sem_orcamento'
    WHEN expects_refusal THEN CASE WHEN refuses THEN 'pass' ELSE 'fail' END
    WHEN NOT has_gold THEN 'sem_gold' WHEN NOT executes THEN 'sql_error'
    WHEN matches THEN 'pass' ELSE 'fail' END AS status
    FROM details d JOIN questions q ON d.id = q.id
    LEFT JOIN verdicts v ON v.run_at = d.run_at AND v.id = d.id)
"""


def _last_events(spark: SparkSession, sf: str, run) -> DataFrame:
    """Last event of each user in each run."""
    last = F.max_by(F.struct("event_type", "value", "props"), F.struct("ts", "event_id"))
    rows = read_table(spark, sf, "events").groupBy(run.alias("run"), F.col("user_id").alias("id")).agg(last.alias("e"))
    k = F.get_json_object("e.props", "$.k").cast("int").alias("k")
    return rows.select(F.col("run").cast("string").alias("run_at"), "id", "e.event_type", "e.value", k)


def _details(spark: SparkSession, sf: str) -> DataFrame:
    last = _last_events(spark, sf, F.to_date("ts"))
    kind, ran = F.col("event_type"), F.col("event_type") != "error"
    status = (
        F.when(kind.isin("view", "purchase"), "pass")
        .when(kind == "signup", "fail")
        .when(kind == "click", "sql_error")
        .otherwise("skipped_rate_limit")
    )
    schema = F.when(F.col("value") < 2, "n/a").when(F.col("k") < 20, "alucinou").otherwise("ok")
    return last.join(_questions(spark, sf).select("id", "difficulty", "expects_refusal"), "id").select(
        "run_at", "id", "difficulty", "expects_refusal", "k", "value",
        kind.alias("reason"),
        status.alias("status"),
        kind.isin("view", "purchase").alias("passed"),
        (kind == "error").alias("skipped"),
        F.when(ran, F.concat(F.lit("SELECT "), F.col("k").cast("string"))).alias("sql"),
        F.when(ran, F.when(F.col("value") >= 2, "ok").otherwise("nao_parseia")).alias("sintaxe"),
        F.when(ran, schema).alias("schema"),
        F.when(ran, F.when(F.col("k") > 85, "multi_statement").otherwise("ok")).alias("seguranca"),
        F.when(ran, "ok").alias("eficiencia"),
    )


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("difficulty"),
        F.col("c_name").alias("question"),
        (F.col("c_acctbal") < 0).alias("expects_refusal"),
    )


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Details that carry their own verdicts, so nothing is joined to score them again."""
    ran = F.col("sql").isNotNull()
    verdicts = {
        "executes": F.when(ran, F.col("status") != "sql_error"),
        "has_gold": F.when(ran, F.col("k") >= 10),
        "matches": F.when(ran, F.col("value") > 10),
        "refuses": F.when(ran, F.col("value") > 30),
    }
    return evalruns.with_status(_details(spark, sf).withColumns(verdicts))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("run_at", "id", "difficulty", F.col("rescored_status").alias("status"))


_ACCURACY_SQL = """COUNT(CASE WHEN passed THEN 1 END) AS passed, COUNT(*) AS total,
    round_even(COUNT(CASE WHEN passed THEN 1 END) / COUNT(*), 4) AS accuracy FROM details WHERE NOT skipped"""


@register("acc_overall", f"WITH {_RUNS_SQL} SELECT run_at, {_ACCURACY_SQL} GROUP BY run_at")
def q_acc_overall(spark, sf):
    return evalruns.accuracy(_details(spark, sf))


@register(
    "acc_by_tier", f"WITH {_RUNS_SQL} SELECT run_at, difficulty, {_ACCURACY_SQL} GROUP BY run_at, difficulty"
)
def q_acc_by_tier(spark, sf):
    return evalruns.accuracy(_details(spark, sf), ["run_at", "difficulty"])


@register(
    "axis_rates",
    f"WITH {_RUNS_SQL} "
    + " UNION ALL ".join(
        f"""SELECT run_at, '{a}' AS axis, COUNT(CASE WHEN "{a}" = 'ok' THEN 1 END) AS ok, COUNT("{a}") AS total,
        round_even(COUNT(CASE WHEN "{a}" = 'ok' THEN 1 END) / nullif(COUNT("{a}"), 0), 4) AS rate
        FROM details WHERE NOT skipped GROUP BY run_at"""
        for a in evalruns.AXES
    ),
)
def q_axis_rates(spark, sf):
    return evalruns.axis_rates(_details(spark, sf))


@register(
    "run_coverage",
    f"""WITH {_RUNS_SQL} SELECT run_at, COUNT(CASE WHEN NOT skipped THEN 1 END) AS evaluated,
    COUNT(CASE WHEN skipped THEN 1 END) AS skipped, COUNT(CASE WHEN skipped THEN 1 END) = 0 AS complete
    FROM details GROUP BY run_at""",
)
def q_run_coverage(spark, sf):
    return evalruns.run_coverage(_details(spark, sf))


@register("skipped_ids", f"WITH {_RUNS_SQL} SELECT run_at, id FROM details WHERE skipped")
def q_skipped_ids(spark, sf):
    return evalruns.skipped_ids(_details(spark, sf))


@register("rescore", f"WITH {_RUNS_SQL} SELECT run_at, id, difficulty, status FROM scored")
def q_rescore(spark, sf):
    return _scored(spark, sf)


@register(
    "run_summary",
    f"""WITH {_RUNS_SQL}, s AS (SELECT run_at, COUNT(CASE WHEN status IN ('pass','fail','sql_error') THEN 1 END) AS evaluated,
    COUNT(CASE WHEN status = 'pass' THEN 1 END) AS hits FROM scored GROUP BY run_at),
    a AS (SELECT run_at, {_ACCURACY_SQL} GROUP BY run_at)
    SELECT run_at, evaluated, hits, round_even(hits / nullif(evaluated, 0), 4) AS rescored, accuracy AS reported
    FROM s LEFT JOIN a USING (run_at)""",
)
def q_run_summary(spark, sf):
    return evalruns.run_summary_of(_judged(spark, sf))


# Answers to one question per nation (its customers with balances) in three runs: the second leaves out
# customers in debt, the third adds one to the balances of every fifth nation.
_ANSWERS_SQL = """g AS (SELECT c_nationkey AS id, c_custkey, c_acctbal FROM customer),
answers AS (SELECT 'run0' AS run_at, id, c_custkey, c_acctbal FROM g
    UNION ALL SELECT 'run1', id, c_custkey, c_acctbal FROM g WHERE c_acctbal >= 0
    UNION ALL SELECT 'run2', id, c_custkey, c_acctbal + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END FROM g),
runs AS (SELECT DISTINCT run_at FROM answers),
missed AS (SELECT r.run_at, g.id FROM runs r, g LEFT JOIN answers a
    ON a.run_at = r.run_at AND a.id = g.id AND a.c_custkey = g.c_custkey AND a.c_acctbal = g.c_acctbal
    WHERE a.c_custkey IS NULL)"""


@register(
    "rescore_answers",
    f"""WITH {_ANSWERS_SQL} SELECT r.run_at, CAST(n.n_nationkey AS BIGINT) AS id, n.n_name AS difficulty,
    CASE WHEN EXISTS (SELECT 1 FROM missed m WHERE m.run_at = r.run_at AND m.id = n.n_nationkey) THEN 'fail' ELSE 'pass' END AS status
    FROM runs r, nation n WHERE n.n_nationkey IN (SELECT id FROM g)""",
)
def q_rescore_answers(spark, sf):
    """Stored answers of three runs judged against their references, and the runs scored by the verdicts."""
    columns = ["c_custkey", "c_acctbal"]
    gold = read_table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("id"), *columns)
    off = F.col("c_acctbal") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)
    given = {"run0": gold, "run1": gold.filter("c_acctbal >= 0"), "run2": gold.withColumn("c_acctbal", off)}
    golds, cands = [], []
    for run, answer in given.items():
        question = F.concat_ws("/", F.lit(run), "id")
        golds.append(answer_rows(gold, question, columns))
        cands.append(answer_rows(answer, question, columns))
    parts = F.split("question", "/")
    judged = judge(_all(golds), _all(cands)).select(F.get(parts, F.lit(0)).alias("run_at"), F.get(parts, F.lit(1)).cast("long").alias("id"), "passed")
    yes, no = F.lit(True), F.lit(False)
    verdicts = judged.select("run_at", "id", yes.alias("executes"), yes.alias("has_gold"), F.col("passed").alias("matches"), no.alias("refuses"))
    nation = read_table(spark, sf, "nation")
    questions = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("difficulty"), no.alias("expects_refusal"))
    details = judged.select("run_at", "id", F.lit("SELECT").alias("sql"))
    return evalruns.rescore(details, questions, verdicts)


_COMMON_SQL = """common AS (SELECT id FROM scored WHERE status IN ('pass','fail','sql_error') GROUP BY id
    HAVING COUNT(DISTINCT run_at) >= (SELECT COUNT(DISTINCT run_at) FROM scored))"""

# A user seldom shows up on each day, so for the common base a run is a span of ten days from the first on.
_SPANS_SQL = _RUNS_SQL.replace(
    "strftime(ts, '%Y-%m-%d')", "CAST(date_diff('day', (SELECT MIN(ts) FROM events)::DATE, ts::DATE) // 10 AS VARCHAR)"
)


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    """Re-scored states with a span of ten days as the run."""
    first = read_table(spark, sf, "events").agg(F.to_date(F.min("ts"))).scalar()
    span = F.floor(F.datediff(F.to_date("ts"), first) / 10)
    last = _last_events(spark, sf, span)
    ran = F.col("event_type") != "error"
    details = last.withColumn("sql", F.when(ran, F.concat(F.lit("SELECT "), F.col("k").cast("string"))))
    verdicts = details.filter(ran).select(
        "run_at", "id",
        (F.col("event_type") != "click").alias("executes"),
        (F.col("k") >= 10).alias("has_gold"),
        (F.col("value") > 10).alias("matches"),
        (F.col("value") > 30).alias("refuses"),
    )
    return evalruns.rescore(details, _questions(spark, sf), verdicts)


@register("common_base", f"WITH {_SPANS_SQL}, {_COMMON_SQL} SELECT id FROM common")
def q_common_base(spark, sf):
    return evalruns.common_base(_spans(spark, sf))


@register(
    "common_base_acc",
    f"""WITH {_SPANS_SQL}, {_COMMON_SQL} SELECT run_at, COUNT(CASE WHEN status = 'pass' THEN 1 END) AS hits,
    COUNT(*) AS total, round_even(COUNT(CASE WHEN status = 'pass' THEN 1 END) / COUNT(*), 4) AS accuracy
    FROM scored WHERE id IN (SELECT id FROM common) GROUP BY run_at""",
)
def q_common_base_acc(spark, sf):
    return evalruns.common_base_accuracy(_spans(spark, sf))


@register(
    "latest_failures",
    f"""WITH {_RUNS_SQL} SELECT id, status, reason, q.difficulty, q.question FROM details JOIN questions q USING (id)
    WHERE run_at = (SELECT MAX(run_at) FROM details) AND status IN ('fail', 'sql_error')""",
)
def q_latest_failures(spark, sf):
    return evalruns.latest_failures(_details(spark, sf), _questions(spark, sf))


@register(
    "latest_violations",
    f"WITH {_RUNS_SQL} SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT id, '{a}' AS axis, "{a}" AS violation FROM details WHERE run_at = (SELECT MAX(run_at) FROM details)"""
        for a in evalruns.AXES
    )
    + ") WHERE violation <> 'ok'",
)
def q_latest_violations(spark, sf):
    return evalruns.latest_violations(_details(spark, sf))


_SYMBOL_SQL = "CASE status " + " ".join(f"WHEN '{s}' THEN '{x}'" for s, x in evalruns.SYMBOLS.items()) + " ELSE '?' END"


@register(
    "status_matrix",
    f"WITH {_RUNS_SQL} SELECT id, run_at, {_SYMBOL_SQL} AS symbol FROM scored",
)
def q_status_matrix(spark, sf):
    return evalruns.status_cells(_scored(spark, sf))


@register(
    "plan_rerun",
    f"""WITH {_RUNS_SQL}, l AS (SELECT * FROM details WHERE run_at = (SELECT MAX(run_at) FROM details)),
    a AS (SELECT q.id, CASE WHEN l.passed AND NOT l.skipped THEN 'reuse' ELSE 'rerun' END AS action
          FROM questions q LEFT JOIN l ON q.id = l.id)
    SELECT 'unchanged' AS scenario, id, action FROM a UNION ALL SELECT 'no_print', id, action FROM a
    UNION ALL SELECT 'changed', id, 'rerun' FROM a""",
)
def q_plan_rerun(spark, sf):
    questions, last = _questions(spark, sf), evalruns.latest_run(_details(spark, sf))
    prints = {"unchanged": "0f", "no_print": None, "changed": "1e"}
    plans = [
        evalruns.plan_rerun(questions, last, F.lit("0f"), F.lit(old).cast("string")).withColumn("scenario", F.lit(s))
        for s, old in prints.items()
    ]
    return plans[0].unionByName(plans[1]).unionByName(plans[2])


@register(
    "hits_delta",
    """WITH h AS (SELECT event_type, COUNT(*) AS after_hits,
    COUNT(CASE WHEN dayofmonth(ts) < 16 THEN 1 END) AS before_hits FROM events GROUP BY event_type)
    SELECT event_type, after_hits - before_hits AS hits_gained FROM h""",
)
def q_hits_delta(spark, sf):
    events = read_table(spark, sf, "events")
    keys = ["event_type", "user_id"]
    before = events.filter(F.dayofmonth("ts") < 16).groupBy(*keys).agg(F.count("*").alias("hits"))
    after = events.groupBy(*keys).agg(F.count("*").alias("hits"))
    return evalruns.hits_delta(before, after, ["event_type"])


# ---------------------------------------------------------------- error texts and replies


def _errors(spark: SparkSession, sf: str) -> DataFrame:
    events = read_table(spark, sf, "events")
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    k = F.get_json_object("props", "$.k")
    text = (
        F.when(kind == "error", F.concat(F.lit("Error 429: try again in "), k, F.lit("m"), number, F.lit(".5s")))
        .when(kind == "view", F.concat(F.lit("Rate limit hit, Try Again in "), k, F.lit(".25s")))
        .when(kind == "signup", F.concat(F.lit("busy, try again in "), k, F.lit("h2m3.5s")))
        .when(kind == "purchase", F.concat(F.lit("try again in a while, request "), number, F.lit("s")))
    )
    return events.select("event_id", text.alias("error"))


_ERRORS_SQL = """errors AS (SELECT event_id, CASE event_type
    WHEN 'error' THEN 'Error 429: try again in ' || json_extract_string(props, '$.k') || 'm' || event_id || '.5s'
    WHEN 'view' THEN 'Rate limit hit, Try Again in ' || json_extract_string(props, '$.k') || '.25s'
    WHEN 'signup' THEN 'busy, try again in ' || json_extract_string(props, '$.k') || 'h2m3.5s'
    WHEN 'purchase' THEN 'try again in a while, request ' || event_id || 's' END AS error FROM events)"""


@register(
    "retry_after_seconds",
    f"""WITH {_ERRORS_SQL}, p AS (SELECT event_id,
    TRY_CAST(regexp_extract(error, '(?i)try again in (?:([\\d.]+)h)?(?:([\\d.]+)m)?(?:([\\d.]+)s)?', 1) AS DOUBLE) AS h,
    TRY_CAST(regexp_extract(error, '(?i)try again in (?:([\\d.]+)h)?(?:([\\d.]+)m)?(?:([\\d.]+)s)?', 2) AS DOUBLE) AS m,
    TRY_CAST(regexp_extract(error, '(?i)try again in (?:([\\d.]+)h)?(?:([\\d.]+)m)?(?:([\\d.]+)s)?', 3) AS DOUBLE) AS s
    FROM errors)
    SELECT event_id, CASE WHEN coalesce(h, m, s) IS NOT NULL
      THEN coalesce(h, 0) * 3600 + coalesce(m, 0) * 60 + coalesce(s, 0) END AS seconds FROM p""",
)
def q_retry_after(spark, sf):
    return _errors(spark, sf).select("event_id", retry_after_seconds("error").alias("seconds"))


_LIMITED_SQL = "(contains(lower(error), '429') OR contains(lower(error), 'rate limit'))"


@register("rate_limit_flag", f"WITH {_ERRORS_SQL} SELECT event_id, {_LIMITED_SQL} AS limited FROM errors")
def q_rate_limit_flag(spark, sf):
    return _errors(spark, sf).select("event_id", rate_limited("error").alias("limited"))


@register(
    "classify_status",
    f"""WITH {_ERRORS_SQL} SELECT CASE WHEN error IS NULL THEN NULL WHEN {_LIMITED_SQL} THEN 'skipped_rate_limit'
    ELSE 'agent_error' END AS status, COUNT(*) AS n FROM errors GROUP BY 1""",
)
def q_classify_status(spark, sf):
    states = _errors(spark, sf).select(evalruns.classify_error(F.col("error")).alias("status"))
    return states.groupBy("status").agg(F.count("*").alias("n"))


_WORDS = ["license", "idiot", "año", "étion", "über"]


def _mentions_sql(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@register(
    "refusal_flag",
    f"SELECT doc_id, {_mentions_sql(_WORDS)} AS listed, {_mentions_sql(REFUSAL_WORDS)} AS refuses FROM documents",
)
def q_refusal_flag(spark, sf):
    rows = read_table(spark, sf, "documents")
    return rows.select("doc_id", refuses("text", _WORDS).alias("listed"), refuses("text").alias("refuses"))


@register(
    "run_labels",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, strftime(ts, '%m-%d') AS day,
    strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events""",
)
def q_run_labels(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return read_table(spark, sf, "events").select(
        "event_id",
        minute_label(iso).alias("minute"),
        day_label(iso).alias("day"),
        file_stamp(F.col("ts")).alias("stamp"),
    )


# Every order is answered in one of several ways, good and bad, that name the order.
_REPLY_PARTS = {
    ("1-URGENT", None): (
        "Here you go:\n```sql\nSELECT c.c_name, SUM(o.o_totalprice) AS total FROM orders o "
        "JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderkey = ",
        " GROUP BY c.c_name ORDER BY total DESC;\n```\nDone; create it.",
    ),
    ("2-HIGH", "F"): ("  SELECT o_vitamin, o.o_colour FROM orders o WHERE o.o_orderkey = ", ";  "),
    ("2-HIGH", "O"): (
        "SELECT \"c_name\" FROM main.orders JOIN shop . main.\"customer\" AS c ON o_custkey = c.c_custkey WHERE o_orderkey = ", ""
    ),
    ("2-HIGH", "P"): ("```sql\nWITH gone AS (DELETE FROM orders WHERE o_orderkey = ", " RETURNING *) SELECT * FROM gone\n```"),
    ("3-MEDIUM", "F"): (
        "Try this: WITH big AS (SELECT o_custkey, MAX(o_totalprice) AS top FROM orders WHERE o_orderkey > ",
        " GROUP BY o_custkey) SELECT top, n_name FROM big CROSS JOIN nation",
    ),
    ("3-MEDIUM", "O"): ("```\n```\nSELECT 'it''s; drop table x' AS note -- delete; all\nFROM orders LIMIT ", ""),
    ("3-MEDIUM", "P"): ("```\nno query\n``` SELECT ", ""),
    ("4-NOT SPECIFIED", "F"): ("DROP TABLE orders_", ""),
    ("4-NOT SPECIFIED", "O"): ("SELECT 1; DELETE FROM orders WHERE o_orderkey = ", ""),
    ("4-NOT SPECIFIED", "P"): ("I cannot answer this for order ", "."),
    ("5-LOW", "F"): ("SELECT * FROM missing_sales JOIN nation USING (n_nationkey) WHERE n_nationkey < ", ""),
    ("5-LOW", "O"): ("SELECT o_orderkey FROM orders WHERE (o_orderkey = ", ""),
    ("5-LOW", "P"): ("   ", None),
}


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    reply = F.lit(None).cast("string")
    for (priority, status), (head, tail) in _REPLY_PARTS.items():
        hit = F.col("o_orderpriority") == priority
        if status is not None:
            hit = hit & (F.col("o_orderstatus") == status)
        text = F.lit(head) if tail is None else F.concat(F.lit(head), key, F.lit(tail))
        reply = F.when(hit, text).otherwise(reply)
    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("stmt_id"), reply.alias("reply"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replies_sql() -> str:
    cases = []
    for (priority, status), (head, tail) in _REPLY_PARTS.items():
        hit = f"o_orderpriority = '{priority}'" + (f" AND o_orderstatus = '{status}'" if status else "")
        text = _quoted(head) if tail is None else f"{_quoted(head)} || o_orderkey || {_quoted(tail)}"
        cases.append(f"WHEN {hit} THEN {text}")
    return f"replies AS (SELECT o_orderkey AS stmt_id, CASE {' '.join(cases)} END AS reply FROM orders)"


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_STATEMENTS_SQL = f"""{_replies_sql()},
found AS (SELECT *, {_TRIM.format("reply")} AS t,
    coalesce(nullif({_TRIM.format("regexp_extract(reply, '(?is)```(?:sql)?[ ]*[\\s]*(.*?)```', 1)")}, ''),
             nullif({_TRIM.format("regexp_extract(reply, '(?is)[^a-z0-9_]((?:SELECT|WITH)[^a-z0-9_].*)$', 1)")}, ''),
             CASE WHEN regexp_matches({_TRIM.format("reply")}, '(?i)^(SELECT|WITH)[^a-z0-9_]') THEN {_TRIM.format("reply")} END) AS raw FROM replies),
parsed AS (SELECT *, {_TRIM.format("rtrim(raw, ';')")} AS stmt FROM found),
judged AS (SELECT *, CASE WHEN t IS NULL OR t = '' THEN 'empty' WHEN stmt IS NULL THEN 'no_statement'
    WHEN NOT regexp_matches(stmt, '(?i)^(SELECT|WITH)\\b') THEN 'not_a_read' END AS reason FROM parsed)
"""


@register(
    "extract_sql",
    f"WITH {_STATEMENTS_SQL} SELECT stmt_id, CASE WHEN reason IS NULL THEN stmt END AS sql FROM judged",
)
def q_extract_sql(spark, sf):
    return parse_replies(_replies(spark, sf)).select("stmt_id", "sql")


@register("reject_reason", f"WITH {_STATEMENTS_SQL} SELECT stmt_id, reason FROM judged")
def q_reject_reason(spark, sf):
    return parse_replies(_replies(spark, sf)).select("stmt_id", F.col("reject_reason").alias("reason"))


# The audit looks at the statement where one was found, else at the reply itself.
_CODE_SQL = rf"""{_STATEMENTS_SQL}, audited AS (SELECT stmt_id, coalesce(CASE WHEN reason IS NULL THEN stmt END, reply) AS sql FROM judged),
code AS (SELECT stmt_id, sql, regexp_replace(regexp_replace(sql, '('')(?:[^''])*''|--[^\n]*|/\*(?s:.*?)\*/', '\1 \1', 'g'),
  '"([A-Za-z_]\w*)"', '\1', 'g') AS code FROM audited)"""


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse_replies(_replies(spark, sf))
    return parsed.select("stmt_id", F.coalesce("sql", "reply").alias("sql"))


@register(
    "write_flag",
    rf"""WITH {_CODE_SQL} SELECT stmt_id,
    nullif(lower(regexp_extract(code, '(?i)(?:^|;|\(|\))\s*(INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\b', 1)), '') AS verb FROM code""",
)
def q_write_flag(spark, sf):
    return with_code(_audited(spark, sf)).select("stmt_id", change_verb("code").alias("verb"))


@register(
    "multi_stmt",
    rf"""WITH {_CODE_SQL} SELECT stmt_id, contains(regexp_replace(code, '[;\s]+$', ''), ';') AS several FROM code""",
)
def q_multi_stmt(spark, sf):
    return with_code(_audited(spark, sf)).select("stmt_id", several_statements("code").alias("several"))


@register(
    "join_without_on",
    rf"""WITH {_CODE_SQL} SELECT stmt_id, CAST(greatest(len(regexp_extract_all(code, '(?i)\bJOIN\b'))
    - len(regexp_extract_all(code, '(?i)\b(?:ON|USING)\b')), 0) AS INTEGER) AS bare_joins FROM code""",
)
def q_join_without_on(spark, sf):
    return with_code(_audited(spark, sf)).select("stmt_id", joins_without_condition("code").alias("bare_joins"))


def _catalog(spark: SparkSession, sf: str) -> dict[str, list[str]]:
    return catalog_of({t: read_table(spark, sf, t) for t in TABLES})


_CATALOG_SQL = """cat AS (SELECT lower(table_name) AS table_name, lower(column_name) AS column_name
    FROM information_schema.columns)"""
_NAMES_SQL = rf"""{_CODE_SQL},
tabs AS (SELECT DISTINCT stmt_id, unnest(regexp_extract_all(lower(code), '\b(?:from|join)\s+(?:[a-z_]\w*\s*\.\s*)*([a-z_]\w*)', 1)) AS table_name FROM code),
ctes AS (SELECT DISTINCT stmt_id, unnest(regexp_extract_all(lower(code), '(?:\bwith\s+(?:recursive\s+)?|,\s*)([a-z_]\w*)\s+as\s*\(', 1)) AS table_name FROM code),
used AS (SELECT * FROM tabs EXCEPT SELECT * FROM ctes),
bad_tables AS (SELECT * FROM used WHERE table_name NOT IN (SELECT table_name FROM cat))"""


@register(
    "unknown_tables", f"WITH {_CATALOG_SQL}, {_NAMES_SQL} SELECT stmt_id, table_name FROM bad_tables"
)
def q_unknown_tables(spark, sf):
    return unknown_tables(_audited(spark, sf), _catalog(spark, sf))


def _column_names_sql() -> str:
    from larder.functions.replies import LANGUAGE_WORDS

    words = ", ".join(f"'{w}'" for w in LANGUAGE_WORDS)
    return rf"""words AS (SELECT DISTINCT stmt_id, unnest(regexp_extract_all(
    regexp_replace(regexp_replace(lower(code), '\b[a-z_]\w*\s*\(', '(', 'g'), '\b[a-z_]\w*\s*\.', ' ', 'g'),
    '\b([a-z_]\w*)\b', 1)) AS column_name FROM code),
given AS (SELECT * FROM tabs UNION SELECT * FROM ctes
    UNION SELECT stmt_id, unnest(regexp_extract_all(lower(code), '\b(?:from|join)\s+(?:[a-z_]\w*\s*\.\s*)*[a-z_]\w*\s+(?:as\s+)?([a-z_]\w*)', 1)) FROM code
    UNION SELECT stmt_id, unnest(regexp_extract_all(lower(code), '\bas\s+([a-z_]\w*)', 1)) FROM code),
expected AS (SELECT * FROM words WHERE column_name NOT IN ({words}) EXCEPT SELECT * FROM given),
bad_columns AS (SELECT * FROM expected EXCEPT
    SELECT stmt_id, column_name FROM used JOIN cat USING (table_name))"""


@register(
    "unknown_columns",
    f"WITH {_CATALOG_SQL}, {_NAMES_SQL}, {_column_names_sql()} SELECT stmt_id, column_name FROM bad_columns",
)
def q_unknown_columns(spark, sf):
    return unknown_columns(_audited(spark, sf), _catalog(spark, sf))


_VERDICTS_SQL = rf"""{_column_names_sql()},
    bad_names AS (SELECT stmt_id, string_agg(name, ', ' ORDER BY name) AS unknown_names
      FROM (SELECT stmt_id, table_name AS name FROM bad_tables UNION SELECT stmt_id, column_name FROM bad_columns) GROUP BY stmt_id),
    checked AS (SELECT stmt_id, code,
      nullif(lower(regexp_extract(code, '(?i)(?:^|;|\(|\))\s*(INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\b', 1)), '') AS verb,
      contains(regexp_replace(code, '[;\s]+$', ''), ';') AS several,
      greatest(len(regexp_extract_all(code, '(?i)\bJOIN\b')) - len(regexp_extract_all(code, '(?i)\b(?:ON|USING)\b')), 0) AS bare,
      regexp_matches({_TRIM.format("code")}, '(?i)^(SELECT|WITH)\b|(?:^|;|\(|\))\s*(INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\b')
      AND len(regexp_extract_all(code, '\(')) = len(regexp_extract_all(code, '\)'))
      AND NOT regexp_matches(code, '(?i)\bSELECT\s+FROM\b|\bFROM\s+(?:WHERE|GROUP|ORDER|LIMIT)\b|\b(?:WHERE|AND|OR|BY|ON|FROM|SELECT)\s*;?\s*$') AS parses
      FROM code)
    SELECT stmt_id, CASE WHEN parses THEN 'ok' ELSE 'nao_parseia' END AS sintaxe,
      CASE WHEN NOT parses OR parses IS NULL THEN 'n/a' WHEN stmt_id IN (SELECT stmt_id FROM bad_tables)
           OR stmt_id IN (SELECT stmt_id FROM bad_columns) THEN 'alucinou' ELSE 'ok' END AS "schema",
      CASE WHEN NOT parses OR parses IS NULL THEN 'n/a' WHEN verb IS NOT NULL THEN 'escrita: ' || verb WHEN several THEN 'multi_statement' ELSE 'ok' END AS seguranca,
      CASE WHEN NOT parses OR parses IS NULL THEN 'n/a' WHEN bare > 0 THEN bare || ' JOIN sem ON' ELSE 'ok' END AS eficiencia,
      CASE WHEN parses THEN unknown_names END AS unknown_names
    FROM checked LEFT JOIN bad_names USING (stmt_id)"""


@register("axis_verdicts", f"WITH {_CATALOG_SQL}, {_NAMES_SQL}, {_VERDICTS_SQL}")
def q_axis_verdicts(spark, sf):
    return axis_verdicts(_audited(spark, sf), _catalog(spark, sf))


# Whole documents quoted into statements: as a literal, and as a comment if they do not end one.
_QUOTED_SQL = """audited AS (SELECT doc_id AS stmt_id, CASE WHEN doc_id % 2 = 0 OR contains(text, '*/')
    THEN 'SELECT ' || chr(39) || replace(text, chr(39), chr(39) || chr(39)) || chr(39)
         || ' AS note, odd_column FROM documents WHERE doc_id = ' || doc_id
    ELSE 'SELECT doc_id /* ' || text || ' */ FROM odd_table' END AS sql FROM documents)"""


@register(
    "axis_verdicts_quoting",
    f"WITH {_CATALOG_SQL}, {_QUOTED_SQL}, {_NAMES_SQL[_NAMES_SQL.index('code AS ('):]}, {_VERDICTS_SQL}",
)
def q_axis_verdicts_quoting(spark, sf):
    text, number = F.col("text"), F.col("doc_id").cast("string")
    quoted = F.replace(text, F.lit("'"), F.lit("''"))
    literal = F.concat(F.lit("SELECT '"), quoted, F.lit("' AS note, odd_column FROM documents WHERE doc_id = "), number)
    comment = F.concat(F.lit("SELECT doc_id /* "), text, F.lit(" */ FROM odd_table"))
    sql = F.when((F.col("doc_id") % 2 == 0) | text.contains("*/"), literal).otherwise(comment)
    statements = read_table(spark, sf, "documents").select(F.col("doc_id").alias("stmt_id"), sql.alias("sql"))
    return axis_verdicts(statements, _catalog(spark, sf))


# ---------------------------------------------------------------- cache
# Events are store calls: what was asked, the SQL, its result and sometimes a reply. The first half of
# the month is already in the cache, the second half is the new batch.

_CALLS_SQL = f"""raw AS (SELECT event_id AS seq, ts AS stored_at, 'How  many ' || CASE WHEN value > 20 THEN upper(event_type) ELSE event_type END
    || ' with ' || props || ' ?' AS question, 'SELECT ' || event_type AS sql,
    CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS result,
    CASE WHEN value >= 5 THEN 'There are ' || event_id END AS response, dayofmonth(ts) < 16 AS early FROM events),
calls AS (SELECT *, {QUESTION_KEY_SQL.format("question")} AS question_key FROM raw),
folded AS (SELECT question_key, early, arg_min(question, (stored_at, seq)) AS question_raw, arg_max(sql, (stored_at, seq)) AS sql,
    arg_max(result, (stored_at, seq)) AS result_snapshot,
    arg_max(response, (stored_at, seq)) FILTER (WHERE response IS NOT NULL) AS response,
    MIN(stored_at) AS created_at, MAX(stored_at) AS updated_at, COUNT(*) AS n FROM calls GROUP BY question_key, early),
cache AS (SELECT question_key, question_raw, sql, result_snapshot, response, n AS hits, created_at, updated_at FROM folded WHERE early),
batch AS (SELECT * FROM folded WHERE NOT early),
merged AS (SELECT question_key, coalesce(c.question_raw, b.question_raw) AS question_raw,
    CASE WHEN b.updated_at IS NOT NULL THEN b.sql ELSE c.sql END AS sql,
    CASE WHEN b.updated_at IS NOT NULL THEN b.result_snapshot ELSE c.result_snapshot END AS result_snapshot,
    coalesce(b.response, c.response) AS response, coalesce(c.hits, 0) AS hits,
    coalesce(c.created_at, b.created_at) AS created_at,
    CASE WHEN b.updated_at IS NOT NULL THEN b.updated_at ELSE c.updated_at END AS updated_at
    FROM cache c FULL JOIN batch b USING (question_key))"""


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("value") > 20, F.upper("event_type")).otherwise(F.col("event_type"))
    calls = read_table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.col("ts").alias("at"),
        F.concat(F.lit("How  many "), kind, F.lit(" with "), "props", F.lit(" ?")).alias("question"),
        F.concat(F.lit("SELECT "), "event_type").alias("sql"),
        F.floor(F.col("value") / 20).cast("string").alias("result"),
        F.when(F.col("value") >= 5, F.concat(F.lit("There are "), F.col("event_id").cast("string"))).alias("response"),
        (F.dayofmonth("ts") < 16).alias("early"),
    )
    return with_key(calls)


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    """The first half of the month in an empty cache, each call counted as a hit."""
    return cache_of(_calls(spark, sf).filter("early"))


def _late(spark: SparkSession, sf: str) -> DataFrame:
    return _calls(spark, sf).filter("not early")


@register("cache_upsert", f"WITH {_CALLS_SQL} SELECT * FROM merged")
def q_cache_upsert(spark, sf):
    return cache_upsert(_cache(spark, sf), _late(spark, sf))


@register("cache_upsert_buckets", f"WITH {_CALLS_SQL} SELECT * FROM merged")
def q_cache_upsert_buckets(spark, sf):
    path, late = new_path(spark, "cache-buckets"), _late(spark, sf)
    cachebuckets.create(spark, path, 16)
    cachebuckets.fill(_cache(spark, sf), path)
    ends = late.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    middle = F.lit(ends.first + (ends.last - ends.first) / 2) if ends.first else F.lit(None)
    halves = late.where(F.col("at") < middle), late.where(F.col("at") >= middle)
    cachebuckets.upsert(halves[0], path, 1)
    cachebuckets.compact(spark, path)
    cachebuckets.upsert(halves[0], path, 1)  # sent again, counts once
    cachebuckets.upsert(halves[1], path, 2)
    return cachebuckets.read(spark, path)


@register(
    "cache_lookup",
    f"""WITH {_CALLS_SQL} SELECT seq, question_key, c.sql, result_snapshot, c.response, c.question_key IS NOT NULL AS found
    FROM calls LEFT JOIN cache c USING (question_key) WHERE NOT early""",
)
def q_cache_lookup(spark, sf):
    questions = _late(spark, sf).select("seq", "question_key")
    return cache_lookup(questions, _cache(spark, sf))


@register(
    "cache_hits",
    f"""WITH {_CALLS_SQL}, h AS (SELECT question_key, COUNT(*) AS n FROM calls WHERE NOT early GROUP BY 1)
    SELECT question_key, hits + coalesce(n, 0) AS hits FROM cache LEFT JOIN h USING (question_key)""",
)
def q_cache_hits(spark, sf):
    return cache_hits(_cache(spark, sf), _late(spark, sf)).select("question_key", "hits")


@register(
    "cache_stats", f"WITH {_CALLS_SQL} SELECT COUNT(*) AS entries, CAST(coalesce(SUM(hits), 0) AS BIGINT) AS total_hits FROM merged"
)
def q_cache_stats(spark, sf):
    return cache_stats(cache_upsert(_cache(spark, sf), _late(spark, sf)))


@register(
    "valid_reuse",
    f"""WITH {_CALLS_SQL} SELECT seq, question_key, k.sql, result, coalesce(c.response IS NOT NULL AND c.sql IS NOT DISTINCT FROM k.sql
    AND c.result_snapshot IS NOT DISTINCT FROM k.result, false) AS reuse
    FROM calls k LEFT JOIN cache c USING (question_key) WHERE NOT early""",
)
def q_valid_reuse(spark, sf):
    fresh = _late(spark, sf).select("seq", "question_key", "sql", "result")
    return valid_reuse(_cache(spark, sf), fresh)


# ---------------------------------------------------------------- conversations


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "conversations")
    sql = F.when(F.col("role") == "assistant", F.concat(F.lit("SELECT  *\n FROM t WHERE id ="), F.col("conv_id").cast("string")))
    return rows.withColumn("sql", sql)


_BACK = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"


@register(
    "history_window",
    f"SELECT conv_id, turn, COUNT(*) {_BACK} AS n_history, MIN(turn) {_BACK} AS first_turn, MAX(turn) {_BACK} AS last_turn FROM conversations",
)
def q_history_window(spark, sf):
    turns = F.col("history.turn")
    return history_window(_messages(spark, sf)).select(
        "conv_id", "turn",
        F.size("history").cast("long").alias("n_history"),
        F.array_min(turns).alias("first_turn"),
        F.array_max(turns).alias("last_turn"),
    )


@register(
    "render_history",
    f"""WITH m AS (SELECT conv_id, turn, CASE WHEN role IN ('user', 'human') THEN 'Usuário: ' || text
        WHEN role = 'assistant' THEN 'SQL usado: SELECT * FROM t WHERE id =' || conv_id || chr(10) || 'Assistente: ' || text
        ELSE 'Assistente: ' || text END AS line FROM conversations)
    SELECT conv_id, turn, coalesce(string_agg(line, chr(10)) {_BACK}, '') AS history_text FROM m""",
)
def q_render_history(spark, sf):
    rows = history_window(_messages(spark, sf), columns=("role", "text", "sql"))
    return rows.select("conv_id", "turn", render_history(F.col("history"), has_sql=True).alias("history_text"))


@register(
    "thread_preview",
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back,
        COUNT(*) OVER (PARTITION BY conv_id) AS n_messages FROM conversations)
    SELECT conv_id, turn, role, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '…' ELSE text END AS preview,
    n_messages FROM c WHERE back <= 4""",
)
def q_thread_preview(spark, sf):
    return thread_preview(read_table(spark, sf, "conversations"))


@register(
    "cache_eligible",
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)
    SELECT conv_id, turn FROM c WHERE place = 1 AND NOT contains(lower(text), 'license')""",
)
def q_cache_eligible(spark, sf):
    failed = F.when(F.lower("text").contains("license"), F.lit("refused"))
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", failed.alias("error"))
    return cache_eligible(turns).select("conv_id", "turn")


# ---------------------------------------------------------------- terms

SYNONYMS = [
    ("tamanho", ["p_size"], False),
    ("preço", ["p_retailprice"], False),
    ("preco", ["p_retailprice"], False),
    ("encargos", ["tax_max"], False),
    ("encargos totais", ["discount_min", "tax_max"], False),
    ("devolução", ["bulk_return_price"], True),
    ("peso", ["p_weight"], False),
]
_ASKED = [(10, "Tamanho"), (20, "PREÇO"), (30, "encargos totais"), (40, "devolução e o preço"), (50, "peso")]


def _part_questions(spark: SparkSession, sf: str) -> DataFrame:
    word = F.lit(None).cast("string")
    for limit, asked in reversed(_ASKED):
        word = F.when(F.col("p_size") <= limit, asked).otherwise(word)
    text = F.concat(F.lit("Qual o "), word, F.lit(" de "), "p_name", F.lit("?"))
    return read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("question_id"), F.col("p_partkey").alias("item_id"), text.alias("question")
    )


_TERMS_SQL = (
    "asked AS (SELECT p_partkey AS question_id, unnest(CASE "
    "WHEN p_size <= 10 THEN ['tamanho'] WHEN p_size <= 20 THEN ['preco'] WHEN p_size <= 30 THEN ['encargos totais'] "
    "WHEN p_size <= 40 THEN ['devolucao', 'preco'] ELSE ['peso'] END) AS term FROM part), "
    "syn AS (SELECT * FROM (VALUES ('tamanho', 'p_size', false), ('preco', 'p_retailprice', false), "
    "('encargos totais', 'discount_min', false), ('encargos totais', 'tax_max', false), "
    "('devolucao', 'bulk_return_price', true), ('peso', 'p_weight', false)) AS t(term, measure_name, is_proxy))"
)


@register(
    "resolve_terms",
    f"WITH {_TERMS_SQL} SELECT question_id, term, measure_name, is_proxy FROM asked JOIN syn USING (term)",
)
def q_resolve_terms(spark, sf):
    found = resolve_terms(_part_questions(spark, sf), SYNONYMS)
    return found.select("question_id", "term", F.explode("targets").alias("measure_name"), "is_proxy")


GROUP_SYNONYMS = [
    ("promoção", ["PROMO"], False),
    ("promocao", ["PROMO"], False),
    ("pequenos", ["SMALL"], False),
    ("pequenos e médios", ["SMALL", "MEDIUM"], False),
]
_GROUPS_ASKED = [(15, "em PROMOÇÃO"), (30, "Pequenos e Médios"), (40, "pequenos ou em promocao"), (50, "grandes")]


@register(
    "resolve_groups",
    """WITH asked AS (SELECT p_partkey AS question_id, unnest(CASE WHEN p_size <= 15 THEN ['promocao']
      WHEN p_size <= 30 THEN ['pequenos e medios'] WHEN p_size <= 40 THEN ['pequenos', 'promocao'] ELSE [] END) AS term FROM part),
    syn AS (SELECT * FROM (VALUES ('promocao', 'PROMO'), ('pequenos', 'SMALL'), ('pequenos e medios', 'SMALL'),
      ('pequenos e medios', 'MEDIUM')) AS t(term, group_name)),
    sizes AS (SELECT p_type AS group_name, COUNT(*) AS n_items FROM part GROUP BY p_type)
    SELECT question_id, term, group_name, n_items FROM asked JOIN syn USING (term) JOIN sizes USING (group_name)""",
)
def q_resolve_groups(spark, sf):
    """Groups that questions name, with the items in them."""
    word = F.lit(None).cast("string")
    for limit, asked in reversed(_GROUPS_ASKED):
        word = F.when(F.col("p_size") <= limit, asked).otherwise(word)
    part = read_table(spark, sf, "part")
    questions = part.select(F.col("p_partkey").alias("question_id"), F.concat(F.lit("Quais itens "), word, F.lit("?")).alias("question"))
    found = resolve_terms(questions, GROUP_SYNONYMS).select("question_id", "term", F.explode("targets").alias("group_name"))
    sizes = part.groupBy(F.col("p_type").alias("group_name")).agg(F.count("*").alias("n_items"))
    return found.join(sizes, "group_name").select("question_id", "term", "group_name", "n_items")


@register(
    "resolve_composite",
    f"""WITH {PARTS_SQL}, {_TERMS_SQL} SELECT question_id, term, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total
    FROM asked JOIN syn USING (term) JOIN fact ON fact.item_id = question_id AND fact.measure_name = syn.measure_name
    GROUP BY question_id, term""",
)
def q_resolve_composite(spark, sf):
    totals = resolve_totals(_part_questions(spark, sf), SYNONYMS, parts(spark, sf), ["question_id"], SCALE)
    return totals.select("question_id", "term", "total")


_PATTERNS = ["%data%", "%the%ing%", "%_er %on%", "%r_", "%not there at all%"]


@register(
    "search_trigrams",
    f"""SELECT pattern, doc_id FROM documents, (VALUES {", ".join(f"('{p}')" for p in _PATTERNS)}) AS p(pattern)
    WHERE text LIKE pattern""",
)
def q_search_trigrams(spark, sf):
    folder = new_path(spark, "trigrams")
    textindex.build(read_table(spark, sf, "documents"), folder, "doc_id", "text")
    return _all(textindex.search(spark, folder, p).select(F.lit(p).alias("pattern"), F.col("id").alias("doc_id")) for p in _PATTERNS)


# ---------------------------------------------------------------- round trips


@register("write_then_read", "SELECT l_orderkey, l_returnflag, l_quantity FROM lineitem")
def q_write_then_read(spark, sf):
    path = new_path(spark, "lines")
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    write_table(lines, path, partition_by=["l_returnflag"])
    write_table(lines, path, partition_by=["l_returnflag"])
    return spark.read.parquet(path).select("l_orderkey", "l_returnflag", "l_quantity")


@register(
    "snapshot_load",
    """SELECT 'newest' AS state, o_orderstatus, count(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 'first', o_orderstatus, count(*), CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_orderstatus""",
)
def q_snapshot_load(spark, sf):
    """Orders loaded in two snapshots; a third load dies before its manifest and is not seen."""
    path = new_path(spark, "orders")
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    first = commit({"orders": orders.where("o_orderstatus <> 'O'")}, path, {"orders": ["o_orderstatus"]})
    newest = commit({"orders": orders}, path, {"orders": ["o_orderstatus"]})
    write_data({"orders": orders.unionByName(orders)}, path, {"orders": ["o_orderstatus"]})
    states = [read_snapshot(spark, path, "orders", v).withColumn("state", F.lit(s)) for v, s in ((first.version, "first"), (newest.version, "newest"))]
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")
    return states[0].unionByName(states[1]).groupBy("state", "o_orderstatus").agg(F.count("*").alias("n"), total)


@register("grid_round_trip", "SELECT CAST(o_orderkey AS VARCHAR) AS c0, o_orderpriority AS c1, NULL::VARCHAR AS c2 FROM orders")
def q_grid_round_trip(spark, sf):
    """A sheet exported as CSV in several files and read back as a grid."""
    path = new_path(spark, "sheet")
    rows = read_table(spark, sf, "orders").select(F.col("o_orderkey").cast("string"), "o_orderpriority", F.lit("").alias("blank"))
    rows.repartition(3, "o_orderkey").write.csv(path, emptyValue="")
    grid = read_grid(spark, path, 3)
    # A number that two rows share would drop one of them here.
    return grid.dropDuplicates(["row_idx"]).select("c0", "c1", "c2")


@register("report_round_trip", f"WITH {_RUNS_SQL} SELECT run_at, CAST(id AS VARCHAR) AS id, status, sintaxe FROM details")
def q_report_round_trip(spark, sf):
    """One nested document of many lines for each run, read back by the report reader."""
    folder = new_path(spark, "documents")
    checks = F.struct("sintaxe", "schema", "seguranca", "eficiencia").alias("checks")
    detail = F.struct(F.col("id").cast("string").alias("id"), "status", checks)
    runs = _details(spark, sf).groupBy("run_at").agg(F.collect_list(detail).alias("details"))
    text = F.to_json(F.struct("run_at", "details"), {"pretty": "true"})
    runs.select(F.col("run_at").alias("run"), text.alias("value")).write.partitionBy("run").text(folder)
    return report_details(read_reports(spark, f"{folder}/*")).select("run_at", "id", "status", "sintaxe")


@register(
    "report_sink",
    f"""WITH {_RUNS_SQL} SELECT run_at, id, difficulty, status, passed, skipped FROM details""",
)
def q_report_sink(spark, sf):
    folder = new_path(spark, "reports")
    columns = ["run_at", "id", "difficulty", "status", "passed", "skipped"]
    details = _details(spark, sf).select(*columns)
    write_reports(details, folder)
    schema = "id bigint, difficulty string, status string, passed boolean, skipped boolean, run_at string"
    return spark.read.schema(schema).json(f"{folder}/details").select(*columns)


@register(
    "report_heads",
    f"""WITH {_RUNS_SQL}, c AS (SELECT run_at, COUNT(CASE WHEN NOT skipped THEN 1 END) AS evaluated,
    COUNT(CASE WHEN skipped THEN 1 END) AS skipped FROM details GROUP BY run_at),
    t AS (SELECT run_at, difficulty, COUNT(*) AS total, COUNT(CASE WHEN passed THEN 1 END) AS passed FROM details
    WHERE NOT skipped GROUP BY ALL)
    SELECT run_at, evaluated, skipped, difficulty, total, passed FROM c JOIN t USING (run_at)""",
)
def q_report_heads(spark, sf):
    heads = run_heads(_details(spark, sf))
    rows = heads.select("run_at", "evaluated", "skipped", F.explode("by_difficulty").alias("difficulty", "tier"))
    return rows.select("run_at", "evaluated", "skipped", "difficulty", "tier.total", "tier.passed")


@register(
    "json_explode",
    """SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS rows_agent,
    event_type AS status, CASE WHEN value > 2 THEN 'ok' ELSE 'nao_parseia' END AS sintaxe FROM events""",
)
def q_json_explode(spark, sf):
    """Each event as a nested report line, read back under the report schema and exploded."""
    from larder.sources.reports import REPORT

    checks = F.struct(F.when(F.col("value") > 2, "ok").otherwise("nao_parseia").alias("sintaxe"))
    detail = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("status"),
        F.get_json_object("props", "$.k").cast("int").alias("rows_agent"),
        checks.alias("checks"),
    )
    lines = read_table(spark, sf, "events").select(
        F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("run_at"), F.array(detail).alias("details"))).alias("line")
    )
    reports = lines.select(F.from_json("line", REPORT).alias("r")).select("r.*")
    return report_details(reports).select(F.col("id").cast("long").alias("id"), "rows_agent", "status", "sintaxe")
