import math

import pytest
from food_rows import AMINO, FATTY, FOODS
from pyspark.sql import functions as F

from larder.operators.clean import carry_forward_group, groups_in_order
from larder.operators.coverage import coverage_guard, coverage_profile, guard, null_aware_anti, unused_measures
from larder.operators.quality import null_profile, row_counts
from larder.operators.rank import result_cap
from larder.operators.star import Star
from larder.operators.terms import resolve_terms, resolve_totals
from larder.plans import food
from larder.sources.grid import read_grid
from larder.sources.tables import catalog_table, session_catalog


def number(cell):
    if cell == "Tr":
        return 0.0
    try:
        return float(cell)
    except ValueError:
        return None


def facts():
    """(id, measure) -> value, worked out by hand from the fixture."""
    out = {}
    for key, _, _, cells in FOODS:
        out |= {(key, m): number(cells.get(m, "1")) for m in food.sheet_measures("main")}
    for sheet, table in (("fatty_acids", FATTY), ("amino_acids", AMINO)):
        for key, cells in table.items():
            out |= {(key, m): number(cells.get(m, "1")) for m in food.sheet_measures(sheet)}
    return out


NAMES = {f[0]: f[1] for f in FOODS}
GROUPS = {f[0]: f[2] for f in FOODS}


def test_row_order_of_a_split_sheet(spark, sheets):
    path = sheets["main"]
    whole = [line for line in open(path, encoding="utf-8").read().splitlines()]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        grid = read_grid(spark, path, len(food.SHEETS["main"]))
        assert grid.rdd.getNumPartitions() > 3
        rows = grid.orderBy("row_idx").collect()
        grouped = carry_forward_group(grid, chunk_rows=64).filter("c1 is not null and c0 rlike '^[0-9]+$'")
        got = {int(r.c0): r.item_group for r in grouped.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.c0 for r in rows] == [line.split('"')[1] if line.startswith('"') else None for line in whole]
    assert len({r.row_idx for r in rows}) == len(rows)
    assert got == GROUPS


def test_bronze(bronze):
    main = {r.item_id: r for r in bronze["main"].collect()}
    assert {k: (r.item_name, r.item_group) for k, r in main.items()} == {k: (NAMES[k], GROUPS[k]) for k in NAMES}
    expected = facts()
    for key, row in main.items():
        for m in food.sheet_measures("main"):
            assert row[m] == expected[key, m]
    assert len(food.sheet_measures("main")) == 26
    assert len(food.sheet_measures("fatty_acids")) == 22
    assert len(food.sheet_measures("amino_acids")) == 18


def test_groups_by_first_appearance(spark, sheets):
    grid = read_grid(spark, sheets["main"], len(food.SHEETS["main"]))
    rows = carry_forward_group(grid).filter("c0 rlike '^[0-9]+$'")
    assert [r.item_group for r in groups_in_order(rows, "item_group").collect()] == list(dict.fromkeys(GROUPS.values()))


def test_gold(star):
    groups = {r.group_id: r for r in star.group.collect()}
    assert [groups[i + 1].group_name for i in range(len(groups))] == sorted(set(GROUPS.values()))
    assert groups[[i for i, r in groups.items() if r.group_name == "Gorduras e óleos"][0]].group_name_normalized == "gorduras e oleos"
    items = {r.item_id: r for r in star.item.collect()}
    assert set(items) == set(NAMES)
    assert items[6].item_name_normalized == "carne, bovina, figado, cru"
    ids = {name: i for i, name, _, _ in food.MEASURES}
    got = {(r.item_id, r.measure_id): (r.value, r.is_missing) for r in star.fact.collect()}
    assert got == {(k, ids[m]): (v, v is None) for (k, m), v in facts().items()}


def test_checks_find_the_orphan(star):
    failed = {(r.table_name, r.check, r.column_name): r.failures for r in food.gold_checks(star).collect() if r.failures}
    assert failed == {("fact", "relationships", "item_id"): 22}


def brute_rank(measure, n=10, inverse=False, groups=None):
    rows = [(k, v) for (k, m), v in facts().items() if m == measure and k in NAMES and v is not None]
    rows = [(k, v) for k, v in rows if (groups is None or GROUPS[k] in groups) and (not inverse or v > 0)]
    rows.sort(key=lambda r: (r[1] if inverse else -r[1], NAMES[r[0]], r[0]))
    return [(k, v) for k, v in rows[:n]]


def pairs(df):
    return [(r.item_id, r.value) for r in df.collect()]


def brute_composite(measures, groups=None, measured_only=False):
    sums = {}
    for (k, m), v in facts().items():
        if m in measures and k in NAMES and (groups is None or GROUPS[k] in groups):
            if v is None and measured_only:
                continue
            old = sums.get(NAMES[k])
            sums[NAMES[k]] = old if v is None else v + (old or 0.0)
    rows = sorted(sums.items(), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    return rows[:10]


def test_questions(star):
    q = food.questions(star)
    fruit, meat = ["Frutas e derivados"], ["Carnes e derivados"]
    assert pairs(q["Q001"]) == [(7, 9.5), (6, 5.6)]
    assert pairs(q["Q002"]) == brute_rank("vitamina_c_mg", groups=fruit)
    assert pairs(q["Q004"]) == brute_rank("calcio_mg", None, groups=["Nozes e sementes", "Leite e derivados"])
    assert pairs(q["Q006"]) == brute_rank("tiamina_mg", inverse=True)
    assert pairs(q["Q008"]) == brute_rank("zinco_mg")
    assert pairs(q["Q009"]) == brute_rank("niacina_mg", inverse=True)
    assert pairs(q["Q011"]) == []
    assert pairs(q["Q013"]) == brute_rank("ag_poliinsaturados_g")
    assert pairs(q["Q014"]) == brute_rank("lipideos_g", groups=meat)
    assert pairs(q["Q016"]) == brute_rank("proteina_g", inverse=True, groups=food.VEGETABLE_PROTEIN)
    assert pairs(q["Q018"]) == brute_rank("aa_leucina_g")
    assert pairs(q["Q019"]) == brute_rank("aa_leucina_g", groups=food.VEGETABLE_PROTEIN)
    assert pairs(q["Q021"]) == brute_rank("energia_kcal", inverse=True)
    assert q["Q010"].first()[0] == len(FOODS)

    totals = {}
    for (k, m), v in facts().items():
        if m == "calcio_mg" and k in NAMES:
            totals[GROUPS[k]] = totals.get(GROUPS[k], 0) + v
    ranked = sorted(totals.items(), key=lambda r: (-r[1], r[0]))
    assert [tuple(r) for r in q["Q003"].collect()] == ranked
    assert [tuple(r) for r in q["Q003_alt0"].collect()] == ranked[:1]

    best = {g: max(v for (k, m), v in facts().items() if m == "energia_kcal" and GROUPS.get(k) == g) for g in GROUPS.values()}
    winners = {(k, v) for (k, m), v in facts().items() if m == "energia_kcal" and k in NAMES and v == best[GROUPS[k]]}
    assert set(pairs(q["Q005"])) == winners
    assert {8, 9} <= {k for k, _ in winners}

    for key, measures, groups, measured in (
        ("Q007", food.OMEGA_3, None, False),
        ("Q012", food.TRANS_FAT, None, True),
        ("Q015", food.ESSENTIAL_AMINO_ACIDS, food.VEGETABLE_PROTEIN, True),
    ):
        got = [(r.item_name, r.total) for r in q[key].collect()]
        expected = brute_composite(measures, groups, measured)
        assert [n for n, _ in got] == [n for n, _ in expected]
        assert all(a == b or math.isclose(a, b) for (_, a), (_, b) in zip(got, expected, strict=True))
    assert q["Q007"].first().item_name == "Linhaça, semente"

    f = facts()
    crossed = [k for k in NAMES if GROUPS[k] in food.VEGETABLE_PROTEIN]
    crossed.sort(key=lambda k: (-f[k, "proteina_g"], f[k, "carboidrato_g"], NAMES[k]))
    assert [r.item_id for r in q["Q017"].collect()] == crossed[:10]
    crossed = sorted(NAMES, key=lambda k: (-f[k, "energia_kcal"], -f[k, "lipideos_g"], NAMES[k]))
    assert [r.item_id for r in q["Q020"].collect()] == crossed[:10]
    assert [r.item_id for r in q["similar_to_rice"].collect()] == [3, 1]


def test_plain_sql_over_the_star(spark, star):
    food.register(star)
    rows = spark.sql(
        """
        WITH ranked AS (
          SELECT f.food_name, g.food_group_name, fv.value, n.unit,
                 RANK() OVER (PARTITION BY g.food_group_name ORDER BY fv.value DESC) AS place
          FROM fact_nutrient_values fv JOIN dim_food f ON fv.food_id = f.food_id
          JOIN dim_food_group g ON f.food_group_id = g.food_group_id
          JOIN dim_nutrient n ON fv.nutrient_id = n.nutrient_id
          WHERE n.nutrient_name = 'energia_kcal' AND fv.value IS NOT NULL)
        SELECT food_name FROM ranked WHERE place = 1"""
    ).collect()
    assert sorted(r[0] for r in rows) == sorted(r.item_name for r in food.questions(star)["Q005"].collect())
    catalog = session_catalog(spark)
    assert "food_group_name_normalized" in catalog["dim_food_group"]
    assert catalog_table(spark, {"dim_food": catalog["dim_food"]}).count() == 5


def test_coverage(star):
    profile = {r.measure_name: r for r in coverage_profile(star).collect()}
    assert len(profile) == 67
    n = len(FOODS)
    assert tuple(profile["vitamina_d_mcg"])[1:] == (0, 0, 0, n)
    assert tuple(profile["tiamina_mg"])[1:] == (n - 1, 1, 0, 0)
    assert tuple(profile["vitamina_c_mg"])[1:] == (n - 1, 0, 1, 0)
    assert tuple(profile["aa_lisina_g"])[1:] == (1, 0, 1, n - 2)
    assert [r.measure_name for r in unused_measures(star).collect()] == ["vitamina_d_mcg"]
    status = {r.measure_name: r.status for r in coverage_guard(star, 0.5).collect()}
    assert status["proteina_g"] == "sufficient"
    assert status["aa_leucina_g"] == "insufficient"
    assert guard(food.questions(star)["Q018"]).first()["status"] == "insufficient"
    assert guard(food.questions(star)["Q008"]).first()["status"] == "sufficient"


def test_not_in_keeps_its_null_rules(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")

    def rest(listed):
        other = spark.createDataFrame([(x,) for x in listed], "x int")
        return sorted((r.k for r in null_aware_anti(df, "k", other, "x").collect()), key=str)

    assert rest([2, 2, 2]) == [1]
    assert rest([2, None]) == []
    assert rest([]) == [1, 2, None]


def test_profile_and_cap(spark, bronze, star):
    rows = {r.column_name: (r.n_rows, r.n_nulls) for r in null_profile(bronze["main"], ["proteina_g", "item_id"]).collect()}
    assert rows == {"proteina_g": (13, 2), "item_id": (13, 0)}
    counts = {r.table_name: r.n_rows for r in row_counts({"item": star.item, "measure": star.measure}).collect()}
    assert counts == {"item": 13, "measure": 67}
    capped = result_cap(star.measure, [F.col("measure_id").desc()], 50).collect()
    assert len(capped) == 50
    assert {r.total_rows for r in capped} == {67}
    assert capped[0].measure_id == 67


@pytest.mark.parametrize(
    ("question", "terms"),
    [
        ("Quanto de PROTEÍNA tem o arroz?", {"proteina"}),
        ("gordura trans ou gordura saturada", {"gordura trans", "gordura saturada"}),
        ("só gordura", {"gordura"}),
        ("isoleucina", {"isoleucina"}),
        ("fonte de Ômega-3", {"omega-3"}),
        ("nada", set()),
    ],
)
def test_terms(spark, question, terms):
    df = spark.createDataFrame([(1, question)], "id int, question string")
    assert sorted(r.term for r in resolve_terms(df, food.measure_synonyms()).collect()) == sorted(terms)


def test_composite_of_a_term(spark, star):
    df = spark.createDataFrame([(1, 12, "omega-3?"), (2, 10, "omega-3?"), (3, 1, "omega-3?")], "q int, item_id long, question string")
    got = {r.q: r.total for r in resolve_totals(df, food.measure_synonyms(), star, ["q"], 4).collect()}
    assert got == {1: 19.81, 2: 0.04, 3: None}
    groups = resolve_terms(df.withColumn("question", F.lit("proteínas vegetais")), food.group_synonyms())
    assert groups.first().targets == food.VEGETABLE_PROTEIN


def test_spellings_of_a_term_mean_the_same(spark):
    from larder.operators.terms import synonym_table

    assert synonym_table(spark, [("Preço", ["a", "b"], False), ("preco", ["b", "a"], False)]).count() == 1
    with pytest.raises(ValueError, match="preco"):
        synonym_table(spark, [("preço", ["a"], False), ("preco", ["b"], False)])


def test_group_without_name_drops_its_items(spark, star):
    from larder.operators.star import group_dim, item_dim

    longs = spark.createDataFrame([(1, "a", "g"), (2, "b", None)], "item_id long, item_name string, item_group string")
    groups = group_dim(longs, "table")
    assert [r.item_id for r in item_dim(longs, groups, "table").collect()] == [1]
    assert isinstance(star, Star)


def test_rows_of_several_files_have_numbers_of_their_own(spark, tmp_path):
    for name, rows in (("b.csv", ["3,c", "4,d"]), ("a.csv", ["1,a", "2,b"])):
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    rows = read_grid(spark, str(tmp_path), 2).orderBy("row_idx").collect()
    assert [r.c0 for r in rows] == ["1", "2", "3", "4"] and len({r.row_idx for r in rows}) == 4


def test_unnamed_group_and_states(spark):
    from larder.functions.numbers import value_state
    from larder.operators.star import group_dim

    longs = spark.createDataFrame([("b",), (None,), ("a",)], "item_group string")
    assert {r.group_name: r.group_id for r in group_dim(longs, "t").collect()} == {"a": 1, "b": 2, None: 3}
    cells = spark.createDataFrame([(-3.0,), (0.0,), (float("nan"),), (None,)], "v double")
    assert [r.s for r in cells.select(value_state("v").alias("s")).collect()] == ["present", "zero", "missing", "missing"]
