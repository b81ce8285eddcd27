"""The food-composition lakehouse: three sheets to a star schema, and the questions asked of it."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.clean import sheet_to_table
from larder.operators.compose import composite, cross_measures, total_by_group
from larder.operators.coverage import count_without
from larder.operators.quality import not_null, relationships, unique
from larder.operators.rank import compare_groups, lookup, rank_by, rank_items, top_per_group
from larder.operators.reshape import to_long
from larder.operators.similar import similar_to
from larder.operators.star import Star, build_fact, group_dim, item_dim, measure_dim, register_views
from larder.sources.snapshots import commit, read_snapshot, snapshots

# The measure catalog (id, name, unit, category).
MEASURES = [
    (1, "umidade_pct", "pct", "composicao_centesimal"),
    (2, "energia_kcal", "kcal", "energia"),
    (3, "energia_kj", "kj", "energia"),
    (4, "proteina_g", "g", "macro"),
    (5, "lipideos_g", "g", "macro"),
    (6, "colesterol_mg", "mg", "macro"),
    (7, "carboidrato_g", "g", "macro"),
    (8, "fibra_alimentar_g", "g", "macro"),
    (9, "cinzas_g", "g", "composicao_centesimal"),
    (10, "calcio_mg", "mg", "micro"),
    (11, "magnesio_mg", "mg", "micro"),
    (12, "manganes_mg", "mg", "micro"),
    (13, "fosforo_mg", "mg", "micro"),
    (14, "ferro_mg", "mg", "micro"),
    (15, "sodio_mg", "mg", "micro"),
    (16, "potassio_mg", "mg", "micro"),
    (17, "cobre_mg", "mg", "micro"),
    (18, "zinco_mg", "mg", "micro"),
    (19, "retinol_mcg", "mcg", "micro"),
    (20, "re_mcg", "mcg", "micro"),
    (21, "rae_mcg", "mcg", "micro"),
    (22, "tiamina_mg", "mg", "micro"),
    (23, "riboflavina_mg", "mg", "micro"),
    (24, "piridoxina_mg", "mg", "micro"),
    (25, "niacina_mg", "mg", "micro"),
    (26, "vitamina_c_mg", "mg", "micro"),
    (27, "vitamina_d_mcg", "mcg", "micro"),
    (28, "ag_saturados_g", "g", "AGS"),
    (29, "ag_12_0_g", "g", "AGS"),
    (30, "ag_14_0_g", "g", "AGS"),
    (31, "ag_16_0_g", "g", "AGS"),
    (32, "ag_18_0_g", "g", "AGS"),
    (33, "ag_20_0_g", "g", "AGS"),
    (34, "ag_22_0_g", "g", "AGS"),
    (35, "ag_24_0_g", "g", "AGS"),
    (36, "ag_monoinsaturados_g", "g", "AGI"),
    (37, "ag_poliinsaturados_g", "g", "AGI"),
    (38, "ag_14_1_g", "g", "AGI"),
    (39, "ag_16_1_g", "g", "AGI"),
    (40, "ag_18_1_g", "g", "AGI"),
    (41, "ag_20_1_g", "g", "AGI"),
    (42, "ag_18_2_n6_g", "g", "AGI"),
    (43, "ag_18_3_n3_g", "g", "AGI"),
    (44, "ag_20_4_g", "g", "AGI"),
    (45, "ag_20_5_g", "g", "AGI"),
    (46, "ag_22_5_g", "g", "AGI"),
    (47, "ag_22_6_g", "g", "AGI"),
    (48, "ag_18_1t_g", "g", "TRANS"),
    (49, "ag_18_2t_g", "g", "TRANS"),
    (50, "aa_triptofano_g", "g", "AA"),
    (51, "aa_treonina_g", "g", "AA"),
    (52, "aa_isoleucina_g", "g", "AA"),
    (53, "aa_leucina_g", "g", "AA"),
    (54, "aa_lisina_g", "g", "AA"),
    (55, "aa_metionina_g", "g", "AA"),
    (56, "aa_cistina_g", "g", "AA"),
    (57, "aa_fenilalanina_g", "g", "AA"),
    (58, "aa_tirosina_g", "g", "AA"),
    (59, "aa_valina_g", "g", "AA"),
    (60, "aa_arginina_g", "g", "AA"),
    (61, "aa_histidina_g", "g", "AA"),
    (62, "aa_alanina_g", "g", "AA"),
    (63, "aa_acido_aspartico_g", "g", "AA"),
    (64, "aa_acido_glutamico_g", "g", "AA"),
    (65, "aa_glicina_g", "g", "AA"),
    (66, "aa_prolina_g", "g", "AA"),
    (67, "aa_serina_g", "g", "AA"),
]

# The columns of the three sheets in order. The first two are key and name; None is a
# repeated header column.
SHEETS = {
    "main": [
        "item_id", "item_name", "umidade_pct", "energia_kcal", "energia_kj", "proteina_g", "lipideos_g",
        "colesterol_mg", "carboidrato_g", "fibra_alimentar_g", "cinzas_g", "calcio_mg", "magnesio_mg",
        None, "manganes_mg", "fosforo_mg", "ferro_mg", "sodio_mg", "potassio_mg", "cobre_mg", "zinco_mg",
        "retinol_mcg", "re_mcg", "rae_mcg", "tiamina_mg", "riboflavina_mg", "piridoxina_mg", "niacina_mg",
        "vitamina_c_mg",
    ],
    "fatty_acids": [
        "item_id", "item_name", "ag_saturados_g", "ag_monoinsaturados_g", "ag_poliinsaturados_g",
        "ag_12_0_g", "ag_14_0_g", "ag_16_0_g", "ag_18_0_g", "ag_20_0_g", "ag_22_0_g", "ag_24_0_g",
        None, "ag_14_1_g", "ag_16_1_g", "ag_18_1_g", "ag_20_1_g", "ag_18_2_n6_g", "ag_18_3_n3_g",
        "ag_20_4_g", "ag_20_5_g", "ag_22_5_g", "ag_22_6_g", "ag_18_1t_g", "ag_18_2t_g",
    ],
    "amino_acids": [
        "item_id", "item_name", "aa_triptofano_g", "aa_treonina_g", "aa_isoleucina_g", "aa_leucina_g",
        "aa_lisina_g", "aa_metionina_g", "aa_cistina_g", "aa_fenilalanina_g", "aa_tirosina_g",
        None, "aa_valina_g", "aa_arginina_g", "aa_histidina_g", "aa_alanina_g", "aa_acido_aspartico_g",
        "aa_acido_glutamico_g", "aa_glicina_g", "aa_prolina_g", "aa_serina_g",
    ],
}

# What users say and the measures meant (terms, measures, is a stand-in).
MEASURE_WORDS = [
    (["proteína", "proteina"], ["proteina_g"], False),
    (["gordura", "lipídeo", "lipideo", "gordura total"], ["lipideos_g"], False),
    (["carboidrato", "carbo", "CHO"], ["carboidrato_g"], False),
    (["fibra", "fibra alimentar"], ["fibra_alimentar_g"], False),
    (["calorias", "energia", "kcal"], ["energia_kcal"], False),
    (["vitamina C", "ácido ascórbico"], ["vitamina_c_mg"], False),
    (["cálcio", "calcio"], ["calcio_mg"], False),
    (["ferro"], ["ferro_mg"], False),
    (["sódio", "sodio"], ["sodio_mg"], False),
    (["potássio", "potassio"], ["potassio_mg"], False),
    (["zinco"], ["zinco_mg"], False),
    (["colesterol"], ["colesterol_mg"], False),
    (["ômega-3", "omega-3"], ["ag_18_3_n3_g", "ag_20_5_g", "ag_22_6_g"], False),
    (["gordura saturada", "ácidos graxos saturados"], ["ag_saturados_g"], False),
    (["gordura trans"], ["ag_18_1t_g", "ag_18_2t_g"], False),
    (["vitamina B1", "tiamina"], ["tiamina_mg"], False),
    (["vitamina B2", "riboflavina"], ["riboflavina_mg"], False),
    (["vitamina B6", "piridoxina"], ["piridoxina_mg"], False),
    (["niacina", "vitamina B3"], ["niacina_mg"], False),
    (["retinol", "vitamina A"], ["retinol_mcg"], False),
    (["vitamina D"], ["vitamina_d_mcg"], False),
    (["leucina"], ["aa_leucina_g"], False),
    (["isoleucina"], ["aa_isoleucina_g"], False),
    (["lisina"], ["aa_lisina_g"], False),
    (["metionina"], ["aa_metionina_g"], False),
    (["triptofano"], ["aa_triptofano_g"], False),
    (["valina"], ["aa_valina_g"], False),
    (["ômega-6", "omega-6", "poli-insaturados"], ["ag_poliinsaturados_g"], True),
]

# What users say and the groups meant.
GROUP_WORDS = [
    (["carnes", "carne vermelha", "boi", "vaca"], ["Carnes e derivados"]),
    (["frango", "aves", "galinha"], ["Carnes e derivados"]),
    (["peixe", "peixes", "frutos do mar", "pescados"], ["Pescados e frutos do mar"]),
    (["leite", "laticínios", "lácteos", "queijo", "iogurte"], ["Leite e derivados"]),
    (["frutas"], ["Frutas e derivados"]),
    (["verduras", "legumes", "vegetais", "hortaliças"], ["Verduras, hortaliças e derivados"]),
    (["cereais", "grãos", "arroz", "trigo", "aveia"], ["Cereais e derivados"]),
    (["leguminosas", "feijão", "lentilha", "grão-de-bico"], ["Leguminosas e derivados"]),
    (
        ["oleaginosas", "castanhas", "nozes", "amendoim", "semente", "sementes", "gergelim", "linhaça",
         "chia", "girassol"],
        ["Nozes e sementes"],
    ),
    (
        ["proteínas vegetais", "fontes vegetais de proteína"],
        ["Leguminosas e derivados", "Nozes e sementes", "Cereais e derivados"],
    ),
    (["ovos"], ["Ovos e derivados"]),
    (["óleos", "azeite", "manteiga"], ["Gorduras e óleos"]),
    (["bebidas", "sucos", "refrigerantes"], ["Bebidas (alcoólicas e não alcoólicas)"]),
]

OMEGA_3 = ["ag_18_3_n3_g", "ag_20_5_g", "ag_22_6_g"]
TRANS_FAT = ["ag_18_1t_g", "ag_18_2t_g"]
MACROS = ["proteina_g", "lipideos_g", "carboidrato_g"]
VEGETABLE_PROTEIN = ["Leguminosas e derivados", "Nozes e sementes", "Cereais e derivados"]
ESSENTIAL_AMINO_ACIDS = [
    "aa_isoleucina_g", "aa_leucina_g", "aa_lisina_g", "aa_metionina_g", "aa_fenilalanina_g",
    "aa_treonina_g", "aa_triptofano_g", "aa_valina_g", "aa_histidina_g",
]

# Names under which plain SQL finds the four tables.
VIEWS = {
    "group": (
        "dim_food_group",
        {
            "group_id": "food_group_id",
            "group_name": "food_group_name",
            "group_name_normalized": "food_group_name_normalized",
        },
    ),
    "item": (
        "dim_food",
        {
            "item_id": "food_id",
            "item_name": "food_name",
            "item_name_normalized": "food_name_normalized",
            "group_id": "food_group_id",
        },
    ),
    "measure": ("dim_nutrient", {"measure_id": "nutrient_id", "measure_name": "nutrient_name"}),
    "fact": ("fact_nutrient_values", {"item_id": "food_id", "measure_id": "nutrient_id"}),
}


def measure_synonyms() -> list[tuple[str, list[str], bool]]:
    return [(term, targets, proxy) for terms, targets, proxy in MEASURE_WORDS for term in terms]


def group_synonyms() -> list[tuple[str, list[str], bool]]:
    return [(term, targets, False) for terms, targets in GROUP_WORDS for term in terms]


def sheet_columns(sheet: str) -> dict[int, str]:
    return {i: c for i, c in enumerate(SHEETS[sheet]) if c is not None}


def sheet_measures(sheet: str) -> list[str]:
    return [c for c in SHEETS[sheet][2:] if c is not None]


def bronze(grids: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Clean wide table per sheet."""
    return {s: sheet_to_table(g, sheet_columns(s), "item_id", "item_name") for s, g in grids.items()}


def silver(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Long table per sheet, NULLs kept."""
    ids = ["item_id", "item_name", "item_group"]
    return {s: to_long(t, ids, sheet_measures(s)) for s, t in tables.items()}


def gold(spark: SparkSession, longs: Mapping[str, DataFrame], source: str) -> Star:
    """Star schema. Items and groups come from the main sheet, facts from all three."""
    groups = group_dim(longs["main"], source)
    measures = measure_dim(spark, MEASURES)
    items = item_dim(longs["main"], groups, source)
    return Star(groups, items, measures, build_fact(list(longs.values()), measures))


GOLD = ("group", "item", "measure", "fact")


def write_gold(star: Star, folder: str) -> Star:
    """The four tables as one snapshot, the fact partitioned by measure since every question names one."""
    tables = dict(zip(GOLD, (star.group, star.item, star.measure, star.fact), strict=True))
    found = commit(tables, folder, {"fact": ["measure_id"]})
    return read_gold(star.fact.sparkSession, folder, found.version)


def read_gold(spark: SparkSession, folder: str, version: int | None = None) -> Star:
    """The star of one snapshot: its tables always belong together."""
    version = version or snapshots(spark, folder)[0].version
    return Star(*[read_snapshot(spark, folder, t, version) for t in GOLD])


def gold_checks(star: Star) -> DataFrame:
    """All tests declared on the star."""
    checks = [
        not_null(star.group, "group", ["group_id", "group_name", "group_name_normalized", "source"]),
        unique(star.group, "group", ["group_id"]),
        not_null(star.item, "item", ["item_id", "item_name", "item_name_normalized", "group_id", "source"]),
        unique(star.item, "item", ["item_id"]),
        relationships(star.item, "item", "group_id", star.group, "group_id"),
        not_null(star.measure, "measure", ["measure_id", "measure_name", "unit", "category"]),
        unique(star.measure, "measure", ["measure_id"]),
        unique(star.measure, "measure", ["measure_name"]),
        not_null(star.fact, "fact", ["item_id", "measure_id"]),
        unique(star.fact, "fact", ["item_id", "measure_id"]),
        relationships(star.fact, "fact", "item_id", star.item, "item_id"),
        relationships(star.fact, "fact", "measure_id", star.measure, "measure_id"),
    ]
    return reduce(DataFrame.unionByName, checks)


def questions(star: Star) -> dict[str, DataFrame]:
    """The standing questions, each as a plan over the star."""
    with_protein_and_carbs = cross_measures(star, ["proteina_g", "carboidrato_g"], VEGETABLE_PROTEIN)
    with_energy_and_fat = cross_measures(star, ["energia_kcal", "lipideos_g"])
    return {
        "Q001": lookup(star, "ferro_mg", "%fígado%", any_case=True, by_value=True),
        "Q002": rank_items(star, "vitamina_c_mg", groups=["Frutas e derivados"]),
        "Q003": total_by_group(star, "calcio_mg"),
        "Q003_alt0": total_by_group(star, "calcio_mg", 1),
        "Q004": compare_groups(star, "calcio_mg", ["Nozes e sementes", "Leite e derivados"]),
        "Q005": top_per_group(star, "energia_kcal"),
        "Q006": rank_items(star, "tiamina_mg", inverse=True),
        "Q007": composite(star, OMEGA_3, by_name=True),
        "Q008": rank_items(star, "zinco_mg"),
        "Q009": rank_items(star, "niacina_mg", inverse=True),
        "Q010": count_without(star, "vitamina_d_mcg"),
        "Q011": rank_items(star, "vitamina_d_mcg").filter(F.col("value") > 0),
        "Q012": composite(star, TRANS_FAT, measured_only=True, by_name=True),
        "Q013": rank_items(star, "ag_poliinsaturados_g"),
        "Q014": rank_items(star, "lipideos_g", groups=["Carnes e derivados"]),
        "Q015": composite(star, ESSENTIAL_AMINO_ACIDS, groups=VEGETABLE_PROTEIN, measured_only=True, by_name=True),
        "Q016": rank_items(star, "proteina_g", inverse=True, groups=VEGETABLE_PROTEIN),
        "Q017": rank_by(
            with_protein_and_carbs,
            [("proteina_g", True), ("carboidrato_g", False), ("item_name", False), ("item_id", False)],
            10,
        ),
        "Q018": rank_items(star, "aa_leucina_g"),
        "Q019": rank_items(star, "aa_leucina_g", groups=VEGETABLE_PROTEIN),
        "Q020": rank_by(
            with_energy_and_fat,
            [("energia_kcal", True), ("lipideos_g", True), ("item_name", False), ("item_id", False)],
            10,
        ),
        "Q021": rank_items(star, "energia_kcal", inverse=True),
        "similar_to_rice": similar_to(star, "%arroz%tipo 1%cozido%", MACROS, 1.0, 10),
    }


def register(star: Star) -> None:
    """Make the four tables known to spark.sql."""
    register_views(star, VIEWS)
