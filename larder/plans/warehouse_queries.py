"""Cleaning, reshaping, star, ranking, totals, similarity, coverage and quality on the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.numbers import to_number, value_state
from larder.functions.text import fingerprint, normalize_question, strip_accents_lower
from larder.operators.clean import carry_forward_group, clean_sentinels, filter_data_rows, groups_in_order, sheet_to_table
from larder.operators.compose import composite, composite_strict, cross_measures, mean_by_group, total_by_group
from larder.operators.coverage import (
    count_without,
    coverage_guard,
    coverage_profile,
    guard,
    items_without,
    unused_measures,
)
from larder.operators.quality import not_null, null_profile, relationships, row_counts, sample_head, unique
from larder.operators.rank import (
    compare_groups,
    lookup,
    rank_by,
    rank_items,
    result_cap,
    top_k,
    top_per_group,
)
from larder.operators.reshape import pivot_measures, to_long
from larder.operators.similar import similar_to, similar_to_anchors
from larder.operators.star import Star, build_fact, group_dim, measure_dim, register_views, star_rows
from larder.plans.registry import register
from larder.plans.testdata import (
    DOC_MEASURES,
    DOCS_SQL,
    PART_MEASURES,
    PARTS_SQL,
    SCALE,
    SOURCE,
    build_parts,
    doc_longs,
    docs,
    part_longs,
    part_sheet,
    parts,
)
from larder.sources.tables import read_table

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

# ---------------------------------------------------------------- cleaning

_MARKED_CELL_SQL = """
CASE o_orderpriority WHEN '1-URGENT' THEN 'Tr' WHEN '5-LOW' THEN 'NA'
     WHEN '2-HIGH' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' mg'
     WHEN '4-NOT SPECIFIED' THEN 'Tr ' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END
"""
_NUMBER_SQL = (
    "CASE WHEN regexp_full_match({0}, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*') "
    "THEN TRY_CAST(trim({0}) AS DOUBLE) END"
)


def _marked_orders(spark: SparkSession, sf: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    cell = (
        F.when(priority == "1-URGENT", "Tr")
        .when(priority == "5-LOW", "NA")
        .when(priority == "2-HIGH", F.concat(price, F.lit(" mg")))
        .when(priority == "4-NOT SPECIFIED", "Tr ")
        .otherwise(price)
    )
    return read_table(spark, sf, "orders").select("o_orderkey", cell.alias("cell"))


@register(
    "clean_sentinels",
    f"""WITH cells AS (SELECT o_orderkey, {_MARKED_CELL_SQL} AS cell FROM orders)
    SELECT o_orderkey, cell, CASE WHEN cell = 'Tr' THEN 0.0::DOUBLE WHEN cell = 'NA' THEN NULL
           ELSE {_NUMBER_SQL.format("cell")} END AS value FROM cells""",
)
def q_clean_sentinels(spark, sf):
    rows = _marked_orders(spark, sf).withColumn("value", F.col("cell"))
    return clean_sentinels(rows, ["value"])


@register(
    "to_number",
    f"""WITH cells AS (SELECT o_orderkey, CASE o_orderpriority
        WHEN '1-URGENT' THEN ' ' || o_orderkey || '.5 ' WHEN '2-HIGH' THEN '-' || o_orderkey || 'e1'
        WHEN '3-MEDIUM' THEN o_orderkey || 'd' WHEN '5-LOW' THEN 'NaN' ELSE '.' || o_orderkey END AS cell
        FROM orders)
    SELECT o_orderkey, cell, {_NUMBER_SQL.format("cell")} AS value FROM cells""",
)
def q_to_number(spark, sf):
    priority, key = F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    cell = (
        F.when(priority == "1-URGENT", F.concat(F.lit(" "), key, F.lit(".5 ")))
        .when(priority == "2-HIGH", F.concat(F.lit("-"), key, F.lit("e1")))
        .when(priority == "3-MEDIUM", F.concat(key, F.lit("d")))
        .when(priority == "5-LOW", "NaN")
        .otherwise(F.concat(F.lit("."), key))
    )
    cells = read_table(spark, sf, "orders").select("o_orderkey", cell.alias("cell"))
    return cells.withColumn("value", to_number("cell"))


# A sheet made of orders and their lines. A finished order heads a section, any other order is a
# header row; lines are data rows whose cells carry marks.
_GRID_SQL = """
grid AS (
  SELECT o_orderkey * 16 AS row_idx,
         CASE WHEN o_orderstatus = 'F' THEN 'Section ' || o_orderkey ELSE 'Alimento' END AS c0,
         CAST(NULL AS VARCHAR) AS c1, CAST(NULL AS VARCHAR) AS c2
  FROM orders
  UNION ALL
  SELECT l_orderkey * 16 + l_linenumber, CAST(l_partkey AS VARCHAR), l_returnflag,
         CASE WHEN l_discount = 0 THEN 'Tr' WHEN l_tax = 0 THEN 'NA'
              ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END
  FROM lineitem),
marked AS (SELECT *, CASE WHEN c1 IS NULL AND c0 <> 'Alimento' AND TRY_CAST(c0 AS DOUBLE) IS NULL
                          THEN c0 END AS label FROM grid),
filled AS (SELECT *, last_value(label IGNORE NULLS) OVER
             (ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS item_group FROM marked)
"""
_CELL_VALUE_SQL = "CASE WHEN c2 = 'Tr' THEN 0.0::DOUBLE ELSE TRY_CAST(c2 AS DOUBLE) END"


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    section = F.when(
        F.col("o_orderstatus") == "F", F.concat(F.lit("Section "), F.col("o_orderkey").cast("string"))
    ).otherwise("Alimento")
    heads = read_table(spark, sf, "orders").select(
        (F.col("o_orderkey") * 16).alias("row_idx"), section.alias("c0"), nothing.alias("c1"), nothing.alias("c2")
    )
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    cell = F.when(F.col("l_discount") == 0, "Tr").when(F.col("l_tax") == 0, "NA").otherwise(price)
    lines = read_table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("row_idx"),
        F.col("l_partkey").cast("string").alias("c0"),
        F.col("l_returnflag").alias("c1"),
        cell.alias("c2"),
    )
    return heads.unionAll(lines)


@register(
    "carry_forward",
    f"WITH {_GRID_SQL} SELECT row_idx, c0, c1, c2, item_group FROM filled WHERE c1 IS NOT NULL",
)
def q_carry_forward(spark, sf):
    grouped = carry_forward_group(_grid(spark, sf))
    return filter_data_rows(grouped, "c0").select("row_idx", "c0", "c1", "c2", "item_group")


@register(
    "sheet_to_table",
    f"""WITH {_GRID_SQL},
    rows AS (SELECT CAST(c0 AS BIGINT) AS item_id, c1 AS item_name, row_idx, item_group,
                    {_CELL_VALUE_SQL} AS price FROM filled WHERE c1 IS NOT NULL),
    lookup AS (SELECT item_id, arg_max(item_group, row_idx) AS item_group FROM rows GROUP BY item_id)
    SELECT item_id, item_name, lookup.item_group, price FROM rows JOIN lookup USING (item_id)""",
)
def q_sheet_to_table(spark, sf):
    return sheet_to_table(_grid(spark, sf), {0: "item_id", 1: "item_name", 2: "price"}, "item_id", "item_name")


@register(
    "groups_in_order",
    f"""WITH {_GRID_SQL} SELECT item_group, MIN(row_idx) AS first_seen FROM filled
    WHERE c1 IS NOT NULL GROUP BY item_group""",
)
def q_groups_in_order(spark, sf):
    rows = filter_data_rows(carry_forward_group(_grid(spark, sf)), "c0")
    return groups_in_order(rows, "item_group")


@register(
    "profile_nulls",
    """WITH e AS (SELECT event_id, nullif(value, 0) AS value, nullif(event_type, 'error') AS event_type FROM events)
    SELECT COUNT(*) AS n_rows, 'event_id' AS column_name, COUNT(*) - COUNT(event_id) AS n_nulls FROM e
    UNION ALL SELECT COUNT(*), 'value', COUNT(*) - COUNT(value) FROM e
    UNION ALL SELECT COUNT(*), 'event_type', COUNT(*) - COUNT(event_type) FROM e""",
)
def q_profile_nulls(spark, sf):
    events = read_table(spark, sf, "events").select(
        "event_id",
        F.nullif("value", F.lit(0.0)).alias("value"),
        F.nullif("event_type", F.lit("error")).alias("event_type"),
    )
    return null_profile(events, ["event_id", "value", "event_type"])


@register("sample_head", "SELECT * FROM events ORDER BY event_id LIMIT 5")
def q_sample_head(spark, sf):
    return sample_head(read_table(spark, sf, "events"), "event_id")


@register(
    "value_state",
    """WITH s AS (SELECT l_orderkey, nullif(l_discount, 0) AS discount, l_tax FROM lineitem)
    SELECT CASE WHEN discount IS NULL THEN 'missing' WHEN discount = 0 THEN 'zero' ELSE 'present' END AS discount_state,
           CASE WHEN l_tax IS NULL THEN 'missing' WHEN l_tax = 0 THEN 'zero' ELSE 'present' END AS tax_state,
           COUNT(*) AS n FROM s GROUP BY 1, 2""",
)
def q_value_state(spark, sf):
    states = read_table(spark, sf, "lineitem").select(
        value_state(F.nullif("l_discount", F.lit(0.0))).alias("discount_state"),
        value_state("l_tax").alias("tax_state"),
    )
    return states.groupBy("discount_state", "tax_state").agg(F.count("*").alias("n"))


@register(
    "strip_accents_norm", "SELECT doc_id, strip_accents(lower(text)) AS text_normalized FROM documents"
)
def q_strip_accents(spark, sf):
    return read_table(spark, sf, "documents").select(
        "doc_id", strip_accents_lower("text").alias("text_normalized")
    )


QUESTION_KEY_SQL = (
    r"trim(regexp_replace(rtrim(regexp_replace(strip_accents(lower({0})), '^\s+|\s+$', '', 'g'), '?!. '), "
    r"'\s+', ' ', 'g'))"
)


@register(
    "normalize_question",
    f"SELECT conv_id, turn, {QUESTION_KEY_SQL.format('text')} AS question_key FROM conversations",
)
def q_normalize_question(spark, sf):
    return read_table(spark, sf, "conversations").select(
        "conv_id", "turn", normalize_question("text").alias("question_key")
    )


@register(
    "fingerprint",
    """SELECT 'benchmark' AS tab, item_id AS id, substr(sha256(text), 1, 16) AS print FROM benchmark
    UNION ALL SELECT 'documents', doc_id, substr(sha256(text), 1, 16) FROM documents""",
)
def q_fingerprint(spark, sf):
    def prints(table, key):
        rows = read_table(spark, sf, table)
        return rows.select(F.lit(table).alias("tab"), F.col(key).alias("id"), fingerprint("text").alias("print"))

    return prints("benchmark", "item_id").unionAll(prints("documents", "doc_id"))


# ---------------------------------------------------------------- reshape

_LINES_WIDE_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_discount, 0) AS discount, l_tax AS tax,
       l_quantity AS quantity FROM lineitem
"""
_LINES_LONG_SQL = " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, l_partkey, '{m}' AS measure_name, {m} AS value FROM w"
    for m in ("discount", "tax", "quantity")
)


def _lines_wide(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_quantity").alias("quantity"),
    )


_LINE_IDS = ["l_orderkey", "l_linenumber", "l_partkey"]


@register("to_long_keep_nulls", f"WITH w AS ({_LINES_WIDE_SQL}) {_LINES_LONG_SQL}")
def q_to_long_keep_nulls(spark, sf):
    return to_long(_lines_wide(spark, sf), _LINE_IDS, ["discount", "tax", "quantity"])


@register(
    "to_long", f"WITH w AS ({_LINES_WIDE_SQL}) SELECT * FROM ({_LINES_LONG_SQL}) WHERE value IS NOT NULL"
)
def q_to_long(spark, sf):
    return to_long(_lines_wide(spark, sf), _LINE_IDS, ["discount", "tax", "quantity"], keep_nulls=False)


@register(
    "pivot_measures",
    f"""WITH {PARTS_SQL} SELECT item_id,
    MAX(CASE WHEN measure_name = 'p_size' THEN value END) AS p_size,
    MAX(CASE WHEN measure_name = 'qty_total' THEN value END) AS qty_total,
    MAX(CASE WHEN measure_name = 'bulk_return_price' THEN value END) AS bulk_return_price
    FROM fact GROUP BY item_id""",
)
def q_pivot_measures(spark, sf):
    wanted = ["p_size", "qty_total", "bulk_return_price"]
    return pivot_measures(star_rows(parts(spark, sf), wanted), ["item_id"], wanted)


# ---------------------------------------------------------------- star


@register(
    "dim_group_key_null",
    """WITH g AS (SELECT DISTINCT nullif(p_type, 'PROMO') AS group_name FROM part)
    SELECT row_number() OVER (ORDER BY group_name NULLS LAST) AS group_id, group_name FROM g""",
)
def q_dim_group_key_null(spark, sf):
    """A group without a name gets the last key."""
    sheet = part_sheet(spark, sf).withColumn("item_group", F.nullif("item_group", F.lit("PROMO")))
    return group_dim(sheet, SOURCE).select("group_id", "group_name")


@register("dim_group_key", f"WITH {PARTS_SQL} SELECT group_id, group_name FROM grp")
def q_dim_group_key(spark, sf):
    return build_parts(spark, sf).group.select("group_id", "group_name")


@register(
    "dim_item",
    f"""WITH {PARTS_SQL} SELECT item_id, item_name, item_name_normalized, group_id, 'warehouse' AS source
    FROM item""",
)
def q_dim_item(spark, sf):
    return build_parts(spark, sf).item


@register(
    "dim_measure", f"""WITH {PARTS_SQL} SELECT m.measure_id, m.measure_name, m.unit, m.category,
    COUNT(f.item_id) AS n_facts FROM measure m LEFT JOIN fact f USING (measure_name) GROUP BY ALL"""
)
def q_dim_measure(spark, sf):
    star = parts(spark, sf)
    counts = star.fact.groupBy("measure_id").agg(F.count("item_id").alias("n_facts"))
    return star.measure.join(counts, "measure_id", "left").fillna(0, ["n_facts"])


@register(
    "fact_union",
    f"""WITH {PARTS_SQL} SELECT item_id, measure_id, value, value IS NULL AS is_missing
    FROM fact JOIN measure USING (measure_name)""",
)
def q_fact_union(spark, sf):
    return build_fact(part_longs(spark, sf), measure_dim(spark, PART_MEASURES))


@register(
    "fact_union_docs",
    f"""WITH {DOCS_SQL} SELECT item_id, measure_id, value, value IS NULL AS is_missing
    FROM fact JOIN measure USING (measure_name)""",
)
def q_fact_union_docs(spark, sf):
    return build_fact(doc_longs(spark, sf), measure_dim(spark, DOC_MEASURES))


@register(
    "star_join",
    f"WITH {PARTS_SQL} SELECT item_id, item_name, group_name, measure_name, value, unit FROM star",
)
def q_star_join(spark, sf):
    star = parts(spark, sf)
    measures = ["p_size", "p_retailprice", "qty_total", "discount_min", "tax_max", "bulk_return_price"]
    rows = star_rows(star, measures, with_group=True)
    return rows.select("item_id", "item_name", "group_name", "measure_name", "value", "unit")


_BEST_SQL = """WITH ranked AS (
      SELECT i.item_name, i.item_id, g.group_name, f.value, m.unit,
             RANK() OVER (PARTITION BY g.group_name ORDER BY f.value DESC) AS place
      FROM {0}fact f JOIN {0}item i ON f.item_id = i.item_id
      JOIN {0}grp g ON i.group_id = g.group_id JOIN {0}measure m ON f.{1} = m.{1}
      WHERE m.measure_name = 'qty_total' AND f.value IS NOT NULL)
    SELECT item_name, item_id, group_name, value, unit FROM ranked WHERE place = 1"""


@register(
    "sql_over_views",
    f"WITH {PARTS_SQL}" + _BEST_SQL.format("", "measure_name").replace("WITH ranked", ", ranked"),
)
def q_sql_over_views(spark, sf):
    """The star as views, questioned in plain SQL."""
    names = {"fact": "star_fact", "item": "star_item", "group": "star_grp", "measure": "star_measure"}
    register_views(parts(spark, sf), {table: (view, {}) for table, view in names.items()})
    return spark.sql(_BEST_SQL.format("star_", "measure_id"))


# ---------------------------------------------------------------- lookup and ranking


@register(
    "lookup_like",
    f"""WITH {PARTS_SQL} SELECT item_id, item_name, value, unit FROM star
    WHERE measure_name = 'p_retailprice' AND item_name_normalized LIKE '%re%ring%'""",
)
def q_lookup_like(spark, sf):
    return lookup(parts(spark, sf), "p_retailprice", "%re%ring%")


@register(
    "lookup_ilike",
    f"""WITH {PARTS_SQL} SELECT item_id, item_name, value, unit FROM star
    WHERE measure_name = 'p_size' AND item_name ILIKE '%WIDGET%'""",
)
def q_lookup_ilike(spark, sf):
    return lookup(parts(spark, sf), "p_size", "%WIDGET%", any_case=True, by_value=True)


@register(
    "search_text",
    """SELECT doc_id, lang FROM documents WHERE strip_accents(lower(text)) LIKE '%license%version%'
    OR text ILIKE '%ção%' OR text ILIKE '%éa%'""",
)
def q_search_text(spark, sf):
    rows = read_table(spark, sf, "documents")
    hit = strip_accents_lower("text").like("%license%version%")
    hit = hit | F.col("text").ilike("%ção%") | F.col("text").ilike("%éa%")
    return rows.filter(hit).select("doc_id", "lang")


@register(
    "rank_direct",
    f"""WITH {PARTS_SQL} SELECT item_id, item_name, value, unit FROM star
    WHERE measure_name = 'qty_total' AND value IS NOT NULL ORDER BY value DESC, item_name, item_id LIMIT 10""",
)
def q_rank_direct(spark, sf):
    return rank_items(parts(spark, sf), "qty_total")


@register(
    "rank_inverse",
    f"""WITH {PARTS_SQL} SELECT item_id, item_name, value, unit FROM star
    WHERE measure_name = 'discount_min' AND value > 0 ORDER BY value, item_name, item_id LIMIT 10""",
)
def q_rank_inverse(spark, sf):
    return rank_items(parts(spark, sf), "discount_min", inverse=True)


@register(
    "rank_in_group",
    f"""WITH {PARTS_SQL} SELECT item_id, item_name, group_name, value, unit FROM star
    WHERE measure_name = 'bulk_return_price' AND value IS NOT NULL AND group_name = 'PROMO'
    ORDER BY value DESC, item_name, item_id LIMIT 10""",
)
def q_rank_in_group(spark, sf):
    return rank_items(parts(spark, sf), "bulk_return_price", groups=["PROMO"])


@register(
    "rank_in_groups",
    f"""WITH {PARTS_SQL} SELECT item_id, item_name, group_name, value, unit FROM star
    WHERE measure_name = 'p_size' AND value > 0
    AND (lower(group_name) LIKE '%mall%' OR lower(group_name) LIKE '%ar%')
    ORDER BY value, item_name, item_id LIMIT 10""",
)
def q_rank_in_groups(spark, sf):
    return rank_items(parts(spark, sf), "p_size", inverse=True, group_patterns=["%mall%", "%ar%"])


@register(
    "compare_groups",
    f"""WITH {PARTS_SQL} SELECT item_id, item_name, group_name, value, unit FROM star
    WHERE measure_name = 'bulk_return_price' AND value IS NOT NULL AND group_name IN ('SMALL', 'LARGE')""",
)
def q_compare_groups(spark, sf):
    return compare_groups(parts(spark, sf), "bulk_return_price", ["SMALL", "LARGE"])


@register(
    "rank_docs",
    f"""WITH {DOCS_SQL} SELECT item_id, item_name, value, unit FROM star
    WHERE measure_name = 'n_chars' AND value IS NOT NULL ORDER BY value DESC, item_name, item_id LIMIT 10""",
)
def q_rank_docs(spark, sf):
    return rank_items(docs(spark, sf), "n_chars")


_TOP = f"""WITH {PARTS_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY group_name ORDER BY value DESC) AS rnk,
    row_number() OVER (PARTITION BY group_name ORDER BY value DESC, item_name, item_id) AS rn
    FROM star WHERE measure_name = '{{0}}' AND value IS NOT NULL)
    SELECT item_id, item_name, group_name, value FROM r WHERE {{1}} = 1"""


@register("top_per_group_ties", _TOP.format("p_size", "rnk"))
def q_top_per_group_ties(spark, sf):
    return top_per_group(parts(spark, sf), "p_size")


@register("top_per_group_price", _TOP.format("p_retailprice", "rnk"))
def q_top_per_group_price(spark, sf):
    return top_per_group(parts(spark, sf), "p_retailprice")


@register("top_per_group_one", _TOP.format("p_size", "rn"))
def q_top_per_group_one(spark, sf):
    return top_per_group(parts(spark, sf), "p_size", ties=False)


@register(
    "top_k_rownum",
    f"""WITH {PARTS_SQL}, r AS (SELECT item_id, item_name, value, unit,
    row_number() OVER (ORDER BY value DESC, item_name, item_id) AS row_num FROM star
    WHERE measure_name = 'p_size' AND value IS NOT NULL) SELECT * FROM r WHERE row_num <= 5""",
)
def q_top_k(spark, sf):
    return top_k(parts(spark, sf), "p_size", 5)


_TWO = f"""WITH {PARTS_SQL}, a AS (SELECT item_id, value AS qty_total FROM fact WHERE measure_name = 'qty_total'),
    b AS (SELECT item_id, value AS bulk_return_price FROM fact WHERE measure_name = 'bulk_return_price')
    SELECT item_id, item_name, group_name, qty_total, bulk_return_price FROM a JOIN b USING (item_id)
    JOIN item USING (item_id) WHERE qty_total IS NOT NULL AND bulk_return_price IS NOT NULL"""


@register(
    "two_measure_rank", f"{_TWO} ORDER BY qty_total DESC, bulk_return_price, item_name, item_id LIMIT 10"
)
def q_two_measure_rank(spark, sf):
    rows = cross_measures(parts(spark, sf), ["qty_total", "bulk_return_price"], with_group=True)
    order = [("qty_total", True), ("bulk_return_price", False), ("item_name", False), ("item_id", False)]
    return rank_by(rows, order, 10)


@register(
    "two_measure_expression",
    f"{_TWO} AND group_name IN ('PROMO', 'ECONOMY') ORDER BY qty_total + bulk_return_price DESC, item_id LIMIT 10",
)
def q_two_measure_expression(spark, sf):
    rows = cross_measures(
        parts(spark, sf), ["qty_total", "bulk_return_price"], groups=["PROMO", "ECONOMY"], with_group=True
    )
    total = F.col("qty_total") + F.col("bulk_return_price")
    return rank_by(rows, [(total, True), ("item_id", False)], 10)


@register("two_measure_all", _TWO)
def q_two_measure_all(spark, sf):
    return cross_measures(parts(spark, sf), ["qty_total", "bulk_return_price"], with_group=True)


@register(
    "result_cap",
    """SELECT o_orderkey, o_totalprice, (SELECT COUNT(*) FROM orders) AS total_rows FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""",
)
def q_result_cap(spark, sf):
    rows = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return result_cap(rows, [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()])


# ---------------------------------------------------------------- totals and composites

_EXACT = "CAST(SUM(CAST({0} AS DECIMAL(18,4))) AS DOUBLE)"


@register(
    "total_by_group",
    f"""WITH {PARTS_SQL} SELECT group_name, {_EXACT.format("value")} AS total FROM star
    WHERE measure_name = 'bulk_return_price' GROUP BY group_name""",
)
def q_total_by_group(spark, sf):
    return total_by_group(parts(spark, sf), "bulk_return_price", scale=SCALE)


@register(
    "total_by_group_plain",
    f"""WITH {PARTS_SQL} SELECT group_name, SUM(value) AS total FROM star WHERE measure_name = 'qty_total' GROUP BY group_name""",
)
def q_total_by_group_plain(spark, sf):
    """Summed as doubles, without rounding: quantities are whole, so any order of adding gives the same."""
    return total_by_group(parts(spark, sf), "qty_total")


@register(
    "composite_sum_plain",
    f"""WITH {PARTS_SQL} SELECT item_id, item_name, SUM(value) AS total FROM star
    WHERE measure_name IN ('p_size', 'qty_total') GROUP BY item_id, item_name""",
)
def q_composite_sum_plain(spark, sf):
    return composite(parts(spark, sf), ["p_size", "qty_total"], None)


@register(
    "total_top1",
    f"""WITH {PARTS_SQL} SELECT group_name, {_EXACT.format("value")} AS total FROM star
    WHERE measure_name = 'qty_total' GROUP BY group_name ORDER BY total DESC, group_name LIMIT 1""",
)
def q_total_top1(spark, sf):
    return total_by_group(parts(spark, sf), "qty_total", 1, scale=SCALE)


@register(
    "mean_by_group",
    f"""WITH {DOCS_SQL} SELECT group_name, {_EXACT.format("value")} / COUNT(value) AS mean FROM star
    WHERE measure_name = 'n_chars' GROUP BY group_name""",
)
def q_mean_by_group(spark, sf):
    return mean_by_group(docs(spark, sf), "n_chars", scale=SCALE)


@register(
    "composite_sum",
    f"""WITH {PARTS_SQL} SELECT item_id, item_name, {_EXACT.format("value")} AS total FROM star
    WHERE measure_name IN ('p_retailprice', 'bulk_return_price') GROUP BY item_id, item_name""",
)
def q_composite_sum(spark, sf):
    return composite(parts(spark, sf), ["p_retailprice", "bulk_return_price"], None, scale=SCALE)


@register(
    "composite_top",
    f"""WITH {DOCS_SQL} SELECT item_id, item_name, group_name, {_EXACT.format("value")} AS total FROM star
    WHERE measure_name IN ('quality', 'toxic') AND group_name IN ('fr', 'es') AND value IS NOT NULL
    GROUP BY item_id, item_name, group_name ORDER BY total DESC, item_name, item_id LIMIT 10""",
)
def q_composite_top(spark, sf):
    return composite(docs(spark, sf), ["quality", "toxic"], 10, ["fr", "es"], measured_only=True, scale=SCALE)


@register(
    "composite_by_name",
    f"""WITH {PARTS_SQL} SELECT item_name, {_EXACT.format("value")} AS total FROM star
    WHERE measure_name IN ('qty_total', 'bulk_return_price') GROUP BY item_name""",
)
def q_composite_by_name(spark, sf):
    return composite(parts(spark, sf), ["qty_total", "bulk_return_price"], None, by_name=True, scale=SCALE)


@register(
    "composite_strict",
    f"""WITH {PARTS_SQL} SELECT item_id, item_name, CAST(
    CAST(MAX(CASE WHEN measure_name = 'p_retailprice' THEN value END) AS DECIMAL(18,4)) +
    CAST(MAX(CASE WHEN measure_name = 'bulk_return_price' THEN value END) AS DECIMAL(18,4)) AS DOUBLE) AS total
    FROM star WHERE measure_name IN ('p_retailprice', 'bulk_return_price') GROUP BY item_id, item_name""",
)
def q_composite_strict(spark, sf):
    return composite_strict(parts(spark, sf), ["p_retailprice", "bulk_return_price"], scale=SCALE)


# ---------------------------------------------------------------- similarity

_WIDE = f"""{PARTS_SQL}, wide AS (SELECT item_id, item_name, item_name_normalized,
    MAX(CASE WHEN measure_name = 'p_size' THEN value END) AS p_size,
    MAX(CASE WHEN measure_name = 'p_retailprice' THEN value END) AS p_retailprice
    FROM star GROUP BY item_id, item_name, item_name_normalized)"""


@register(
    "similar_to_anchor",
    f"""WITH {_WIDE}, anchor AS (SELECT * FROM wide WHERE item_name_normalized LIKE '%re%ring%'
    ORDER BY item_name, item_id LIMIT 1)
    SELECT w.item_id, w.item_name, w.p_size, w.p_retailprice FROM wide w, anchor a
    WHERE abs(w.p_size - a.p_size) < 5 AND abs(w.p_retailprice - a.p_retailprice) < 5""",
)
def q_similar_to_anchor(spark, sf):
    return similar_to(parts(spark, sf), "%re%ring%", ["p_size", "p_retailprice"], 5.0)


@register(
    "similar_to_anchors",
    f"""WITH {_WIDE}, near AS (SELECT a.item_id AS anchor_id, w.item_id, w.item_name,
    row_number() OVER (PARTITION BY a.item_id ORDER BY w.item_name, w.item_id) AS place
    FROM wide a JOIN wide w ON abs(w.p_size - a.p_size) < 1 AND abs(w.p_retailprice - a.p_retailprice) < 1)
    SELECT * FROM near WHERE place <= 10""",
)
def q_similar_to_anchors(spark, sf):
    measures = ["p_size", "p_retailprice"]
    wide = cross_measures(parts(spark, sf), measures)
    anchors = wide.select(F.col("item_id").alias("anchor_id"), *measures)
    return similar_to_anchors(wide, anchors, measures, 1.0, 10)


# ---------------------------------------------------------------- coverage


@register(
    "items_without",
    f"""WITH {DOCS_SQL} SELECT item_id, item_name FROM item WHERE item_id NOT IN
    (SELECT item_id FROM fact WHERE measure_name = 'quality' AND value > 0)""",
)
def q_items_without(spark, sf):
    return items_without(docs(spark, sf), "quality")


@register(
    "count_without",
    f"""WITH {PARTS_SQL} SELECT COUNT(DISTINCT item_id) AS items_without FROM item WHERE item_id NOT IN
    (SELECT item_id FROM fact WHERE measure_name = 'bulk_return_price' AND value > 0)""",
)
def q_count_without(spark, sf):
    return count_without(parts(spark, sf), "bulk_return_price")


_COVERAGE = """SELECT m.measure_name, COUNT(CASE WHEN value > 0 THEN 1 END) AS present, COUNT(CASE WHEN value = 0 THEN 1 END) AS zero,
    COUNT(CASE WHEN f.item_id IS NOT NULL AND value IS NULL THEN 1 END) AS missing,
    (SELECT COUNT(*) FROM item) - COUNT(DISTINCT f.item_id) AS absent
    FROM measure m LEFT JOIN fact f USING (measure_name) GROUP BY m.measure_name"""


# Sizes above 40 below zero, size 7 not a number.
_STATES = "CASE WHEN measure_name = 'p_size' AND value > 40 THEN -value WHEN measure_name = 'p_size' AND value = 7 THEN NULL ELSE value END"


@register(
    "coverage_profile_states",
    f"""WITH {PARTS_SQL}, s AS (SELECT item_id, measure_name, {_STATES} AS value FROM fact)
    SELECT m.measure_name, COUNT(CASE WHEN value <> 0 THEN 1 END) AS present, COUNT(CASE WHEN value = 0 THEN 1 END) AS zero,
    COUNT(CASE WHEN s.item_id IS NOT NULL AND value IS NULL THEN 1 END) AS missing,
    (SELECT COUNT(*) FROM item) - COUNT(DISTINCT s.item_id) AS absent
    FROM measure m LEFT JOIN s USING (measure_name) GROUP BY m.measure_name""",
)
def q_coverage_profile_states(spark, sf):
    """Negative values are present, what is not a number is missing."""
    star, value = parts(spark, sf), F.col("value")
    size = F.col("measure_id") == 1
    odd = F.when(size & (value > 40), -value).when(size & (value == 7), F.lit(float("nan"))).otherwise(value)
    return coverage_profile(Star(star.group, star.item, star.measure, star.fact.withColumn("value", odd)))


@register("coverage_profile", f"WITH {DOCS_SQL} {_COVERAGE}")
def q_coverage_profile(spark, sf):
    return coverage_profile(docs(spark, sf))


@register("coverage_profile_parts", f"WITH {PARTS_SQL} {_COVERAGE}")
def q_coverage_profile_parts(spark, sf):
    return coverage_profile(parts(spark, sf))


@register(
    "coverage_guard",
    f"""WITH {DOCS_SQL}, c AS (SELECT m.measure_name,
    round_even(COUNT(DISTINCT CASE WHEN value IS NOT NULL THEN f.item_id END) / (SELECT COUNT(*) FROM item), 4) AS coverage
    FROM measure m LEFT JOIN fact f USING (measure_name) GROUP BY m.measure_name)
    SELECT measure_name, coverage, CASE WHEN coverage < 0.5 THEN 'insufficient' ELSE 'sufficient' END AS status FROM c""",
)
def q_coverage_guard(spark, sf):
    return coverage_guard(docs(spark, sf), 0.5)


@register(
    "insufficient_guard",
    f"""WITH {PARTS_SQL}, t AS (SELECT measure_name FROM star WHERE value > 0)
    SELECT m AS measure_name, CASE WHEN n < 3 THEN 'insufficient' ELSE 'sufficient' END AS status, n AS n_rows
    FROM (SELECT 'p_weight' AS m, least(10, COUNT(CASE WHEN measure_name = 'p_weight' THEN 1 END)) AS n FROM t
          UNION ALL SELECT 'p_size', least(10, COUNT(CASE WHEN measure_name = 'p_size' THEN 1 END)) FROM t)""",
)
def q_insufficient_guard(spark, sf):
    star = parts(spark, sf)
    verdicts = [
        guard(rank_items(star, m, inverse=True)).withColumn("measure_name", F.lit(m))
        for m in ("p_weight", "p_size")
    ]
    return verdicts[0].unionByName(verdicts[1])


@register(
    "unused_measures",
    f"""WITH {DOCS_SQL} SELECT measure_id, measure_name FROM measure
    WHERE measure_name NOT IN (SELECT measure_name FROM fact)""",
)
def q_unused_measures(spark, sf):
    return unused_measures(docs(spark, sf))


# ---------------------------------------------------------------- quality


def _all(tests: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tests)


_NOT_NULL_SQL = "SELECT '{0}' AS table_name, 'not_null' AS \"check\", '{1}' AS column_name, COUNT(*) AS failures FROM {0} WHERE {1} IS NULL"


@register(
    "dq_not_null",
    " UNION ALL ".join(
        _NOT_NULL_SQL.format(t, c)
        for t, c in [
            ("orders", "o_orderkey"), ("orders", "o_custkey"), ("documents", "text"), ("events", "value"),
        ]
    )
    + " UNION ALL SELECT 'discounts', 'not_null', 'discount', COUNT(*) FROM lineitem WHERE nullif(l_discount, 0) IS NULL",
)
def q_dq_not_null(spark, sf):
    return _all(
        [
            not_null(read_table(spark, sf, "orders"), "orders", ["o_orderkey", "o_custkey"]),
            not_null(read_table(spark, sf, "documents"), "documents", ["text"]),
            not_null(read_table(spark, sf, "events"), "events", ["value"]),
            not_null(_lines_wide(spark, sf), "discounts", ["discount"]),
        ]
    )


_UNIQUE_SQL = """SELECT '{0}' AS table_name, 'unique' AS "check", '{1}' AS column_name, COUNT(*) AS failures
    FROM (SELECT {1} FROM {0} GROUP BY ALL HAVING COUNT(*) > 1)"""


@register(
    "dq_unique",
    " UNION ALL ".join(
        _UNIQUE_SQL.format(t, c)
        for t, c in [("part", "p_partkey"), ("part", "p_name"), ("documents", "text"), ("labels", "doc_id")]
    ),
)
def q_dq_unique(spark, sf):
    columns = [("part", "p_partkey"), ("part", "p_name"), ("documents", "text"), ("labels", "doc_id")]
    return _all([unique(read_table(spark, sf, t), t, [c]) for t, c in columns])


@register("dq_composite_key", _UNIQUE_SQL.format("lineitem", "l_orderkey,l_linenumber"))
def q_dq_composite_key(spark, sf):
    return unique(read_table(spark, sf, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"])


_FOREIGN_KEYS = [
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("events", "user_id", "customer", "c_custkey"),
    ("documents", "doc_id", "labels", "doc_id"),
]


@register(
    "dq_relationships",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS table_name, 'relationships' AS "check", '{fk}' AS column_name, COUNT(*) AS failures
        FROM {c} a WHERE NOT EXISTS (SELECT 1 FROM {p} b WHERE b.{pk} = a.{fk})"""
        for c, fk, p, pk in _FOREIGN_KEYS
    ),
)
def q_dq_relationships(spark, sf):
    return _all(
        [
            relationships(read_table(spark, sf, c), c, fk, read_table(spark, sf, p), pk)
            for c, fk, p, pk in _FOREIGN_KEYS
        ]
    )


@register(
    "row_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows FROM {t}" for t in TABLES),
)
def q_row_counts(spark, sf):
    return row_counts({t: read_table(spark, sf, t) for t in TABLES})
