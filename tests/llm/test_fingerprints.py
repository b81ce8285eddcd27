import hashlib

import plain
from odd_rows import ODD
from pyspark.sql import functions as F

from larder.llm import fingerprints as fp


def rows_of(df):
    found = df.select(
        "doc_id", "n_chars", "edited_sha256", fp.as_text(F.col("lanes")).alias("f"), fp.as_text(F.col("edited_lanes")).alias("e"),
        fp.likeness(F.col("lanes"), F.col("edited_lanes")).alias("x"), fp.likeness(F.col("lanes"), F.col("next_lanes")).alias("y"),
    )
    return sorted(map(tuple, found.collect()), key=repr)


def expected(rows):
    out = []
    for i, text, edited, following in plain.edits(rows):
        own, other, behind = plain.lanes(text), plain.lanes(edited), plain.lanes(following)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), plain.lanes_text(own), plain.lanes_text(other), plain.likeness(own, other), plain.likeness(own, behind)))
    return sorted(out, key=repr)


def test_odd_rows(odd):
    assert rows_of(fp.fingerprint_edits(odd)) == expected(ODD)


def test_neighbours_over_window_borders(odd, monkeypatch):
    monkeypatch.setattr(fp, "WINDOW_ROWS", 2)
    monkeypatch.setattr(fp, "STEP", 2)
    assert rows_of(fp.fingerprint_edits(odd)) == expected(ODD)


def test_empty_table_and_single_row(odd, none):
    assert fp.fingerprint_edits(none).count() == 0
    one = odd.where("doc_id = 7")
    assert rows_of(fp.fingerprint_edits(one)) == expected([ODD[0]])
    nameless = odd.where("doc_id is null")
    assert fp.fingerprint_edits(nameless).count() == 2


def test_order_insertion_and_deletion(spark):
    texts = ["a b. c\nd, e\nf", "f\na b. c\n\nd, e", "a b. c\nd, e", "f"]
    df = fp.with_lanes(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), ["k"], "t")
    lanes = {r.k: r.lanes for r in df.collect()}
    assert lanes[0] == lanes[1] == plain.lanes(texts[0])
    pair = spark.createDataFrame([(lanes[2], lanes[3], lanes[0])], "rest array<long>, one array<long>, whole array<long>")
    got = pair.select(fp.insert(F.col("rest"), F.col("one")).alias("i"), fp.delete(F.col("whole"), F.col("one")).alias("d")).first()
    assert got.i == lanes[0] and got.d == lanes[2]


def test_native(odd):
    plan = fp.fingerprint_edits(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
