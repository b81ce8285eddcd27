import random

import plain
from odd_rows import ODD

from larder.llm import linededup as ld


def cleaned(df):
    return sorted(((r.doc_id, r.text) for r in ld.without_copies(df).collect()), key=repr)


def expected(rows):
    clean = plain.line_dedup(rows)
    return sorted(((i, None if t is None else clean[i, t]) for i, t in rows), key=repr)


def random_rows(seed, n):
    rng = random.Random(seed)
    lines = [" ".join(rng.choices("ab", k=rng.choice([1, 1, 2, 4, 12]))) + str(k) for k in range(9)] + ["", "  ", "tail  "]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randrange(1, 14)))) for i in range(n)]
    for _ in range(n // 4):
        i, j = rng.randrange(n), rng.randrange(n)
        rows[i] = (i, rows[j][1] + rng.choice(["", "\nmore 1"]))
    return rows


def test_random_documents(spark):
    for seed in (1, 2):
        rows = random_rows(seed, 60)
        assert cleaned(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_odd_rows(odd, none):
    assert cleaned(odd) == expected(ODD)
    out = ld.without_copies(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_deleted"]
    counts = {(r.doc_id, r.text): (r.n_lines, r.n_deleted) for r in out.collect()}
    assert counts[6, ""] == (0, 0) and counts[5, None] == (0, 0)
    assert ld.without_copies(none).count() == 0


def test_maximal_runs(spark):
    copy = ["one two three four five", "six seven", "eight nine ten eleven twelve", "short"]
    rows = [(1, "\n".join(["alone a"] + copy + ["alone b"])), (2, "\n".join(copy)), (3, "\n".join(["alone c"] + copy[1:] + ["alone d"])), (4, "short\nsix seven")]
    found = ld.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in found) == [(2, 0, 4, 1, 1)]
    # six seven / eight ... twelve / short: eight words, not enough
    longer = ld.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), min_words=8).collect()
    assert sorted(tuple(r) for r in longer) == [(2, 0, 4, 1, 1), (3, 1, 3, 1, 2)]


def test_ranks_are_a_suffix_array(spark):
    rng = random.Random(9)
    rows = [(i, "\n".join(rng.choices(["x1", "y2", "z3"], k=rng.randrange(1, 20)))) for i in range(30)]
    positions, levels = ld.suffix_ranks(ld.line_table(spark.createDataFrame(rows, "doc_id long, text string")), 8)
    assert levels == 4
    found = positions.collect()
    line_rank = {}
    text = {(r.doc, r.n): r.r0 for r in found}
    for r in found:
        line_rank[r.doc, r.n] = [text[r.doc, r.n + k] for k in range(8) if (r.doc, r.n + k) in text]
    whole = [r for r in found if r.r3 is not None]
    order = sorted(whole, key=lambda r: r.r3)
    prefixes = [line_rank[r.doc, r.n] for r in order]
    assert prefixes == sorted(prefixes) and all(len(p) == 8 for p in prefixes)
    assert len({r.r3 for r in order}) == len({tuple(p) for p in prefixes})


def test_native(odd):
    plan = ld.without_copies(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_words_at_tabs_and_in_scripts_without_blanks(spark):
    tabs, wide = "\t".join(f"w{k}" for k in range(10)), "多" * 99 + "　終"
    rows = [(1, f"{tabs}\nend"), (2, f"first\n{tabs}"), (3, wide), (4, f"b\n{wide}"), (5, "多" * 80), (6, "c\n" + "多" * 80), (7, "a\xa0b"), (8, "d\na\xa0b")]
    found = {r.doc_id: r.text for r in ld.without_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: t for (i, _), t in zip(rows, [c for _, c in sorted((k[0], v) for k, v in plain.line_dedup(rows).items())], strict=True)}
    assert found[2] == "first" and found[4] == "b" and found[6] == "c\n" + "多" * 80
