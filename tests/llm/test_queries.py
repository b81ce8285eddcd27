"""Registered queries against their SQL twins, and the rows that contracts ask for."""

import zlib
from pathlib import Path

import duckdb
import pytest

from larder.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, tables, name):
    df = QUERIES[name](spark, SF)
    found = tables.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(columns)) for r in df.collect()), key=repr) == expected
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(spark, tables, name):
    rows = QUERIES[name](spark, SF).collect()
    key, table = ("conv_id", "(SELECT DISTINCT conv_id FROM conversations)") if name.startswith("op13") else ("doc_id", "documents")
    ids = sorted(r[0] for r in tables.execute(f"SELECT {key} FROM {table}").fetchall())
    assert sorted({r[key] for r in rows}) == ids
    if name != "op6_packing":
        assert len(rows) == len(ids)
    if name.startswith("op5"):
        assert all(r.held_out == (fold(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    if name.startswith("op7"):
        lang = dict(tables.execute("SELECT doc_id, lang FROM documents").fetchall())
        assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
        assert sum(r.lang_pred == lang[r.doc_id] for r in rows) > 0.95 * len(rows)
    if name.startswith("op4"):
        assert all(r.parity for r in rows)
