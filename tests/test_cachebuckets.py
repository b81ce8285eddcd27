from datetime import datetime, timedelta

import pytest

from larder.operators.cache import CACHE_SCHEMA, cache_lookup, cache_upsert
from larder.sources import cachebuckets as cb

START = datetime(2026, 1, 1)
CALLS = "question_key string, question string, sql string, result string, response string, at timestamp_ntz, seq bigint"


def calls(spark, rows, at):
    """Calls (key, sql, response) from a second on."""
    full = [(k, f"Q {k}", sql, f"r {sql}", response, START + timedelta(seconds=at + i), i) for i, (k, sql, response) in enumerate(rows)]
    return spark.createDataFrame(full, CALLS)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("question_key", "question_raw", "sql", "result_snapshot", "response", "hits", "created_at", "updated_at").collect()), key=repr)


def first_cache(spark, keys):
    return spark.createDataFrame([(k, f"Raw {k}", "s0", "r0", None if k == "a" else "old", 3, START, START) for k in keys], CACHE_SCHEMA)


def test_batches_are_merged_as_by_upserts_of_the_whole(spark, tmp_path):
    path = str(tmp_path / "cache")
    cb.create(spark, path, 8)
    assert rows_of(cb.read(spark, path)) == []
    plain = first_cache(spark, "abcdefgh")
    cb.fill(plain, path)
    batches = [
        [("a", "s1", None), ("b", "s1", "new"), ("z", "s1", None), ("a", "s2", None)],
        [],
        [("b", None, None), ("z", "s3", "late"), ("", "s3", "empty key")],
        [("a", "s4", "at last"), ("y", "s4", None)],
    ]
    for number, some in enumerate(batches, 1):
        batch = calls(spark, some, 100 * number)
        plain = cache_upsert(plain, batch)
        cb.upsert(batch, path, number)
        assert cb.upsert(batch, path, number) == cb.state(spark, path)  # sent again
        assert rows_of(cb.read(spark, path)) == rows_of(plain)
        if number == 2:
            cb.compact(spark, path)
            assert all(len(f) == 1 for f in cb.state(spark, path).folders.values())
            assert rows_of(cb.read(spark, path)) == rows_of(plain)
    asked = spark.createDataFrame([("a",), ("y",), ("not there",)], "question_key string")
    order = ["question_key", "sql", "response", "found"]
    assert sorted(cb.lookup(asked, path).select(order).collect()) == sorted(cache_lookup(asked, plain).select(order).collect())


def test_only_the_buckets_of_a_batch_are_written_and_read(spark, tmp_path):
    path = str(tmp_path / "cache")
    cb.create(spark, path, 16)
    before = cb.fill(first_cache(spark, [f"k{i}" for i in range(200)]), path)
    assert len(before.folders) == 16
    after = cb.upsert(calls(spark, [("k7", "s", None), ("k7", "t", "x")], 9), path, 1)
    touched = [b for b in after.folders if after.folders[b] != before.folders[b]]
    assert len(touched) == 1 and len(after.folders[touched[0]]) == 2
    asked = spark.createDataFrame([("k7",)], "question_key string")
    found = cb.read(spark, path, touched)
    assert all(f"bucket={touched[0]}/" in f for f in found.inputFiles())
    assert cb.lookup(asked, path).select("sql", "response").collect() == [("t", "x")]
    assert cb.compact(spark, path, least=3) == after
    done = cb.compact(spark, path)
    assert [b for b in done.folders if done.folders[b] != after.folders[b]] == touched
    assert cb.expire(spark, path) == 0 and cb.expire(spark, path, older_than_s=-1) == 2
    assert cb.read(spark, path).count() == 200


def test_a_batch_that_dies_and_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    cb.create(spark, path, 4)
    cb.fill(first_cache(spark, "ab"), path)
    before = rows_of(cb.read(spark, path))
    batch = calls(spark, [("a", "s9", "x"), ("q", "s9", "x")], 5)

    def dies(*_):
        raise RuntimeError("killed between data and manifest")

    monkeypatch.setattr(cb, "_published", dies)
    with pytest.raises(RuntimeError):
        cb.upsert(batch, path, 1)
    monkeypatch.undo()
    assert rows_of(cb.read(spark, path)) == before
    (tmp_path / "cache/manifests/000000000003.json").write_text('{"buckets": 4, "la')  # died within its manifest
    assert rows_of(cb.read(spark, path)) == before
    slow = cb.state(spark, path)
    assert cb.upsert(batch, path, 1).number == 4
    assert rows_of(cb.read(spark, path)) == rows_of(cache_upsert(first_cache(spark, "ab"), batch))
    monkeypatch.setattr(cb, "state", lambda *_: slow)
    with pytest.raises(RuntimeError, match="another writer"):
        cb.upsert(batch, path, 2)
    monkeypatch.undo()
    with pytest.raises(RuntimeError, match="another writer"):
        cb.create(spark, path, 4)
    with pytest.raises(FileNotFoundError):
        cb.read(spark, str(tmp_path / "none"))
