import shutil
from pathlib import Path

import pytest

from larder.sources import snapshots as sn
from larder.sources import tables


def numbers(spark, n):
    return spark.range(n).selectExpr("id", "id % 3 AS part")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_write_that_dies_leaves_the_former_snapshot(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert sn.latest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        sn.read_snapshot(spark, path, "t")
    assert sn.commit({"t": numbers(spark, 5)}, path).version == 1

    def dies(*_):
        raise RuntimeError("killed between data and manifest")

    monkeypatch.setattr(sn, "publish", dies)
    with pytest.raises(RuntimeError):
        sn.commit({"t": numbers(spark, 9)}, path)
    monkeypatch.undo()
    assert ids(sn.read_snapshot(spark, path, "t")) == list(range(5))
    (tmp_path / "t/manifests/000000000002.json").write_text('{"folder": "/half')  # died within its manifest
    assert sn.latest(spark, path).version == 1
    assert sn.commit({"t": numbers(spark, 2)}, path).version == 3
    assert ids(sn.read_snapshot(spark, path, "t")) == [0, 1] and ids(sn.read_snapshot(spark, path, "t", 1)) == list(range(5))


def test_a_write_that_dies_within_its_data(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sn.commit({"a": numbers(spark, 3), "b": numbers(spark, 4)}, path)
    real = tables.write_table

    def second_dies(df, where, partition_by=()):
        if where.endswith("/b"):
            raise RuntimeError("killed")
        real(df, where, partition_by)

    monkeypatch.setattr(sn, "write_table", second_dies)
    with pytest.raises(RuntimeError):
        sn.commit({"a": numbers(spark, 7), "b": numbers(spark, 8)}, path)
    assert ids(sn.read_snapshot(spark, path, "a")) == [0, 1, 2] and ids(sn.read_snapshot(spark, path, "b")) == [0, 1, 2, 3]


def test_readers_keep_their_files_and_writers_their_numbers(spark, tmp_path):
    path = str(tmp_path / "t")
    sn.commit({"t": numbers(spark, 4)}, path, {"t": ["part"]})
    before = sn.read_snapshot(spark, path, "t")
    a, b = (sn.write_data({"t": numbers(spark, n)}, path) for n in (6, 7))
    assert [sn.publish(spark, path, f, ["t"]).version for f in (a, b)] == [2, 3]
    assert ids(before) == [0, 1, 2, 3] and ids(sn.read_snapshot(spark, path, "t")) == list(range(7))
    assert [s.version for s in sn.snapshots(spark, path)] == [3, 2, 1]
    with pytest.raises(ValueError):
        sn.read_snapshot(spark, path, "other")


def test_expire(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2, 3, 4):
        sn.commit({"t": numbers(spark, n)}, path)
    sn.write_data({"t": numbers(spark, 9)}, path)  # perhaps still being written
    assert sn.expire(spark, path, keep=2) == 2
    assert [s.version for s in sn.snapshots(spark, path)] == [4, 3] and ids(sn.read_snapshot(spark, path, "t", 3)) == [0, 1, 2]
    assert sn.expire(spark, path, keep=2, older_than_s=-1) == 1
    assert len(list(Path(path, "data").iterdir())) == 2
    assert sn.commit({"t": numbers(spark, 1)}, path).version == 5


def test_state_of_files(spark, tmp_path):
    path = str(tmp_path / "t")
    numbers(spark, 5).write.parquet(path)
    before = sn.state_of_files(spark, path)
    assert before == sn.state_of_files(spark, path)
    numbers(spark, 1).write.mode("append").parquet(path)
    assert sn.state_of_files(spark, path) != before
    shutil.copytree(path, tmp_path / "copy")
    assert sn.state_of_files(spark, str(tmp_path / "copy")) != sn.state_of_files(spark, path)
