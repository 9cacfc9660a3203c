"""The archive source: row ranges of stored members, whole members otherwise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.sources import archives as ar, sinks


def make(folder, name, n=1000, width=5, save=np.savez, order="C", dtype=np.float64, seed=0):
    x = np.asarray(np.random.default_rng(seed).normal(size=(n, width)), dtype=dtype, order=order)
    save(folder / f"{name}.npz", X=x, y=np.arange(n) % 3, other=np.zeros(2))
    return x


def rows_of(df):
    got = sorted((r["dataset"], r["row_id"], r["y"], tuple(r["features"])) for r in df.collect())
    return {d: np.array([f for e, _, _, f in got if e == d]) for d in {g[0] for g in got}}, got


def test_an_archive_is_read_by_several_tasks(spark, tmp_path):
    x = make(tmp_path, "big", 3000)
    df = ar.scan_matrix_archives(spark, str(tmp_path), partition_bytes=8000)
    assert df.rdd.getNumPartitions() == 15
    values, got = rows_of(df)
    assert np.array_equal(values["big"], x) and [g[1] for g in got] == list(range(3000)) and [g[2] for g in got] == [k % 3 for k in range(3000)]
    assert df.agg(F.max("row_id")).first()[0] == 2999 and ar.scan_matrix_archives(spark, f"file://{tmp_path}").count() == 3000


@pytest.mark.parametrize("save,order,dtype,parts", [
    (np.savez, "C", np.float32, 5), (np.savez, "C", np.int16, 3), (np.savez, "F", np.float64, 1), (np.savez_compressed, "C", np.float64, 1)])
def test_kinds_of_members(spark, tmp_path, save, order, dtype, parts):
    x = make(tmp_path, "one", 1000, 5, save, order, dtype)
    df = ar.scan_matrix_archives(spark, str(tmp_path), partition_bytes=4000)
    assert df.rdd.getNumPartitions() == parts
    assert np.array_equal(rows_of(df)[0]["one"], x.astype(np.float64))


def test_names_left_out_and_empty_folders(spark, tmp_path):
    make(tmp_path, "keep", 7)
    make(tmp_path, "skip", 7)
    (tmp_path / "notes.txt").write_text("no archive")
    assert {r["dataset"] for r in ar.scan_matrix_archives(spark, str(tmp_path), exclude=("skip",)).collect()} == {"keep"}
    assert ar.scan_matrix_archives(spark, str(tmp_path), exclude=("skip", "keep")).count() == 0
    make(tmp_path, "none", 0)
    assert ar.scan_matrix_archives(spark, str(tmp_path), exclude=("skip", "keep")).count() == 0


def test_archives_that_are_refused(spark, tmp_path):
    np.savez(tmp_path / "bad.npz", X=np.array([[{"a": 1}]], dtype=object), y=np.array([0]))
    with pytest.raises(Exception, match="allow_pickle"):
        ar.scan_matrix_archives(spark, str(tmp_path)).count()
    np.savez(tmp_path / "bad.npz", X=np.zeros((3, 2)), y=np.zeros(4))
    with pytest.raises(Exception, match="one row per label"):
        ar.scan_matrix_archives(spark, str(tmp_path)).count()


def test_saved_archives_are_numpy_archives(spark, tmp_path):
    rows = [("a", i, [float(i), 2.0], i % 2) for i in range(9)] + [("b c", 5, [1.0, -0.5], 1)]
    sinks.save_matrix_archives(spark.createDataFrame(rows, "dataset string, row_id long, features array<double>, y int"), str(tmp_path / "out"))
    with np.load(tmp_path / "out" / "a.npz") as one:
        assert one["X"].tolist() == [r[2] for r in rows[:9]] and one["y"].tolist() == [r[3] for r in rows[:9]]
    got = rows_of(ar.scan_matrix_archives(spark, str(tmp_path / "out")))[1]
    assert len(got) == 10 and {g[0] for g in got} == {"a", "b c"} or {g[0] for g in got} == {"a", "b%20c"}


def test_small_ranges_of_a_large_archive_do_not_cost_a_task_each(spark, tmp_path, monkeypatch):
    x = make(tmp_path, "big", 3000)
    make(tmp_path, "small", 3)
    monkeypatch.setattr(ar, "MOST_PARTITIONS", 20)
    reader = ar.ArchiveReader(str(tmp_path), frozenset(), 40)
    parts = reader.partitions()
    assert 20 <= len(parts) <= 22
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist() if r["dataset"] == "big"]
    assert [r["row_id"] for r in rows] == list(range(3000)) and np.array_equal([r["features"] for r in rows], x)
