import os

import pytest

from corpuskit.operators import ordering as od
from corpuskit.sinks import versions as vs


def _df(spark, k):
    return spark.range(5).selectExpr("id", f"{k} AS k")


def test_publish_read_and_retention(spark, tmp_dir):
    path = tmp_dir + "/out"
    with pytest.raises(ValueError):
        vs.read_version(spark, path)
    assert [vs.publish(_df(spark, k), path, keep=3) for k in range(5)] == [0, 1, 2, 3, 4]
    assert vs.versions(spark, path) == [2, 3, 4]
    assert {r.k for r in vs.read_version(spark, path).collect()} == {4} and {r.k for r in vs.read_version(spark, path, 2).collect()} == {2}
    assert len(os.listdir(path + "/data")) == 3
    with pytest.raises(ValueError):
        vs.read_version(spark, path, 1)
    with pytest.raises(ValueError):
        vs.publish(_df(spark, 9), path, keep=0)


def test_a_writer_killed_before_its_commit_is_never_seen(spark, tmp_dir, monkeypatch):
    path = tmp_dir + "/out"
    vs.publish(_df(spark, 0), path)
    real = vs._files

    def dying(spark, p):
        fs, at = real(spark, p)

        class Dead:
            def __getattr__(self, name):
                if name == "create":
                    raise RuntimeError("killed")
                return getattr(fs, name)
        return Dead(), at
    monkeypatch.setattr(vs, "_files", dying)
    with pytest.raises(RuntimeError):
        vs.publish(_df(spark, 1), path)
    monkeypatch.setattr(vs, "_files", real)
    assert vs.versions(spark, path) == [0] and len(os.listdir(path + "/data")) == 2
    with open(path + "/commits/000000000001", "w"):
        pass  # killed between creating the commit and writing it
    assert vs.versions(spark, path) == [0] and {r.k for r in vs.read_version(spark, path).collect()} == {0}
    assert vs.publish(_df(spark, 2), path, keep=1) == 2
    assert vs.versions(spark, path) == [2] and {r.k for r in vs.read_version(spark, path).collect()} == {2}
    assert len(os.listdir(path + "/data")) == 1  # what the dead writers left is gone too


def test_two_writers_of_one_number(spark, tmp_dir, monkeypatch):
    path = tmp_dir + "/out"
    vs.publish(_df(spark, 0), path)
    names = vs._names
    monkeypatch.setattr(vs, "_names", lambda fs, folder: [] if folder.getName() == "commits" else names(fs, folder))
    assert vs.publish(_df(spark, 1), path) == 1  # it believed to be the first
    monkeypatch.setattr(vs, "_names", names)
    assert vs.versions(spark, path) == [0, 1] and {r.k for r in vs.read_version(spark, path).collect()} == {1}


def test_sparse_keys_need_no_bucket_table(spark):
    keys = [(k * 10**14 + 7,) for k in range(50)] + [(None,)]
    df = spark.createDataFrame(keys, "key long")
    got = od.with_row_index(df, "key")
    assert {r.key: r.idx for r in got.collect()} == {k[0]: i + 1 for i, k in enumerate(sorted(keys, key=lambda k: (k[0] is not None, k[0] or 0)))}
    assert "_b0" not in got._jdf.queryExecution().toString()
