import pytest

from corpuskit.session import ensure_checkpoint_dir, spread


class _Conf:
    def __init__(self, d):
        self.d = d

    def get(self, k, default=None):
        return self.d.get(k, default)


class _SC:
    def __init__(self, master, ckpt=None):
        self.master = master
        self._ckpt = ckpt

    def getCheckpointDir(self):
        return self._ckpt

    def getConf(self):
        return _Conf({})

    def setCheckpointDir(self, d):
        self._ckpt = d


class _Spark:
    def __init__(self, master, ckpt=None):
        self.sparkContext = _SC(master, ckpt)
        self.conf = _Conf({})


def test_cluster_without_shared_checkpoint_dir_is_an_error():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Spark("yarn"))
    assert ensure_checkpoint_dir(_Spark("yarn", "hdfs:///shared/ckpt")) == "hdfs:///shared/ckpt"


def test_local_session_gets_a_scratch_dir():
    assert ensure_checkpoint_dir(_Spark("local[2]")).startswith("/")


def test_spread_only_small_scans(spark):
    small = spark.range(10).coalesce(1)
    assert spread(small, 4).rdd.getNumPartitions() == 4
    big = spark.range(100).repartition(8)
    assert spread(big, 4) is big
