import pytest

from vellumine import session


class Fake:
    def __init__(self, master, conf=None):
        self.master, self.dir, self.sparkContext = master, None, self
        self.conf = self
        self.named = conf

    def get(self, key, default):
        return self.named or default

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


def test_checkpoint_folder(tmp_path):
    assert session.checkpoint_dir(Fake("spark://x:1", "hdfs://shared")) == "hdfs://shared"
    assert "vellumine-" in session.checkpoint_dir(Fake("local[8]"))
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Fake("local-cluster[3,2,1000]"))
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Fake("yarn"))


def test_cut_keeps_rows(spark):
    df = session.cut(spark.range(10))
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().toString()
