import pytest

from weftgraph import session


def test_shared_folder(spark):
    base = session.shared_dir(spark)
    set_here = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert base == set_here if set_here else base.startswith("file://")
    df = session.materialise(spark.range(5), "test")
    assert df.count() == 5 and base.removeprefix("file://") in df.inputFiles()[0]
    session.remove(spark, df.inputFiles()[0].rpartition("/")[0])
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST|PATH_NOT_FOUND"):
        df.count()


def test_a_cluster_needs_the_setting(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": lambda self, key, default=None: default})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
