import os

import pytest

from sedgemill import session as S


def test_cut_and_release(spark):
    t = S.cut(spark.range(5).toDF("a"), "x")
    path = S._written[t].removeprefix("file://")
    assert t.count() == 5 and os.path.isdir(path)
    S.release(t, spark.range(1))
    assert not os.path.exists(path) and t not in S._written


class OnACluster:
    """A session whose tasks run elsewhere."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:
        master = "spark://somewhere:7077"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        S.work_dir(OnACluster)


def test_tables_go_when_the_session_is_gone(tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    S._remove(None, f"file://{folder}")
    assert not folder.exists()


def test_a_bound_saves_counting(spark):
    df = spark.range(50).selectExpr("id % 2 as k")
    assert S.heavy_keys(df, "k", least=10, total=9).isEmpty()
    assert S.heavy_keys(df, "k", share=0.1, least=10, total=50).count() == 2
