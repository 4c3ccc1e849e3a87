"""Where tables between stages go."""

from types import SimpleNamespace

import pytest

from skylattice.sources.shared import shared_dir


def session(master, conf=None, folder=None):
    made = []
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: conf), getCheckpointDir=lambda: folder, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=context), made


def test_the_named_folder_comes_first():
    assert shared_dir(session("spark://host:7077", "/shared")[0]) == "/shared"
    assert shared_dir(session("yarn", None, "hdfs://a/b/uuid")[0]) == "hdfs://a/b"


def test_only_a_local_master_may_use_its_own_folder():
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(session("spark://host:7077")[0])
    spark, made = session("local[4]")
    assert made == [shared_dir(spark)]
