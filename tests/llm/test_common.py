from types import SimpleNamespace

import pytest

from dockline.llm.common import shared_dir


def session(master, named=None):
    folder = []
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: folder[-1] if folder else None,
                         setCheckpointDir=folder.append, getConf=lambda: {})
    return SimpleNamespace(sparkContext=sc, conf={"spark.checkpoint.dir": named})


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077"))
    assert shared_dir(session("spark://host:7077", "/shared/x")) == "/shared/x"
    assert "dockline-llm-" in shared_dir(session("local[2]"))
