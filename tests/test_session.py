"""The folder for intermediate tables."""

import os
from types import SimpleNamespace

import pytest

from evidence.session import scratch_dir


def session(master, setting=None, folder=None):
    """What ``scratch_dir`` asks of a session."""
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder, setCheckpointDir=lambda path: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=context)


def test_shared_folder_comes_first():
    assert scratch_dir(session("spark://x", "file:///shared/"), "t").startswith("file:///shared/t-")
    assert scratch_dir(session("spark://x", None, "hdfs:///own"), "t").startswith("hdfs:///own/t-")


@pytest.mark.parametrize("master", ["spark://x", "local-cluster[2,1,1024]", "yarn"])
def test_clusters_need_one(master):
    with pytest.raises(ValueError):
        scratch_dir(session(master))


@pytest.mark.parametrize("master", ["local", "local[4]"])
def test_one_machine_gets_its_own(master):
    assert os.path.isdir(os.path.dirname(scratch_dir(session(master))))
