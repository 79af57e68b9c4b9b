"""Where queries write files for themselves."""

from types import SimpleNamespace

import pytest

from lodestream.sources.scratch import fresh_path, shared_folder


def session(master, setting=None, checkpoint=None):
    folder = {"at": checkpoint}
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: folder["at"], setCheckpointDir=lambda path: folder.update(at=path))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting or default), sparkContext=sc)


def test_only_a_local_master_may_do_without_the_setting():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://host:7077"))
    assert shared_folder(session("local[2]")).startswith("file:///")
    assert shared_folder(session("yarn", "hdfs:///shared")) == "hdfs:///shared" and shared_folder(session("yarn", None, "s3a://b/c")) == "s3a://b/c"
    a, b = (fresh_path(session("yarn", "hdfs:///shared/"), "x") for _ in range(2))
    assert a != b and a.startswith("hdfs:///shared/lodestream-x-")
