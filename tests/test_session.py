"""Intermediate tables: where they go, and that they go away."""

import os
from types import SimpleNamespace

import pytest

from seqloom.session import cut_lineage, release, shared_folder


def test_written_and_released(spark):
    t = cut_lineage(spark.range(5))
    assert t.count() == 5 and os.path.isdir(t._seqloom_path)
    release(t, spark.range(1))
    assert not os.path.exists(t._seqloom_path)
    release(t)


@pytest.mark.parametrize("master,named,there,want", [
    ("spark://host:7077", None, None, RuntimeError), ("yarn", None, None, RuntimeError), ("local-cluster[2,1,1024]", None, None, RuntimeError),
    ("yarn", "hdfs://x/tmp", None, "hdfs://x/tmp"), ("yarn", None, "hdfs://y/tmp", "hdfs://y/tmp"), ("local[4]", "/shared", None, "/shared"),
])
def test_only_a_local_master_may_do_without_a_shared_folder(master, named, there, want):
    conf = SimpleNamespace(get=lambda *a: named)
    found = SimpleNamespace(isEmpty=lambda: there is None, get=lambda: there)
    sc = SimpleNamespace(master=master, getConf=lambda: conf, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: found)))
    fake = SimpleNamespace(sparkContext=sc, conf=conf)
    if want is RuntimeError:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(fake)
    else:
        assert shared_folder(fake) == want
