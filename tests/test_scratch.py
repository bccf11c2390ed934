"""The shared folder: errors on a cluster without one, and deletion."""

import os
from types import SimpleNamespace

import pytest

from catchwater import scratch


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    there = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(there)


def test_written_tables_can_be_dropped(spark):
    t, kept = scratch.written(spark.range(5), "t"), scratch.written(spark.range(6), "kept")
    path = t._written_to.removeprefix("file://")
    assert t.count() == 5 and os.path.isdir(path)
    scratch.dropped(t)
    assert not os.path.exists(path) and kept.count() == 6
