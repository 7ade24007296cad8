"""A temporary folder is for local mode only: a cluster must name a shared one."""

from unittest.mock import MagicMock

import pytest

from quillspark.llm import storage


def made(master, named):
    spark = MagicMock()
    spark.conf.get.return_value = named
    spark.sparkContext.master = master
    spark.sparkContext._jsc.sc.return_value.getCheckpointDir.return_value.isEmpty.return_value = True
    return spark


@pytest.mark.parametrize("master", ["spark://h:1", "yarn", "local-cluster[1,1,100]"])
def test_a_cluster_must_name_its_folder(master):
    with pytest.raises(ValueError):
        storage.shared_folder(made(master, None))
    storage.shared_folder(made(master, "/shared"))


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_local_mode_may_name_none(master):
    storage.shared_folder(made(master, None))
