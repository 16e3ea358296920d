"""The shared folder comes from the session's setting."""

from types import SimpleNamespace

import pytest

from gradeloom import session


def _fake(master, setting=None, folder=None):
    context = SimpleNamespace(
        master=master,
        getConf=lambda: {"spark.checkpoint.dir": setting} if setting else {},
        getCheckpointDir=lambda: context.folder,
        setCheckpointDir=lambda path: setattr(context, "folder", path),
        folder=folder,
    )
    return SimpleNamespace(sparkContext=context, conf={})


def test_named_folder_is_used():
    fake = _fake("yarn", "hdfs://shared/checkpoints")
    assert session.shared_folder(fake) == "hdfs://shared/checkpoints"
    assert fake.sparkContext.folder == "hdfs://shared/checkpoints"
    assert session.new_folder(fake, "x").startswith("hdfs://shared/checkpoints/x-")


def test_cluster_without_a_folder_is_refused():
    with pytest.raises(RuntimeError):
        session.shared_folder(_fake("yarn"))


def test_local_session_gets_its_own_folder(spark):
    folder = session.shared_folder(spark)
    assert folder == session.shared_folder(spark)
    assert session.cut_lineage(spark.range(3)).count() == 3
