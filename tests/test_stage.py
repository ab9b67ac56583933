"""Staged tables: where they lie and when they go."""

import pytest

from matchloom import stage


def test_blocks_leave_nothing(spark):
    def held():
        files, path = stage._path(spark, stage.session_dir(spark))
        return {f.getPath().getName() for f in files.listStatus(path)}

    before = held()
    with stage.stages(spark) as folder:
        assert stage.staged(spark.range(3), "a").count() == 3
        assert len(held() - before) == 1
    assert held() == before
    kept = stage.staged_alone(spark, "b", lambda: stage.staged(spark.range(4), "c").where("id > 1"))
    assert kept.count() == 2 and len(held() - before) == 1 and folder not in held()


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        stage.shared_dir(Session())


def test_replace_keeps_the_old_one_on_failure(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "old/x").write_text("x")
    with pytest.raises(OSError):
        stage.replace(spark, f"file://{tmp_path}/old", f"file://{tmp_path}/missing")
    assert (tmp_path / "old/x").read_text() == "x"
    (tmp_path / "new").mkdir()
    (tmp_path / "new/y").write_text("y")
    stage.replace(spark, f"file://{tmp_path}/old", f"file://{tmp_path}/new")
    assert [p.name for p in tmp_path.iterdir()] == ["old"] and [p.name for p in (tmp_path / "old").iterdir() if p.suffix != ".crc"] == ["y"]
