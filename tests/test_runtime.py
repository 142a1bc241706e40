from pathlib import Path

import pytest

from weftline import runtime


def test_closed_stages_leave_nothing(spark):
    stage, other = runtime.Stage(spark, "one"), runtime.Stage(spark, "two")
    for s in (stage, other):
        assert s.write(spark.range(3).toDF("id"), "t").count() == 3
    folder, kept = (Path(s.path.removeprefix("file://")) for s in (stage, other))
    stage.close()
    assert not folder.exists() and kept.exists()
    runtime.clean()
    assert not kept.exists()


def test_a_cluster_must_name_its_folder(spark):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Settings:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext = Context()
        conf = Settings()

    with pytest.raises(RuntimeError):
        runtime.shared_root(Session())
