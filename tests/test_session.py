"""The shared folder."""

import os

from lidarlake import session


def test_staged_tables_live_in_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    staged = session.stage(spark.range(10), "ids")
    assert staged.count() == 10 and staged.columns == ["id"]
    assert staged.inputFiles()[0].startswith(f"file://{tmp_path}/lidarlake/")
    session.clear(spark)
    assert os.listdir(tmp_path / "lidarlake") == []


def test_configured_folder_is_used(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    found = session.shared_dir(spark)
    assert found == (configured or spark.sparkContext.getCheckpointDir()).rstrip("/")
