from __future__ import annotations

import os

from marquetry import session


def test_package_is_sent_only_where_needed(spark, monkeypatch):
    root = os.path.dirname(os.path.dirname(os.path.abspath(session.__file__)))
    monkeypatch.setenv("PYTHONPATH", root)
    assert session.ship_package(spark) is False
    monkeypatch.setenv("PYTHONPATH", "")
    monkeypatch.chdir("/tmp")
    assert session.ship_package(spark) is True
    assert session.ship_package(spark) is False
    assert "marquetry.zip" in [os.path.basename(f) for f in spark.sparkContext.listFiles]


def test_checkpoint_dir_is_the_named_one(spark):
    assert session.ensure_checkpoint_dir(spark) == session.ensure_checkpoint_dir(spark)
    assert session.cut(spark.range(3)).count() == 3


def test_partitions_for(spark):
    assert session.partitions_for(spark, 10, 1000) == 4 and session.partitions_for(spark, 100_000, 1000) == 100
