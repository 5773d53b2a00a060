"""Staged tables: where they are written, and that they go."""

import pytest
from posewright import staging


def test_stage_and_discard(spark):
    df = spark.range(10).selectExpr("id", "CAST(id AS STRING) AS s")
    kept = staging.stage(df, "test")
    assert kept.schema.simpleString() == df.schema.simpleString() and kept.count() == 10
    assert spark.sparkContext.applicationId in kept.inputFiles()[0]
    staging.discard(kept)
    again = staging.new_path(spark, "test")
    assert again != staging.new_path(spark, "test") and again.startswith(staging.shared_root(spark))


def test_empty_table_keeps_its_schema(spark):
    df = spark.createDataFrame([], "a long, b array<string>")
    assert staging.stage(df, "none").collect() == [] and staging.stage(df, "none").schema == df.schema


def test_root_is_in_the_folder_of_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    root = staging.shared_root(spark)
    assert root.startswith(configured.rstrip("/") if configured else "file:///")


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_root(Session())


def test_long_rows_get_more_files(spark, monkeypatch):
    df = spark.range(0, 40, 1, 20)
    assert len(staging.stage(df, "few", rows=40).inputFiles()) == staging.LEAST_FILES
    monkeypatch.setattr(staging, "BYTES_A_FILE", 10)
    assert len(staging.stage(df, "more", rows=40, size=120).inputFiles()) == 12
