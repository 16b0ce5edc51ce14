"""Checkpoint folder: read from the session, set only where unset (local mode)."""

from gridmf.session import ensure_checkpoint_dir, scratch_path


def test_existing_checkpoint_dir_is_kept(spark):
    before = spark.sparkContext.getCheckpointDir()
    assert before  # conftest sets spark.checkpoint.dir
    assert ensure_checkpoint_dir(spark) == before
    path = scratch_path(spark, "x")
    assert path.startswith(before) and path != scratch_path(spark, "x")
