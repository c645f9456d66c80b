import os

import pytest

from tripgrid import session


def test_shared_dir_is_the_one_the_cluster_names(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_local_session_without_a_folder_gets_one_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(session, "CHECKPOINT_DIR", "spark.tripgrid.unset")
    own = session.shared_dir(spark)
    assert os.path.isdir(own) and session.shared_dir(spark) == own


def test_staged_tables_go_with_the_block_also_after_an_error(spark):
    with pytest.raises(ValueError), session.scratch(spark):
        kept = session.stage(spark.range(5))
        assert kept.df.count() == 5 and session.path_exists(spark, kept.path)
        raise ValueError
    assert not session.path_exists(spark, kept.path)
    outside = session.stage(spark.range(5))
    assert session.path_exists(spark, outside.path)


def test_spread_leaves_wide_scans_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == cores
    assert session.spread(spark.range(0, 100, 1, cores * 3)).rdd.getNumPartitions() == cores * 3
