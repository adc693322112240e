import os
import time
from types import SimpleNamespace

import pytest

from foliospark.sources import storage


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(SimpleNamespace(conf={}, sparkContext=context))


def test_staged_tables_come_and_go(spark):
    df = storage.staged(spark.range(5).withColumnRenamed("id", "x"), "numbers")
    other = storage.staged(df.where("x > 2"), "few")
    assert df.columns == ["x"] and df.count() == 5 and other.count() == 2
    storage.discard(df)
    assert not os.path.exists(df.staged_at) and other.count() == 2
    root = os.path.dirname(other.staged_at)
    storage.remove_staged(spark)
    assert not os.path.exists(root)


def test_release_frees_the_shuffle_files_of_steps_done(spark):
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffled():
        return {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    before = shuffled()
    storage.staged(spark.range(5000).selectExpr("id % 7 AS k").groupBy("k").count(), "counted")
    made = shuffled() - before
    assert made
    storage.release(spark)
    for _ in range(50):
        if not made & shuffled():
            break
        time.sleep(0.1)
    assert not made & shuffled()
