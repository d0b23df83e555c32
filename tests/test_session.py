import time

from tracelens.session import CLEANUP, materialize


def shuffle_files(spark):
    """Names of the shuffle files in Spark's own folders."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    listed = folders.getAllFiles()
    return {name for i in range(listed.size()) if (name := listed.apply(i).getName()).startswith("shuffle_")}


def test_shuffle_files_of_a_written_stage_go(spark):
    before, own = shuffle_files(spark), spark.conf.get(CLEANUP)
    rows = materialize(spark.range(1000).repartition(3, "id"))
    assert spark.conf.get(CLEANUP) == own
    end = time.time() + 10  # files are removed in the background
    while (left := {f for f in shuffle_files(spark) - before if f.endswith(".data")}) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert rows.count() == 1000
