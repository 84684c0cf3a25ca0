import gc
import os
import time

from islet import storage


def test_staged_tables_go_with_their_last_reader(spark):
    a = storage.stage(spark.range(5), "a")
    path = a._islet_path.removeprefix("file://")
    b = a.where("id > 1")
    del a
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    storage.sweep(spark)
    assert os.path.isdir(path) and b.count() == 3
    del b
    for _ in range(60):  # the JVM keeps the plans of some last queries
        spark.range(10).distinct().count()
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
        storage.sweep(spark)
        if not os.path.isdir(path):
            break
    assert not os.path.isdir(path)


def test_shared_folder_is_the_checkpoint_folder(spark):
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    table = storage.stage(spark.range(3), "x")
    assert table._islet_path.startswith(storage.shared_dir(spark))
    storage.drop(table)
    assert not os.path.isdir(table._islet_path.removeprefix("file://"))
