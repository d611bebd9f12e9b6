import time
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from keyfold.llm import shared


def test_staged_tables_are_read_from_the_shared_folder_and_dropped(spark):
    before = shared.staged_folders()
    df = shared.staged(spark.range(5), "five")
    new = [f for f in shared.staged_folders() if f not in before]
    assert df.count() == 5 and len(new) == 1 and new[0].startswith(shared.shared_folder(spark))
    folder = Path(new[0].removeprefix("file:"))
    assert folder.exists()
    shared.drop_staged(spark, new)
    assert not folder.exists() and shared.staged_folders() == before


def test_wrapped_columns_come_back_in_order(spark):
    df = spark.createDataFrame([(1, "a", 2)], "row int, `a.b` string, key int")
    w = shared.wrapped(df, "key")
    assert w.columns == ["row", "key"] and w.select(*shared.unwrapped(w)).columns == df.columns
    assert w.select(*shared.unwrapped(w, "row")).columns == ["a.b", "key"]


def test_no_folder_of_our_own_off_a_local_master():
    none = SimpleNamespace(get=lambda *_: None)
    held = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(getConf=lambda: none, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: held)), master="local-cluster[3,2,1024]")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(SimpleNamespace(conf=none, sparkContext=context))


def test_last_staged_drops_what_was_staged_on_the_way(spark):
    before = shared.staged_folders()
    a = shared.staged(spark.range(3), "a")
    kept = shared.staged_folders()
    b = shared.staged(a.withColumn("x", a.id + 1), "b")
    c = shared.last_staged(b.filter("x > 1"), "c", kept)
    assert c.count() == 2 and a.count() == 3 and len(shared.staged_folders()) == len(before) + 2
    shared.drop_staged(spark, [f for f in shared.staged_folders() if f not in before])


def test_shuffle_files_go_with_the_step(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: {f for d in folders for f in Path(d).glob("*/shuffle_*.data")}
    before = held()
    assert len(shared.staged(spark.range(20_000).withColumn("k", F.col("id") % 7000).groupBy("k").count(), "t").collect()) == 7000
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before
    assert spark.conf.get(shared.CLEANUP) == "false"
