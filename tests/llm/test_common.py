import os
import time

from stowage.llm.common import kept, release, scratch_of, staged, stored
from stowage.session import shared_folder


def test_staged_rows_come_back_and_can_be_released(spark):
    df = staged(spark.range(5).selectExpr("id", "cast(null as string) as s"), "t")
    assert df.count() == 5 and df.schema["s"].dataType.simpleString() == "string"
    folder = f"{shared_folder(spark)}/stowage-{spark.sparkContext.applicationId}"
    assert os.path.isdir(folder)
    release(spark)
    assert not os.path.isdir(folder)


def test_scratch_goes_and_what_is_stored_stays(spark):
    with scratch_of(spark, "stage"):
        inner = staged(spark.range(3).toDF("id"), "inner")
        outer = stored(inner, "outer")
        path = inner.inputFiles()[0]
    assert outer.count() == 3 and not os.path.exists(path.removeprefix("file://").removeprefix("file:"))


def test_kept_rows_go_with_the_outer_scratch(spark):
    with scratch_of(spark, "outer"):
        with scratch_of(spark, "inner"):
            df = kept(spark.range(3).toDF("id"), "result")
        path = df.inputFiles()[0].removeprefix("file://").removeprefix("file:")
        assert df.count() == 3
    assert not os.path.exists(path)


def test_staging_leaves_no_shuffle_files_and_the_setting_as_it_was(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    blocks = lambda: str(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()).count("shuffle_")
    before, had = spark.conf.get(key), blocks()
    df = staged(spark.range(100_000).selectExpr("id % 1000 as k").groupBy("k").count(), "counted")
    ends = time.time() + 10
    while blocks() > had and time.time() < ends:
        time.sleep(0.1)
    assert blocks() <= had
    assert df.count() == 1000
    assert spark.conf.get(key) == before
