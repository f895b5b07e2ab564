"""Intermediate tables."""

import time

from pyspark.sql import functions as F

from tideline.llm.common import Tables, checkpoint


def test_written_tables_leave_no_shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for f in range(files.getAllFiles().size()) if (name := files.getAllFiles().apply(f).getName()).startswith("shuffle_")}

    before, tables = shuffled(), Tables(spark)
    groups = [spark.range(1000).groupBy((F.col("id") % 7 + i).alias("k")).count() for i in range(2)]
    written = [tables(groups[0]), checkpoint(groups[1])]
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert [w.count() for w in written] == [7, 7] and groups[0].count() == 7
    tables.drop()
