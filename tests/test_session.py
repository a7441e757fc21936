from pathlib import Path

from pyspark.sql import functions as F

from opsloom.llm.components import member_bitmap
from opsloom.llm.components import stored as stored_in
from opsloom.session import cut_lineage, stored, stored_meanwhile


def _shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in blocks.splitlines() if "/shuffle_" in x}


def test_stored_results_leave_no_shuffle_files(spark):
    counted = lambda n: spark.range(n).groupBy((F.col("id") % 97).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    for keep in (cut_lineage, stored, lambda df: stored_in(df, "kept"), lambda df: member_bitmap(df, "k")):
        before = _shuffle_files(spark)
        found = keep(counted(10_000))
        assert not _shuffle_files(spark) - before
        # What was stored can be read again and again.
        if hasattr(found, "agg"):
            assert [found.agg(F.sum("n")).first()[0] for _ in range(2)] == [10_000, 10_000]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_rows_stored_meanwhile_go_afterwards(spark):
    with stored_meanwhile(spark.range(5)) as kept:
        path = Path(kept.inputFiles()[0].removeprefix("file://")).parent
        assert kept.count() == 5 and path.exists()
    assert not path.exists()
