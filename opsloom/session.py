"""Session helpers: recommended settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that suit both a laptop and a large cluster. The number of shuffle partitions is only a
# starting point: AQE coalesces small ones and splits skewed ones.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("opsloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local folder
    would lose the checkpoint together with its executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="opsloom-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Plans that are made meanwhile give their shuffle files back as soon as they have run.

    Spark otherwise keeps them until the driver happens to collect its garbage, and the shuffles of all steps of a query
    lie on the disks side by side. For results that are stored and read again, whose plans never run twice.
    """
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, used between the rounds of iterative operators."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def never_broadcast(df: DataFrame) -> DataFrame:
    """One side of a join that grows with the input: the join sorts and merges, whatever size this side is told as.

    Exploded, compressed or filtered rows may be told as far fewer bytes than they take, and a broadcast passes through
    the driver whole.
    """
    return df.hint("merge")


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the checkpoint folder as Parquet, for the rounds of loops that end by themselves.

    A checkpoint hands on the size that its plan was estimated at, and a join's is the product of its sides: fed back
    round by round, that number's digits double each time, until planning takes longer than the work. Files tell their
    own size.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_written(df))


def _written(df: DataFrame) -> str:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return path


@contextmanager
def stored_meanwhile(df: DataFrame) -> Iterator[DataFrame]:
    """The rows as `stored` gives them, until the block ends: then their files go."""
    path = _written(df)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
