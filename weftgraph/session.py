"""Session and checkpoint helpers shared by every module."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the files that a frame is made of, for each portion of ``spread``; frames of an unknown size count as nothing.
PORTION, UNKNOWN = 32 << 20, 1 << 60


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "weftgraph") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only where none is set and all is on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="weftgraph-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it again, so that lost executors cost no recomputation.

    A written table and not ``checkpoint()``: a checkpoint keeps the size that was estimated for its
    plan, which in a loop of joins is a product with ever more digits, until planning never ends. A
    table's size is known, so that what follows is planned by it. Columns without a type, which
    Parquet lacks, are checkpointed.
    """
    folder = checkpoint_dir(df.sparkSession)
    if "void" in df.schema.simpleString():
        return df.checkpoint(eager=True)
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def uncut(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote and that nothing will read again; other frames are left alone."""
    for df in tables:
        spark = df.sparkSession
        own, paths = checkpoint_dir(spark), df.inputFiles()
        folders = {p.rsplit("/", 1)[0] for p in paths}
        if len(folders) == 1 and (folder := folders.pop()).rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") == own.split(":", 1)[-1].lstrip("/"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` dealt by ``keys`` in portions whose size does not grow with the input; rows of one key that lie in several tasks go to several portions.

    For what follows a join and gathers rows by key: tasks after a join read as much as shuffled
    partitions are merged to, and an aggregate in them holds nearly all of those rows where keys are
    nearly unique. A given number of portions is not merged, and a hot key still meets in no single task.
    """
    sizes = [int(str(leaf.stats().sizeInBytes())) for leaf in _each(df._jdf.queryExecution().optimizedPlan().collectLeaves())]
    portions = max(df.sparkSession.sparkContext.defaultParallelism, -(-sum(x for x in sizes if x < UNKNOWN) // PORTION))
    return df.withColumn("__from", F.spark_partition_id()).repartition(portions, *keys, "__from").drop("__from")


def _each(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
