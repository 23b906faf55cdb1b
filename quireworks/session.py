"""Session settings the library is written for."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword, dots written as double underscores."""
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session whose executors run in the driver's own process (a local master, as in tests) takes its
    warehouse folder; any other session is refused, as its machines would not see each other's files.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = spark.conf.get("spark.sql.warehouse.dir")
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_dir(spark)}/quireworks/{name}-{uuid.uuid4().hex}"


#: Staged tables of this process that nobody has discarded yet
STAGED: list[str] = []


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    What a returned result still reads stays until discard() or discard_since() is told.
    """
    path = shared_path(df.sparkSession, name)
    STAGED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that no later step reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in STAGED:
            STAGED.remove(path)


def discard_since(spark: SparkSession, mark: int, *keep: str) -> None:
    """Delete what was staged since len(STAGED) was mark, but for the tables to keep."""
    discard(spark, *[p for p in STAGED[mark:] if p not in keep])
