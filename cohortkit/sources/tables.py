"""Read Parquet, keep a projected frame, cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def session(app_name: str = "cohortkit") -> SparkSession:
    """The running session, or a new one with the cluster's own settings."""
    return SparkSession.builder.appName(app_name).getOrCreate()


def load(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """Parquet files from any Hadoop file system; globs allowed.

    With a ``schema`` no file is opened before the query runs.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths)


def table(
    spark: SparkSession, directory: str, name: str, schema: str | None = None
) -> DataFrame:
    """One named table of a directory of Parquet tables."""
    return load(spark, f"{str(directory).rstrip('/')}/{name}.parquet", schema=schema)


def keep(df: DataFrame, columns: list[str]) -> DataFrame:
    """Persist only the named columns, spilling to disk.

    Persisting the full-width frame would make every later query read all of
    its columns. A block lost with its executor is rebuilt from the source.
    """
    return df.select(*columns).persist(StorageLevel.MEMORY_AND_DISK)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the cluster's shared folder and read it back.

    For frames that later steps must see unchanged (fixed row placement) or
    read many times. Survives the loss of any executor, is computed in one
    pass, and later steps read only the columns they need. The table stays
    until the folder is cleaned.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession) -> str:
    """A path that is not taken, in the cluster's shared folder."""
    return f"{_shared_folder(spark)}/cohortkit-{uuid.uuid4().hex}"


def discard(df: DataFrame) -> None:
    """Delete the table that ``cut_lineage`` wrote for ``df``; it can't be read afterwards."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        if folder.rpartition("/")[2].startswith("cohortkit-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def _machine_local(folder: str) -> bool:
    """Whether a folder is below this machine's own temporary one."""
    path = folder.removeprefix("file://").removeprefix("file:")
    own = tempfile.gettempdir().rstrip("/")
    return path.startswith("/") and f"{path}/".startswith(f"{own}/")


def _shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where unset and local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = named or spark.sparkContext.getCheckpointDir()
    local = spark.sparkContext.master.startswith("local")
    if folder is not None and (local or not _machine_local(folder)):
        return folder.rstrip("/")
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortkit-"))
    return spark.sparkContext.getCheckpointDir()
