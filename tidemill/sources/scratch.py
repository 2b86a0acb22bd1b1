"""Where steps that write and read again put their files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir. Where that is unset, a temporary folder serves a single machine; on a cluster it is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = _temporary(spark)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def _temporary(spark: SparkSession) -> str:
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-scratch-")
        atexit.register(shutil.rmtree, _own[app], True)
    return _own[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df from a table in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Removes what this process has put into the shared folder; DataFrames that read it can't be used any more."""
    while _made:
        remove_path(spark, _made.pop())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its own file system, local or remote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def has_partitions(spark: SparkSession, path: str, column: str) -> bool:
    """Whether a partitioned table has any partition."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}=*")
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where))


def remove_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def rename_path(spark: SparkSession, old: str, new: str) -> None:
    Path = spark._jvm.org.apache.hadoop.fs.Path
    if not Path(old).getFileSystem(spark._jsc.hadoopConfiguration()).rename(Path(old), Path(new)):
        raise OSError(f"{old} couldn't be renamed to {new}")


def make_dir(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's children; none of a missing folder's."""
    fs, where = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _file_system(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _file_system(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def rename_new(spark: SparkSession, old: str, new: str) -> bool:
    """Renames a file unless the new name is taken, in one step; whether it did."""
    jvm = spark._jvm
    Path = jvm.org.apache.hadoop.fs.Path
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_file_system(spark, new)[0].getUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(Path(old), Path(new), how)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True
