"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it back, so that a lost executor costs
nothing that was already computed.  The setting is read from the session; only where it is unset (tests, a laptop) is a
folder of our own made, and then only for a local master.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one for a local master without that setting."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _own.append(tempfile.mkdtemp(prefix="feedmill-"))
    at = "file://" + _own[-1]
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for a table; removed when the interpreter ends."""
    path = f"{shared_dir(spark)}/feedmill/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _at(spark: SparkSession, path: str):
    """(file system, path object, configuration) of a path on any file system that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return where.getFileSystem(conf), where, conf


def remove(spark: SparkSession, path: str) -> None:
    fs, where, _ = _at(spark, path)
    fs.delete(where, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    fs, where, _ = _at(spark, path)
    return fs.getContentSummary(where).getLength()


def get_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    fs, where, _ = _at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file: written beside it, then moved over it, so that readers see the old text or the new one."""
    fs, new, conf = _at(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(new, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    gateway, hadoop = spark.sparkContext._gateway, spark.sparkContext._jvm.org.apache.hadoop.fs
    how = gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(hadoop.Path(path)), how)


def release(spark: SparkSession) -> None:
    """Removes what this process has written for a session; call it before the session is stopped."""
    mine = [m for m in _made if m[0] is spark]
    for m in mine:
        remove(*m)
        _made.remove(m)


def _remove_all() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session has ended: a folder of our own is removed below, a shared one by its owner
            break
    for at in _own:
        shutil.rmtree(at, ignore_errors=True)


atexit.register(_remove_all)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back.select(*df.columns)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as the session has cores, where a small table would come in fewer; a large one stays as it is.

    Meant for scans: to count the tasks of a plan with shuffles would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
