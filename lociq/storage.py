"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session may make one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lociq-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, which goes when the driver's JVM ends."""
    base = f"{shared_dir(spark).rstrip('/')}/lociq-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return base


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _at(path: str):
    """(file system, path) of a path of any store that Spark reads."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(path: str) -> bool:
    fs, p = _at(path)
    return fs.exists(p)


def is_folder(path: str) -> bool:
    fs, p = _at(path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def names(folder: str) -> list[str]:
    """Names in a folder that are not hidden, sorted; a folder that is not there has none."""
    fs, p = _at(folder)
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in found if not n.startswith("."))


def size(path: str) -> int:
    """Bytes of a file or of all files in a folder; 0 if there is none."""
    fs, p = _at(path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def make_folder(path: str) -> None:
    fs, p = _at(path)
    fs.mkdirs(p)


def delete(path: str) -> None:
    fs, p = _at(path)
    fs.delete(p, True)


def write_text(path: str, body: str) -> None:
    """A small text file, written by the driver."""
    fs, p = _at(path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()
