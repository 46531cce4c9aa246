"""Small files and folders on any file system that Spark reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name in the cluster's shared folder (spark.checkpoint.dir); without one, in local mode alone, in a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str) -> tuple:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    own, fs = _at(spark, path)
    fs.delete(own, True)


def make(spark: SparkSession, path: str) -> None:
    own, fs = _at(spark, path)
    fs.mkdirs(own)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    own, fs = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(own)) if fs.exists(own) else []


def read_text(spark: SparkSession, path: str) -> str:
    own, fs = _at(spark, path)
    stream = fs.open(own)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file under another name first, so that it appears whole or not at all; FileExistsError if it exists."""
    own, fs = _at(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(own.getParent(), f".{own.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename(spark, draft.toString(), path)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file or folder in one step; FileExistsError, and the source goes, if the target exists."""
    own, fs = _at(spark, source)
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(own, to, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:
        exists = fs.exists(to)
        fs.delete(own, True)
        if exists:
            raise FileExistsError(target) from error
        raise
