"""Small file operations on whatever file system holds the paths."""

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _file_system(spark, path)
    return fs.exists(target)


def write_pointer(spark: SparkSession, path: str, text: str) -> None:
    """Write a short text so that readers see the old or the new one, never a part."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, fs = _file_system(spark, path)
    draft, _ = _file_system(spark, f"{path}.draft-{text}")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(draft, target, options)


def read_pointer(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    return spark.read.text(path).first()[0]


def last_entry(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """Number and text of a log's last entry; (0, None) if it has none."""
    target, fs = _file_system(spark, folder)
    if not fs.exists(target):
        return 0, None
    numbers = [int(f.getPath().getName()) for f in fs.listStatus(target) if f.getPath().getName().isdigit()]
    return (max(numbers), spark.read.text(f"{folder}/{max(numbers):09d}").first()[0]) if numbers else (0, None)


def append_entry(spark: SparkSession, folder: str, number: int, text: str) -> bool:
    """Add entry ``number`` to a log, whole or not at all; False if it is there already.

    Entries are never replaced, so of two writers who saw the same last entry one wins and the other is told. The
    draft is renamed without overwriting, which is atomic on file systems whose rename is.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, fs = _file_system(spark, f"{folder}/{number:09d}")
    draft, _ = _file_system(spark, f"{folder}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = getattr(hadoop.Options.Rename, "NONE")
    try:
        context.rename(draft, target, options)
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True
