"""Small files and folders through Hadoop's file systems, so that they lie where the data does."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """(file system, path) of an address, as objects of the JVM."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder. For folders of few entries."""
    system, where = _at(spark, path)
    if not system.exists(where):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(where))


def delete(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)


def modified_at(spark: SparkSession, path: str) -> float:
    """Seconds since 1970 of a file's last change."""
    system, where = _at(spark, path)
    return system.getFileStatus(where).getModificationTime() / 1000


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole of a small file, or None where there is none."""
    system, where = _at(spark, path)
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file, replacing one that is there."""
    system, where = _at(spark, path)
    stream = system.create(where, True)
    try:
        stream.write(data)
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file in one step: readers see the old text or the new one."""
    write_bytes(spark, f"{path}.new", text.encode())
    system, new = _at(spark, f"{path}.new")
    context = spark.sparkContext
    replace = getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = context._gateway.new_array(replace, 1)
    how[0] = replace.OVERWRITE
    files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else system.getUri(), context._jsc.hadoopConfiguration())
    files.rename(system.makeQualified(new), system.makeQualified(context._jvm.org.apache.hadoop.fs.Path(path)), how)


def arrow_system(address: str):
    """(pyarrow file system, path) of an address, for tasks, which have no JVM of their own to ask."""
    import pyarrow.fs as pafs

    address = address[5:] if address.startswith("file:/") and not address.startswith("file://") else address
    return (pafs.LocalFileSystem(), address) if address.startswith("/") else pafs.FileSystem.from_uri(address)
