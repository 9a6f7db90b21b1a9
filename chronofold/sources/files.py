"""Small files and whole folders on whatever store Spark writes to, published so that a name is taken once.

All go through Hadoop's file systems, so a path may be local, shared or in an object store. What is published is
complete before it gets its name, and a name that is taken is never put over: of two writers at once one is told so.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def _rename(spark: SparkSession, fs, source, target) -> bool:
    """Give the name; False, and nothing moved, if it is taken."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        # Without options a rename neither replaces what is there nor moves into it.
        files.rename(source, target, spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
        return True
    except Exception:
        if fs.exists(target):
            return False
        raise


def exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _at(spark, path)
    return fs.exists(hpath)


def remove(spark: SparkSession, path: str) -> None:
    fs, hpath = _at(spark, path)
    fs.delete(hpath, True)


def _link(spark: SparkSession, source, target) -> bool | None:
    """On a local file system, give a file a second name, which one of any number of writers can do; None where links aren't known."""
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.java.nio.file.Path.of(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
    try:
        jvm.java.nio.file.Files.createLink(at(target), at(source))
        return True
    except Exception as problem:
        kind = problem.java_exception.getClass().getName() if hasattr(problem, "java_exception") else ""
        if kind == "java.nio.file.FileAlreadyExistsException":
            return False
        if kind == "java.lang.UnsupportedOperationException":
            return None
        raise


def publish(spark: SparkSession, path: str, data: bytes) -> bool:
    """A file of this content; False if the name is taken."""
    fs, target = _at(spark, path)
    local = fs.getScheme() == "file"
    # A local rename looks before it moves, and moves checksums apart: links are used there, and no checksum files.
    raw = fs.getRawFileSystem() if local and hasattr(fs, "getRawFileSystem") else fs
    staged = target.getParent().suffix(f"/.{target.getName()}.{uuid.uuid4().hex}")
    out = raw.create(staged, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    done = _link(spark, staged, target) if local else None
    if done is None:
        done = _rename(spark, fs, staged, target)
        if done:
            return True
    raw.delete(staged, False)
    return done


def publish_folder(spark: SparkSession, staged: str, path: str) -> bool:
    """Give a written folder its name; False, and the folder gone, if the name is taken."""
    fs, source = _at(spark, staged)
    _, target = _at(spark, path)
    fs.mkdirs(target.getParent())
    if _rename(spark, fs, source, target):
        return True
    fs.delete(source, True)
    return False


def read(spark: SparkSession, path: str) -> bytes:
    fs, hpath = _at(spark, path)
    stream = fs.open(hpath)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """The published names in a folder, in order; none if it isn't there."""
    fs, hpath = _at(spark, folder)
    if not fs.exists(hpath):
        return []
    found = (status.getPath().getName() for status in fs.listStatus(hpath))
    return sorted(n for n in found if not n.startswith((".", "_")))
