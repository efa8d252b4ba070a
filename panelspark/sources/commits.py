"""Artifacts on any file system that the session reaches: whole or not at all, replaced only while unchanged, kept as backups.

Tables are written by Spark beside their target, told by a digest that doesn't depend on the order of rows or files, and then
moved; a failed task or a lost race leaves the old artifact as it was. Single files are written beside their target and moved
over it. Moves are the file system's own; on stores that copy instead of moving they aren't atomic.
"""

from __future__ import annotations

import hashlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    """The qualified path and its file context."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    p = fs.Path(path)
    p = p.getFileSystem(conf).makeQualified(p)
    return p, fs.FileContext.getFileContext(p.toUri(), conf)


def exists(spark: SparkSession, path: str) -> bool:
    p, context = _path(spark, path)
    return context.util().exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, context = _path(spark, path)
    if context.util().exists(p):
        context.delete(p, True)


def move(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> None:
    """Rename; an existing target is an error unless it is to be replaced."""
    p, context = _path(spark, source)
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, int(overwrite))
    if overwrite:
        options[0] = rename.OVERWRITE
    try:
        context.rename(p, _path(spark, target)[0], options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            raise FileExistsError(target) from None
        raise


def _free(path: str):
    yield f"{path}.bak"
    n = 1
    while True:
        yield f"{path}.bak.{n}"
        n += 1


# --- single files -----------------------------------------------------------------------------------------------------


def file_digest(spark: SparkSession, path: str) -> str:
    """sha256 of a file's bytes, as they stream by."""
    p, context = _path(spark, path)
    stream = context.open(p)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, body: bytes) -> None:
    """A new file; FileExistsError where there is one."""
    p, _ = _path(spark, path)
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.newInstance(p.toUri(), spark._jsc.hadoopConfiguration())
    try:
        fs.setWriteChecksum(False)  # other tools may write these files too
        out = fs.create(p, False)
        for at in range(0, len(body), 1 << 20):
            out.write(bytearray(body[at : at + (1 << 20)]))
        out.close()
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            raise FileExistsError(path) from None
        raise
    finally:
        fs.close()


def put(spark: SparkSession, path: str, body: bytes) -> None:
    """Write a file whole or not at all, over what stands there."""
    part = f"{path}.part-{uuid.uuid4().hex}"
    try:
        _create(spark, part, body)
        move(spark, part, path, overwrite=True)
    finally:
        delete(spark, part)


def backup(spark: SparkSession, path: str) -> str:
    """A copy under the first free name of path.bak, path.bak.1, ...; never over an existing file."""
    p, context = _path(spark, path)
    part = f"{path}.part-{uuid.uuid4().hex}"
    context.util().copy(p, _path(spark, part)[0])
    try:
        for name in _free(path):
            try:
                move(spark, part, name)
                return name
            except FileExistsError:
                continue
    finally:
        delete(spark, part)


def replace_checked(spark: SparkSession, path: str, body: bytes, expected_sha256: str) -> str:
    """Replace a file only while it still is what it was when read; returns the backup's name."""
    if file_digest(spark, path) != expected_sha256:
        raise ValueError("file changed since it was read")
    kept = backup(spark, path)
    if file_digest(spark, kept) != expected_sha256 or file_digest(spark, path) != expected_sha256:
        raise ValueError("file changed while it was backed up")
    put(spark, path, body)
    return kept


# --- tables -----------------------------------------------------------------------------------------------------------


def table_digest(spark: SparkSession, path: str) -> str:
    """A digest of the lines of a folder as a multiset: their number and sums of slices of their hashes."""
    h = F.sha2("value", 256)
    sums = [F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(4)]
    got = spark.read.text(path).agg(F.count(F.lit(1)).alias("n"), *sums).first()
    return hashlib.sha256(",".join(str(v or 0) for v in got).encode()).hexdigest()


def publish(df: DataFrame, path: str, expected: str | None = None) -> tuple[str, str | None]:
    """Write rows as JSON lines; returns the artifact's digest and its predecessor's backup, if there was one.

    An existing artifact is replaced only if its digest is the expected one, before and after the rows are written; without an
    expected digest there must be none. Nulls are kept as nulls. Whatever fails, what stood there stays or comes back.
    """
    spark = df.sparkSession

    def check():
        there = exists(spark, path)
        if there and expected is None:
            raise FileExistsError(path)
        if expected is not None and not (there and table_digest(spark, path) == expected):
            raise ValueError("artifact changed since it was read")

    check()
    staged = f"{path}.part-{uuid.uuid4().hex}"
    try:
        df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")).write.text(staged)
        digest = table_digest(spark, staged)
        check()
        kept = None
        if expected is not None:
            for name in _free(path):
                try:
                    move(spark, path, name)
                    kept = name
                    break
                except FileExistsError:
                    continue
        try:
            move(spark, staged, path)
        except BaseException:
            if kept is not None and not exists(spark, path):
                move(spark, kept, path)
            raise
    finally:
        delete(spark, staged)
    return digest, kept
