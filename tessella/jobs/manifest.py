"""Small JSON files that name what is published: claimed by one writer only, or replaced whole.

A claim needs a file system whose rename does not replace a file (HDFS and its like) or, for file: paths, links.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer was first."""


def claim(spark: SparkSession, path: str, content: dict) -> None:
    """Put a whole file at the path unless there is one; of several writers one succeeds, the others get Conflict."""
    own = _written(spark, path, content)
    try:
        if _is_local(path):
            os.link(_local(own), _local(path))
        else:
            _rename(spark, own, path, "NONE")
    except FileExistsError:
        raise Conflict(path) from None
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise Conflict(path) from None
        raise
    finally:
        remove(spark, own)


def replace(spark: SparkSession, path: str, content: dict) -> None:
    """Put a file at the path, whatever stood there; readers see the old one or the whole new one."""
    own = _written(spark, path, content)
    if _is_local(path):
        os.replace(_local(own), _local(path))
    else:
        _rename(spark, own, path, "OVERWRITE")


def content(spark: SparkSession, path: str) -> dict:
    system, where = _opened(spark, path)
    stream = system.open(where)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers that files of a folder bear, in order; none where there is no folder."""
    system, where = _opened(spark, folder)
    if not system.exists(where):
        return []
    names = (status.getPath().getName() for status in system.listStatus(where))
    return sorted(int(name[:-5]) for name in names if re.fullmatch(r"\d+\.json", name))


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; False where there was none."""
    system, where = _opened(spark, path)
    return system.delete(where, True)


def _written(spark: SparkSession, path: str, content: dict) -> str:
    own = f"{path.rpartition('/')[0]}/{uuid.uuid4().hex}.tmp"
    system, where = _opened(spark, own)
    stream = system.create(where, False)
    try:
        stream.write(bytearray(json.dumps(content, ensure_ascii=False, sort_keys=True).encode()))
    finally:
        stream.close()
    return own


def _opened(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _rename(spark: SparkSession, old: str, new: str, how: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(hadoop.Path(new).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = getattr(hadoop.Options.Rename, how)
    context.rename(hadoop.Path(old), hadoop.Path(new), options)


def _is_local(path: str) -> bool:
    return urlparse(path).scheme == "file"


def _local(path: str) -> str:
    return unquote(urlparse(path).path)
