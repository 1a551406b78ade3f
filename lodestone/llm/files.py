"""Whole files written and read by executors, on any shared file system.

Spark's own writers make tables only. A file here is first written under a
name of its own and then renamed, so a task that dies leaves no half file under
a final name; the caller's index names the files of the tasks that ended.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def _local(path: str) -> str | None:
    parsed = urlparse(path)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


def _remote(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def make_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)


def write(path: str, body: bytes) -> None:
    local = _local(path)
    if local is None:
        system, at = _remote(path)
        part = f"{at}.{uuid.uuid4().hex[:8]}.part"
        with system.open_output_stream(part) as f:
            f.write(body)
        system.move(part, at)
        return
    part = f"{local}.{uuid.uuid4().hex[:8]}.part"
    with open(part, "wb") as f:
        f.write(body)
    os.replace(part, local)


def open_read(path: str):
    """A seekable binary reader."""
    local = _local(path)
    if local is None:
        system, at = _remote(path)
        return system.open_input_file(at)
    return open(local, "rb")
