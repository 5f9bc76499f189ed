"""Byte access to the shared file system from inside tasks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

from tilespark.session import checkpoint_dir


def open_filesystem(uri: str):
    """File system and path of a location; plain paths and file: URIs are mounted storage."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_bytes(uri: str, payload: bytes) -> None:
    """Write a whole file under a temporary name, then rename it, so a lost or repeated task never
    leaves half a file behind."""
    filesystem, path = open_filesystem(uri)
    filesystem.create_dir(os.path.dirname(path), recursive=True)
    staged = f"{path}.{uuid.uuid4().hex}.tmp"
    with filesystem.open_output_stream(staged, compression=None) as out:
        out.write(payload)
    filesystem.move(staged, path)


def get_bytes(uri: str) -> bytes:
    filesystem, path = open_filesystem(uri)
    with filesystem.open_input_stream(path, compression=None) as src:
        return src.read()


def open_random(uri: str):
    """Random-access reader of a file."""
    filesystem, path = open_filesystem(uri)
    return filesystem.open_input_file(path)


def open_stream(uri: str):
    """Sequential reader of a file's stored bytes."""
    filesystem, path = open_filesystem(uri)
    return filesystem.open_input_stream(path, compression=None)


def qualified(spark: SparkSession, path: str) -> str:
    """Location with its scheme, so Spark and tasks mean the same storage."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
