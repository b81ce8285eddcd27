"""Byte access from tasks to the shared folder, for files that Spark itself has no writer or range reader for."""

from __future__ import annotations

import pyarrow.fs as pafs


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder named by URI (file, hdfs, s3, gs, abfs) or by absolute path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)
