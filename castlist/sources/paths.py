"""Paths as Spark writes them, and the file systems that Arrow knows for them."""

from __future__ import annotations

import posixpath
from functools import cache

from pyarrow import fs

# Names under which Spark reports the file systems that Arrow knows.
SCHEMES = {
    "file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3",
    "gs": "gs", "gcs": "gs", "abfs": "abfs", "abfss": "abfss",
}


def split_path(path: str) -> tuple[str, str, str]:
    """(scheme, authority, name) of a path as Spark writes it (unescaped)."""
    scheme, found, rest = path.partition(":/")
    if not found:
        return "file", "", path
    if not rest.startswith("/"):
        return scheme, "", "/" + rest
    authority, _, name = rest[1:].partition("/")
    return scheme, authority, "/" + name.lstrip("/")


@cache
def _file_system(scheme: str, authority: str) -> tuple[fs.FileSystem, str]:
    """A file system, made once in each process, and where its root lies in it."""
    if scheme not in SCHEMES:
        raise ValueError(f"no file system known for {scheme}:")
    if scheme == "file":
        return fs.LocalFileSystem(), "/"
    return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}://{authority}/")


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the name there."""
    scheme, authority, name = split_path(path)
    system, root = _file_system(scheme, authority)
    return system, posixpath.join(root, name.lstrip("/")) if name.startswith("/") else name
