"""Small files in a folder that all tasks share: what has been done, by whom, and whose turn it is.

Names are paths as Spark writes them. A file appears with its whole content or not at all. ``publish``
succeeds for one of several writers; it needs a file system that can do so: local ones (also
mounted network folders) link a finished file to its name, HDFS refuses to move onto an existing one. On other
file systems ``publish`` raises.
"""

from __future__ import annotations

import os
import posixpath
import uuid

from pyarrow import fs

from castlist.sources.paths import locate, split_path


def read(path: str) -> bytes | None:
    """The content of a file, None if there is none."""
    system, name = locate(path)
    try:
        with system.open_input_stream(name, compression=None) as stream:
            return stream.read()
    except FileNotFoundError:
        return None


def exists(path: str) -> bool:
    system, name = locate(path)
    return system.get_file_info(name).type != fs.FileType.NotFound


def names(folder: str) -> list[str]:
    """The finished files of a folder, in order; none if there is no folder."""
    system, name = locate(folder)
    found = system.get_file_info(fs.FileSelector(name, allow_not_found=True))
    return sorted(f"{folder}/{info.base_name}" for info in found if info.is_file and not info.base_name.startswith("_"))


def put(path: str, content: bytes) -> None:
    """Write a file; one that exists is replaced."""
    system, name = locate(path)
    system.move(_unfinished(system, name, content), name)


def publish(path: str, content: bytes) -> bool:
    """Write a file unless it exists; of several that try, one succeeds."""
    scheme = split_path(path)[0]
    if scheme not in ("file", "hdfs", "viewfs"):
        raise ValueError(f"files in {scheme}: cannot be created exclusively")
    system, name = locate(path)
    made = _unfinished(system, name, content)
    try:
        if scheme == "file":
            os.link(made, name)
        else:
            system.move(made, name)
            return True
    except OSError:
        if not exists(path):
            raise
        return False
    finally:
        if exists_in(system, made):
            system.delete_file(made)
    return True


def exists_in(system: fs.FileSystem, name: str) -> bool:
    return system.get_file_info(name).type != fs.FileType.NotFound


def remove(path: str) -> None:
    """Delete a file that may be gone already."""
    system, name = locate(path)
    try:
        system.delete_file(name)
    except FileNotFoundError:
        pass


def _unfinished(system: fs.FileSystem, name: str, content: bytes) -> str:
    folder, base = posixpath.split(name)
    system.create_dir(folder)
    made = posixpath.join(folder, f"_{base}.{uuid.uuid4().hex}")
    with system.open_output_stream(made, compression=None) as stream:
        stream.write(content)
    return made
