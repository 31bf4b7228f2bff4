"""Text files as a Spark data source, ``castlist_files``: every file is a row, and all files of a write appear together.

Reading lists the folders on the driver, names and sizes only, and deals the files out by size; tasks read them
in batches of a bounded size. The driver holds ``RUN_FILES`` names at most: more are sorted in runs on its disk, and what a task is to
read stands in a file of the shared folder (option ``listing``). Other file systems than local ones list a folder at once.
Other than Spark's binary source it has empty files and, if asked, hidden ones.

Writing is in two phases. Every task writes its files under names that no reader takes up, next to where they belong,
each batch after it has noted them in a list in the ``staging`` folder; only the names of the lists go to the driver. When all
tasks have succeeded, the driver writes these names down, and tasks of a second job (``castlist.sources.files``) go through the
lists and give the files their names. If one fails, or a path is in
a file system that cannot be reached, it leaves a mark at which tasks still running give up, and removes what any list names, so
nothing appears.

Files longer than a cell are read as segments by ``castlist_segments``: rows (path, seg_idx, text) for the operators on segments, cut at a
number of bytes and moved to the next character, so that tasks read parts of one file side by side. They are written by the same writer with
the option ``segments``: rows of one path that follow each other go to one file, as a stream.
"""

from __future__ import annotations

import fnmatch
import heapq
import json
import os
import posixpath
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from castlist.sources import shared
from castlist.sources.paths import locate, split_path

FORMAT = "castlist_files"
TASK_BYTES, TASK_FILES = 128 << 20, 10_000
BATCH_BYTES, BATCH_FILES = 16 << 20, 1000
# Names that the driver sorts at once, and how many such runs it keeps; names that go to the tasks without a file of their own.
RUN_FILES, RUNS, HELD_FILES = 100_000, 64, 10_000
_GLOB = re.compile(r"[*?\[]")
FILES = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])


def read_batches(paths: Iterator[str], content: bool = True) -> Iterator[pa.RecordBatch]:
    """(path, length, content) of files, in batches of about BATCH_BYTES; a larger file is a batch by itself."""
    rows: list[tuple] = []
    size = 0
    for path in paths:
        system, name = locate(path)
        if content:
            with system.open_input_stream(name, compression=None) as stream:
                data = stream.read()
            length = len(data)
        else:
            data, length = None, system.get_file_info(name).size
        if rows and (size + len(data or b"") > BATCH_BYTES or len(rows) >= BATCH_FILES):
            yield _batch(rows)
            rows, size = [], 0
        rows.append((path, length, data))
        size += len(data or b"")
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FILES)], schema=FILES)


def list_files(path: str, recursive: bool = False, hidden: bool = False) -> Iterator[tuple[str, int]]:
    """(path, size) of a file, of the files of a folder, or of those that a pattern matches, where ``*`` stays in a folder; in no order."""
    scheme, authority, name = split_path(path)
    prefix = f"{scheme}://{authority}" if authority else f"{scheme}:"
    system, _ = locate(path)
    pattern = None
    if _GLOB.search(name):
        parts = name.split("/")
        fixed = next(i for i, part in enumerate(parts) if _GLOB.search(part))
        pattern, name = parts[fixed:], "/".join(parts[:fixed]) or "/"
    root, local = locate(f"{prefix}{name}")[1], name.rstrip("/")
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"PATH_NOT_FOUND: {path}")
    if info.is_file:
        yield f"{prefix}{name}", info.size
        return
    deep = recursive or (pattern is not None and len(pattern) > 1)
    for below, size in _walk(system, root, deep):
        parts = below.split("/")
        if not hidden and any(part[0] in "._" for part in parts):
            continue
        if pattern is not None and not _matches(parts, pattern, recursive):
            continue
        yield f"{prefix}{local}/{below}", size


def _walk(system: fs.FileSystem, root: str, deep: bool) -> Iterator[tuple[str, int]]:
    """(name below the root, size) of the files of a folder, and of those below it."""
    folders = [""]
    while folders:
        folder = folders.pop()
        for name, is_file, is_folder, size in _entries(system, posixpath.join(root, folder)):
            below = posixpath.join(folder, name)
            if is_file:
                yield below, size
            elif deep and is_folder:
                folders.append(below)


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, bool, int]]:
    """(name, is file, is folder, size) of what is in a folder; from local ones one by one."""
    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(folder)):
            yield info.base_name, info.is_file, info.type == fs.FileType.Directory, info.size
        return
    with os.scandir(folder) as entries:
        for entry in entries:
            try:
                is_file = entry.is_file()
                yield entry.name, is_file, entry.is_dir(), entry.stat().st_size if is_file else 0
            except FileNotFoundError:  # gone meanwhile
                pass


def sorted_files(paths: list[str], wanted: dict[str, bool]) -> Iterator[tuple[str, int]]:
    """(path, size) of the files of all paths, each once, in order."""
    found = (file for path in paths for file in list_files(path, **wanted))
    run = sorted(islice(found, RUN_FILES))
    if len(run) < RUN_FILES:
        yield from _once(run)
        return
    with tempfile.TemporaryDirectory(prefix="castlist-listing-") as folder:
        runs = []
        while run:
            runs.append(_write_run(folder, run))
            if len(runs) == RUNS:
                runs = [_write_run(folder, heapq.merge(*map(_read_run, runs)))]
            run = sorted(islice(found, RUN_FILES))
        yield from _once(heapq.merge(*map(_read_run, runs)))


def _once(files: Iterable[tuple[str, int]]) -> Iterator[tuple[str, int]]:
    for _, same in groupby(files, key=itemgetter(0)):
        yield next(same)


def _write_run(folder: str, run: Iterable[tuple[str, int]]) -> str:
    name = f"{folder}/{uuid.uuid4().hex}"
    with open(name, "w") as out:
        out.writelines(json.dumps(file) + "\n" for file in run)
    return name


def _read_run(name: str) -> Iterator[tuple[str, int]]:
    with open(name) as lines:
        for line in lines:
            yield tuple(json.loads(line))


def _noted(names: list, listing: str | None, before: int) -> tuple[list, str | None]:
    """What a task is to read, or the file that has it, given how much other tasks have been told."""
    if listing is None or before + len(names) <= HELD_FILES:
        return names, None
    target = f"{listing}/{uuid.uuid4().hex}.json"
    shared.put(target, "\n".join(map(json.dumps, names)).encode())
    return [], target


def _told(names: list, listed: str | None) -> list:
    if listed is None:
        return names
    content = shared.read(listed)
    if content is None:
        raise FileNotFoundError(f"the list of files {listed} is gone")
    return [json.loads(line) for line in content.decode().split("\n")]


def _matches(parts: list[str], pattern: list[str], recursive: bool) -> bool:
    if len(parts) < len(pattern) or (len(parts) > len(pattern) and not recursive):
        return False
    return all(fnmatch.fnmatchcase(part, p) for part, p in zip(parts, pattern))


class Files(DataSource):
    """Options for reading: paths (a JSON list), recursive, hidden, content, listing; for writing: staging, segments."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, length bigint, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FileReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FileWriter(self.options["staging"], self.options.get("segments", "false") == "true")


@dataclass
class Share(InputPartition):
    """The files of a task, or the list that names them."""

    paths: list[str]
    listed: str | None = None


class FileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        wanted = {name: options.get(name, "false") == "true" for name in ("recursive", "hidden")}
        self.paths, self.wanted = json.loads(options["paths"]), wanted
        self.content = options.get("content", "true") == "true"
        self.listing = options.get("listing")

    def partitions(self) -> Sequence[InputPartition]:
        shares, told = [], 0
        for paths in self._shares():
            shares.append(Share(*_noted(paths, self.listing, told)))
            told += len(paths)
        return shares

    def _shares(self) -> Iterator[list[str]]:
        paths, size = [], 0
        for path, n in sorted_files(self.paths, self.wanted):
            if paths and (size + n > TASK_BYTES or len(paths) >= TASK_FILES):
                yield paths
                paths, size = [], 0
            paths.append(path)
            size += n
        yield paths

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return read_batches(iter(_told(partition.paths, partition.listed)), self.content)


class Segments(DataSource):
    """Options: paths (a JSON list), recursive, hidden, size, listing."""

    @classmethod
    def name(cls) -> str:
        return "castlist_segments"

    def schema(self) -> str:
        return "path string, seg_idx int, text string, reason string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SegmentReader(dict(self.options))


@dataclass
class Stretches(InputPartition):
    """The segments of a task, (path, length of the file, first segment, end), or the list that names them."""

    parts: list[tuple[str, int, int, int]]
    listed: str | None = None


# The bytes of the mark that files may begin with, and the most that a character has after its first byte.
UTF8_MARK, MOST_AFTER = b"\xef\xbb\xbf", 3


class SegmentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.listed = FileReader(options)
        self.size = int(options["size"])

    def partitions(self) -> Sequence[InputPartition]:
        shares, told = [], 0
        for parts in self._shares():
            shares.append(Stretches(*_noted(parts, self.listed.listing, told)))
            told += len(parts)
        return shares

    def _shares(self) -> Iterator[list[tuple[str, int, int, int]]]:
        step = max(1, TASK_BYTES // self.size)
        parts, held = [], 0
        for path, length in sorted_files(self.listed.paths, self.listed.wanted):
            count = max(1, -(-length // self.size))
            for first in range(0, count, step):
                end = min(first + step, count)
                n = min(end * self.size, length) - first * self.size
                if parts and (held + n > TASK_BYTES or len(parts) >= TASK_FILES):
                    yield parts
                    parts, held = [], 0
                parts.append((path, length, first, end))
                held += n
        yield parts

    def read(self, partition: Stretches) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for path, length, first, end in _told(partition.parts, partition.listed):
            system, name = locate(path)
            with system.open_input_file(name) as file:
                for k in range(first, end):
                    rows.append((path, k, *segment_text(file.read_at, length, self.size, k)))
                    held += self.size
                    if held >= BATCH_BYTES:
                        yield _segments(rows)
                        rows, held = [], 0
        if rows:
            yield _segments(rows)


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["path", "seg_idx", "text", "reason"])


def segment_text(read_at: Callable[[int, int], bytes], length: int, size: int, k: int) -> tuple[str | None, str | None]:
    """(text, reason) of segment k of a UTF-8 file: its characters are those that begin within its bytes."""
    start, end = min(k * size, length), min((k + 1) * size, length)
    # Bytes of a character that has begun before belong to the segment before; what goes on behind the end belongs to this one.
    data = read_at(min(end + MOST_AFTER, length) - start, start)
    first = last = 0
    while k and first < min(MOST_AFTER, len(data)) and data[first] & 0xC0 == 0x80:
        first += 1
    last = end - start
    while last < len(data) and data[last] & 0xC0 == 0x80:
        last += 1
    if k == 0 and data.startswith(UTF8_MARK):
        first = len(UTF8_MARK)
    try:
        return data[min(first, last) : last].decode(), None
    except UnicodeDecodeError:
        return None, "not valid as utf-8"


@dataclass
class Staged(WriterCommitMessage):
    """A task's lists of unfinished files, and how many files there are."""

    lists: list[str]
    files: int


class Aborted(Exception):
    """Another task has failed."""


class FileWriter(DataSourceArrowWriter):
    def __init__(self, staging: str, segments: bool = False):
        self.staging, self.segments = staging, segments
        self.folders: set[str] = set()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        if self.segments:
            return self._write_segments(iterator)
        mark, lists, files = uuid.uuid4().hex, [], 0
        for batch in iterator:
            paths = batch.column("path").to_pylist()
            pairs = [(f"{_hidden(path)}.{mark}.{files + k}", path) for k, path in enumerate(paths)]
            lists.append(f"{self.staging}/{mark}-{len(lists)}.json")
            shared.put(lists[-1], "\n".join(map(json.dumps, pairs)).encode())
            self._go_on(lists)
            for (unfinished, _), content in zip(pairs, batch.column("content")):
                with self._open(unfinished) as stream:
                    stream.write(content.as_buffer() if content.is_valid else b"")
            files += len(pairs)
        self._go_on(lists)
        return Staged(lists, files)

    def _write_segments(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Rows of one path, which follow each other, into one file."""
        mark, lists, files, now, stream = uuid.uuid4().hex, [], 0, object(), None
        try:
            for batch in iterator:
                self._go_on(lists)
                paths = batch.column("path").to_pylist()
                # The files that begin in a batch share a list.
                begun = [path for before, path in zip([now, *paths], paths) if path != before]
                pairs = [(f"{_hidden(path)}.{mark}.{files + k}", path) for k, path in enumerate(begun)]
                if pairs:
                    lists.append(f"{self.staging}/{mark}-{len(lists)}.json")
                    shared.put(lists[-1], "\n".join(map(json.dumps, pairs)).encode())
                waiting = iter(pairs)
                for path, content in zip(paths, batch.column("content")):
                    if path != now:
                        if stream is not None:
                            stream.close()
                        now, stream = path, self._open(next(waiting)[0])
                    stream.write(content.as_buffer() if content.is_valid else b"")
                files += len(pairs)
        finally:
            if stream is not None:
                stream.close()
        self._go_on(lists)
        return Staged(lists, files)

    def _open(self, path: str) -> pa.NativeFile:
        """A new file, in a folder that is made if need be."""
        system, name = locate(path)
        folder = f"{path.removesuffix(name)}\0{posixpath.dirname(name) or '.'}"
        if folder not in self.folders:
            system.create_dir(posixpath.dirname(name) or ".")
            self.folders.add(folder)
        return system.open_output_stream(name, compression=None)

    def _go_on(self, lists: list[str]) -> None:
        if shared.exists(f"{self.staging}/aborted"):
            for listed in lists:
                _remove(listed)
            raise Aborted("another task has failed")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        staged = [message for message in messages if message is not None]
        lists = [name for message in staged for name in message.lists]
        total = sum(message.files for message in staged)
        shared.put(f"{self.staging}/total", json.dumps({"files": total, "lists": lists}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shared.put(f"{self.staging}/aborted", b"")
        for name in shared.names(self.staging):
            if name.endswith(".json"):
                _remove(name)


def _hidden(path: str) -> str:
    folder, _, base = path.rpartition("/")
    return f"{folder}/_{base}" if folder or path.startswith("/") else f"_{base}"


def _pairs(listed: str) -> list[tuple[str, str]]:
    return [tuple(json.loads(line)) for line in (shared.read(listed) or b"").decode().split("\n") if line]


def finish(listed: str) -> None:
    """Give the files of a list their names; those that have them already, from a task that was lost, stay."""
    for unfinished, path in _pairs(listed):
        system, name = locate(unfinished)
        try:
            system.move(name, locate(path)[1])
        except FileNotFoundError:
            if not shared.exists(path):
                raise


def _remove(listed: str) -> None:
    for unfinished, _ in _pairs(listed):
        try:
            shared.remove(unfinished)
        except ValueError:  # a path that cannot be reached has no file
            pass
