"""Variant files as bytes: listing, the header from a file's first bytes, and the lines that begin in a range of bytes.

Tasks and the planner open files with pyarrow's file systems: local paths, and the URIs that these know (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatchcase
from posixpath import basename, dirname

import numpy as np
from pyarrow import fs

from .header import FormatError

#: Bytes that are read at once.
CHUNK = 4 << 20
_END = re.compile(rb"\r\n|\n|\r")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return (fs.LocalFileSystem(), path) if not re.match(r"/|[a-z][a-z0-9+.-]*:", path) else fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """Path and size of each file, by name: one file, those right below a folder, or those that a glob in the last part names.

    Names that begin with a dot or an underscore are left out, as Spark's own readers do.
    """
    system, place = opened(path.rstrip("/"))
    name = basename(place)
    if re.search(r"[*?\[]", name):
        found = [f for f in system.get_file_info(fs.FileSelector(dirname(place) or ".")) if fnmatchcase(f.base_name, name)]
        inside = [x for f in found if f.type == fs.FileType.Directory for x in system.get_file_info(fs.FileSelector(f.path))]
        found = [f for f in found if f.type == fs.FileType.File] + inside
    else:
        (info,) = system.get_file_info([place])
        if info.type == fs.FileType.NotFound:
            raise FormatError(f"No such file or folder: {path}")
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def header_lines_of(path: str, chunk: int = 1 << 16) -> tuple[list[str], int]:
    """A file's lines up to and with the first that is not metadata, and the byte after them. No more of the file is read than a chunk beyond."""
    system, place = opened(path)
    lines, at = [], 0
    with system.open_input_file(place) as stream:
        for own, starts, after in _read(stream, 0, stream.size(), chunk):
            for k, line in enumerate(own):
                lines.append(line.decode(errors="replace"))
                if not line.startswith(b"##"):
                    return lines, int(starts[k + 1]) if k + 1 < len(starts) else after
            at = after
    return lines, at


def lines_between(path: str, first: int, start: int, end: int) -> Iterator[list[bytes]]:
    """The lines that begin at or after `start` and before `end`, in lists. No line begins before `first`.

    Lines end as in text files: a line feed, a carriage return, or both. A line that the range before has begun is left to it.
    """
    system, place = opened(path)
    with system.open_input_file(place) as stream:
        if start > first:
            start = _next_start(stream, start)
        for own, starts, _ in _read(stream, start, end, CHUNK):
            n = int(np.searchsorted(starts, end))
            if n:
                yield own[:n]
            if n < len(own):
                return


def _next_start(stream, start: int) -> int:
    """Where the first line begins at or after start."""
    at = start - 1
    while True:
        stream.seek(at)
        data = stream.read(CHUNK)
        found = _END.search(data)
        if found and (found.end() < len(data) or not data.endswith(b"\r")):
            return at + found.end()
        if len(data) < CHUNK:
            return at + len(data)
        at += found.start() if found else len(data)


def _read(stream, start: int, end: int, chunk: int) -> Iterator[tuple[list[bytes], np.ndarray, int]]:
    """Lines from `start` on until one begins at or after `end`: lists of lines, where each begins, and the byte after the last."""
    stream.seek(start)
    tail, at = b"", start
    while at < end:
        data = stream.read(chunk)
        last = len(data) < chunk
        data = tail + data
        # A line is whole if its end is here; a carriage return may be half of one.
        stop = len(data) if last else max(data.rfind(b"\n"), data.rfind(b"\r", 0, max(0, len(data) - 1))) + 1
        tail = data[stop:]
        if stop:
            own = data[:stop].splitlines(keepends=True)
            starts = at + np.concatenate([[0], np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))])
            at += stop
            yield data[:stop].splitlines(), starts[:-1], at
        if last:
            return
