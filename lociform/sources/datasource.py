"""Variant text as a data source of Spark: `spark.read.format("vcf")` and `df.write.format("vcf")`, in batch and on streams.

Reading. The planner (or `read_vcf` for it, by the option `files`) lists the files, reads each header once from the file's first bytes and cuts the rest into ranges of bytes; a
task reads the lines that begin in its range. A schema names the columns that are wanted (SCHEMA has them all), and no other is
made. With the option `pushFilters`, filters on `file`, `chrom` and `pos` are pushed down: files are left out when planning, lines
before they are taken apart. Spark keeps what was pushed for all queries of a loaded DataFrame, so such a one is for one query; that
is why the option is off where it is not asked for. `rsidsOnly` leaves out records without an rs number, and holds for every query.

Writing. A task writes each output's lines to a file of its own in a temporary folder and reports it; the driver renames what
successful tasks report, or drops all of it. An output without a line still gets a file with its header. Rows that carry a `guard`
code fail the write with the least place among them: nothing of it appears.
"""

from __future__ import annotations

import json
import operator
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from .files import header_lines_of, lines_between, listed, opened
from .header import FormatError, Header, parse_header

#: All columns: where a line stands (range: where its range of bytes begins; nth: from 1 in that range; line_no: unknown, unless the
#: range is the file's first), the line, and its fields as they are written; pos is null where it is no 64-bit integer. `lines` counts
#: the lines of a range, header those before its file's records: with them each range is one row.
SCHEMA = (
    "file string, range long, nth long, line_no long, value string, chrom string, pos long, id string, ref string, alt string, "
    "qual string, filter string, info string, format string, samples array<string>"
)
COUNTS = "file string, range long, lines long, header long"
_FIELDS = {"chrom": 0, "id": 2, "ref": 3, "alt": 4, "qual": 5, "filter": 6, "info": 7, "format": 8}
_INTEGER, _RS = re.compile(rb"[+-]?[0-9]+"), re.compile(rb"rs[0-9]")
_COMPARE = {
    "EqualTo": operator.eq, "EqualNullSafe": operator.eq, "LessThan": operator.lt, "LessThanOrEqual": operator.le, "GreaterThan": operator.gt,
    "GreaterThanOrEqual": operator.ge, "In": lambda x, some: x in some, "StringStartsWith": str.startswith, "StringEndsWith": str.endswith,
}


def whole_number(text: bytes) -> int | None:
    """A signed 64-bit integer, or None."""
    if not _INTEGER.fullmatch(text):
        return None
    value = int(text)
    return value if -(1 << 63) <= value < 1 << 63 else None


def survey(path: str, wanted: Callable[[str], bool] = lambda file: True) -> tuple[Header | None, list[tuple[str, int, int, int, int]]]:
    """The first file's header, and of each file: path, size, where its records begin, lines of its header, and columns.

    Each header is read once, from the file's first bytes, and checked; all must have the same columns.
    """
    first, out = None, []
    files = [(file, size) for file, size in listed(path) if wanted(file)]
    for file, size in files:
        lines, at = header_lines_of(file)
        try:
            head = parse_header(lines)
        except FormatError as e:
            raise e if len(files) == 1 else FormatError(f"{file}: {e}") from None
        if first is not None and head.columns != first.columns:
            raise FormatError("The files have different columns")
        first = first or head
        out.append((file, size, at, head.lines, len(head.columns)))
    return first, out


@dataclass
class Range(D.InputPartition):
    """Bytes of a file: `first` is where its records begin, `header` how many lines are before that."""

    file: str
    first: int
    start: int
    end: int
    header: int
    columns: int


class VariantReader(D.DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = schema.names
        self.fields = pa.schema([pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in schema])
        self.path, self.split = options["path"], int(options.get("splitBytes", 128 << 20))
        self.rsids_only, self.pushes = (options.get(x, "false").lower() == "true" for x in ("rsidsOnly", "pushFilters"))
        self.surveyed = json.loads(options["files"]) if "files" in options else None
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        kept = []
        for f in filters:
            name, kind = getattr(f, "attribute", ("",)), type(f).__name__
            if self.pushes and len(name) == 1 and name[0] in ("file", "chrom", "pos") and kind in _COMPARE and f.value is not None:
                self.filters.append((name[0], kind, f.value))
            else:
                kept.append(f)
        # A comparison that is pushed leaves out nulls by itself.
        return [f for f in kept if not (isinstance(f, D.IsNotNull) and any(f.attribute == (x,) for x, _, _ in self.filters))]

    def _passes(self, name: str, value: object) -> bool:
        return all(value is not None and _COMPARE[kind](value, other) for n, kind, other in self.filters if n == name)

    def partitions(self) -> list[Range]:
        return self._ranges(lambda file: True) or [Range("", 0, 0, 0, 0, 0)]

    def _ranges(self, wanted: Callable[[str], bool]) -> list[Range]:
        files = self.surveyed if self.surveyed is not None else survey(self.path, wanted)[1]
        kept = [f for f in files if self._passes("file", f[0])]
        return [Range(file, first, s, min(s + self.split, size), lines, columns) for file, size, first, lines, columns in kept for s in range(first, max(size, first + 1), self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        if "lines" in self.names:
            n = sum(map(len, lines_between(partition.file, partition.first, partition.start, partition.end)))
            yield self._batch({"file": [partition.file], "range": [partition.start], "lines": [n], "header": [partition.header]}, 1)
            return
        before = 0
        for lines in lines_between(partition.file, partition.first, partition.start, partition.end):
            picked = self._picked(lines, partition.columns)
            nth = [before + k + 1 for k in picked] if picked is not None else list(range(before + 1, before + len(lines) + 1))
            own = lines if picked is None else [lines[k] for k in picked]
            before += len(lines)
            for at in range(0, len(own), 10_000):
                part, places = own[at : at + 10_000], nth[at : at + 10_000]
                yield self._batch(self._columns(part, places, partition), len(part))

    def _picked(self, lines: list[bytes], columns: int) -> list[int] | None:
        """Which lines pass the filters; None for all."""
        if not (self.rsids_only or any(n != "file" for n, _, _ in self.filters)):
            return None
        out = []
        for k, line in enumerate(lines):
            parts = line.split(b"\t", 3)
            if self._passes("chrom", parts[0].decode(errors="replace")) and self._passes("pos", whole_number(parts[1]) if len(parts) > 1 else None) and not (self.rsids_only and self._skipped(line, columns)):
                out.append(k)
        return out

    @staticmethod
    def _skipped(line: bytes, columns: int) -> bool:
        """True for a record without an rs number. The checks that come before that are made first, so a line that fails them stays."""
        parts = line.split(b"\t")
        sound = not line.startswith(b"#") and line.strip() and len(parts) == columns and all(parts[:8]) and whole_number(parts[1]) is not None
        return bool(sound) and (parts[2] == b"." or not _RS.search(parts[2]))

    def _columns(self, lines: list[bytes], nth: list[int], where: Range) -> dict[str, list]:
        n = len(lines)
        out: dict[str, list] = {"file": [where.file] * n, "range": [where.start] * n, "nth": nth, "value": lines}
        out["line_no"] = [where.header + k for k in nth] if where.start == where.first else [None] * n
        if set(self.names) - out.keys():
            parts = [x.split(b"\t") for x in lines]
            out["pos"] = [whole_number(p[1]) if len(p) > 1 else None for p in parts]
            out |= {name: [p[i] if len(p) > i else None for p in parts] for name, i in _FIELDS.items() if name in self.names}
            out["samples"] = [[x.decode(errors="replace") for x in p[9:]] for p in parts] if "samples" in self.names else []
        return out

    def _batch(self, columns: dict[str, list], n: int) -> pa.RecordBatch:
        made = [_text(columns[f.name]) if f.type == pa.string() else pa.array(columns.get(f.name, [None] * n), f.type) for f in self.fields]
        return pa.RecordBatch.from_arrays(made, schema=self.fields)


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}


def _text(values: list) -> pa.Array:
    """Bytes as text; what is no UTF-8 is replaced."""
    if values and isinstance(values[0], str):
        return pa.array(values, pa.string())
    raw = pa.array(values, pa.binary())
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([v if v is None else v.decode(errors="replace") for v in values], pa.string())


class VariantStreamReader(VariantReader, D.DataSourceStreamReader):
    """Files of a folder as they come, each whole, in the order of their names: a later file must have a later name."""

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max((file for file, _ in listed(self.path)), default="")}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for r in self._ranges(lambda file: start["last"] < file <= end["last"]) if r.file]

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(D.WriterCommitMessage):
    """What a task has written: (output, partition, temporary file), how many lines, and the least bad place (file, line number, code)."""

    files: list[tuple[int, int, str]] = field(default_factory=list)
    lines: int = 0
    bad: tuple[str, int, str] | None = None


class Sink:
    """Both writers: tasks write below a temporary folder of each output, the driver commits or aborts.

    Columns of the rows: value (a line), and if they are there output (its number, else 0), guard (a code, if the record must not be
    written), file and line_no (where it was read). Options: path or paths (JSON, a folder for each output), headers (JSON: a list of
    lines for each output).
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folders = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.headers = json.loads(options["headers"])
        if len(self.headers) != len(self.folders):
            raise FormatError("one header for each output")
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def _below(self, k: int, *parts: str) -> tuple[fs.FileSystem, str]:
        system, folder = opened(self.folders[k].rstrip("/"))
        return system, "/".join([folder, *parts])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task, streams, out = TaskContext.get(), {}, Written()
        try:
            for b in iterator:
                self._add(b, task, streams, out)
        finally:
            for stream in streams.values():
                stream.close()
        return out

    def _add(self, b: pa.RecordBatch, task: TaskContext, streams: dict, out: Written) -> None:
        names, none = b.schema.names, [None] * b.num_rows
        column = lambda name: b.column(name).to_pylist() if name in names else none
        guards = column("guard")
        if any(guards):
            found = min((f or "", n or 0, g) for f, n, g in zip(column("file"), column("line_no"), guards, strict=True) if g)
            out.bad = found if out.bad is None else min(found, out.bad)
        if out.bad is not None:
            return  # this write fails: only the least place still matters
        lines: dict[int, list[str]] = {}
        for k, text in zip(column("output"), column("value"), strict=True):
            lines.setdefault(k or 0, []).append(text)
        for k, own in lines.items():
            if k not in streams:
                system, folder = self._below(k, f"_temporary-{self.job}")
                system.create_dir(folder, recursive=True)
                name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.vcf"
                streams[k] = system.open_output_stream(name)
                out.files.append((k, task.partitionId(), name))
                streams[k].write(("\n".join(self.headers[k]) + "\n").encode())
            streams[k].write(("\n".join(own) + "\n").encode())
            out.lines += len(own)

    def abort(self, messages: list, *_) -> None:
        self._clear()

    def _clear(self) -> None:
        for k in range(len(self.folders)):
            system, folder = self._below(k, f"_temporary-{self.job}")
            if system.get_file_info([folder])[0].type == fs.FileType.Directory:
                system.delete_dir(folder)

    def _commit(self, messages: list[Written | None], prefix: str, always: bool) -> None:
        """Move what tasks report to names that begin with the prefix. always: also an output without lines gets a file."""
        done = [m for m in messages if m is not None]
        bad = min((m.bad for m in done if m.bad is not None), default=None)
        if bad is not None:
            self._clear()
            file, line, code = bad
            raise FormatError(f"{file + ': ' if file else ''}Cannot write record: {code}", line or None, "data")
        for k in range(len(self.folders)):
            system, folder = self._below(k)
            system.create_dir(folder, recursive=True)
            there = [f for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File]
            for f in there:
                if f.base_name.startswith(prefix) or self.overwrite and f.base_name.startswith(("part-", "_SUCCESS")):
                    system.delete_file(f.path)
            own = [name for _, name in sorted((p, name) for m in done for o, p, name in m.files if o == k)]
            for n, name in enumerate(own):
                system.move(name, f"{folder}/{prefix}{n:05d}.vcf")
            if not own and (always or not there):
                with system.open_output_stream(f"{folder}/{prefix}00000.vcf") as stream:
                    stream.write(("\n".join(self.headers[k]) + "\n").encode())
            with system.open_output_stream(f"{folder}/_SUCCESS"):
                pass
        self._clear()


class VariantWriter(Sink, D.DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages, "part-" if self.overwrite else f"part-{self.job[:8]}-", True)


class VariantStreamWriter(Sink, D.DataSourceStreamArrowWriter):
    """A batch that is written again, after a restart, replaces its own files."""

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._commit(messages, f"part-{batchId:08d}-", False)

    def abort(self, messages: list, batchId: int) -> None:
        self._clear()


class VariantSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "vcf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> VariantReader:
        return VariantReader(schema, self.options)

    def streamReader(self, schema: StructType) -> VariantStreamReader:
        return VariantStreamReader(schema, {"splitBytes": str(1 << 62), **self.options})  # a file is a range: its lines have their numbers

    def writer(self, schema: StructType, overwrite: bool) -> VariantWriter:
        return VariantWriter(self.options, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> VariantStreamWriter:
        return VariantStreamWriter(self.options, False)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VariantSource)
