"""Reading variant text: from lines, from a file, and from a stream of text."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grammar as G
from ..functions import record as R
from ..functions import typed as T
from . import datasource
from .header import FormatError, Header, parse_header

#: What the codes of malformed lines say.
MESSAGES = {
    "COMMENT": "a line after the header begins with #", "BLANK": "the line is blank", "COLUMN_COUNT": "the line has not as many columns as the header", "EMPTY_FIELD": "one of the first eight columns is empty",
    "POS_NUMBER": "POS is no 64-bit integer", "CHROM_WHITESPACE": "CHROM has whitespace", "POS_NEGATIVE": "POS is negative", "ID_CHARACTER": "an ID has whitespace or a semicolon", "ID_DUPLICATE": "an ID stands twice",
    "REF_GRAMMAR": "REF has other characters than A, C, G, T, N", "ALT_GRAMMAR": "an ALT is no allele", "ALT_MISSING_COMBINED": "a missing ALT stands beside others", "FILTER_WHITESPACE": "a FILTER has whitespace",
    "FILTER_ZERO": "0 is a reserved FILTER", "FILTER_COMBINED": "PASS or the missing value stands beside other FILTERs", "FORMAT_KEY": "a FORMAT key has a wrong name", "FORMAT_DUPLICATE": "a FORMAT key stands twice",
    "FORMAT_GT_FIRST": "GT is not the first FORMAT key", "SAMPLE_TOO_LONG": "a sample has more values than FORMAT has keys",
}
MODES = ("FAILFAST", "PERMISSIVE", "DROPMALFORMED")
Out = TypeVar("Out")


def rsid_skip(parts: Column) -> Column:
    """True for lines that the rs-number filter leaves out: no ID, or none that has an rs number."""
    raw = F.get(parts, F.lit(2))
    return (raw == ".") | ~raw.rlike(G.RSID)


def from_lines(lines: DataFrame, header: Header | None = None, rsids_only: bool = False, mode: str = "PERMISSIVE") -> DataFrame:
    """Records of a DataFrame with `value` (a data line) and, if it has one, `line_no`; other columns pass through.

    PERMISSIVE keeps malformed lines with an `error` code, DROPMALFORMED leaves them out, FAILFAST raises at the first one
    that a task meets. INFO and QUAL are not checked here: their errors show when they are read. qual_raw, info_raw and
    samples_raw are the text as it was read, which edits of the other columns do not change.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    header = header or Header()
    n, samples = len(header.columns), len(header.samples)
    at = lambda i: F.get(F.col("parts"), F.lit(i))

    # Generators, not projections: a line is split once, however many fields are read of it, and a filter does not repeat the split.
    once = lambda c: F.explode(F.array(c))
    cut = lines.select("*", once(R.fields(F.col("value"))).alias("parts"))
    cut = cut.withColumn("keys", once(R.fields(at(8), ":")) if n > 8 else F.array().cast("array<string>"))
    skipped = rsid_skip(F.col("parts")) if rsids_only else None
    error = R.first_error(F.col("value"), F.col("parts"), F.col("keys"), n, samples, skipped)
    if rsids_only or mode == "DROPMALFORMED":
        cut = cut.withColumn("error", once(error))
        if rsids_only:
            cut = cut.filter(F.col("error").isNotNull() | ~F.coalesce(skipped, F.lit(True)))
        if mode == "DROPMALFORMED":
            cut = cut.filter(F.col("error").isNull())
    else:
        cut = cut.withColumn("error", error)
    if mode == "FAILFAST":
        number = F.concat(F.lit("[Line #"), F.col("line_no"), F.lit("] ")) if "line_no" in lines.columns else F.lit("")
        text = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])[F.col("error")]
        said = F.concat(number, F.lit("Error parsing data: "), text, F.lit(" ("), F.col("error"), F.lit(")"))
        cut = cut.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(said).cast("string")))
    keys = F.col("keys")
    texts = F.slice("parts", 10, samples) if samples else F.array().cast("array<string>")
    values = F.transform(texts, lambda s: R.sample_values(s, keys)) if samples else F.array().cast("array<array<string>>")
    return cut.select(
        *[c for c in lines.columns if c not in ("value",)], at(0).alias("chrom"), R.position(at(1)).alias("pos"), R.list_field(at(2), ";").alias("ids"), at(3).alias("ref"),
        R.list_field(at(4), ",").alias("alts"), at(5).alias("qual_raw"), T.qual(at(5)).alias("qual"), R.filters(at(6)).alias("filters"), R.filters_applied(at(6)).alias("filters_applied"),
        at(7).alias("info_raw"), R.info(at(7)).alias("info"), keys.alias("format"), values.alias("samples"), texts.alias("samples_raw"), "error", R.warnings(F.col("parts"), samples).alias("warnings"),
    )


#: A row per file block that is broadcast is well below a kilobyte, so this many stay below a hundred megabytes.
_BLOCKS = 100_000


def _text(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block (where its split begins) and mid, which grows along a split. Nothing may stand between scan and mid."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))


def _beside(scan: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """scan with the columns of a table that has a row per file or block; that is broadcast unless there may be too many of them."""
    few = scan.rdd.getNumPartitions() + len(scan.inputFiles()) <= _BLOCKS
    return scan.join(F.broadcast(small) if few else small, keys)


def _starts(scan: DataFrame) -> DataFrame:
    """file, block and shift: what added to mid gives a line's number. A pass that only counts."""
    blocks = scan.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """value, file, line_no (from 1, per file): counts of each file block place its lines, so no line is shuffled."""
    scan = _text(spark, path)
    return _beside(scan, _starts(scan), ["file", "block"]).select("value", "file", (F.col("mid") + F.col("shift")).alias("line_no"))


def header_texts(spark: SparkSession, path: str) -> DataFrame:
    """file and lines: each file's lines up to and with the first that is not metadata, in order. No other line is shuffled."""
    at = F.struct("block", "mid").alias("at")
    scan = _text(spark, path).select("value", "file", at)
    meta = F.col("value").startswith("##")
    ends = scan.groupBy("file").agg(F.min(F.when(~meta, F.col("at"))).alias("end"))
    head = _beside(scan, ends, ["file"]).filter(F.when(meta, F.col("end").isNull() | (F.col("at") < F.col("end"))).otherwise(F.col("at") == F.col("end")))
    return head.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("lines"))


def read_header(spark: SparkSession, path: str) -> Header:
    """The header of one file, or of the first by name."""
    first = header_texts(spark, path).orderBy("file").limit(1).collect()
    return parse_header(first[0]["lines"] if first else [])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, header_lines, columns and error of each header, parsed where it is."""
    for b in batches:
        rows = []
        for lines in b.column("lines").to_pylist():
            try:
                head = parse_header(lines)
                rows.append((head.lines, "\t".join(head.columns), None))
            except FormatError as e:
                rows.append((0, None, str(e)))
        yield pa.RecordBatch.from_arrays([b.column("file"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string())))], names=["file", "header_lines", "columns", "error"])


def read_vcf(spark: SparkSession, path: str, rsids_only: bool = False, mode: str = "FAILFAST", line_numbers: bool = True, split_bytes: int = 128 << 20) -> tuple[Header, DataFrame]:
    """Header and records of uncompressed files: one, a folder or a glob whose name ends in `.vcf`. Text is read once, by the `vcf` data source.

    Each file's header is read once, from its first bytes, and checked; the rest is cut to ranges of `split_bytes`. All files must have the same columns, and the
    header that is returned is that of the first file by name. Records have their file and line_no; without line_numbers, range
    and nth tell their place. Only where a file has several ranges do line numbers need the lines of each to be counted first.
    rsids_only is pushed into the source. FAILFAST raises at the first bad line that a task meets; `checked` raises at the first one
    of the files, in the same pass as what reads the records.
    """
    _named(path)
    datasource.register(spark)
    header, files = datasource.survey(path)
    if header is None:
        raise FormatError("The file is empty", 0, "metadata")  # a folder without files
    options = {"splitBytes": split_bytes, "rsidsOnly": rsids_only, "files": json.dumps(files)}
    source = lambda schema: spark.read.format("vcf").schema(schema).options(**options).load(path)
    lines = source("file string, range long, nth long, line_no long, value string")
    if line_numbers and any(size - first > split_bytes for _, size, first, _, _ in files):  # a file of one range has its numbers from the source
        ranges = source(datasource.COUNTS)  # a row per range
        before = F.sum("lines").over(Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
        heads = F.first("header").over(Window.partitionBy("file").orderBy("range"))
        starts = ranges.select("file", "range", (F.coalesce(before, F.lit(0)) + heads).alias("before"))
        lines = lines.join(_few(starts, lines), ["file", "range"]).select("value", "file", (F.col("nth") + F.col("before")).alias("line_no"))
    return header, from_lines(lines.select("value", "file", *(["line_no"] if line_numbers else ["range", "nth"])), header, rsids_only, mode)


def _named(path: str) -> None:
    if not path.rstrip("/").endswith(".vcf"):
        raise FormatError(f"Not a .vcf file: {path}")


def _few(small: DataFrame, scan: DataFrame) -> DataFrame:
    """A table with a row per range: broadcast, unless there may be too many of them."""
    return F.broadcast(small) if scan.rdd.getNumPartitions() <= _BLOCKS else small


def read_text(spark: SparkSession, path: str, rsids_only: bool = False, mode: str = "FAILFAST") -> tuple[Header, DataFrame]:
    """`read_vcf` by Spark's own text reader, for stores that only Spark can open. Headers are found by passes over the text."""
    if not path.rstrip("/").endswith(".vcf"):
        raise FormatError(f"Not a .vcf file: {path}")
    heads = header_texts(spark, path).mapInArrow(_checked, "file string, header_lines long, columns string, error string")
    first, last, errors = heads.agg(F.min("columns"), F.max("columns"), F.min(F.when(F.col("error").isNotNull(), F.struct("file", "error")))).first()
    header = read_header(spark, path)
    if errors is not None:
        raise FormatError(f"{errors['file']}: {errors['error']}")
    if first != last:
        raise FormatError("The files have different columns")
    scan = _text(spark, path)
    starts = _starts(scan).join(heads.select("file", "header_lines"), "file")
    lines = _beside(scan, starts, ["file", "block"]).select("value", "file", (F.col("mid") + F.col("shift")).alias("line_no"), "header_lines")
    return header, from_lines(lines.filter(F.col("line_no") > F.col("header_lines")).drop("header_lines"), header, rsids_only, mode)


def first_failure(rows: DataFrame) -> FormatError | None:
    """The error of the smallest line (of the first file by name) among rows of PERMISSIVE mode, with its line number and text."""
    place = [c for c in ("file", "line_no") if c in rows.columns]
    found = rows.filter(F.col("error").isNotNull()).agg(F.min(F.struct(*place, "error")).alias("e")).first()["e"]
    if found is None:
        return None
    return FormatError(f"{MESSAGES[found['error']]} ({found['error']})", found["line_no"] if "line_no" in place else None, "data")


#: Columns that tell where a line stands, in the order in which they count.
_PLACE = ("file", "line_no", "range", "nth")


def watched(rows: DataFrame, name: str = "records") -> tuple[DataFrame, Observation]:
    """rows of PERMISSIVE mode, and what the next action over them tells: `records`, `first` (place and error of the first bad line), and a count of each error's code."""
    seen, bad = Observation(name), F.col("error").isNotNull()
    place = [c for c in _PLACE if c in rows.columns]
    counts = [F.count_if(F.coalesce(F.col("error") == code, F.lit(False))).alias(code) for code in MESSAGES]
    return rows.observe(seen, F.count(F.lit(1)).alias("records"), F.min(F.when(bad, F.struct(*place, "error"))).alias("first"), *counts), seen


def checked(rows: DataFrame, action: Callable[[DataFrame], Out]) -> Out:
    """action(rows), or the error of the first bad line of the first file, at any partitioning and with no other pass over the text.

    Malformed lines do not reach the action.
    """
    seen_rows, seen = watched(rows)
    out = action(seen_rows.filter(F.col("error").isNull()))
    first = seen.get["first"]
    if first is not None:
        raise failure_of(first)
    return out


def failure_of(found: Row) -> FormatError:
    own = found.asDict()
    where = f"{own['file']}: " if own.get("file") else ""
    return FormatError(f"{where}{MESSAGES[own['error']]} ({own['error']})", own.get("line_no"), "data")


def require_good(rows: DataFrame) -> DataFrame:
    """rows of PERMISSIVE mode, or the error of their first bad line: a pass of its own that reads nothing but structure."""
    failure = first_failure(rows)
    if failure is not None:
        raise failure
    return rows
