"""Chained transformations with an output each, and edits of records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.header import Header
from .records import RecordFunction, each_record
from .writer import PLACE, save_lines, with_lines, write_vcf


@dataclass(frozen=True)
class Transformation:
    """header: an edit of the header. rows: an edit of the records. keep: which records go to this output (null: all).

    each: Python code that sees single records after `rows`, edits them, and keeps them from this output by returning False; see
    `records.each_record`.
    """

    header: Callable[[Header], Header] = lambda h: h
    rows: Callable[[DataFrame], DataFrame] = lambda df: df
    keep: Column | None = None
    each: RecordFunction | None = None

    def applied(self, k: int, header: Header, records: DataFrame) -> tuple[Header, DataFrame, Column | None]:
        """The header and all records after this step, the k-th, and which of them go to its output."""
        header, records, keep = self.header(header), self.rows(records), self.keep
        if self.each is not None:
            records = each_record(records, header, self.each, flag=f"kept__{k}")
            keep = F.col(f"kept__{k}") if keep is None else keep & F.col(f"kept__{k}")
        return header, records, keep


def chain(header: Header, records: DataFrame, steps: list[Transformation]) -> list[tuple[Header, DataFrame]]:
    """Header and records of each output. Each step sees the edits of all before it; a record that one output leaves out is still seen by the next."""
    if not steps:
        raise ValueError("at least one transformation is needed")
    out = []
    for k, step in enumerate(steps):
        header, records, keep = step.applied(k, header, records)
        out.append((header, records if keep is None else records.filter(keep)))
    return out


def put_info(entries: Column, key: str, values: list[str] | None) -> Column:
    """INFO with the key's values set in place, or added at the end; None makes a flag."""
    new = F.struct(F.lit(key).alias("key"), F.array(*map(F.lit, values or [""])).alias("values"), F.lit(values is None).alias("is_flag"))
    there = F.exists(entries, lambda e: e["key"] == key)
    return F.when(there, F.transform(entries, lambda e: F.when(e["key"] == key, new).otherwise(e))).otherwise(F.concat(entries, F.array(new)))


def remove_info(entries: Column, key: str) -> Column:
    return F.filter(entries, lambda e: e["key"] != key)


def _evaluated(rows: DataFrame) -> DataFrame:
    """rows with each column evaluated here, once for all that read it: a generator, which projections are not merged across."""
    return rows.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))).alias("r")).select("r.*")


def fan_out(header: Header, records: DataFrame, steps: list[Transformation], check: bool = False) -> tuple[list[Header], DataFrame]:
    """The headers of all outputs of a chain, and one DataFrame of their lines with `output`, the number of the output: see `writer.guarded`.

    A record is parsed once and goes through the steps once; each step takes its line as the record stands after it. A step edits
    columns; one that leaves out the columns that it does not know, or adds up rows, cannot be fanned out.
    """
    if not steps:
        raise ValueError("at least one transformation is needed")
    headers, made, records = [], [], _evaluated(records)
    for k, step in enumerate(steps):
        header, records, keep = step.applied(k, header, records)
        if not set(made) <= set(records.columns):
            raise ValueError(f"step {k} drops columns that it does not know: use chain")
        records = _evaluated(records)
        place = [c for c in PLACE if c in records.columns]
        made.append(f"output__{k}")
        guard, value = f"guard__{k}", f"value__{k}"
        line = F.struct(F.lit(k).alias("output"), *place, F.col(guard).alias("guard"), F.col(value).alias("value"))
        records = with_lines(records, header, check, guard, value).withColumn(made[-1], line if keep is None else F.when(keep, line)).drop(guard, value)
        headers.append(header)
    outputs = records.select(F.explode(F.array_compact(F.array(*made))).alias("o"))
    return headers, outputs.select("o.*")


def write_fan_out(header: Header, records: DataFrame, steps: list[Transformation], folders: list[str], check: bool = False, single: bool = False, sort: bool = False) -> None:
    """All outputs of a chain in one job: each record is read and parsed once and written to the folders that keep it.

    Lines stay in the partitions and the order in which their records come, as `read_vcf` gives them; sort: see `writer.save_lines`.
    """
    if len(steps) != len(folders):
        raise ValueError("one folder for each output")
    headers, lines = fan_out(header, records, steps, check)
    save_lines(lines, headers, folders, single, sort)


def write_chain(outputs: list[tuple[Header, DataFrame]], folders: list[str], check: bool = False, single: bool = False) -> None:
    """Write each output of `chain` to its folder, with a job and a pass over the text for each. `write_fan_out` needs one for all."""
    if len(outputs) != len(folders):
        raise ValueError("one folder for each output")
    for (header, rows), folder in zip(outputs, folders, strict=True):
        write_vcf(rows, header, folder, check, single)


def _checked_value(key: str, value: Column) -> Column:
    """The value, or an error if it would break the line that it is written to."""
    if not key or any(c in key for c in ":\t\r\n"):
        raise ValueError(f"not a sample key: {key!r}")
    bad = value.rlike("[\t\r\n]") if key == "GLE" else value.rlike("[\t\r\n:]")
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit(f"Not a value of {key}: "), value)).cast("string")).otherwise(value)


def sample_entries(values: Column, keys: Column) -> Column:
    """array<struct<key, value>> of one sample, in the order of FORMAT."""
    return F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))


def clear_samples(rows: DataFrame) -> DataFrame:
    """rows without FORMAT keys and sample values; the samples themselves stay, empty."""
    return _both(rows, F.transform("samples", lambda s: F.slice(s, 1, 0)), F.array().cast("array<string>"))


def put_sample(rows: DataFrame, sample: int, key: str, value: Column) -> DataFrame:
    """rows with one sample's value set; a new key is added to FORMAT, missing (`.`) in the other samples.

    A value with a tab, a line end or (but for GLE) a colon is an error.
    """
    value = _checked_value(key, value)
    there = F.array_contains("format", key)
    at = F.when(there, F.array_position("format", key)).otherwise(F.size("format") + 1)
    filled = F.transform("samples", lambda s: F.when(there, s).otherwise(F.concat(s, F.array(F.lit(".")))))
    edited = F.transform(filled, lambda s, i: F.when(i == sample, F.transform(s, lambda v, j: F.when(j == at - 1, value).otherwise(v))).otherwise(s))
    return _both(rows, edited, F.when(there, F.col("format")).otherwise(F.concat("format", F.array(F.lit(key)))))


def remove_sample_key(rows: DataFrame, key: str) -> DataFrame:
    at = F.array_position("format", key)
    return _both(rows, F.transform("samples", lambda s: F.filter(s, lambda v, i: i != at - 1)), F.filter("format", lambda k: k != key))


def _both(rows: DataFrame, samples: Column, keys: Column) -> DataFrame:
    """rows with new samples, made from the old format too, then with the new format.

    Two projections: in one, a name inside a lambda may be taken for the new column of that name.
    """
    return rows.withColumn("samples", samples).withColumn("format", keys)
