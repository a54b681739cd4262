"""Rendering records to text, the checks before that, and content warnings."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grammar as G
from ..functions import typed as T
from ..functions.genotypes import expected_values, gt_index_ok, ploidy
from ..functions.record import alt_error, format_error, info, info_error, let, sample_property
from ..sources import datasource
from ..sources.header import Header, header_lines, validate_header


def info_field(entries: Column) -> Column:
    one = F.transform(entries, lambda e: F.when(e["is_flag"], e["key"]).otherwise(F.concat(e["key"], F.lit("="), F.array_join(e["values"], ","))))
    return F.when(F.size(entries) == 0, ".").otherwise(F.array_join(one, ";"))


def _joined(xs: Column, by: str) -> Column:
    return F.when(F.size(xs) == 0, ".").otherwise(F.array_join(xs, by))


def line(n_samples: int) -> Column:
    """A record's line, from the columns of from_lines."""
    filters = F.when(F.size("filters") > 0, F.array_join("filters", ";")).when(F.col("filters_applied"), "PASS").otherwise(".")
    parts = [F.col("chrom"), F.col("pos").cast("string"), _joined(F.col("ids"), ";"), F.col("ref"), _joined(F.col("alts"), ","), F.coalesce(T.decimal_text(F.col("qual_raw")), F.lit(".")), filters, info_field(F.col("info"))]
    head = F.concat(parts[0], *[x for p in parts[1:] for x in (F.lit("\t"), p)])  # null if a field is, unlike concat_ws
    if not n_samples:
        return head
    samples = F.transform("samples", lambda s: F.array_join(F.transform(F.col("format"), lambda k, i: F.coalesce(F.get(s, i), F.lit("."))), ":"))
    return F.when(F.size("format") > 0, F.concat(head, F.lit("\t"), F.array_join("format", ":"), F.lit("\t"), F.array_join(samples, "\t"))).otherwise(head)


def write_guard(n_samples: int, error: bool = True, text: Column | None = None) -> Column:
    """Code of what forbids to write a record; null if nothing does.

    The record's own `error` comes first (error: rows have that column), so a line that PERMISSIVE mode has kept is never
    written; who mends such a record sets `error` to null. QUAL and INFO are read here, so what is malformed in them
    shows, as it does in any other reading. text: the record's line, if there is a column of it already.
    """
    text = line(n_samples) if text is None else text
    own = [F.col("error")] if error else []
    found = (
        F.when(F.col("chrom").isNull(), "CHROM_EMPTY").when(F.col("pos").isNull(), "POS_EMPTY")
        .when(F.lit(n_samples == 0) & ((F.size("format") > 0) | (F.size("samples") > 0)), "SAMPLES_UNDECLARED")
        .when(F.size("samples") != n_samples, "SAMPLE_COUNT").when((F.size("samples") > 0) & (F.size("format") == 0), "FORMAT_EMPTY")
        .when(F.col("ref").isNull() | (F.col("ref") == ""), "REF_EMPTY").when(~T.qual_ok(F.col("qual_raw")), "QUAL_NUMBER")
        .when(F.col("info_raw").rlike(r"\s"), info_error(info(F.col("info_raw"))))
    )
    # One `when` may end without a code (INFO with whitespace that it drops), so the last check stands on its own.
    return F.coalesce(*own, found, F.when(text.isNull(), "FIELD_NULL").when(text.rlike("[\n\r]"), "LINE_TERMINATOR"))


def invalid() -> Column:
    """The code of the first check that an edited record fails; null for a valid one."""
    filters = F.col("filters")
    bad_filter = F.exists(filters, lambda x: x.rlike(r"\s") | x.isin("0", "PASS", "."))
    samples = F.exists("samples", lambda s: F.exists(F.zip_with("format", s, lambda k, v: v.isNull() | (v == "") | v.rlike("[\t\r\n]") | ((k != "GLE") & v.contains(":"))), lambda x: x))
    return (
        F.when(F.col("chrom").rlike(r"\s") | (F.col("chrom") == ""), "CHROM").when(F.col("pos") < 0, "POS").when(~F.col("ref").rlike(G.REF), "REF")
        .when(F.exists("ids", lambda x: x.rlike(r"[\s;]")) | (F.size(F.array_distinct("ids")) < F.size("ids")), "ID").when(alt_error(F.col("alts")).isNotNull(), "ALT")
        .when(bad_filter, "FILTER").when(info_error(F.col("info")).isNotNull(), "INFO").when(format_error(F.col("format")).isNotNull(), "FORMAT").when(samples, "SAMPLE")
    )


def validate(rows: DataFrame) -> DataFrame:
    """rows with `invalid`."""
    return rows.withColumn("invalid", invalid())


def declarations(header: Header, section: str) -> Callable[[Column], Column]:
    """What a header declares in a section, by ID: a struct of kind and number; null for an ID that it does not declare.

    One constant, whatever the number of entries: buckets by a hash of the ID, so that a lookup reads an entry or two. A header of
    many thousand entries makes a plan no larger and a lookup no slower than one of a few.
    """
    known = {i: p for i, p in header.entries[section].items() if i is not None}
    buckets: list[dict] = [{} for _ in range(max(1, len(known)))]
    for i, props in known.items():
        buckets[zlib.crc32(i.encode()) % len(buckets)][i] = {"kind": props.get("Type"), "number": props.get("Number")}
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string, struct<kind: string, number: string>>>")
    return lambda key: F.get(table, F.pmod(F.crc32(key), F.lit(len(buckets))).cast("int"))[key]


def _fits(value: Column, kind: Column) -> Column:
    out = F.lit(True)
    for name in ("Integer", "Float", "Character", "Flag"):
        out = F.when(kind == name, T.element_ok(value, name)).otherwise(out)
    return (value == ".") | out


def content_warnings(header: Header) -> Column:
    """Codes `WHAT:key` of undeclared keys and of values that do not fit what the header declares."""
    of = {section: declarations(header, section) for section in ("FILTER", "INFO", "FORMAT")}
    undeclared = lambda keys, section, code: F.transform(F.filter(keys, lambda k: of[section](k).isNull()), lambda k: F.concat(F.lit(code), k))
    keys = F.transform("info", lambda e: e["key"])

    def misfit(e: Column) -> Column:
        return let(of["INFO"](e["key"]), lambda d: odd(e, d["kind"], d["number"]))

    def odd(e: Column, kind: Column, number: Column) -> Column:
        want = expected_values(number, F.size("alts"), F.lit(2))
        return (
            F.when((kind == "Flag") & ~e["is_flag"], F.concat(F.lit("INFO_FLAG_VALUE:"), e["key"])).when(kind == "Flag", None)
            .when(F.exists(e["values"], lambda v: v == ""), F.concat(F.lit("INFO_EMPTY:"), e["key"])).when(F.size(e["values"]) != want, F.concat(F.lit("INFO_COUNT:"), e["key"]))
            .when(F.exists(e["values"], lambda v: ~_fits(v, kind)), F.concat(F.lit("INFO_TYPE:"), e["key"]))
        )

    return F.concat(undeclared(F.col("filters"), "FILTER", "FILTER_UNDECLARED:"), undeclared(keys, "INFO", "INFO_UNDECLARED:"), undeclared(F.col("format"), "FORMAT", "FORMAT_UNDECLARED:"), F.array_compact(F.transform("info", misfit)))


def _declared_format(header: Header) -> Column:
    """What the header declares about each FORMAT key of a record: looked up once a record, not once a value."""
    return F.transform("format", lambda k: F.struct(_type_of(header, "FORMAT", k, "Type").alias("kind"), _type_of(header, "FORMAT", k, "Number").alias("number")))


def format_warning(kind: Column, number: Column, key: Column, value: Column, n_alts: Column, gt: Column) -> Column:
    """Code of what is odd about one sample value of a declared type and number; null if nothing is. gt: the sample's genotype."""
    values = F.when(key == "GLE", F.array(value)).otherwise(F.split(value, ",", -1))
    odd = lambda vs: (
        F.when(F.array_contains(vs, ""), "FORMAT_EMPTY").when(F.size(vs) != expected_values(number, n_alts, ploidy(gt)), "FORMAT_COUNT")
        .when(F.exists(vs, lambda v: ~_fits(v, kind)), "FORMAT_TYPE")
    )
    # One value where one is declared is the common case, and needs no list.
    one = (number == "1") & (value != "") & ~value.contains(",")
    return F.when(value == ".", None).when(one, F.when(~_fits(value, kind), "FORMAT_TYPE")).otherwise(let(values, odd))


#: Genotypes of the reference and the first alternative allele, the common case.
_FIRST_TWO = r"\A[01.]([/|][01.])*\z"


def sample_format_warnings(header: Header) -> Column:
    """For each sample the codes of its values' oddities, joined by commas: also values that are missing or too many, and a GT that names no allele."""
    n_alts = F.size("alts")
    # What the header declares about each FORMAT key: looked up once a record, not once a value.
    of = declarations(header, "FORMAT")
    declared = F.transform("format", lambda k: let(of(k), lambda d: F.struct(k.alias("key"), d["kind"].alias("kind"), d["number"].alias("number"))))

    def of_sample(s: Column, gt: Column, keys: Column) -> Column:
        def of_value(v: Column, d: Column) -> Column:
            odd = format_warning(d["kind"], d["number"], d["key"], v, n_alts, gt)
            return F.when(d.isNotNull(), F.when(v.isNull(), "SAMPLE_MISSING").otherwise(odd))

        known = (n_alts > 0) & gt.rlike(_FIRST_TWO)
        whole = F.array(F.when(F.size(s) > F.size("format"), "SAMPLE_EXTRA"), F.when(~F.when(known, True).otherwise(gt_index_ok(gt, F.col("alts"))), "GT_INDEX"))
        return F.array_join(F.concat(F.zip_with(s, keys, of_value), whole), ",")  # nulls are left out

    gt = lambda s: F.struct(sample_property(s, F.col("format"), "GT").alias("gt"))
    return let(declared, lambda keys: F.transform("samples", lambda s: let(gt(s), lambda g: of_sample(s, g["gt"], keys))))


#: Columns that tell where a record was read, in the order in which they count.
PLACE = ("file", "line_no")


def with_lines(rows: DataFrame, header: Header, check: bool = False, guard: str = "guard", value: str = "value") -> DataFrame:
    """rows with two more columns: what forbids to write a record, or null, and its line, or null. The line is made once for both."""
    n = len(header.samples)
    found = write_guard(n, "error" in rows.columns, F.col(f"`{value}`"))
    if check:
        validate_header(header)
        found = F.coalesce(F.concat(F.lit("invalid "), invalid()), found)
    made = rows.withColumn(value, line(n)).withColumn(guard, found)
    return made.withColumn(value, F.when(F.col(f"`{guard}`").isNull(), F.col(f"`{value}`")))


def guarded(rows: DataFrame, header: Header, check: bool = False) -> DataFrame:
    """`value` lines of rows, or null and a `guard` code for a record that must not be written; where it was read passes through.

    check: also validate header and rows.
    """
    return with_lines(rows, header, check).select(*[c for c in PLACE if c in rows.columns], "guard", "value")


def render(rows: DataFrame, header: Header, check: bool = False) -> DataFrame:
    """`value` lines of rows; a record that must not be written is an error. check: also validate header and rows."""
    made = guarded(rows, header, check)
    said = F.concat(F.lit("Cannot write record: "), F.col("guard"))
    value = F.when(F.col("guard").isNull(), F.col("value")).otherwise(F.raise_error(said).cast("string"))
    return made.select(*[c for c in ("line_no",) if c in rows.columns], value.alias("value"))


def save_lines(lines: DataFrame, headers: list[Header], folders: list[str], single: bool = False, sort: bool = True, mode: str = "overwrite") -> None:
    """Write the rows of `guarded`, with `output` (which of the folders) if there are several, by the sink of the `vcf` format: in one job.

    Each file has its output's header; an output without a line has a file with nothing else. The job commits as a whole: a record
    that must not be written fails it with the least place among such records, and a task that is lost leaves nothing behind.
    sort: lines are put in the order of file and line number, within a file and from file to file; Spark reads the rows twice for
    that, once to find the ranges. Without it rows stay where they are, and that is the same order if they come from `read_vcf` and
    nothing has shuffled them. single: one file for each output, sorted by the one task that all lines go to.
    """
    datasource.register(lines.sparkSession)
    order = [c for c in ("output", *PLACE) if c in lines.columns]
    ranged = sort and order[-1:] == ["line_no"]
    by = lines.repartition(1) if single else lines.repartitionByRange(*order) if ranged else lines
    options = {"paths": json.dumps(folders), "headers": json.dumps([header_lines(h) for h in headers])}
    (by.sortWithinPartitions(*order) if order and (single or ranged) else by).write.format("vcf").options(**options).mode(mode).save()


def write_vcf(rows: DataFrame, header: Header, folder: str, check: bool = False, single: bool = False, sort: bool = True) -> None:
    """Text files below folder, each a whole file with its own header, in the order of file and line_no; single: one file. See `save_lines`.

    Sorting by range keeps each file's lines together in order; only `single` brings all lines to one task.
    """
    save_lines(guarded(rows, header, check), [header], [folder], single, sort)
