"""Registered queries of the variant operators, with the SQL that says what each must return."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles as A
from ..functions import genotypes as N
from ..functions import record as R
from ..functions import typed as T
from ..functions.grammar import RESERVED_FORMAT, RESERVED_INFO
from ..operators import store, transform, views, writer
from ..sources.header import FormatError, entry_warnings, quote, split_properties, unquote
from ..sources.scan import from_lines
from . import bridge as B
from . import columns
from .derived import DERIVED

Query = Callable[[SparkSession, str], DataFrame]


def _text(xs: Column, by: str = "~") -> Column:
    """A list as text with its size, missing elements as NULL."""
    return F.concat(F.size(xs).cast("string"), F.lit(":"), F.array_join(xs.cast("array<string>"), by, "NULL"))


def _checked(error: Column, value: Column) -> Column:
    return F.coalesce(error, value)


def _alts(text: Column) -> Column:
    return F.split(text, ",", -1)


def _info_text(raw: Column) -> Column:
    return F.array_join(F.transform(R.info(raw), lambda e: F.concat(e["key"], F.when(e["is_flag"], "!").otherwise("="), F.array_join(e["values"], ","))), " ")


def _typed(kind: str, is_list: bool = False) -> Callable[[Column], Column]:
    def text(v: Column) -> Column:
        made = T.convert(v, kind, is_list)
        shown = _text(made) if is_list else made.cast("string")
        return F.when(~T.convertible(v, kind, is_list), "error").otherwise(shown)

    return text


def _reserved(catalogue: dict[str, tuple[str, bool]]) -> Callable[[Column, Column], Column]:
    def text(key: Column, raw: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, (kind, is_list) in catalogue.items():
            out = F.when(key == k, _typed(kind, is_list)(raw)).otherwise(out)
        return out

    return text


def _info_reserved(raw: Column, key: Column) -> Column:
    entries, some = R.info(raw), ("AN", "MQ", "DB", "SVLEN", "HOMSEQ")
    return F.coalesce(*[F.when(key == k, _reserved({k: RESERVED_INFO[k]})(F.lit(k), R.info_text(entries, k))) for k in some])


def _format_reserved(text: Column, key: Column) -> Column:
    keys = F.split(F.lit("GT:DP:HQ:GQ:GLE"), ":")
    values, some = R.sample_values(text, keys), ("GT", "DP", "HQ", "GQ")
    return F.coalesce(*[F.when(key == k, _reserved({k: RESERVED_FORMAT[k]})(F.lit(k), R.sample_property(values, keys, k))) for k in some])


def _diploid(gt: Column) -> Column:
    ref, alts = F.lit("A"), F.array(F.lit("C"), F.lit("GT"), F.lit("<DEL>"))
    return F.when(N.diploid_error(gt, ref, alts), "error").otherwise(N.render(N.diploid(gt, ref, alts)))


def _store_gt(gt: Column) -> Column:
    ref, alts = F.lit("A"), F.array(F.lit("C"), F.lit("GT"))
    return F.when(N.store_genotype_error(gt, ref, alts), "error").otherwise(N.render_store(N.store_genotype(gt, ref, alts)))


def _gt_facts(gt: Column) -> Column:
    said = lambda c, yes: F.when(c, yes).otherwise("-")
    shown = lambda g: F.concat(said(g["phased"], "P"), said(N.is_homozygous(g), "H"), said(N.is_no_call(g), "N"), _text(N.allele_set(g)))
    return R.let(N.diploid(gt, F.lit("A"), F.array(F.lit("C"))), shown)


def _made_gt(gt: Column) -> Column:
    ref, alts = F.lit("A"), F.array(F.lit("C"), F.lit("GT"))
    return N.make_gt(N.diploid(gt, ref, alts), ref, alts)


def _by_python(f: Callable[[str], str]) -> Callable[[DataFrame], DataFrame]:
    """result = f(value), by the driver's own header functions run on each row's text."""

    def on_lines(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            known = lru_cache(10_000)(f)
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([known(x) for x in b.column(1).to_pylist()], pa.string())], names=["case_no", "result"])

        return rows.select("case_no", "value").mapInArrow(run, "case_no long, result string")

    return on_lines


def _props(text: str) -> str:
    try:
        return " ".join(f"{k}->{v}" for k, v in sorted(split_properties(text).items()))
    except FormatError:
        return "error"


def _entry_warnings(text: str) -> str:
    section, _, props = text.partition(" ")
    return ",".join(entry_warnings(section, split_properties(props)))


def _quoting(text: str) -> str:
    return f"{quote(text)} {unquote(quote(text)) == text} {unquote(text)}"


def _line(*fields: str) -> str:
    return "\t".join(fields)


def _parsed(result: Callable[[], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: from_lines(rows, B.header()).select("case_no", result().cast("string").alias("result"))


_GOOD = ("chr1", "10", "rs1", "A", "C", "9.5", "PASS", "DP=1", "GT:DP", "0/1:3", "0/0:4")


def _but(**other: str) -> str:
    names = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "s1", "s2")
    return _line(*[other.get(n, v) for n, v in zip(names, _GOOD, strict=True)])


_C = B.Cases
CASES: dict[str, B.Cases] = {
    "split_fields": _C([("a,b", "2:a~b"), ("", "1:"), (",", "2:~"), ("a,,b,", "4:a~~b~"), ("x", "1:x")], lambda t: _text(R.fields(t, ","))),
    "bad_lines_by_code": _C([
        (_but(), None), ("#note", "COMMENT"), ("\t ", "BLANK"), (_line("chr1", "10"), "COLUMN_COUNT"), (_but(info=""), "EMPTY_FIELD"), (_but(pos="ten"), "POS_NUMBER"), (_but(pos=" 5"), "POS_NUMBER"),
        (_but(chrom="chr 1"), "CHROM_WHITESPACE"), (_but(pos="-1"), "POS_NEGATIVE"), (_but(pos="0"), None), (_but(id="a b"), "ID_CHARACTER"), (_but(id="a;a"), "ID_DUPLICATE"), (_but(ref="X"), "REF_GRAMMAR"),
        (_but(alt="X"), "ALT_GRAMMAR"), (_but(alt=".,C"), "ALT_MISSING_COMBINED"), (_but(filter="0"), "FILTER_ZERO"), (_but(filter="PASS;q10"), "FILTER_COMBINED"), (_but(filter="q 10"), "FILTER_WHITESPACE"),
        (_but(format="GT:1X"), "FORMAT_KEY"), (_but(format="DP:DP"), "FORMAT_DUPLICATE"), (_but(format="DP:GT"), "FORMAT_GT_FIRST"), (_but(s2="0/0:4:5"), "SAMPLE_TOO_LONG"), (_but(info="A B"), None), (_but(qual="x"), None),
        (_but(pos="-1", ref="X"), "POS_NEGATIVE"), (_but(chrom="c:1"), None),
    ], on_lines=_parsed(lambda: F.col("error"))),
    "normalisation_warnings": _C([
        (_but(), ""), (_but(id="a;;b"), "ID_EMPTY"), (_but(alt="C,"), "ALT_EMPTY"), (_but(filter="PASS;"), "FILTER_EMPTY"), (_but(info="A;;B"), "INFO_EMPTY_ENTRY"), (_but(info="A=1,,2"), "INFO_EMPTY_VALUE"),
        (_but(format="GT:"), "FORMAT_EMPTY"), (_but(s1="0/1:"), "SAMPLE_EMPTY"), (_but(id=";", info="=1"), "ID_EMPTY,INFO_EMPTY_ENTRY"),
    ], on_lines=_parsed(lambda: F.array_join("warnings", ","))),
    "id_normalised": _C([(".", "0:"), ("rs1", "1:rs1"), ("a;b", "2:a~b"), ("a;;b;", "2:a~b"), (";", "0:"), ("a;a", "ID_DUPLICATE"), ("a b", "ID_CHARACTER")], lambda t: _checked(R.id_error(R.list_field(t, ";")), _text(R.list_field(t, ";")))),
    "ref_alt_validity": _C([
        ("A", "true"), ("ACGTNacgtn", "true"), ("<DEL>", "true"), ("*", "true"), (".", "true"), (".A", "true"), ("A.", "true"), ("G]17:198982]", "true"), ("]13:123456]T", "true"), ("C[2:321682[", "true"),
        ("[17:198983[A", "true"), ("G[<ctg1>:7[", "true"), ("A<X>", "true"), ("G]chr17:198982]", "false"), ("R", "false"), ("A\n", "false"), ("", "false"), ("<a b>", "false"), ("<a,b>", "false"), ("A[1:2", "false"), ("A[1:2]", "false"),
    ], lambda t: A.is_allele(t)),
    "alt_list": _C([(".", "0:"), ("C", "1:C"), ("C,GT", "2:C~GT"), ("C,,GT,", "2:C~GT"), ("C,C", "2:C~C"), (".,C", "ALT_MISSING_COMBINED"), ("C,?", "ALT_GRAMMAR")], lambda t: _checked(R.alt_error(R.list_field(t, ",")), _text(R.list_field(t, ",")))),
    "filter_normalised": _C([
        ("PASS", "PASSED 0:"), (".", "NONE 0:"), ("q10", "FAILED 1:q10"), ("q10;;s50", "FAILED 2:q10~s50"), (";", "PASSED 0:"), ("PASS;", "PASSED 0:"), (".;", "NONE 0:"), ("0", "FILTER_ZERO"), ("q10;0", "FILTER_ZERO"), ("PASS;q10", "FILTER_COMBINED"), (".;q10", "FILTER_COMBINED"), ("a b", "FILTER_WHITESPACE"),
    ], lambda t: _checked(R.filter_error(t), F.concat(R.filter_status(t), F.lit(" "), _text(R.filters(t))))),
    "qual_parsed": _C([("9.5", "9.5"), (".", None), ("1e3", "1000.0"), ("1d", None), ("NaN", None), (" 1.5", None), (".5", "0.5"), ("-2.", "-2.0"), ("12x", None)], lambda t: T.qual(t)),
    "decimal_text": _C([("122.00", "122.00"), ("5.2e-10", "5.2E-10"), ("1e3", "1E+3"), ("007", "7"), ("0.000001", "0.000001"), ("0.0000001", "1E-7"), ("-1.50", "-1.50"), (".5", "0.5"), ("0.00", "0.00"), ("12e1", "1.2E+2"), ("1.25e1", "12.5"), ("x", None), ("+3", "3"), ("-0", "0")], lambda t: T.decimal_text(t)),
    "format_keys": _C([("GT:DP", "2:GT~DP"), ("DP", "1:DP"), ("GT::DP:", "4:GT~~DP~"), ("GT:GT", "FORMAT_DUPLICATE"), ("DP:GT", "FORMAT_GT_FIRST"), ("1000G", "FORMAT_KEY"), (".", "FORMAT_KEY"), ("_a.b", "1:_a.b")], lambda t: _checked(R.format_error(R.fields(t, ":")), _text(R.fields(t, ":")))),
    "sample_values": _C([("0/1:3:9", "3:0/1~3~9"), ("0/1", "3:0/1~.~."), ("0/1::9", "3:0/1~.~9"), ("", "3:.~.~."), ("0/1:3:", "3:0/1~3~."), ("0:1:2:3", "4:0~1~2~3")], lambda t: _text(R.sample_values(t, F.split(F.lit("GT:DP:GQ"), ":")))),
    "gle_split": _C([
        ("0/1:0:-1,0/1:-2,1:-3:7", "3:0/1~0:-1,0/1:-2,1:-3~7"), ("0/1:.:7", "3:0/1~.:7~."), ("0/1:0|1:-3.2", "3:0/1~0|1:-3.2~."), ("0/1:x:7", "3:0/1~x~7"), ("0/1", "3:0/1~.~."), ("0/1:0:-1:7", "3:0/1~0:-1~7"), ("0/1:0:-1:", "3:0/1~0:-1~."),
    ], lambda t: _text(R.sample_values(t, F.split(F.lit("GT:GLE:DP"), ":")))),
    "info_entries": _C([
        (".", ""), ("DB", "DB!"), ("A=1,2", "A=1,2"), ("A=1;;B", "A=1 B!"), ("A=1;", "A=1"), ("A=1,,2", "A=1,.,2"), ("A=", "A=."), ("A=b=c", "A=b=c"), ("=1;A=2", "A=2"), ("A=1;B=2;A=3", "A=1,3 B=2"), ("A=1,", "A=1,."),
    ], _info_text),
    "info_keys_presence": _C([("A=1;DB", "true:1"), ("DB", "true:"), (".", "false"), ("DP=3", "false"), ("DB=1;DB", "true:1,")], lambda t: F.when(R.info_values(R.info(t), "A").isNotNull() | R.info_values(R.info(t), "DB").isNotNull(), F.concat(F.lit("true:"), F.array_join(F.coalesce(R.info_values(R.info(t), "A"), R.info_values(R.info(t), "DB")), ","))).otherwise("false")),
    "info_content": _C([("A=1", None), ("A=x y", "INFO_CHARACTER"), ("A B=1", "INFO_CHARACTER"), ("A=b=c", None), (".", None)], lambda t: R.info_error(R.info(t))),
    "info_reserved_typed": _C([
        ("AN=3", "AN", "3"), ("AN=1,2", "AN", "error"), ("MQ=1.5", "MQ", "1.5"), ("DB", "DB", "true"), ("AN=3", "DB", None), ("SVLEN=-5,7", "SVLEN", "2:-5~7"), ("HOMSEQ=A,,T", "HOMSEQ", "3:A~NULL~T"), ("DB;DB", "DB", "error"), ("AN=.", "AN", None), ("SVLEN=x", "SVLEN", "error"),
    ], _info_reserved),
    "format_reserved_typed": _C([("0/1:3:1,2:9", "HQ", "2:1~2"), ("0/1:3:1,:9", "HQ", "2:1~NULL"), ("0/1:3", "GQ", None), ("0/1:3", "DP", "3"), ("0/1:x", "DP", "error"), ("0/1:3", "GT", "0/1"), ("0/1:1,2", "DP", "error")], _format_reserved),
    "convert_integer": _C([("5", "5"), ("+7", "7"), ("-1", "-1"), (" 5", "error"), ("1.0", "error"), (".", None), ("9223372036854775808", "error"), ("", "error")], _typed("Integer")),
    "convert_float": _C([("1.5", "1.5"), ("1e2", "100.0"), ("NaN", "error"), ("1d", "error"), (".", None)], _typed("Float")),
    "convert_boolean": _C([("", "true"), ("1", "true"), ("TRUE", "true"), ("0", "false"), ("False", "false"), (".", None), ("yes", "error")], _typed("Flag")),
    "convert_character": _C([("x", "x"), ("xy", "error"), (".", None), ("", "error")], _typed("Character")),
    "convert_list": _C([("1,2", "2:1~2"), ("1,,2", "3:1~NULL~2"), (".", None), (".,3", "2:NULL~3"), ("1,x", "error"), ("4", "1:4")], _typed("Integer", True)),
    "allele_at_index": _C([("0", "A"), ("1", "C"), ("2", "GT"), ("3", None), ("-1", None)], lambda i: A.allele_at(F.lit("A"), F.array(F.lit("C"), F.lit("GT")), i.cast("int"))),
    "allele_primary_type": _C([("A", "SINGLE_BASE 1"), ("AC", "MULTI_BASE 2"), ("*", "DELETED -"), (".", "NO_VARIATION 1"), ("<DEL>", "SYMBOLIC -"), ("G]17:1]", "BREAKPOINT -"), ("G[<c>:1[", "BREAKPOINT -"), (".A", "MULTI_BASE 2")], lambda a: F.concat(A.primary_type(a), F.lit(" "), F.coalesce(A.allele_length(a).cast("string"), F.lit("-")))),
    "allele_ambiguous": _C([("A", "false true"), ("N", "true false"), ("an", "true false"), ("<N>", "false false"), ("A<N>", "false true"), ("<A>n", "true false")], lambda a: F.concat(A.is_ambiguous(a).cast("string"), F.lit(" "), A.contains_base(a, "A").cast("string"))),
    "allele_lowercase": _C([("ACGT", "acgt"), ("A<DEL>T", "a<DEL>t"), ("<INS:ME>", "<INS:ME>"), ("*", "*"), ("G]17:1]", "g]17:1]")], lambda a: A.lowercase_bases(a)),
    "genotype_store": _C([("0|1", "A|C"), ("0/1", "A/C"), ("1", "C"), (".", None), ("./.", None), ("0/.", "A/."), ("0/", "A/."), ("0/1/2", "A/C/GT"), ("+1/0", "C/A"), ("5", "error"), ("X/0", "error"), ("0/0", "A/A")], _store_gt),
    "genotype_diploid": _C([("0/1", "A/C"), ("0|3", "A|<DEL>"), ("2/2", "GT|GT"), ("1", "C|C"), ("./.", "./."), (".", ".|."), ("0/.", "A/."), (".|1", ".|C"), ("0/1/2", "error"), ("4/0", "error"), ("+1/0", "error"), ("", "error")], _diploid),
    "genotype_from_bases": _C([("A/TT", "A/TT"), ("A|TT", "A|TT"), ("A/A", "A|A"), ("A", "A|A"), (".", ".|."), ("./.", "./."), ("A/.", "A/."), ("G]17:1]/A", "G]17:1]/A"), ("<D|X>/A", "<D|X>|A"), ("A/Q", None), ("A/C/G", None)], lambda t: N.render(N.from_bases(t))),
    "genotype_facts": _C([("0/1", "---2:A~C"), ("1|1", "PH-1:C"), ("./.", "-HN0:"), (".", "PHN0:"), ("0/.", "---1:A")], _gt_facts),
    "make_gt_roundtrip": _C([("0/1", "0/1"), ("2|0", "2|0"), ("1/1", "1|1"), ("1", "1|1"), ("./.", "./."), (".|1", ".|1")], _made_gt),
    "sv_code_parse": _C([("DEL", "true 1"), ("DUP:TANDEM", "true 2"), ("INS:ME:LINE", "true 3"), ("DEL:ME", "true 2"), ("DEL:TANDEM", "false 2"), ("XYZ", "false 1"), ("DEL:", "false 2"), ("", "false 1"), ("TANDEM", "false 1"), ("INS:x:ME", "false 3"), ("DEL:INS", "false 2"), ("CNV:a:b", "true 3")], lambda t: F.concat(A.sv_valid(t).cast("string"), F.lit(" "), F.size(A.sv_components(t)).cast("string"))),
    "sv_reserved": _C([("INS:ME:LINE", "3:INS~ME~NULL"), ("CNV", "1:CNV"), ("DEL:x", "2:DEL~NULL")], lambda t: _text(A.sv_reserved(t))),
    "expected_cardinality": _C([("A", "2", "2", "2"), ("R", "2", "2", "3"), ("G", "2", "2", "6"), ("G", "2", "3", "10"), ("G", "1", "1", "2"), ("4", "1", "2", "4"), (".", "1", "2", None), ("x", "1", "2", None), ("G", "70", "40", "9223372036854775807"), ("G", "30", "30", "118264581564861424"), ("G", "3", "0", "1")], lambda n, a, p: N.expected_values(n, a.cast("int"), p.cast("int"))),
    "gt_ploidy": _C([("0/1", "2"), ("1", "1"), ("0|1|2", "3"), (None, "2"), (".", "1")], lambda t: N.ploidy(t)),
    "content_warnings": _C([
        (_but(), ""), (_but(filter="s50"), "FILTER_UNDECLARED:s50"), (_but(info="XX=1"), "INFO_UNDECLARED:XX"), (_but(format="GT:ZZ"), "FORMAT_UNDECLARED:ZZ"), (_but(info="DB=1"), "INFO_FLAG_VALUE:DB"), (_but(info="DP=x"), "INFO_TYPE:DP"),
        (_but(info="AF=1,2"), "INFO_COUNT:AF"), (_but(alt="C,G", info="AF=0.1,0.2;XR=a,b,c"), ""), (_but(info="XR=a"), "INFO_COUNT:XR"), (_but(info="DP=."), ""),
    ], on_lines=_parsed(lambda: F.array_join(writer.content_warnings(B.header()), ","))),
    "format_value_warnings": _C([(_but(), "|"), (_but(s1="0/1:x"), "FORMAT_TYPE|"), (_but(s2="0/1:1,2"), "|FORMAT_COUNT"), (_but(format="GT:PL", s1="0/1:1,2,3", s2="1:1,2"), "|"), (_but(format="GT:PL", s1="0/1:1,2", s2="."), "FORMAT_COUNT|"), (_but(s1="0/1:."), "|")], on_lines=_parsed(lambda: F.array_join(writer.sample_format_warnings(B.header()), "|"))),
    "write_guards": _C([("1", None), ("2", "REF_EMPTY"), ("3", "SAMPLE_COUNT"), ("4", "FORMAT_EMPTY"), ("5", "LINE_TERMINATOR")], on_lines=lambda rows: _guarded(rows)),
    "row_validation": _C([("1", None), ("2", "REF"), ("3", "ALT"), ("4", "ID"), ("5", "SAMPLE"), ("6", "INFO"), ("7", "FILTER")], on_lines=lambda rows: _edited(rows)),
    "header_props": _C([('ID=a,Number=1', "ID->a Number->1"), ('ID=a,Description="x, y=z"', 'Description->"x, y=z" ID->a'), ('ID=a,D="q\\"r,s"', 'D->"q\\"r,s" ID->a'), ("ID=a,b", "error"), ("ID=a=b", "error"), ("ID=a,ID=b", "ID->b")], on_lines=_by_python(_props)),
    "header_quoting": _C([("plain", '"plain" True plain'), ('a"b', '"a\\"b" True a"b'), ("a\\b", '"a\\\\b" True a\\b'), ("", '"" True '), ('"', '"\\"" True "'), ('"x"', '"\\"x\\"" True x')], on_lines=_by_python(_quoting)),
    "header_warnings": _C([
        ('INFO ID=a,Number=1,Type=Integer,Description="d"', ""), ('INFO ID=a,Number=1,Type=Flag,Description="d"', "FLAG_NUMBER"), ("INFO ID=a,Number=x,Type=Float,Description=d", "NUMBER_INVALID,DESCRIPTION_UNQUOTED"), ('INFO ID=a,Number=A,Type=Odd,Description="d"', "TYPE_INVALID"),
        ("contig ID=1,assembly=b,length=5", ""), ("contig ID=1,length=x", "ASSEMBLY_MISSING,LENGTH_INVALID"), ('FILTER ID=q,Description="d",Extra=1', "PROPERTY_UNEXPECTED"), ('FORMAT ID=a,Number=G,Type=Flag,Description="d"', "TYPE_INVALID,FLAG_NUMBER"), ('ALT Description="d"', "ID_MISSING"),
        ('INFO ID=a,Number=1,Type=String,Description="d",Source=s', "SOURCE_UNQUOTED"),
    ], on_lines=_by_python(_entry_warnings)),
}


def _record(rows: DataFrame) -> DataFrame:
    """A good record for each row; `value`, the number of the edit, stays as `edit`."""
    return from_lines(rows.select("case_no", F.col("value").alias("edit"), F.lit(_but()).alias("value")), B.header())


def _guarded(rows: DataFrame) -> DataFrame:
    e, none = F.col("edit"), F.array().cast("array<string>")
    edited = _record(rows).withColumns({
        "ref": F.when(e == "2", "").otherwise(F.col("ref")), "samples": F.when(e == "3", F.slice("samples", 1, 1)).otherwise(F.col("samples")),
        "format": F.when(e == "4", none).otherwise(F.col("format")), "chrom": F.when(e == "5", "a\nb").otherwise(F.col("chrom")),
    })
    return edited.select("case_no", writer.write_guard(2).alias("result"))


def _edited(rows: DataFrame) -> DataFrame:
    e = F.col("edit")
    base = _record(rows)
    bad_sample = F.transform("samples", lambda s: F.transform(s, lambda v: F.concat(v, F.lit(":"))))
    edited = base.withColumns({
        "ref": F.when(e == "2", "Z").otherwise(F.col("ref")), "alts": F.when(e == "3", F.array(F.lit("?"))).otherwise(F.col("alts")), "ids": F.when(e == "4", F.array(F.lit("a"), F.lit("a"))).otherwise(F.col("ids")),
        "samples": F.when(e == "5", bad_sample).otherwise(F.col("samples")), "info": F.when(e == "6", transform.put_info(F.col("info"), "X", ["a b"])).otherwise(F.col("info")), "filters": F.when(e == "7", F.array(F.lit("0"))).otherwise(F.col("filters")),
    })
    return writer.validate(edited).select("case_no", F.col("invalid").alias("result"))


# Queries over text made from the tables themselves.


def variants_by_chrom_filter_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = from_lines(B.lineitem_lines(spark, sf_dir), B.header())
    status = F.when(F.size("filters") > 0, "FAILED").when(F.col("filters_applied"), "PASSED").otherwise("NONE")
    return rows.groupBy("chrom", status.alias("status")).agg(F.count("*").alias("n"))


def info_depth_by_chrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = from_lines(B.lineitem_lines(spark, sf_dir), B.header())
    depth, flag = T.convert(R.info_text_of(F.col("info_raw"), "DP"), "Integer"), R.info_has(F.col("info_raw"), "DB")
    return rows.groupBy("chrom").agg(F.sum(depth).alias("depth"), F.sum(flag.cast("int")).alias("flagged"))


def genotypes_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.genotype_counts(from_lines(B.lineitem_lines(spark, sf_dir), B.header()))


def genotypes_long_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = views.genotypes_long(B.header(), from_lines(B.lineitem_lines(spark, sf_dir), B.header()))
    depth = F.get(F.filter("properties", lambda p: p["key"] == "DP"), F.lit(0))["value"]
    return long.groupBy("sample_name", "gt", depth.alias("depth")).agg(F.count("*").alias("n"))


def sql_over_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.register_views(spark, B.header(), _orders(spark, sf_dir), "orders_")
    return spark.sql("""
        select f.filter, e.kind is not null as declared, count(*) as n
        from (select explode(filters) as filter from orders_variants) f left join orders_header_entries e on e.kind = 'FILTER' and e.id = f.filter
        group by 1, 2""")


def rsid_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_lines(B.lineitem_lines(spark, sf_dir), B.header(), rsids_only=True).groupBy("chrom").agg(F.count("*").alias("n"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_lines(B.orders_lines(spark, sf_dir), B.header())


def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.dedupe(_orders(spark, sf_dir).select("chrom", "pos", "line_no"), ["chrom", "pos"], "KEEP_FIRST")


def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.dedupe(_orders(spark, sf_dir).select("chrom", "pos", "line_no"), ["chrom", "pos"], "KEEP_LAST")


def duplicate_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.duplicates(_orders(spark, sf_dir), ["chrom", "pos"])


def _store(spark: SparkSession, sf_dir: str) -> store.VariantStore:
    return store.VariantStore(B.header(), _orders(spark, sf_dir), "KEEP_FIRST", "KEEP_LAST")


def lookup_by_locus(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = B.table(spark, sf_dir, "customer").select(F.concat(F.lit("chr"), (F.col("c_custkey") % 5 + 1).cast("string")).alias("chrom"), F.col("c_custkey").alias("pos"))
    return _store(spark, sf_dir).lookup_loci(keys).select("chrom", "pos", "line_no")


def lookup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = B.table(spark, sf_dir, "customer").select(F.concat(F.lit("rs"), F.col("c_custkey").cast("string")).alias("id"))
    return _store(spark, sf_dir).lookup_ids(keys).select("id", "line_no")


def sample_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    return s.sample(s.positions(), "S1").select("line_no", F.array_join("sample", ":").alias("sample"))


def genotype_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    return s.genotype(s.positions(), "S1").select("line_no", N.render_store(F.col("genotype")).alias("genotype"))


def _chained(spark: SparkSession, sf_dir: str):
    first = transform.Transformation(
        header=lambda h: h.with_entry("FILTER", {"ID": "deep", "Description": '"Deep"'}),
        rows=lambda df: df.withColumns({"pos": F.col("pos") + 10, "info": transform.put_info(F.col("info"), "DB", None)}), keep=F.col("line_no") % 2 == 0,
    )
    second = transform.Transformation(rows=lambda df: df.withColumns({"pos": F.col("pos") * 2, "info": transform.remove_info(F.col("info"), "DP")}))
    return transform.chain(B.header(), _orders(spark, sf_dir), [first, second])


def _rendered(output) -> DataFrame:
    head, rows = output
    return writer.render(rows, head).select("line_no", F.regexp_replace("value", "\t", " ").alias("value"))


def transform_chain_out1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(_chained(spark, sf_dir)[0])


def transform_chain_out2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(_chained(spark, sf_dir)[1])


def roundtrip_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered((B.header(), _orders(spark, sf_dir)))


def sample_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transform.put_sample(_orders(spark, sf_dir), 1, "GQ", F.lit("50"))
    return _rendered((B.header(), transform.remove_sample_key(rows, "DP")))


_LOCI = "select concat('chr', o_custkey % 5 + 1) as chrom, o_custkey as pos, {} from orders group by 1, 2"
_EDITED = "select o_orderkey as line_no, replace({}, chr(9), ' ') as value from orders {}"


def _orders_line(pos: str = "o_custkey", info: str | None = None) -> str:
    text = B.ORDERS_LINE.replace("cast(o_custkey as varchar(20)), chr(9), case when", f"cast({pos} as varchar(20)), chr(9), case when", 1)
    if info is not None:
        start = text.index("concat('DP='")
        text = text[:start] + info + text[text.index(", chr(9), 'GT:DP'") :]
    return text


TABLE_QUERIES: dict[str, tuple[Query, str]] = {
    "variants_by_chrom_filter_status": (variants_by_chrom_filter_status, "select concat('chr', l_suppkey % 5 + 1) as chrom, case l_partkey % 4 when 0 then 'PASSED' when 2 then 'NONE' else 'FAILED' end as status, count(*) as n from lineitem group by 1, 2"),
    "info_depth_by_chrom": (info_depth_by_chrom, "select concat('chr', l_suppkey % 5 + 1) as chrom, cast(sum(cast(l_quantity as int)) as bigint) as depth, cast(sum(case when l_linenumber % 2 = 0 then 1 else 0 end) as bigint) as flagged from lineitem group by 1"),
    "genotypes_by_sample": (genotypes_by_sample, "select 0 as sample_idx, case l_partkey % 5 when 0 then 'A|A' when 1 then 'A|C' when 2 then 'C|C' when 3 then './.' else '.|.' end as genotype, count(*) as n from lineitem group by 1, 2 union all select 1, 'A/C', count(*) from lineitem"),
    "genotypes_long_by_name": (genotypes_long_by_name, "select 'S1' as sample_name, case l_partkey % 5 when 0 then '0/0' when 1 then '0|1' when 2 then '1/1' when 3 then './.' else '.' end as gt, cast(l_linenumber as varchar) as depth, count(*) as n from lineitem group by 1, 2, 3 union all select 'S2', '0/1', '.', count(*) from lineitem"),
    "sql_over_views": (sql_over_views, "select 'q10' as filter, true as declared, count(*) as n from orders where o_orderstatus <> 'F' having count(*) > 0"),
    "rsid_only": (rsid_only, "select concat('chr', l_suppkey % 5 + 1) as chrom, count(*) as n from lineitem where l_partkey % 3 <> 0 group by 1"),
    "dedupe_keep_first": (dedupe_keep_first, _LOCI.format("min(o_orderkey) as line_no")),
    "dedupe_keep_last": (dedupe_keep_last, _LOCI.format("max(o_orderkey) as line_no")),
    "duplicate_loci": (duplicate_loci, _LOCI.format("count(*) as n, min(o_orderkey) as first_line, max(o_orderkey) as last_line") + " having count(*) > 1"),
    "lookup_by_locus": (lookup_by_locus, "select concat('chr', c_custkey % 5 + 1) as chrom, c_custkey as pos, l as line_no from customer left join (select o_custkey, min(o_orderkey) as l from orders group by 1) on o_custkey = c_custkey"),
    "lookup_by_id": (lookup_by_id, "select concat('rs', c_custkey) as id, l as line_no from customer left join (select o_custkey, max(o_orderkey) as l from orders where o_orderkey % 4 <> 0 group by 1) on o_custkey = c_custkey"),
    "sample_lookup": (sample_lookup, "select l as line_no, concat(case when l % 2 = 0 then '0|1' else '1/1' end, ':', l % 7) as sample from (select min(o_orderkey) as l from orders group by o_custkey)"),
    "genotype_lookup": (genotype_lookup, "select l as line_no, case when l % 2 = 0 then 'A|C' else 'C/C' end as genotype from (select min(o_orderkey) as l from orders group by o_custkey)"),
    "transform_chain_out1": (transform_chain_out1, _EDITED.format(_orders_line("o_custkey + 10", "concat('DP=', o_orderkey % 97, ';DB')"), "where o_orderkey % 2 = 0")),
    "transform_chain_out2": (transform_chain_out2, _EDITED.format(_orders_line("(o_custkey + 10) * 2", "'DB'"), "")),
    "roundtrip_identity": (roundtrip_identity, _EDITED.format(B.ORDERS_LINE, "")),
    "sql_functions_of_columns": (
        columns.sql_functions_of_columns,
        "select concat('chr', l_suppkey % 5 + 1) as chrom, case l_partkey % 4 when 0 then 'PASSED' when 2 then 'NONE' else 'FAILED' end as status, count(*) as n, cast(sum(cast(l_quantity as int)) as bigint) as depth, cast(sum(case when l_linenumber % 2 = 0 then 1 else 0 end) as bigint) as flagged, cast(sum(case when l_partkey % 5 = 1 then 1 else 0 end) as bigint) as called from lineitem group by 1, 2",
    ),
    "dedupe_over_files": (
        columns.dedupe_over_files,
        "select concat('chr', o_custkey % 5 + 1) as chrom, o_custkey as pos, file, line_no from (select o_custkey, concat('f', o_orderkey % 3) as file, o_orderkey // 3 as line_no, row_number() over (partition by o_custkey order by o_orderkey % 3, o_orderkey // 3) as place from orders) where place = 1",
    ),
    "user_code_of_columns": (columns.user_code_of_columns, "select o_orderkey as line_no, 2 * o_custkey + case when o_orderkey % 2 = 0 then 2 else 1 end as pos from orders where o_orderkey % 3 <> 0"),
    "fan_out_lines": (
        columns.fan_out_lines,
        "select 0 as output, line_no, value from (" + _EDITED.format(_orders_line("o_custkey + 10", "concat('DP=', o_orderkey % 97, ';DB')"), "where o_orderkey % 2 = 0") + ") union all select 1, line_no, value from (" + _EDITED.format(_orders_line("(o_custkey + 10) * 2", "'DB'"), "") + ")",
    ),
    "sample_edit": (sample_edit, _EDITED.format(B.ORDERS_LINE.split("'GT:DP'")[0] + "'GT:GQ', chr(9), case when o_orderkey % 2 = 0 then '0|1' else '1/1' end, ':.', chr(9), '0/0:50')", "")),
}


def queries() -> dict[str, Query]:
    return {k: c.query for k, c in (CASES | DERIVED | columns.COLUMNS).items()} | {k: q for k, (q, _) in TABLE_QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: c.sql() for k, c in (CASES | DERIVED | columns.COLUMNS).items()} | {k: s for k, (_, s) in TABLE_QUERIES.items()}
