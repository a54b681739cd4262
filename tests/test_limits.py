"""What must never be written, stored or read wrongly: malformed records, several files, decimals at their limits."""

import pytest
from pyspark.sql import functions as F

from lociform.functions import typed as T
from lociform.operators import store, writer
from lociform.plans.bridge import HEADER_TEXT, header
from lociform.sources.scan import from_lines, read_vcf

GOOD = "chr1\t10\trs1\tA\tC\t9.5\tPASS\tDP=1\tGT:DP\t0/1:3\t0/0:4"


def records(spark, *lines):
    return from_lines(spark.createDataFrame([(x, i) for i, x in enumerate(lines, 1)], "value string, line_no long"), header())


@pytest.mark.parametrize(("bad", "code"), [(GOOD.replace("\t10\t", "\tten\t"), "POS_NUMBER"), (GOOD.replace("\tA\t", "\tX\t"), "REF_GRAMMAR"), (GOOD + "\tmore", "COLUMN_COUNT"), ("#x", "COMMENT")])
def test_malformed_records_are_not_written(spark, bad, code):
    rows = records(spark, GOOD, bad)
    assert [r[0] for r in rows.orderBy("line_no").select(writer.write_guard(2)).collect()] == [None, code]
    with pytest.raises(Exception, match=f"Cannot write record: {code}"):
        writer.render(rows, header()).collect()
    assert writer.render(rows.filter("error is null"), header()).first()["value"] == GOOD


def test_a_null_field_is_not_written(spark):
    rows = records(spark, GOOD)
    for name, code in (("pos", "POS_EMPTY"), ("chrom", "CHROM_EMPTY"), ("ids", "FIELD_NULL"), ("ref", "REF_EMPTY")):
        edited = rows.withColumn(name, F.lit(None).cast(rows.schema[name].dataType)).drop("error")
        with pytest.raises(Exception, match=code):
            writer.render(edited, header()).collect()


def test_store_over_files(spark, tmp_path):
    folder = tmp_path / "all.vcf"
    folder.mkdir()
    for name, depth in (("b.vcf", 2), ("a.vcf", 1), ("c.vcf", 3)):
        (folder / name).write_text("\n".join([HEADER_TEXT, GOOD.replace("DP=1", f"DP={depth}"), GOOD.replace("\t10\t", f"\t{depth}\t").replace("rs1", ".")]) + "\n")
    head, rows = read_vcf(spark, str(folder))
    for policy, want in (("KEEP_FIRST", "DP=1"), ("KEEP_LAST", "DP=3")):
        s = store.VariantStore(head, rows, policy, policy)
        assert [r["info_raw"] for r in s.at_locus("chr1", 10).collect()] == [r["info_raw"] for r in s.at_id("rs1").collect()] == [want]
        assert s.positions().count() == 4
    (found,) = store.duplicates(rows, ["chrom", "pos"]).collect()
    assert found["n"] == 3 and found["first_line"]["file"].endswith("a.vcf") and found["last_line"]["file"].endswith("c.vcf")
    with pytest.raises(Exception, match="Duplicate key"):
        store.dedupe(rows, ["chrom", "pos"]).collect()


def test_store_has_no_malformed_records(spark):
    rows = records(spark, GOOD, GOOD.replace("\t10\t", "\tten\t"), GOOD.replace("\tA\t", "\tX\t").replace("\t10\t", "\t11\t"))
    s = store.VariantStore(header(), rows)
    assert s.positions().count() == s.by_id.count() == 1


DECIMALS = {
    "1e2147483647": True, "1e2147483648": False, "1e-2147483647": True, "1.0e-2147483647": False, "1e99999999999": False, "1e-99999999999999999999999": False, "10.5e-2147483646": True,
    "1e0000000000000000000001": True, "1E+5": True, "1e": False, "e5": False, "1.5": True, ".": False, "-1.e-7": True, "1e2147483647.5": False,
}


def test_decimals_at_their_limits(spark):
    rows = spark.createDataFrame([(x,) for x in DECIMALS], "x string")
    got = {r["x"]: r for r in rows.select("x", T.decimal_ok(F.col("x")).alias("ok"), T.decimal_text(F.col("x")).alias("text"), T.qual(F.col("x")).alias("q"), T.element_ok(F.col("x"), "Float").alias("e")).collect()}
    assert {x: r["ok"] for x, r in got.items()} == {x: r["e"] for x, r in got.items()} == DECIMALS
    assert all((r["text"] is not None) == (r["q"] is not None) == DECIMALS[x] for x, r in got.items())
    assert got["1e2147483647"]["text"] == "1E+2147483647" and got["1e0000000000000000000001"]["text"] == "1E+1" and got["10.5e-2147483646"]["text"] == "1.05E-2147483645" and got["-1.e-7"]["text"] == "-1E-7"
    guard = records(spark, GOOD.replace("9.5", "1e99999999999"), GOOD.replace("9.5", "1e400")).select(writer.write_guard(2).alias("g"), "qual").collect()
    assert [r["g"] for r in guard] == ["QUAL_NUMBER", None] and guard[0]["qual"] is None and guard[1]["qual"] == float("inf")  # a double's limit; the text is kept


def test_a_header_of_very_many_declarations(spark):
    """Plans and lookups do not grow with the header, and codes are those of a small one."""
    import time

    more = [f'##INFO=<ID=K{i},Number={i % 3},Type={"Integer" if i % 2 else "String"},Description="d">' for i in range(20_000)]
    first, *rest = HEADER_TEXT.split("\n")
    from lociform.sources.header import parse_header

    head = parse_header([first, *more, *rest])
    lines = [GOOD.replace("DP=1", x) for x in ("DP=1;K7=5;K8=a,b", "DP=x;K7=y;NONE=1", "K19999=1,2;K20000=1;AF=1,2", "DB=1;K3")]
    rows = from_lines(spark.createDataFrame([(x, i) for i, x in enumerate(lines * 2_500, 1)], "value string, line_no long"), head)
    began = time.time()
    got = rows.select((F.col("line_no") % 4).alias("k"), F.array_join(writer.content_warnings(head), " ").alias("w"), F.array_join(writer.sample_format_warnings(head), "|").alias("s")).distinct().collect()
    assert {r["k"]: r["w"] for r in got} == {1: "", 2: "INFO_UNDECLARED:NONE INFO_TYPE:DP INFO_TYPE:K7", 3: "INFO_UNDECLARED:K20000 INFO_COUNT:K19999 INFO_COUNT:AF", 0: "INFO_FLAG_VALUE:DB INFO_EMPTY:K3"}
    assert {r["s"] for r in got} == {"|"} and time.time() - began < 60


def test_plans_hold_what_is_taken_apart_once(spark):
    """A text is parsed once a row, however many facts are read from it."""
    from conftest import SF

    import __spark_entry__

    plan = lambda name: __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("genotype_facts").count("[/|](") == 1
    assert plan("reserved_info_of_columns").count("SVLEN=-") <= 2
