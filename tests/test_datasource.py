"""The vcf format: reading in one scan with pushed filters, the committing sink in batch and stream, fan-out, the first bad line."""

import os

import pytest
from pyspark.sql import functions as F

from lociform.operators import transform, writer
from lociform.plans.bridge import HEADER_TEXT, header
from lociform.sources import datasource as DS
from lociform.sources.header import FormatError
from lociform.sources.scan import checked, from_lines, read_text, read_vcf
from lociform.streaming.text import stream_vcf, write_stream

ROWS = ["chr%d\t%d\t%s\tA\tC,GT\t5.2E-10\tPASS\tDP=%d;DB\tGT:DP\t0/1:3\t1|2:." % (i % 3, i, f"rs{i}" if i % 4 else ".", i) for i in range(1, 301)]
N = len(HEADER_TEXT.split("\n"))


@pytest.fixture()
def folder(tmp_path):
    out = tmp_path / "all.vcf"
    out.mkdir()
    for name, sep, rows in (("a", "\n", ROWS[:100]), ("b", "\r\n", ROWS[100:200]), ("c", "\r", ROWS[200:])):
        (out / f"{name}.vcf").write_bytes(sep.join([*HEADER_TEXT.split("\n"), *rows]).encode() + (b"" if name == "b" else sep.encode()))
    (out / "_hidden.vcf").write_text("no header")
    return str(out)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_folder_in_one_scan(spark, folder):
    want = sorted((r["file"][-5:], r["line_no"], r["chrom"], r["pos"], r["ids"]) for r in read_text(spark, folder)[1].collect())
    assert len(want) == 300
    for split, scans in ((1 << 20, 1), (1_000, 2), (100, 2)):  # files of several ranges have these counted first
        head, rows = read_vcf(spark, folder, split_bytes=split)
        assert head.columns == header().columns and plan(rows).count("BatchScan vcf") == scans
        assert sorted((r["file"][-5:], r["line_no"], r["chrom"], r["pos"], r["ids"]) for r in rows.collect()) == want
    _, rows = read_vcf(spark, folder, split_bytes=100, line_numbers=False)
    assert plan(rows).count("BatchScan vcf") == 1 and rows.count() == 300


def test_pushed_filters_and_wanted_columns(spark, folder):
    DS.register(spark)
    load = lambda: spark.read.format("vcf").schema("chrom string, pos long, file string, samples array<string>").option("pushFilters", "true").load(folder)
    few = load().filter("chrom in ('chr1', 'chr2') and pos > 95 and pos <= 103 and file like '%b.vcf'")
    assert " Filter " not in plan(few) and sorted((r["chrom"], r["pos"]) for r in few.collect()) == [("chr1", 103), ("chr2", 101)] and few.rdd.getNumPartitions() == 1
    assert few.first()["samples"] == ["0/1:3", "1|2:."]
    odd = load().filter("pos % 2 = 0 and chrom = 'chr0'")
    assert " Filter " in plan(odd) and odd.count() == 50
    kept = spark.read.format("vcf").load(folder)  # one DataFrame, several queries: nothing is pushed
    assert [kept.filter(x).count() for x in ("pos = 7", "pos > 290", "true")] == [1, 10, 300]
    everything = spark.read.format("vcf").load(folder + "/a.vcf").filter("pos = 7").first()
    assert (everything["id"], everything["ref"], everything["alt"], everything["qual"], everything["filter"], everything["info"], everything["format"], everything["nth"], everything["line_no"]) == ("rs7", "A", "C,GT", "5.2E-10", "PASS", "DP=7;DB", "GT:DP", 7, N + 7)


def test_rs_numbers_are_filtered_in_the_source(spark, folder):
    with open(f"{folder}/a.vcf", "a") as f:
        f.write("\n".join([ROWS[3].replace("\t4\t", "\tx\t"), ROWS[3] + "\tmore", "#note"]) + "\n")
    got = read_vcf(spark, folder, rsids_only=True, mode="PERMISSIVE")[1]
    assert got.filter("error is null").count() == 225 and sorted(r["error"] for r in got.filter("error is not null").collect()) == ["COLUMN_COUNT", "COMMENT", "POS_NUMBER"]
    lines = spark.read.format("vcf").schema("value string").option("rsidsOnly", "true").load(folder)
    assert lines.count() == 228  # what the source lets through


def test_files_that_do_not_fit(spark, tmp_path, folder):
    open(f"{folder}/d.vcf", "w").write("\n".join([HEADER_TEXT + "\tS3", ROWS[0] + "\t0/0"]))
    with pytest.raises(Exception, match="different columns"):
        read_vcf(spark, folder)[1].collect()
    open(f"{folder}/d.vcf", "w").write("##fileformat=VCFv4.2\nchr1\t1\n")
    with pytest.raises(Exception, match=r"d.vcf: \[Line #2\]"):
        read_vcf(spark, folder)[1].collect()
    with pytest.raises(FormatError, match="No such file"):
        read_vcf(spark, str(tmp_path / "none.vcf"))
    empty = tmp_path / "empty.vcf"
    empty.mkdir()
    with pytest.raises(FormatError, match="The file is empty"):
        read_vcf(spark, str(empty))
    (empty / "x.vcf").write_text(HEADER_TEXT)
    assert read_vcf(spark, str(empty))[1].count() == 0


@pytest.mark.parametrize("split", [1 << 20, 300])
def test_first_bad_line_in_one_pass(spark, folder, split):
    for name, at in (("c", 5), ("b", 70), ("b", 30)):
        lines = open(f"{folder}/{name}.vcf", newline="").read().splitlines()
        lines[N + at] = lines[N + at].replace("\tA\t", "\tX\t")
        open(f"{folder}/{name}.vcf", "w").write("\n".join(lines) + "\n")
    rows = read_vcf(spark, folder, mode="PERMISSIVE", split_bytes=split)[1]
    with pytest.raises(FormatError, match=rf"\[Line #{N + 31}\] Error parsing data: .*b.vcf.*REF_GRAMMAR"):
        checked(rows, lambda df: df.groupBy("chrom").count().collect())
    assert checked(rows.filter("file like '%a.vcf'"), lambda df: df.count()) == 100
    out = folder + "-out.vcf"
    with pytest.raises(Exception, match=rf"\[Line #{N + 31}\] Error parsing data: .*b.vcf: Cannot write record: REF_GRAMMAR"):
        writer.write_vcf(rows, header(), out)
    assert not [f for f in os.listdir(out) if f != "_SUCCESS"] if os.path.exists(out) else True


def files(folder):
    return sorted(f for f in os.listdir(folder) if not f.startswith("."))


def test_an_empty_result_has_its_header(spark, tmp_path):
    rows = from_lines(spark.createDataFrame([(ROWS[0], 1)], "value string, line_no long"), header())
    for k, single in enumerate((False, True)):
        out = str(tmp_path / f"{k}.vcf")
        writer.write_vcf(rows.filter("pos < 0"), header(), out, single=single)
        assert files(out) == ["_SUCCESS", "part-00000.vcf"] and open(f"{out}/part-00000.vcf").read().rstrip("\n") == HEADER_TEXT
    writer.write_vcf(rows, header(), out)
    assert read_vcf(spark, out)[1].count() == 1  # what was there is replaced


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    out = str(tmp_path / "out.vcf")
    rows = from_lines(spark.createDataFrame([(x, i) for i, x in enumerate(ROWS)], "value string, line_no long").repartition(8), header())
    writer.write_vcf(rows, header(), out)
    before = {f: open(f"{out}/{f}").read() for f in files(out)}
    broken = rows.withColumn("chrom", F.when(F.col("pos") == 250, F.raise_error(F.lit("killed")).cast("string")).otherwise("new"))
    with pytest.raises(Exception, match="killed"):
        writer.write_vcf(broken, header(), out)
    assert {f: open(f"{out}/{f}").read() for f in files(out)} == before


def test_fan_out_parses_once(spark, folder, tmp_path):
    steps = [
        transform.Transformation(header=lambda h: h.with_entry("FILTER", {"ID": "x", "Description": '"X"'}), rows=lambda d: d.withColumn("pos", F.col("pos") + 10), keep=F.col("pos") % 2 == 0),
        transform.Transformation(rows=lambda d: d.withColumns({"pos": F.col("pos") * 2, "info": transform.remove_info(F.col("info"), "DP")})), transform.Transformation(keep=F.col("pos") < 0),
    ]
    head, rows = read_vcf(spark, folder)
    folders = [str(tmp_path / f"{k}.vcf") for k in range(3)]
    from pyspark.sql import Observation

    parsed = Observation("parsed")
    transform.write_fan_out(head, rows.observe(parsed, F.count(F.lit(1)).alias("n")), steps, folders)
    assert parsed.get["n"] == len(ROWS)  # one pass for three outputs
    assert [int(x.split("\t")[1]) for f in files(folders[1])[1:] for x in open(f"{folders[1]}/{f}") if x[0] != "#"] == [2 * (i + 10) for i in range(1, 301)]  # in order
    for out, (own, want) in zip(folders, transform.chain(head, rows, steps), strict=True):
        got_head, got = read_vcf(spark, out)
        assert got_head.entries == own.entries
        assert sorted(r["value"] for r in writer.render(got, got_head).collect()) == sorted(r["value"] for r in writer.render(want, own).collect())
    assert files(folders[2]) == ["_SUCCESS", "part-00000.vcf"]
    with pytest.raises(ValueError, match="drops columns"):
        transform.fan_out(head, rows, [steps[1], transform.Transformation(rows=lambda d: d.select("chrom", "pos"))])
    with pytest.raises(ValueError):
        transform.write_fan_out(head, rows, steps, folders[:1])


def test_stream_through_the_same_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, marks = str(tmp_path / "out.vcf"), str(tmp_path / "marks")
    for k in range(2):  # two runs with one checkpoint
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join([HEADER_TEXT, *ROWS[k * 10 : k * 10 + 10]]) + "\n")
        write_stream(stream_vcf(spark, str(tmp_path / "in"), header()), header(), out, marks).awaitTermination()
    assert sorted(r["pos"] for r in read_vcf(spark, out)[1].collect()) == list(range(1, 21))
    (tmp_path / "in" / "bad.txt").write_text("chr1\tten\n")
    with pytest.raises(Exception, match="COLUMN_COUNT"):
        write_stream(stream_vcf(spark, str(tmp_path / "in"), header()), header(), out, marks).awaitTermination()
    assert read_vcf(spark, out)[1].count() == 20
