import time

import pytest
from pyspark.sql import functions as F

from lociform.operators import store, transform, views, writer
from lociform.plans.bridge import HEADER_TEXT, header
from lociform.sources.header import FormatError
from lociform.sources.scan import from_lines, read_header, read_vcf
from lociform.streaming.text import stream_vcf

ROWS = ["chr1\t%d\trs%d\tA\tC,GT\t5.2E-10\tPASS\tDP=%d;DB\tGT:DP\t0/1:3\t1|2:." % (i, i, i) for i in range(1, 301)]


@pytest.fixture()
def file(tmp_path):
    path = tmp_path / "a.vcf"
    path.write_text("\n".join([HEADER_TEXT, *ROWS]) + "\n")
    return str(path)


def test_read_write_read(spark, file, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        head, rows = read_vcf(spark, file)
        got = rows.select("line_no", "pos").orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["line_no"], r["pos"]) for r in got] == [(i + head.lines, i) for i in range(1, 301)]
    writer.write_vcf(rows, head, str(tmp_path / "out"), check=True, single=True)
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text().split("\n")[:-1][head.lines :] == ROWS


def test_long_header_in_many_splits(spark, tmp_path):
    first, *rest = HEADER_TEXT.split("\n")
    contigs = [f"##contig=<ID=c{i},length=9>" for i in range(120_000)]
    path = tmp_path / "long.vcf"
    path.write_text("\n".join([first, *contigs, *rest, *ROWS, "##late=1"]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        head = read_header(spark, str(path))
        _, rows = read_vcf(spark, str(path), mode="DROPMALFORMED")
        assert head.lines == 120_000 + len(HEADER_TEXT.split("\n")) and head.columns == header().columns
        assert rows.agg(F.min("line_no")).first()[0] == head.lines + 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    path.write_text("##fileformat=VCFv4.2\n##a=b\n")
    with pytest.raises(FormatError, match="No column header"):
        read_header(spark, str(path))


def test_many_files_with_headers_of_their_own(spark, tmp_path):
    from lociform.sources.scan import first_failure, numbered, require_good

    folder = tmp_path / "all.vcf"
    folder.mkdir()
    first, *rest = HEADER_TEXT.split("\n")
    (folder / "a.vcf").write_text("\n".join([first, *[f"##contig=<ID=c{i},length=9>" for i in range(50)], *rest, *ROWS[:10]]) + "\n")
    (folder / "b.vcf").write_text("\n".join([HEADER_TEXT, *ROWS[10:20], "#late"]) + "\n")
    (folder / "c.vcf").write_text("\n".join([HEADER_TEXT, *ROWS[20:30], "bad"]) + "\n")
    head, rows = read_vcf(spark, str(folder), mode="PERMISSIVE")
    got = rows.filter("error is null").selectExpr("regexp_extract(file, '[abc].vcf', 0) as f", "line_no", "pos").collect()
    n = len(HEADER_TEXT.split("\n"))
    assert sorted(map(tuple, got)) == [("a.vcf", n + 50 + i, i) for i in range(1, 11)] + [("b.vcf", n + i, i + 10) for i in range(1, 11)] + [("c.vcf", n + i, i + 20) for i in range(1, 11)]
    assert "c49" in head.entries["contig"] and first_failure(rows).line == n + 11
    with pytest.raises(FormatError, match=rf"\[Line #{n + 11}\] Error parsing data: .*COMMENT"):
        require_good(rows)
    plan = numbered(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    (folder / "d.vcf").write_text("\n".join([HEADER_TEXT + "\tS3", ROWS[0] + "\t0/0"]) + "\n")
    with pytest.raises(FormatError, match="different columns"):
        read_vcf(spark, str(folder))
    (folder / "d.vcf").write_text("##fileformat=VCFv4.2\nchr1\t1\n")
    with pytest.raises(FormatError, match="d.vcf"):
        read_vcf(spark, str(folder))


def test_writer_reads_quality_and_info(spark):
    lines = [ROWS[0].replace("5.2E-10", "x"), ROWS[1].replace("DB", "D B"), ROWS[2], ROWS[3].replace("5.2E-10", ".").replace("DP=4;DB", ".")]
    rows = from_lines(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, line_no long"), header())
    guards = rows.select(writer.write_guard(2).alias("g"), "line_no").orderBy("line_no").collect()
    assert [r["g"] for r in guards] == ["QUAL_NUMBER", "INFO_CHARACTER", None, None]
    with pytest.raises(Exception, match="QUAL_NUMBER|INFO_CHARACTER"):  # whichever task is first
        writer.render(rows, header()).collect()


def test_wrong_name(spark):
    with pytest.raises(FormatError):
        read_vcf(spark, "x.vcf.gz")


def test_modes(spark):
    lines = spark.createDataFrame([(ROWS[0], 1), ("#x", 2), (ROWS[1].replace("rs2", "."), 3)], "value string, line_no long")
    assert [r["error"] for r in from_lines(lines, header()).orderBy("line_no").collect()] == [None, "COMMENT", None]
    assert from_lines(lines, header(), mode="DROPMALFORMED").count() == 2
    assert from_lines(lines, header(), rsids_only=True, mode="DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match=r"\[Line #2\] Error parsing data: .*COMMENT"):
        from_lines(lines, header(), mode="FAILFAST").collect()


def test_store(spark, tmp_path):
    lines = spark.createDataFrame([(ROWS[0], 1), (ROWS[0].replace("rs1", "rs9"), 2), (ROWS[4], 3)], "value string, line_no long")
    rows = from_lines(lines, header())
    s = store.VariantStore(header(), rows, "KEEP_FIRST", "KEEP_LAST")
    assert s.at_locus("chr1", 1).collect()[0]["line_no"] == 1 and s.at_id("rs9").collect()[0]["line_no"] == 2
    got = s.genotype(s.at_id("rs1"), "S2").collect()[0]["genotype"]
    assert got["alleles"] == ["C", "GT"] and got["phased"]
    assert s.sample(s.positions(), "nobody").filter("sample is not null").count() == 0
    with pytest.raises(IndexError):
        s.sample(s.positions(), 2)
    with pytest.raises(Exception, match="Duplicate key"):
        store.dedupe(rows, ["chrom", "pos"]).collect()
    plan = store.dedupe(rows.select("chrom", "pos", "line_no"), ["chrom", "pos"], "KEEP_FIRST")
    assert {r["line_no"] for r in plan.collect()} == {1, 3} and "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()
    last = store.dedupe(rows, ["chrom", "pos"], "KEEP_LAST")
    assert last.columns == rows.columns and {r["line_no"] for r in last.collect()} == {2, 3} and "SortAggregate" not in last._jdf.queryExecution().executedPlan().toString()
    kept = s.save(str(tmp_path / "store"))
    assert kept.at_locus("chr1", 1).collect()[0]["line_no"] == 1 and kept.at_id("rs9").collect()[0]["line_no"] == 2 and kept.positions().count() == 2
    assert "PushedFilters: [IsNotNull(chrom), IsNotNull(pos), EqualTo(chrom,chr1), EqualTo(pos,1)]" in kept.at_locus("chr1", 1)._jdf.queryExecution().executedPlan().toString().replace("\n", " ")


def test_views(spark):
    rows = from_lines(spark.createDataFrame([(ROWS[0], 1), ("#x", 2)], "value string, line_no long"), header())
    assert set(views.register_views(spark, header(), rows, "t_")) <= {r["tableName"] for r in spark.sql("show views").selectExpr("viewName as tableName").collect()}
    got = spark.sql("select sample_name, gt, properties from t_genotypes where line_no = 1 order by sample_idx").collect()
    assert [(r["sample_name"], r["gt"], [tuple(p) for p in r["properties"]]) for r in got] == [("S1", "0/1", [("GT", "0/1"), ("DP", "3")]), ("S2", "1|2", [("GT", "1|2"), ("DP", ".")])]
    assert spark.sql("select count(*) from t_header_entries where kind = 'FORMAT'").first()[0] == 3


def test_write_refuses(spark):
    rows = from_lines(spark.createDataFrame([(ROWS[0],)], "value string"), header())
    with pytest.raises(Exception, match="REF_EMPTY"):
        writer.render(rows.withColumn("ref", F.lit("")), header()).collect()
    with pytest.raises(ValueError):
        transform.chain(header(), rows, [])


def test_stream(spark, file, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(open(file).read())
    q = stream_vcf(spark, str(tmp_path / "in"), header()).select("chrom", "pos", "error").writeStream.format("memory").queryName("variants_seen").start()
    q.processAllAvailable()
    q.stop()
    time.sleep(0)
    assert spark.table("variants_seen").filter("error is null").count() == 300


def test_entry_without_training_data_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/lociform", tmp_path / "lociform", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0 and "False" in said.stdout, said.stderr


def test_entry_without_a_library_of_the_training_data_operators():
    import os
    import subprocess
    import sys

    code = "import sys; sys.modules['public_tokenizers'] = None; import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; print(any(k.startswith('op') for k in e.queries()), len(e.queries()) > 80)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert said.returncode == 0 and "False True" in said.stdout, said.stderr


def test_edits_and_chain_files(spark, tmp_path):
    rows = from_lines(spark.createDataFrame([(ROWS[0], 1), (ROWS[1], 2)], "value string, line_no long"), header())
    got = rows.select(transform.sample_entries(F.get("samples", F.lit(0)), F.col("format")).alias("e")).first()["e"]
    assert [tuple(x) for x in got] == [("GT", "0/1"), ("DP", "3")]
    assert [(r["format"], r["samples"]) for r in transform.clear_samples(rows).collect()] == [([], [[], []])] * 2
    with pytest.raises(Exception, match="Not a value of GQ"):
        transform.put_sample(rows, 0, "GQ", F.lit("1:2")).collect()
    with pytest.raises(ValueError):
        transform.put_sample(rows, 0, "A:B", F.lit("1"))
    assert transform.put_sample(rows, 0, "GLE", F.lit("0:1")).count() == 2
    outputs = transform.chain(header(), rows, [transform.Transformation(keep=F.col("line_no") == 1), transform.Transformation(rows=lambda d: d.withColumn("pos", F.col("pos") + 5))])
    transform.write_chain(outputs, [str(tmp_path / "one.vcf"), str(tmp_path / "two.vcf")])
    assert [r["pos"] for r in read_vcf(spark, str(tmp_path / "one.vcf"))[1].collect()] == [1] and sorted(r["pos"] for r in read_vcf(spark, str(tmp_path / "two.vcf"))[1].collect()) == [6, 7]
    with pytest.raises(ValueError):
        transform.write_chain(outputs, ["x"])


def test_strict_forms(spark):
    from lociform.functions import alleles as A
    from lociform.functions import reserved as V
    from lociform.functions import typed as T
    from lociform.functions.grammar import RESERVED_FORMAT, RESERVED_INFO

    rows = from_lines(spark.createDataFrame([(ROWS[0].replace("DP=1;DB", "AN=1,2;DB;SVLEN=1,.;MATEID=a,b"),)], "value string"), header())
    everything = rows.select(V.all_info(F.col("info")).alias("i"), V.all_of_sample(F.get("samples", F.lit(0)), F.col("format")).alias("s")).first()
    assert set(everything["i"].asDict()) == set(RESERVED_INFO) and set(everything["s"].asDict()) == set(RESERVED_FORMAT) and len(RESERVED_INFO) == 41 and len(RESERVED_FORMAT) == 19
    assert everything["i"]["AN"] is None and everything["i"]["DB"] and everything["i"]["SVLEN"] == [1, None] and everything["i"]["MATEID"] == ["a", "b"] and everything["s"]["DP"] == 3
    for bad in (V.info(F.col("info"), "AN"), T.strict_qual(F.lit("x")), A.strict_length(F.lit("<DEL>")), A.strict_allele_at(F.col("ref"), F.col("alts"), F.lit(9))):
        with pytest.raises(Exception, match="AN|Not of type|QUAL|No length|No allele"):
            rows.select(bad).collect()
    good = rows.select(T.strict_qual(F.lit("1e2")).alias("q"), A.strict_length(F.lit("AC")).alias("n"), A.strict_allele_at(F.col("ref"), F.col("alts"), F.lit(2)).alias("a")).first()
    assert tuple(good) == (100.0, 2, "GT")
