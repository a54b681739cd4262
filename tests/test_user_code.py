"""User code on single records, SQL functions, bucketed stores, duplicate policies on a stream, header edits, the allele grammar."""

import re

import pytest
from pyspark.sql import functions as F

from lociform.functions import alleles, genotypes, record
from lociform.functions.sql import register_functions
from lociform.operators import records, store, transform, writer
from lociform.plans.bridge import HEADER_TEXT, header
from lociform.sources.header import FormatError, Header, header_lines, parse_header
from lociform.sources.scan import from_lines
from lociform.streaming.dedupe import dedupe_stream, stream_records

ROWS = ["chr1\t%d\trs%d\tA\tC,GT\t5.2E-10\tPASS\tDP=%d;DB\tGT:DP\t0/1:3\t1|2:." % (i, i, i) for i in range(1, 31)]


def parsed(spark, lines=ROWS):
    return from_lines(spark.createDataFrame([(x, i) for i, x in enumerate(lines, 11)], "value string, line_no long").repartition(3), header())


def test_user_code_on_records(spark):
    def edit(head, r):
        assert head.samples == ("S1", "S2") and r["info"][0]["key"] == "DP"
        r["pos"] += 1_000
        r["samples"][0][1] = "9"
        return r["pos"] % 2 == 0

    got = records.each_record(parsed(spark, [*ROWS, "#bad"]), header(), edit)
    assert got.schema == parsed(spark).schema
    assert sorted(r["pos"] for r in got.filter("error is null").collect()) == list(range(1_002, 1_031, 2)) and got.filter("error = 'COMMENT'").count() == 1
    assert {r["samples"][0][1] for r in got.filter("error is null").collect()} == {"9"}
    assert writer.render(got.filter("pos = 1002"), header()).first()["value"] == ROWS[1].replace("\t2\t", "\t1002\t").replace("0/1:3", "0/1:9")


def test_errors_of_user_code_name_the_line(spark):
    def fail(head, r):
        if r["pos"] == 7:
            raise KeyError("no such thing")

    with pytest.raises(Exception, match=r"\[Line #17\] Error parsing data: KeyError: 'no such thing'"):
        records.each_record(parsed(spark), header(), fail).collect()


def test_parse_with_calls_the_header_once(spark):
    heads, seen = [], spark.sparkContext.accumulator(0)
    assert records.parse_with(parsed(spark), header(), lambda h, r: seen.add(r["pos"]), heads.append) == 30
    assert records.parse_with(parsed(spark).filter("pos < 0"), header(), lambda h, r: seen.add(1), heads.append) == 0
    assert len(heads) == 2 and seen.value == sum(range(1, 31))


def test_user_code_in_a_chain(spark):
    def odd_only(head, r):
        r["pos"] = r["pos"] * 10
        return r["pos"] // 10 % 2 == 1

    steps = [transform.Transformation(each=odd_only), transform.Transformation(keep=F.col("pos") > 100)]
    first, second = (rows for _, rows in transform.chain(header(), parsed(spark), steps))
    assert sorted(r["pos"] for r in first.collect()) == list(range(10, 300, 20)) and sorted(r["pos"] for r in second.collect()) == list(range(110, 301, 10))
    lines = transform.fan_out(header(), parsed(spark), steps)[1].groupBy("output").agg(F.count("value").alias("n")).collect()
    assert {r["output"]: r["n"] for r in lines} == {0: 15, 1: 20}


def test_sql_functions_equal_the_expressions(spark):
    register_functions(spark)
    infos = [(x, k) for x in ("DP=3;DP=4,;DB", "DB", ".", "XDP=1", "DP=", "A=b=c;DP=+7") for k in ("DP", "DB", "A")]
    made = spark.createDataFrame(infos, "info string, name string")
    for x, k, text, has in ((r[0], r[1], r[2], r[3]) for r in made.selectExpr("info", "name", "vcf_info(info, name)", "vcf_has_info(info, name)").collect()):
        want = made.filter((F.col("info") == x) & (F.col("name") == k)).select(record.info_text(record.info(F.col("info")), k), record.info_has(F.col("info"), k)).first()
        assert (text, has) == tuple(want), (x, k)
    calls = spark.createDataFrame([(g,) for g in ("0|1", "0/1", "1", ".", "./.", "0/.", "0/", "0/1/2", "+1/0", "5", "X/0", "0/0")], "gt string")
    ours = genotypes.render_store(genotypes.store_genotype(F.col("gt"), F.lit("A"), F.array(F.lit("C"), F.lit("GT"))))
    assert calls.select(ours.eqNullSafe(F.expr("vcf_genotype(gt, 'A', 'C,GT')")).alias("same")).filter("not same").count() == 0
    names = spark.createDataFrame([(a,) for a in ("A", "AC", "*", ".", "<D>", "G]17:1]", ".A")], "a string")
    assert names.select((alleles.primary_type(F.col("a")) == F.expr("vcf_allele_type(a)")).alias("same")).filter("not same").count() == 0
    status = spark.createDataFrame([(f,) for f in ("PASS", ".", "q10", "q10;;s50", ";", "PASS;", ".;")], "f string")
    assert status.select((record.filter_status(F.col("f")) == F.expr("vcf_filter_status(f)")).alias("same")).filter("not same").count() == 0
    assert spark.sql("select e.name, e.value from (select 'A=1;;DB' as info) r, lateral vcf_entries(r.info) e").collect() == [("A", "1"), ("DB", None)]


def test_bulk_lookup_leaves_the_store_where_it_is(spark, tmp_path):
    s = store.VariantStore(header(), parsed(spark), "KEEP_FIRST", "KEEP_LAST").save_tables("bucketed_store", 4, str(tmp_path / "tables"))
    keys = spark.range(1, 2_001).selectExpr("concat('chr', cast(1 + cast(id / 1500 as int) as string)) as chrom", "id as pos")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = s.lookup_loci(keys)
        plan = found._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("FileScan parquet") - 400 : plan.index("FileScan parquet")]
        assert plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in below and "Bucketed: true" in plan
        assert found.filter("ref is not null").count() == 30 and found.count() == 2_000
        ids = s.lookup_ids(spark.createDataFrame([("rs3",), ("none",)], "id string"))
        assert ids._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1 and ids.filter("ref is not null").count() == 1
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not show which buckets are read
        one = s.at_id("rs3")
        assert "SelectedBucketsCount: 1 out of 4" in one._jdf.queryExecution().executedPlan().toString() and one.first()["pos"] == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert store.VariantStore.open_tables(spark, header(), "bucketed_store").positions().count() == 30
    for part in ("locus", "id"):
        spark.sql(f"drop table bucketed_store_{part}")


@pytest.mark.parametrize("policy", ["KEEP_FIRST", "KEEP_LAST"])
def test_duplicate_policies_on_a_stream(spark, tmp_path, policy):
    folder, marks = tmp_path / "in.vcf", str(tmp_path / "marks")
    folder.mkdir()
    parts = [[*ROWS[:6], ROWS[0]], [ROWS[4].replace("rs5", "rs99"), *ROWS[6:9], "bad"], [*ROWS[3:5], ROWS[20]]]
    kept = {}

    def take(batch, _):
        for r in batch.collect():
            kept[r["chrom"], r["pos"]] = (r["file"], r["line_no"], r["text"])

    for k, lines in enumerate(parts):  # a batch each, and a restart before each
        (folder / f"{k}.vcf").write_text("\n".join([HEADER_TEXT, *lines]) + "\n")
        rows = stream_records(spark, str(folder), header())
        query = dedupe_stream(rows, ["chrom", "pos"], policy).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()
    from lociform.sources.scan import read_vcf

    whole = read_vcf(spark, str(folder), mode="PERMISSIVE")[1].filter("error is null")
    want = {(r["chrom"], r["pos"]): (r["file"], r["line_no"]) for r in store.dedupe(whole, ["chrom", "pos"], policy).collect()}
    assert {k: v[:2] for k, v in kept.items()} == want and len(want) == 10 and all(v[2].split("\t")[1] == str(k[1]) for k, v in kept.items())


def test_a_duplicate_stops_the_stream(spark, tmp_path):
    folder, marks = tmp_path / "in.vcf", str(tmp_path / "marks")
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.vcf").write_text("\n".join([HEADER_TEXT, ROWS[0], ROWS[k + 1]]) + "\n")
        run = lambda: dedupe_stream(stream_records(spark, str(folder), header()), ["chrom", "pos"]).writeStream.outputMode("update").format("noop").option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
        if k == 0:
            run()
    with pytest.raises(Exception, match="Duplicate key"):
        run()
    with pytest.raises(ValueError):
        dedupe_stream(stream_records(spark, str(folder), header()), ["pos"], "ANY")


def test_header_edits():
    head = parse_header(HEADER_TEXT.replace("#CHROM", '##PEDIGREE=<Child=a,Mother=b>\n##assembly=x\n##assembly=y\n#CHROM').split("\n"))
    assert head.without_raw("assembly", "x").raw_values("assembly") == ["y"] and head.without_raw("assembly").raw == () and head.without_raw("none") == head
    more = head.with_pedigree({"Child": "c"}).with_pedigree({"Child": "c"})
    assert len(more.pedigree) == 3 and "##PEDIGREE=<Child=c>" in header_lines(more)
    assert more.without_pedigree({"Child": "c"}).pedigree == ({"Child": "a", "Mother": "b"}, {"Child": "c"}) and head.without_pedigree({"x": "y"}) == head
    with pytest.raises(FormatError):
        head.with_pedigree({"Child": "a\nb"})
    with pytest.raises(FormatError):
        Header().with_file_format("VCFv4.٣")  # a digit of another script


def test_allele_grammar():
    from lociform.functions.grammar import ALT

    pattern = re.compile(ALT.replace(r"\z", r"\Z"))
    good = ["A", "ACGTNacgtn", "<DEL>", "*", ".", ".A", "A.", ".*", "*.", "G]17:198982]", "]13:123456]T", "C[2:321682[", "[17:198983[A", "G[<ctg1>:7[", "A<X>", "<X>A<Y>.", "[1[", "].1]"[:0] + "]1]", ".G[1:2[.", ".]1]", "[<a>[*"]
    bad = ["", "G]chr17:198982]", "R", "A\n", "<a b>", "<a,b>", "A[1:2", "A[1:2]", "..", ".A.", "A*", "**", "G[1:[", "A[1[A[1[", "<>", "[1[A]", "A-", "]1]A.."]
    assert [a for a in good if not pattern.match(a)] == [] and [a for a in bad if pattern.match(a)] == []
    assert not any(pattern.match(a) for a in ("G[٣:1[",))


def test_info_as_a_variant(spark):
    from lociform.functions import reserved
    from lociform.functions.grammar import RESERVED_INFO
    from lociform.functions.variant import info_variant, variant_info, variant_text

    texts = [".", "DB", "DP=3;DB;AF=0.1,0.2", "DP=1;DP=2", "DP=;AN=1", "A=b=c;SVLEN=-5,,7", ";DP=4;", "=1;DP=5", 'AA="x\\y";1000G', "AN=1,2;DB;DB", "SVLEN=x;END=9223372036854775808", "AA=a\x01b", "MATEID=a,b;H2", "DP=.", "AF=,"]
    rows = spark.createDataFrame([(t,) for t in texts], "raw string").select("raw", info_variant(F.col("raw")).alias("v"))
    for key in RESERVED_INFO:
        same = variant_info(F.col("v"), key).eqNullSafe(reserved.info(record.info(F.col("raw")), key, strict=False))
        assert rows.filter(~same).collect() == [], key
    assert rows.filter(~variant_text(F.col("v"), "A").eqNullSafe(record.info_text(record.info(F.col("raw")), "A"))).count() == 0
    assert rows.select(variant_info(F.col("v"), "DP", "Integer", True).alias("d")).filter("raw = 'DP=1;DP=2'").first()["d"] == [1, 2]
