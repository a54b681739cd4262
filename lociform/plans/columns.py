"""More queries over texts made from column values, a block for each, and queries of user code, SQL functions, fan-out and files."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles as A
from ..functions import genotypes as N
from ..functions import typed as T
from ..functions.sql import register_functions
from ..functions.variant import info_variant, variant_info
from ..operators import records, store, transform, writer
from ..sources.header import entry_warnings, split_properties
from ..sources.scan import from_lines
from . import bridge as B
from .derived import _A, _B, _SEP, DERIVED, Derived, L, O, P, Q, S, _cat, _in_tasks, _line, _on_records, _pick, _s


def _warned(text: str) -> str:
    section, _, props = text.partition(" ")
    return ",".join(entry_warnings(section, split_properties(props)))


def _edited(rows: DataFrame) -> DataFrame:
    """Good records, edited as their number tells, and validated."""
    e = F.col("x1").cast("int")
    made = from_lines(rows.select("value", "x1"), B.header()).withColumns({
        "ref": F.when(e == 1, "Z").otherwise(F.col("ref")),
        "alts": F.when(e == 2, F.array(F.lit("?"))).otherwise(F.col("alts")),
        "ids": F.when(e == 3, F.array(F.lit("a"), F.lit("a"))).otherwise(F.col("ids")),
        "filters": F.when(e == 4, F.array(F.lit("0"))).otherwise(F.col("filters")),
        "pos": F.when(e == 5, -F.col("pos") - 1).otherwise(F.col("pos")),
        "info": F.when(e == 6, transform.put_info(F.col("info"), "X", ["a b"])).otherwise(F.col("info")),
    })
    return made.select(writer.invalid().alias("result"))


_EXPONENT = f"2147483640 + {S} % 16"
_SIGN = f"case when {P} % 2 = 0 then '-' else '' end"

COLUMNS: dict[str, Derived] = {
    "write_guards_of_malformed": Derived(
        table="lineitem",
        texts=(_cat(_line(pos=_pick(P, _s(O), _cat("'x'", _s(O)), _s(O), _s(O)), ref=_pick(P, "'A'", "'A'", _cat("'X'", _s(L)), "'A'")), f"case when {P} % 4 = 3 then concat(chr(9), {_s(L)}) else '' end"),),
        apply=None,
        on_lines=_on_records(lambda: writer.write_guard(2)),
        want=_pick(P, "cast(null as varchar(20))", "'POS_NUMBER'", "'REF_GRAMMAR'", "'COLUMN_COUNT'"),
    ),
    "decimal_limits": Derived(
        table="lineitem",
        texts=(_cat(_s(L), "'e'", _SIGN, _s(_EXPONENT)),),
        apply=lambda t: F.concat(T.decimal_ok(t).cast("string"), F.lit(" "), F.coalesce(T.decimal_text(t), F.lit("none"))),
        want=f"case when {_EXPONENT} > 2147483647 then 'false none' else {_cat(chr(39) + 'true ' + chr(39), _s(L), chr(39) + 'E' + chr(39), f'case when {P} % 2 = 0 then {chr(39)}-{chr(39)} else {chr(39)}+{chr(39)} end', _s(_EXPONENT))} end",
    ),
    "normalisation_warnings_of_columns": Derived(
        table="lineitem",
        texts=(_line(
            ids=_pick(P, _cat("'rs'", _s(P)), _cat("'rs'", _s(P), "';;x'")),
            info=_pick(S, _cat("'DP='", _s(Q)), _cat("'DP='", _s(Q), "';;DB'"), _cat("'AF=0.'", _s(L), "',,1'")),
            s1=f"case when {L} % 2 = 0 then '0/1:' else '0/1:3' end",
        ),),
        apply=None,
        on_lines=_on_records(lambda: F.array_join("warnings", ",")),
        want=f"concat_ws(',', case when {P} % 2 = 1 then 'ID_EMPTY' end, case {S} % 3 when 1 then 'INFO_EMPTY_ENTRY' when 2 then 'INFO_EMPTY_VALUE' end, case when {L} % 2 = 0 then 'SAMPLE_EMPTY' end)",
    ),
    "float_of_columns": Derived(
        table="lineitem",
        texts=(_pick(P, _cat(_s(Q), "'.5'"), _cat(_s(Q), "'e1'"), _cat(_s(Q), "'d'"), "'.'"),),
        apply=lambda t: F.when(~T.convertible(t, "Float"), "error").otherwise(F.coalesce(F.round(T.convert(t, "Float") * 10).cast("long").cast("string"), F.lit("none"))),
        want=_pick(P, _s(f"{Q} * 10 + 5"), _s(f"{Q} * 100"), "'error'", "'none'"),
    ),
    "boolean_of_columns": Derived(
        table="lineitem",
        texts=(_pick(P, _s(f"{S} % 3"), f"substr('TRUEFalse', cast(case when {S} % 2 = 0 then 1 else 5 end as int), cast(case when {S} % 2 = 0 then 4 else 5 end as int))", "'.'", "' '"),),
        apply=lambda t: F.when(~T.convertible(t, "Flag"), "error").otherwise(F.coalesce(T.convert(t, "Flag").cast("string"), F.lit("none"))),
        want=_pick(P, f"case {S} % 3 when 0 then 'false' when 1 then 'true' else 'error' end", f"case when {S} % 2 = 0 then 'true' else 'false' end", "'none'", "'true'"),
    ),
    "character_of_columns": Derived(
        table="lineitem",
        texts=(f"substr('abcdefg', cast({L} as int), cast({P} % 2 + 1 as int))",),
        apply=lambda t: F.when(~T.convertible(t, "Character"), "error").otherwise(T.convert(t, "Character")),
        want=f"case when {P} % 2 = 0 or {L} = 7 then substr('abcdefg', cast({L} as int), 1) else 'error' end",
    ),
    "allele_at_index_of_columns": Derived(
        table="lineitem",
        texts=(f"repeat('A', cast({L} as int))", _cat(f"repeat('C', cast({S} % 3 + 1 as int))", "',GT'"), _s(f"{P} % 5 - 1")),
        apply=lambda ref, alts, i: A.allele_at(ref, F.split(alts, ","), i.cast("int")),
        want=f"case {P} % 5 when 1 then repeat('A', cast({L} as int)) when 2 then repeat('C', cast({S} % 3 + 1 as int)) when 3 then 'GT' end",
    ),
    "allele_ambiguity_of_columns": Derived(
        table="lineitem",
        texts=(_cat(f"repeat('A', cast({L} as int))", _pick(P, "''", "'n'", _cat("'<N'", _s(S), "'>'"))),),
        apply=lambda a: F.concat(A.is_ambiguous(a).cast("string"), F.lit(" "), A.contains_base(a, "A").cast("string"), F.lit(" "), A.contains_base(a, "N").cast("string")),
        want=f"case when {P} % 3 = 1 then 'true true false' else 'false true false' end",
    ),
    "genotype_facts_of_columns": Derived(
        table="lineitem",
        texts=(f"case when {L} = 7 then './.' else concat(case when {_A} = 3 then '.' else {_s(_A)} end, {_SEP}, {_s(_B)}) end",),
        apply=lambda t: (lambda g: F.concat(F.when(g["phased"], "P").otherwise("-"), F.when(N.is_homozygous(g), "H").otherwise("-"), F.when(N.is_no_call(g), "N").otherwise("-"), F.size(N.allele_set(g)).cast("string")))(
            N.diploid(t, F.lit("A"), F.array(F.lit("C"), F.lit("GT")))
        ),
        want=f"case when {L} = 7 then '-HN0' else concat(case when {_A} = {_B} or {O} % 2 = 1 then 'P' else '-' end, case when {_A} = {_B} then 'H' else '-' end, '-', case when {_A} = {_B} or {_A} = 3 then '1' else '2' end) end",
    ),
    "row_validation_of_columns": Derived(
        table="lineitem",
        texts=(_line(), _s(f"({P} + {L}) % 7")),
        apply=None,
        on_lines=_edited,
        want=f"case ({P} + {L}) % 7 when 1 then 'REF' when 2 then 'ALT' when 3 then 'ID' when 4 then 'FILTER' when 5 then 'POS' when 6 then 'INFO' end",
    ),
    "header_warnings_of_columns": Derived(
        table="part",
        texts=(_cat("'INFO ID=p'", _s("p_partkey"), "',Number='", _pick("p_partkey", "'1'", "'x'", "'A'"), "',Type='", _pick("p_size", "'Integer'", "'Odd'", "'Flag'"), "',Description='", "case when p_partkey % 2 = 0 then concat('\"', p_name, '\"') else 'plain' end"),),
        apply=None,
        on_lines=_in_tasks(_warned),
        want="concat_ws(',', case when p_partkey % 3 = 1 then 'NUMBER_INVALID' end, case p_size % 3 when 1 then 'TYPE_INVALID' when 2 then 'FLAG_NUMBER' end, case when p_partkey % 2 = 1 then 'DESCRIPTION_UNQUOTED' end)",
    ),
}


def _by_variant(rows: DataFrame) -> DataFrame:
    """Five reserved keys of INFO, which is a VARIANT column first."""
    v, text = F.col("v"), lambda xs: F.array_join(xs.cast("array<string>"), "+", "NULL")
    got = lambda key: variant_info(v, key)
    shown = F.concat_ws(" ", text(got("SVLEN")), got("END").cast("string"), text(got("MATEID")), F.coalesce(got("DB"), F.lit(False)).cast("string"), text(got("CNADJ")))
    return rows.select(info_variant(F.col("value")).alias("v")).select(shown.alias("result"))


COLUMNS["reserved_info_by_variant"] = replace(DERIVED["reserved_info_of_columns"], apply=None, on_lines=_by_variant)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_lines(B.orders_lines(spark, sf_dir), B.header())


def sql_functions_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_functions(spark)
    B.lineitem_lines(spark, sf_dir).createOrReplaceTempView("lineitem_text")
    return spark.sql("""
        select f[0] as chrom, vcf_filter_status(f[6]) as status, count(*) as n, sum(vcf_info_long(f[7], 'DP')) as depth,
          count_if(vcf_has_info(f[7], 'DB')) as flagged, count_if(vcf_genotype(vcf_sample_value(f[9], f[8], 'GT'), f[3], f[4]) = 'A|C') as called
        from (select split(value, '\\t') as f from lineitem_text) group by 1, 2""")


def dedupe_over_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of three files: the first record of a locus is that of the first file, and of its first line."""
    o = B.table(spark, sf_dir, "orders")
    lines = o.select(F.expr(B.spark_sql(B.ORDERS_LINE)).alias("value"), F.expr("concat('f', cast(o_orderkey % 3 as string))").alias("file"), F.expr("o_orderkey div 3").alias("line_no"))
    rows = from_lines(lines, B.header()).select("chrom", "pos", "file", "line_no")
    return store.dedupe(rows, ["chrom", "pos"], "KEEP_FIRST")


def user_code_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    def edit(header, record: dict) -> bool:
        record["pos"] = 2 * record["pos"] + len(record["info"])
        return record["line_no"] % 3 != 0

    return records.each_record(_orders(spark, sf_dir).select("line_no", "pos", "info"), B.header(), edit).select("line_no", "pos")


def fan_out_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = transform.Transformation(
        header=lambda h: h.with_entry("FILTER", {"ID": "deep", "Description": '"Deep"'}),
        rows=lambda df: df.withColumns({"pos": F.col("pos") + 10, "info": transform.put_info(F.col("info"), "DB", None)}), keep=F.col("line_no") % 2 == 0,
    )
    second = transform.Transformation(rows=lambda df: df.withColumns({"pos": F.col("pos") * 2, "info": transform.remove_info(F.col("info"), "DP")}))
    _, lines = transform.fan_out(B.header(), _orders(spark, sf_dir), [first, second])
    return lines.select("output", "line_no", F.regexp_replace("value", "\t", " ").alias("value"))
