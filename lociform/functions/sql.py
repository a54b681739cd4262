"""The engine's functions in SQL: registered as SQL functions, so that a query inlines and optimises them like its own text."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name and arguments, result, and body of each scalar function. Texts are the fields of a line as they are written.
SCALARS = {
    "vcf_list(text STRING, mark STRING)": ("ARRAY<STRING>", r"if(text = '.', array(), filter(split(text, mark, -1), x -> x <> ''))"),
    "vcf_filter_status(filters STRING)": (
        "STRING",
        "case when exists(vcf_list(filters, ';'), x -> x not in ('PASS', '.')) then 'FAILED' when filters = '.' or array_join(vcf_list(filters, ';'), '') = '.' then 'NONE' else 'PASSED' end",
    ),
    "vcf_has_info(info STRING, name STRING)": ("BOOLEAN", "info <> '.' and exists(split(info, ';', -1), e -> e = name or startswith(e, concat(name, '=')))"),
    "vcf_info_values(info STRING, name STRING)": (
        "ARRAY<STRING>",
        """if(vcf_has_info(info, name), flatten(transform(filter(split(info, ';', -1), e -> e = name or startswith(e, concat(name, '='))),
           e -> if(contains(e, '='), transform(split(substr(e, length(name) + 2), ',', -1), v -> if(v = '', '.', v)), array('')))), null)""",
    ),
    "vcf_info(info STRING, name STRING)": ("STRING", "array_join(vcf_info_values(info, name), ',')"),
    "vcf_info_long(info STRING, name STRING)": ("BIGINT", r"if(rlike(vcf_info(info, name), '\\A[+-]?[0-9]+\\z'), try_cast(vcf_info(info, name) as bigint), null)"),
    "vcf_sample_value(sample STRING, keys STRING, name STRING)": (
        "STRING",
        "if(array_contains(split(keys, ':', -1), name), coalesce(nullif(get(split(sample, ':', -1), cast(array_position(split(keys, ':', -1), name) - 1 as int)), ''), '.'), null)",
    ),
    "vcf_alleles(ref STRING, alt STRING)": ("ARRAY<STRING>", "concat(array(ref), vcf_list(alt, ','))"),
    "vcf_allele_type(allele STRING)": (
        "STRING",
        "case when allele rlike '[\\\\[\\\\]]' then 'BREAKPOINT' when allele = '*' then 'DELETED' when contains(allele, '<') then 'SYMBOLIC' when allele = '.' then 'NO_VARIATION' when length(allele) = 1 then 'SINGLE_BASE' else 'MULTI_BASE' end",
    ),
    "vcf_genotype(gt STRING, ref STRING, alt STRING)": (
        "STRING",
        r"""if(exists(split(translate(gt, '|', '/'), '/', -1), x -> x not in ('', '.'))
             and forall(split(translate(gt, '|', '/'), '/', -1), x -> x in ('', '.') or rlike(x, '\\A[+-]?[0-9]+\\z') and try_cast(x as int) between 0 and size(vcf_list(alt, ','))),
           array_join(transform(split(translate(gt, '|', '/'), '/', -1), x -> if(x in ('', '.'), '.', get(vcf_alleles(ref, alt), try_cast(x as int)))), if(contains(gt, '|'), '|', '/')), null)""",
    ),
}
#: Table functions: a row per sample of a record, and a row per INFO entry.
TABLES = {
    "vcf_samples(ref STRING, alt STRING, keys STRING, samples ARRAY<STRING>)": (
        "sample_idx INT, gt STRING, genotype STRING", "select s.pos, vcf_sample_value(s.col, keys, 'GT'), vcf_genotype(vcf_sample_value(s.col, keys, 'GT'), ref, alt) from posexplode(samples) s",
    ),
    "vcf_entries(info STRING)": ("name STRING, value STRING", "select substring_index(e.col, '=', 1), if(contains(e.col, '='), substr(e.col, instr(e.col, '=') + 1), null) from explode(filter(split(if(info = '.', '', info), ';', -1), x -> x <> '')) e"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; returns their names. Each may use those before it."""
    for name, (kind, body) in SCALARS.items():
        spark.sql(f"create or replace temporary function {name} returns {kind} return {body}")
    for name, (columns, body) in TABLES.items():
        spark.sql(f"create or replace temporary function {name} returns table ({columns}) return {body}")
    return [name.partition("(")[0] for name in (*SCALARS, *TABLES)]
