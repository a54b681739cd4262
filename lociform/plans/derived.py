"""Queries over texts made from column values, with SQL that works out the result from the columns and never parses a text.

Each entry makes a text (or several) from a table's numbers and words, applies an operator to every row, and counts rows by result.
The text is SQL that both engines understand; what must come out is an expression of its own over the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles as A
from ..functions import genotypes as N
from ..functions import record as R
from ..functions import reserved as V
from ..functions import typed as T
from ..operators import writer
from ..sources.header import FormatError, quote, split_properties, unquote
from ..sources.scan import from_lines
from . import bridge as B


@dataclass(frozen=True)
class Derived:
    table: str
    texts: tuple[str, ...]
    apply: Callable[..., Column] | None
    want: str
    on_lines: Callable[[DataFrame], DataFrame] | None = None

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = B.table(spark, sf_dir, self.table).select(*[F.expr(B.spark_sql(x)).alias(f"x{i}") for i, x in enumerate(self.texts)])
        if self.on_lines is not None:
            made = self.on_lines(rows.withColumnRenamed("x0", "value"))
        else:
            made = rows.select(self.apply(*[F.col(f"x{i}") for i in range(len(self.texts))]).cast("string").alias("result"))
        return made.groupBy("result").agg(F.count("*").alias("n"))

    def sql(self) -> str:
        return f"select cast({self.want} as varchar) as result, count(*) as n from {self.table} group by 1"


def _s(x: str) -> str:
    return f"cast({x} as varchar(20))"


def _cat(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


#: Columns of lineitem: part, supplier, order, line (1 to 7), quantity.
P, S, O, L, Q = "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "cast(l_quantity as int)"  # noqa: E741


def _pick(by: str, *values: str) -> str:
    return f"case {by} % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


def _joined(xs: Column) -> Column:
    return F.array_join(xs.cast("array<string>"), "+", "NULL")


def _props(text: str) -> str:
    try:
        got = split_properties(text)
        return f"{got['ID']}|{unquote(got['Description'])}"
    except FormatError:
        return "error"


def _in_tasks(f: Callable[[str], str]) -> Callable[[DataFrame], DataFrame]:
    """The header's own functions on each row's text; they are plain Python, as the header is parsed on one machine."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([f(x) for x in b.column(0).to_pylist()], pa.string())], names=["result"])

    return lambda rows: rows.select("value").mapInArrow(run, "result string")


def _on_records(result: Callable[[], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: from_lines(rows.select("value"), B.header()).select(result().cast("string").alias("result"))


def _line(pos: str = _s(O), ids: str = "'.'", ref: str = "'A'", alt: str = "'C'", qual: str = "'9.5'", filters: str = "'PASS'", info: str = "'DP=1'", keys: str = "'GT:DP'", s1: str = "'0/1:3'", s2: str = "'0/0:4'") -> str:
    tab = "chr(9)"
    fields = ("'chr1'", pos, ids, ref, alt, qual, filters, info, keys, s1, s2)
    return _cat(*[x for f in fields for x in (tab, f)][1:])


_DIGITS = f"concat({_s(f'{P} + 1')}, lpad({_s(f'{S} % 100')}, 2, '0'))"
_SCALE = f"(5 - {L})"
_PLAIN = f"case when {_SCALE} = 0 then {_DIGITS} when length({_DIGITS}) > {_SCALE} then concat(substr({_DIGITS}, 1, cast(length({_DIGITS}) - {_SCALE} as int)), '.', substr({_DIGITS}, cast(length({_DIGITS}) - {_SCALE} + 1 as int))) else concat('0.', lpad({_DIGITS}, cast({_SCALE} as int), '0')) end"
_SCIENCE = f"concat(substr({_DIGITS}, 1, 1), '.', substr({_DIGITS}, 2), 'E+', {_s(f'length({_DIGITS}) - 1 - {_SCALE}')})"
_A, _B = f"{P} % 4", f"{S} % 3"  # allele numbers: the fourth and third are missing
_NAMES = ("'A'", "'C'", "'GT'")
_SEP = f"case when {O} % 2 = 0 then '/' else '|' end"
_SV1, _SV2 = _pick(P, "'DEL'", "'INS'", "'DUP'", "'CNV'", "'XYZ'", "'ME'"), _pick(S, "''", "':ME'", "':TANDEM'", "':x'", "':'", "':DEL'")
_N = f"({L} + 1)"

DERIVED: dict[str, Derived] = {
    "id_list_of_columns": Derived("lineitem", (_pick(P, "'.'", _cat("'rs'", _s(P)), _cat("'rs'", _s(P), "';;x'", _s(S), "';'")),), lambda t: F.coalesce(R.id_error(R.list_field(t, ";")), _joined(R.list_field(t, ";"))), _pick(P, "''", _cat("'rs'", _s(P)), _cat("'rs'", _s(P), "'+x'", _s(S)))),
    "alt_list_of_columns": Derived("lineitem", (_cat(f"repeat('A', cast({L} as int))", "','", f"repeat('GT', cast({S} % 3 + 1 as int))", _pick(P, "''", _cat("',<D'", _s(f"{S} % 7"), "'>'"), "',,'", "',?'")),), lambda t: F.coalesce(R.alt_error(R.list_field(t, ",")), F.concat(F.size(R.list_field(t, ",")).cast("string"), F.lit(":"), _joined(R.list_field(t, ",")))), _pick(P, *[_cat(n, f"repeat('A', cast({L} as int))", "'+'", f"repeat('GT', cast({S} % 3 + 1 as int))", x) for n, x in (("'2:'", "''"), ("'3:'", _cat("'+<D'", _s(f"{S} % 7"), "'>'")), ("'2:'", "''"))], "'ALT_GRAMMAR'")),
    "filter_of_columns": Derived("lineitem", (_pick(P, "'PASS'", "'.'", _cat("'q'", _s(f"{S} % 9 + 1")), _cat("'q'", _s(f"{S} % 9 + 1"), "';s'", _s(L)), "';'", _cat("'PASS;q'", _s(L)), _cat("'a b'", _s(L))),), lambda t: F.coalesce(R.filter_error(t), F.concat(R.filter_status(t), F.lit(" "), _joined(R.filters(t)))), _pick(P, "'PASSED '", "'NONE '", _cat("'FAILED q'", _s(f"{S} % 9 + 1")), _cat("'FAILED q'", _s(f"{S} % 9 + 1"), "'+s'", _s(L)), "'PASSED '", "'FILTER_COMBINED'", "'FILTER_WHITESPACE'")),
    "decimal_text_of_columns": Derived("lineitem", (_cat(_s(f"{P} + 1"), "'.'", f"lpad({_s(f'{S} % 100')}, 2, '0')", "'e'", _s(f"{L} - 3")),), lambda t: T.decimal_text(t), f"case when {_SCALE} >= 0 then {_PLAIN} else {_SCIENCE} end"),
    "qual_of_columns": Derived("lineitem", (_pick(P, _cat(_s(P), "'.'", _s(f"{S} % 10")), "'.'", _cat(_s(S), "'x'"), _cat("'-'", _s(L), "'e1'")),), lambda t: F.concat(T.qual_ok(t).cast("string"), F.lit(" "), F.coalesce(F.round(T.qual(t) * 10).cast("long").cast("string"), F.lit("null"))), _pick(P, _cat("'true '", _s(f"{P} * 10 + {S} % 10")), "'true null'", "'false null'", _cat("'true '", _s(f"{L} * -100")))),
    "format_keys_of_columns": Derived("lineitem", (_pick(P, _cat("'GT:K'", _s(L)), _cat("'K'", _s(L), "':GT'"), _cat("'GT:'", _s(L), "'K'"), _cat("'K'", _s(L), "'::K'", _s(f"{L} + {S} % 2"))),), lambda t: F.coalesce(R.format_error(R.fields(t, ":")), _joined(R.fields(t, ":"))), _pick(P, _cat("'GT+K'", _s(L)), "'FORMAT_GT_FIRST'", "'FORMAT_KEY'", f"case when {S} % 2 = 0 then 'FORMAT_DUPLICATE' else {_cat(chr(39) + 'K' + chr(39), _s(L), chr(39) + '++K' + chr(39), _s(f'{L} + 1'))} end")),
    "sample_values_of_columns": Derived("lineitem", (_pick(P, _cat("'0/1:'", _s(Q), "':'", _s(S)), _cat("'0/1:'", _s(Q)), _cat("'0/1::'", _s(S)), "''", _cat("'0/1:'", _s(Q), "':'", _s(S), "':'", _s(L))),), lambda t: _joined(R.sample_values(t, F.split(F.lit("GT:DP:GQ"), ":"))), _pick(P, _cat("'0/1+'", _s(Q), "'+'", _s(S)), _cat("'0/1+'", _s(Q), "'+.'"), _cat("'0/1+.+'", _s(S)), "'.+.+.'", _cat("'0/1+'", _s(Q), "'+'", _s(S), "'+'", _s(L)))),
    "likelihood_lists_of_columns": Derived("lineitem", (_pick(P, _cat("'0/1:0:-'", _s(Q), "','", _s(L), "'|1:-'", _s(S), "':'", _s(Q)), _cat("'0/1:0:-'", _s(Q), "','", _s(L), "'|1:-'", _s(S)), _cat("'0/1:x'", _s(L), "':'", _s(Q))),), lambda t: _joined(R.sample_values(t, F.split(F.lit("GT:GLE:DP"), ":"))), _pick(P, _cat("'0/1+0:-'", _s(Q), "','", _s(L), "'|1:-'", _s(S), "'+'", _s(Q)), _cat("'0/1+0:-'", _s(Q), "','", _s(L), "'|1:-'", _s(S), "'+.'"), _cat("'0/1+x'", _s(L), "'+'", _s(Q)))),
    "info_repeated_keys_of_columns": Derived("lineitem", (_cat("'DP='", _s(Q), f"case when {P} % 2 = 0 then ';DB' else '' end", "';AF=0.'", _s(f"{S} % 10"), f"case when {P} % 3 = 0 then concat(';DP=', {_s(L)}, ',') else '' end"),), lambda t: F.concat_ws(" ", *[F.array_join(R.info_values(R.info(t), k), "+") for k in ("DP", "DB", "AF")]), _cat(_s(Q), f"case when {P} % 3 = 0 then concat('+', {_s(L)}, '+.') else '' end", f"case when {P} % 2 = 0 then '  0.' else ' 0.' end", _s(f"{S} % 10"))),
    "info_text_by_key_of_columns": Derived("lineitem", (_pick(P, _cat("'XDP=9;DP='", _s(Q), "';DB'"), _cat("'DP='", _s(Q), "';DP='", _s(L)), "'.'", _cat("'DP;AF=0.'", _s(L)), _cat("'DP='", _s(Q), "',,'", _s(L)), "'DB'"),), lambda t: F.concat_ws(" ", F.coalesce(R.info_text_of(t, "DP"), F.lit("none")), R.info_has(t, "DP").cast("string"), (R.info_text_of(t, "DP").eqNullSafe(R.info_text(R.info(t), "DP"))).cast("string")), _pick(P, _cat(_s(Q), "' true true'"), _cat(_s(Q), "','", _s(L), "' true true'"), "'none false true'", "' true true'", _cat(_s(Q), "',.,'", _s(L), "' true true'"), "'none false true'")),
    "reserved_info_of_columns": Derived("lineitem", (_cat("'SVLEN=-'", _s(f"{P} + 1"), "','", _s(f"{S} + 1"), "';END='", _s(O), "';MATEID=a'", _s(L), "',b'", _s(L), f"case when {P} % 2 = 0 then ';DB' else '' end", "';CNADJ=.,'", _s(Q)),), lambda t: R.let(R.info(t), lambda i: F.concat_ws(" ", _joined(V.info(i, "SVLEN")), V.info(i, "END").cast("string"), _joined(V.info(i, "MATEID")), F.coalesce(V.info(i, "DB"), F.lit(False)).cast("string"), _joined(V.info(i, "CNADJ")))), _cat("'-'", _s(f"{P} + 1"), "'+'", _s(f"{S} + 1"), "' '", _s(O), "' a'", _s(L), "'+b'", _s(L), f"case when {P} % 2 = 0 then ' true ' else ' false ' end", "'NULL+'", _s(Q))),
    "reserved_format_of_columns": Derived("lineitem", (_cat("'0/1:'", _s(Q), "':'", _s(P), "','", _s(S), _pick(L, "''", "':.'", _cat("':'", _s(L)))),), lambda t: (lambda keys, values: F.concat_ws(" ", V.sample(values, keys, "DP").cast("string"), _joined(V.sample(values, keys, "HQ")), F.coalesce(V.sample(values, keys, "GQ").cast("string"), F.lit("none"))))(F.split(F.lit("GT:DP:HQ:GQ"), ":"), R.sample_values(t, F.split(F.lit("GT:DP:HQ:GQ"), ":"))), _cat(_s(Q), "' '", _s(P), "'+'", _s(S), "' '", _pick(L, "'none'", "'none'", _s(L)))),
    "integer_list_of_columns": Derived("lineitem", (_pick(P, _cat(_s(f"{P} + 1"), "',,-'", _s(f"{S} + 1")), _cat("'+'", _s(L), "',x'"), "'.'", _s(O)),), lambda t: F.when(~T.convertible(t, "Integer", True), "error").otherwise(F.coalesce(_joined(T.convert(t, "Integer", True)), F.lit("none"))), _pick(P, _cat(_s(f"{P} + 1"), "'+NULL+-'", _s(f"{S} + 1")), "'error'", "'none'", _s(O))),
    "allele_type_of_columns": Derived("lineitem", (_pick(P, f"repeat('A', cast({L} as int))", _cat("'<S'", _s(S), "'>'"), _cat("'G]'", _s(P), "':'", _s(S), "']'"), "'*'", _cat("'.'", f"repeat('T', cast({L} as int))")),), lambda a: F.concat(A.primary_type(a), F.lit(" "), F.coalesce(A.allele_length(a).cast("string"), F.lit("-"))), _pick(P, f"concat(case when {L} = 1 then 'SINGLE_BASE ' else 'MULTI_BASE ' end, {_s(L)})", "'SYMBOLIC -'", "'BREAKPOINT -'", "'DELETED -'", _cat("'MULTI_BASE '", _s(f"{L} + 1")))),
    "allele_case_of_columns": Derived("lineitem", (_cat(f"repeat('Ac', cast({L} as int))", "'<Del'", _s(S), "'>T'"), _cat(f"repeat('aC', cast({L} as int))", f"case when {P} % 2 = 0 then '<Del' else '<DEL' end", _s(S), "'>t'")), lambda a, b: F.concat(A.lowercase_bases(a), F.lit(" "), A.equal_ignoring_case(a, b).cast("string")), _cat(f"repeat('ac', cast({L} as int))", "'<Del'", _s(S), f"case when {P} % 2 = 0 then '>t true' else '>t false' end")),
    "store_genotype_of_columns": Derived("lineitem", (_cat(f"case when {_A} = 3 then '.' else {_s(_A)} end", _SEP, _s(_B), f"repeat('/1', cast({L} % 3 as int))"),), lambda t: F.when(N.store_genotype_error(t, F.lit("A"), F.array(F.lit("C"), F.lit("GT"))), "error").otherwise(N.render_store(N.store_genotype(t, F.lit("A"), F.array(F.lit("C"), F.lit("GT"))))), _cat(_pick(P, *_NAMES, "'.'"), _SEP, _pick(S, *_NAMES), f"repeat(concat({_SEP}, 'C'), cast({L} % 3 as int))")),
    "diploid_genotype_of_columns": Derived("lineitem", (f"case when {L} = 7 then {_s(_B)} else concat(case when {_A} = 3 then '.' else {_s(_A)} end, {_SEP}, {_s(_B)}) end",), lambda t: N.render(N.diploid(t, F.lit("A"), F.array(F.lit("C"), F.lit("GT")))), f"case when {L} = 7 then concat({_pick(S, *_NAMES)}, '|', {_pick(S, *_NAMES)}) else concat({_pick(P, *_NAMES, chr(39) + '.' + chr(39))}, case when {_A} = {_B} then '|' else {_SEP} end, {_pick(S, *_NAMES)}) end"),
    "diploid_errors_of_columns": Derived("lineitem", (_cat(_s(f"{P} % 6"), "'/'", _s(f"{S} % 4"), f"case when {L} = 1 then '/0' else '' end"),), lambda t: N.diploid_error(t, F.lit("A"), F.array(F.lit("C"), F.lit("GT"))), f"{P} % 6 > 2 or {S} % 4 > 2 or {L} = 1"),
    "genotype_indices_of_columns": Derived("lineitem", (_cat(_pick(P, *_NAMES), _SEP, _pick(S, *_NAMES)),), lambda t: N.strict_gt(N.from_bases(t), F.lit("A"), F.array(F.lit("C"), F.lit("GT"))), _cat(_s(f"{P} % 3"), f"case when {P} % 3 = {S} % 3 then '|' else {_SEP} end", _s(f"{S} % 3"))),
    "genotype_counts_of_columns": Derived("lineitem", (_s(L), _s(f"{S} % 5 + 1")), lambda a, p: N.expected_values(F.lit("G"), a.cast("int"), p.cast("int")), _pick(S, _N, f"{_N} * ({_N} + 1) // 2", f"{_N} * ({_N} + 1) * ({_N} + 2) // 6", f"{_N} * ({_N} + 1) * ({_N} + 2) * ({_N} + 3) // 24", f"{_N} * ({_N} + 1) * ({_N} + 2) * ({_N} + 3) * ({_N} + 4) // 120")),
    "ploidy_of_columns": Derived("lineitem", (_cat(f"repeat('0/', cast({L} - 1 as int))", _s(_B)),), lambda t: F.concat(N.ploidy(t).cast("string"), N.gt_index_ok(t, F.array(F.lit("C"))).cast("string")), _cat(_s(L), f"case when {_B} <= 1 then 'true' else 'false' end")),
    "sv_codes_of_columns": Derived("lineitem", (_cat(_SV1, _SV2),), lambda t: F.concat(A.sv_valid(t).cast("string"), F.lit(" "), _joined(A.sv_reserved(t))), f"concat(case when {P} % 6 >= 4 then 'false' else case {S} % 6 when 0 then 'true' when 1 then case when {P} % 6 in (0, 1) then 'true' else 'false' end when 2 then case when {P} % 6 = 2 then 'true' else 'false' end when 3 then 'true' else 'false' end end, ' ', case when {P} % 6 = 4 then 'NULL' else {_SV1} end, case {S} % 6 when 0 then '' when 1 then '+ME' when 2 then '+TANDEM' when 5 then '+DEL' else '+NULL' end)"),
    "bad_records_of_columns": Derived("lineitem", (_line(pos=f"case when {S} % 5 = 0 then concat('-', {_s(O)}) else {_s(O)} end", ref=f"case when {L} = 3 then 'X' else 'A' end", alt=_pick(P, "'C'", "'C,GT'", "'.,C'"), filters=f"case when {O} % 4 = 0 then '0' else 'q10' end"),), None, f"case when {S} % 5 = 0 and {O} > 0 then 'POS_NEGATIVE' when {L} = 3 then 'REF_GRAMMAR' when {P} % 3 = 2 then 'ALT_MISSING_COMBINED' when {O} % 4 = 0 then 'FILTER_ZERO' end", _on_records(lambda: F.col("error"))),
    "content_warnings_of_columns": Derived("lineitem", (_line(filters=_pick(P, "'PASS'", "'s50'"), info=_cat("'DP='", _pick(S, _s(Q), "'x'", _cat(_s(Q), "','", _s(L))), f"case when {L} = 2 then ';ZZ=1' else '' end")),), None, f"concat_ws(',', case when {P} % 2 = 1 then 'FILTER_UNDECLARED:s50' end, case when {L} = 2 then 'INFO_UNDECLARED:ZZ' end, case {S} % 3 when 1 then 'INFO_TYPE:DP' when 2 then 'INFO_COUNT:DP' end)", _on_records(lambda: F.array_join(writer.content_warnings(B.header()), ","))),
    "sample_warnings_of_columns": Derived("lineitem", (_line(s1=_cat("'0/'", _s(_B), "':'", _pick(P, _s(Q), "'x'", "'.'"))),), None, f"concat_ws(',', case when {P} % 3 = 1 then 'FORMAT_TYPE' end, case when {_B} = 2 then 'GT_INDEX' end)", _on_records(lambda: F.get(writer.sample_format_warnings(B.header()), F.lit(0)))),
    "write_guards_of_columns": Derived("lineitem", (_line(qual=_pick(P, _s(Q), "'.'", _cat(_s(Q), "'q'")), info=f"case when {S} % 3 = 0 then concat('A=', {_s(L)}, ' ', {_s(Q)}) else 'DB' end"),), None, f"case when {P} % 3 = 2 then 'QUAL_NUMBER' when {S} % 3 = 0 then 'INFO_CHARACTER' end", _on_records(lambda: writer.write_guard(2))),
    "header_properties_of_columns": Derived("part", (_cat("'ID=p'", _s("p_partkey"), "',Description=\"'", "p_name", "', size='", _s("p_size"), "'\"'", f"case when p_partkey % 3 = 0 then ',x' else '' end"),), None, "case when p_partkey % 3 = 0 then 'error' else concat('p', cast(p_partkey as varchar(20)), '|', p_name, ', size=', cast(p_size as varchar(20))) end", _in_tasks(_props)),
    "quoting_of_columns": Derived("part", (_cat("p_name", "'\"'", "p_type", "chr(92)", _s("p_size")),), None, "concat('\"', replace(replace(concat(p_name, '\"', p_type, chr(92), cast(p_size as varchar(20))), chr(92), concat(chr(92), chr(92))), '\"', concat(chr(92), '\"')), '\"')", _in_tasks(quote)),
}
