"""Variant text made from relational tables, and hand-written cases spread over a table's rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.header import Header, parse_header


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HEADER_TEXT = """##fileformat=VCFv4.2
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">
##INFO=<ID=AF,Number=A,Type=Float,Description="Frequency">
##INFO=<ID=DB,Number=0,Type=Flag,Description="In a database">
##INFO=<ID=XR,Number=R,Type=String,Description="One for each allele">
##FILTER=<ID=q10,Description="Quality below 10">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">
##FORMAT=<ID=PL,Number=G,Type=Integer,Description="Likelihoods">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2"""


def header() -> Header:
    return parse_header(HEADER_TEXT.split("\n"))


#: Parts of the text that both engines make from numbers: SQL that both understand.
LINEITEM_LINE = r"""
concat('chr', cast(l_suppkey % 5 + 1 as varchar(20)), chr(9), cast(l_orderkey * 10 + l_linenumber as varchar(20)), chr(9),
  case when l_partkey % 3 = 0 then '.' else concat('rs', cast(l_partkey as varchar(20))) end, chr(9), 'A', chr(9),
  case when l_partkey % 4 = 0 then 'C,GT' else 'C' end, chr(9), cast(cast(l_extendedprice as decimal(12,2)) as varchar(20)), chr(9),
  case l_partkey % 4 when 0 then 'PASS' when 1 then 'q10' when 2 then '.' else 'q10;s50' end, chr(9),
  concat('DP=', cast(cast(l_quantity as int) as varchar(20)), case when l_linenumber % 2 = 0 then ';DB' else '' end), chr(9),
  'GT:DP', chr(9), case l_partkey % 5 when 0 then '0/0' when 1 then '0|1' when 2 then '1/1' when 3 then './.' else '.' end, ':', cast(l_linenumber as varchar(20)), chr(9), '0/1')
"""
ORDERS_LINE = r"""
concat('chr', cast(o_custkey % 5 + 1 as varchar(20)), chr(9), cast(o_custkey as varchar(20)), chr(9), case when o_orderkey % 4 = 0 then '.' else concat('rs', cast(o_custkey as varchar(20))) end, chr(9), 'A', chr(9),
  case when o_orderkey % 3 = 0 then 'C,GT' else 'C' end, chr(9), cast(cast(o_totalprice as decimal(12,2)) as varchar(20)), chr(9), case when o_orderstatus = 'F' then 'PASS' else 'q10' end, chr(9),
  concat('DP=', cast(o_orderkey % 97 as varchar(20)), case when o_orderkey % 2 = 0 then ';DB' else '' end), chr(9), 'GT:DP', chr(9), case when o_orderkey % 2 = 0 then '0|1' else '1/1' end, ':', cast(o_orderkey % 7 as varchar(20)), chr(9), '0/0:3')
"""


def spark_sql(text: str) -> str:
    return text.replace("varchar(20)", "string").replace(" // ", " div ")


def lineitem_lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.expr(spark_sql(LINEITEM_LINE)).alias("value"), *more)


def orders_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value and line_no = o_orderkey, which is unique."""
    return table(spark, sf_dir, "orders").select(F.expr(spark_sql(ORDERS_LINE)).alias("value"), F.col("o_orderkey").alias("line_no"))


@dataclass(frozen=True)
class Cases:
    """Hand-written cases of an operator: inputs and the text of what it must return (None: null).

    Each row of lineitem stands for the case l_partkey % number of cases; the query counts rows by case and result.
    """

    cases: list[tuple]
    apply: Callable[..., Column] | None = None
    on_lines: Callable[[DataFrame], DataFrame] | None = None

    def inputs(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        k, width = len(self.cases), len(self.cases[0]) - 1
        which = F.col("l_partkey") % k
        values = [F.get(F.array(*[F.lit(c[j]).cast("string") for c in self.cases]), which.cast("int")).alias(f"x{j}") for j in range(width)]
        return table(spark, sf_dir, "lineitem").select(which.alias("case_no"), *values)

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = self.inputs(spark, sf_dir)
        if self.on_lines is not None:
            made = self.on_lines(rows.withColumnRenamed("x0", "value"))
        else:
            made = rows.withColumn("result", self.apply(*[F.col(f"x{j}") for j in range(len(self.cases[0]) - 1)]).cast("string"))
        return made.groupBy("case_no", "result").agg(F.count("*").alias("n"))

    def sql(self) -> str:
        text = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'"
        whens = " ".join(f"when {i} then {text(c[-1])}" for i, c in enumerate(self.cases))
        return f"select l_partkey % {len(self.cases)} as case_no, cast(case l_partkey % {len(self.cases)} {whens} end as varchar) as result, count(*) as n from lineitem group by 1, 2"
