"""Genotypes in long form, and names for records and header so that SQL can be asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genotypes import diploid, render
from ..functions.record import gt_text, sample_property
from ..sources.header import Header


def genotypes_long(header: Header, rows: DataFrame) -> DataFrame:
    """A row per record and sample: where it is, the sample's index and name, `gt`, and `properties` as (key, value) in the order of FORMAT.

    No shuffle: samples are exploded where their record is.
    """
    place = [c for c in ("line_no",) if c in rows.columns] + ["chrom", "pos", "ref", "alts"]
    # The outer form: the inner one filters by the size of the list first, which would take the samples apart twice.
    each = rows.select(*place, "format", F.posexplode_outer("samples").alias("sample_idx", "sample")).filter("sample_idx is not null")
    names = F.array(*map(F.lit, header.samples)).cast("array<string>")
    pairs = F.zip_with("format", "sample", lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return each.select(*place, "sample_idx", F.get(names, F.col("sample_idx")).alias("sample_name"), sample_property(F.col("sample"), F.col("format"), "GT").alias("gt"), pairs.alias("properties"))


def genotype_counts(rows: DataFrame) -> DataFrame:
    """(sample_idx, genotype, n): how often each sample has each diploid genotype; null for calls that are not diploid.

    Calls are counted by their text and alleles first, in each task; only the few distinct ones are read as genotypes.
    """
    # The outer form: the inner one filters by the size of the list first, which would take the samples apart twice.
    each = rows.select("ref", "alts", "format", F.posexplode_outer("samples_raw").alias("sample_idx", "sample")).filter("sample_idx is not null")
    calls = each.select("sample_idx", "ref", "alts", gt_text(F.col("sample"), F.col("format")).alias("gt")).groupBy("sample_idx", "ref", "alts", "gt").agg(F.count("*").alias("n"))
    return calls.groupBy("sample_idx", render(diploid(F.col("gt"), F.col("ref"), F.col("alts"))).alias("genotype")).agg(F.sum("n").alias("n"))


def register_views(spark: SparkSession, header: Header, rows: DataFrame, prefix: str = "") -> list[str]:
    """Temporary views variants, genotypes, header_entries, header_raw and header_columns, each with the prefix; their names are returned."""
    made = {
        "variants": rows, "genotypes": genotypes_long(header, rows), "header_entries": header.entries_df(spark),
        "header_raw": header.raw_df(spark), "header_columns": header.columns_df(spark),
    }
    for name, df in made.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in made]
