"""Keyed store: records by locus and by ID, duplicate policies, lookups of records, samples and genotypes."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genotypes import store_genotype, store_genotype_error
from ..functions.record import sample_property
from ..sources.header import Header

POLICIES = ("FAIL", "KEEP_FIRST", "KEEP_LAST")


def _place(rows: DataFrame, order: str | None) -> Column:
    """Where a record stands: the column `order`, or its line, within its file where there are files."""
    if order is not None:
        return F.col(order)
    return F.struct("file", "line_no") if "file" in rows.columns else F.col("line_no")


def duplicates(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Keys that occur more than once, with their count and their first and last line (of several files: file and line)."""
    order = _place(rows, order)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias("first_line"), F.max(order).alias("last_line")).filter("n > 1")


def dedupe(rows: DataFrame, keys: list[str], policy: str = "FAIL", order: str | None = None) -> DataFrame:
    """One row for each key: the first or the last by `order`, which no two rows of a key share. FAIL raises if a key is repeated.

    Without `order` it is the line number, and of records of several files the file by name and then the line.

    A hash aggregate finds the order of the row to keep, combining before the shuffle, so that a key with very many rows sends
    one row a task; its result is joined back for the columns that are read. Without other columns there is no join.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {', '.join(POLICIES)}")
    place = _place(rows, order)
    own = [order] if order is not None else [c for c in ("file", "line_no") if c in rows.columns]
    pick = F.min(place) if policy != "KEEP_LAST" else F.max(place)
    out = rows.groupBy(*keys).agg(pick.alias("place"), *([F.count("*").alias("n")] if policy == "FAIL" else []))
    if policy == "FAIL":
        out = out.filter(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("Duplicate key: "), F.to_json(F.struct(*keys)))).cast("boolean")).otherwise(True)).drop("n")
    parts = {c: F.col("place")[c] if len(own) > 1 else F.col("place") for c in own}
    if set(rows.columns) == {*keys, *own}:
        return out.withColumns(parts).select(*rows.columns)
    kept = out.select(*[F.col(c).alias(f"kept_{c}") for c in keys], *[p.alias(f"kept_{c}") for c, p in parts.items()])
    return rows.join(kept, reduce(and_, [F.col(c).eqNullSafe(F.col(f"kept_{c}")) for c in (*keys, *own)]), "left_semi")


class VariantStore:
    """Two views of records, each with its own duplicate policy: one row per (chrom, pos), and one per ID.

    A record that loses its locus may still be the one of its ID. Malformed lines, which PERMISSIVE mode keeps, are no records.
    """

    def __init__(self, header: Header, records: DataFrame, locus_policy: str = "FAIL", id_policy: str = "FAIL"):
        self.header = header
        if "error" in records.columns:
            records = records.filter(F.col("error").isNull())
        self.by_locus = dedupe(records, ["chrom", "pos"], locus_policy)
        self.by_id = dedupe(records.withColumn("id", F.explode("ids")), ["id"], id_policy)

    def save(self, folder: str) -> VariantStore:
        """Write both views below folder, each in the order of its key, and return a store that reads them.

        Text is parsed and duplicates are settled once; a lookup then reads the few row groups whose ranges hold its key.
        """
        for name, view, keys in (("locus", self.by_locus, ["chrom", "pos"]), ("id", self.by_id, ["id"])):
            view.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{folder}/{name}")
        return VariantStore.open(self.by_locus.sparkSession, self.header, folder)

    @classmethod
    def open(cls, spark: SparkSession, header: Header, folder: str) -> VariantStore:
        out = cls.__new__(cls)
        out.header, out.by_locus, out.by_id = header, spark.read.parquet(f"{folder}/locus"), spark.read.parquet(f"{folder}/id")
        return out

    def save_tables(self, name: str, buckets: int = 64, folder: str | None = None) -> VariantStore:
        """Write both views as tables of the catalog (below folder, or in the warehouse), in buckets of their key, and return a store that reads them.

        A bulk lookup then shuffles its keys to the buckets and leaves the store where it is; a lookup of one key reads one bucket, and
        of that only row groups whose Bloom filter of IDs, or range of positions, may hold it.
        """
        for view, part, keys in ((self.by_locus, "locus", ["chrom", "pos"]), (self.by_id, "id", ["id"])):
            blooms = {f"parquet.bloom.filter.enabled#{k}": "true" for k in keys if k == "id"}
            where = {"path": f"{folder}/{part}"} if folder else {}
            view.repartition(buckets, *keys).write.options(**blooms, **where).bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(f"{name}_{part}")
        return VariantStore.open_tables(self.by_locus.sparkSession, self.header, name)

    @classmethod
    def open_tables(cls, spark: SparkSession, header: Header, name: str) -> VariantStore:
        out = cls.__new__(cls)
        out.header, out.by_locus, out.by_id = header, spark.table(f"{name}_locus"), spark.table(f"{name}_id")
        return out

    def positions(self) -> DataFrame:
        return self.by_locus

    def at_locus(self, chrom: str, pos: int) -> DataFrame:
        return self.by_locus.filter((F.col("chrom") == chrom) & (F.col("pos") == pos))

    def at_id(self, id_: str) -> DataFrame:
        return self.by_id.filter(F.col("id") == id_)

    def lookup_loci(self, keys: DataFrame) -> DataFrame:
        """keys (chrom, pos) with their records; nulls where there is none."""
        return keys.join(self.by_locus, ["chrom", "pos"], "left")

    def lookup_ids(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.by_id, "id", "left")

    def sample(self, rows: DataFrame, which: str | int) -> DataFrame:
        """rows with `sample`, the values of one sample: null for an unknown name, an error for an index out of range."""
        if isinstance(which, int) and not 0 <= which < len(self.header.samples):
            raise IndexError(which)
        i = which if isinstance(which, int) else self.header.sample_index(which)
        return rows.withColumn("sample", F.get("samples", F.lit(i)) if i >= 0 else F.lit(None).cast("array<string>"))

    def genotype(self, rows: DataFrame, which: str | int) -> DataFrame:
        """rows with `genotype`, of any ploidy, and `genotype_error`."""
        gt = sample_property(F.col("sample"), F.col("format"), "GT")
        got = self.sample(rows, which)
        return got.withColumns({"genotype": store_genotype(gt, F.col("ref"), F.col("alts")), "genotype_error": F.coalesce(store_genotype_error(gt, F.col("ref"), F.col("alts")), F.lit(False))})
