"""Genotypes: the any-ploidy form of keyed lookups, and the diploid canonical form. Null stands for an error or no call; `*_error` tells which."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import grammar as G
from .record import let

_INDEX = r"\A[+-]?\d+\z"
_PAIR = rf"\A({G.ALLELE})[/|]({G.ALLELE})\z"


def _alleles(ref: Column, alts: Column) -> Column:
    return F.concat(F.array(ref), alts)


def _parts(gt: Column) -> Column:
    """The text between separators; one plain character splits without a pattern."""
    return F.split(F.translate(gt, "|", "/"), "/", -1)


def _calls(gt: Column) -> Column:
    return F.transform(_parts(gt), lambda x: F.when(x == "", ".").otherwise(x))


def store_genotype_error(gt: Column, ref: Column, alts: Column) -> Column:
    """An index is no integer or names no allele."""
    ok = lambda x: (x == ".") | F.coalesce(x.rlike(_INDEX) & (x.try_cast("int") >= 0) & (x.try_cast("int") <= F.size(alts)), F.lit(False))
    return gt.isNotNull() & (gt != ".") & ~F.forall(_calls(gt), ok)


def store_genotype(gt: Column, ref: Column, alts: Column) -> Column:
    """struct(alleles, phased): alleles as text (`.` if missing), of any ploidy, as written; null if all are missing."""

    def made(calls: Column) -> Column:
        named = F.transform(calls, lambda x: F.when(x == ".", ".").otherwise(F.get(_alleles(ref, alts), x.try_cast("int"))))
        return F.when(F.exists(calls, lambda x: x != "."), F.struct(named.alias("alleles"), gt.contains("|").alias("phased")))

    return F.when(gt.isNotNull() & ~store_genotype_error(gt, ref, alts), let(_calls(gt), made))


def render_store(genotype: Column) -> Column:
    return let(genotype, lambda g: F.when(g["phased"], F.array_join(g["alleles"], "|")).otherwise(F.array_join(g["alleles"], "/")))


def _canonical(a: Column, b: Column, piped: Column) -> Column:
    return F.struct(a.alias("a1"), b.alias("a2"), (F.coalesce(a == b, F.lit(False)) | piped).alias("phased"))


#: A haploid or diploid text: numbers or dots.
_CALLED = r"\A(\d+|\.)([/|](\d+|\.))?\z"


def _two(gt: Column) -> tuple[Column, Column]:
    """The first and the last index, null for a dot. Short expressions: each of them stands in a plan several times."""
    text = F.translate(gt, "|", "/")
    return F.substring_index(text, "/", 1).try_cast("int"), F.substring_index(text, "/", -1).try_cast("int")


def _fit(gt: Column, alts: Column) -> Column:
    first, last = _two(gt)
    known = lambda i, dot: F.coalesce(i <= F.size(alts), dot)
    return gt.rlike(_CALLED) & known(first, gt.startswith(".")) & known(last, gt.endswith("."))


def diploid_error(gt: Column, ref: Column, alts: Column) -> Column:
    return gt.isNotNull() & ~_fit(gt, alts)


def diploid(gt: Column, ref: Column, alts: Column) -> Column:
    """struct(a1, a2, phased): null alleles are missing; equal alleles and haploid calls are phased."""
    pick = lambda i: F.when(i == 0, ref).otherwise(F.get(alts, i - 1))
    first, last = _two(gt)
    return F.when(gt.isNotNull() & _fit(gt, alts), _canonical(pick(first), pick(last), ~gt.contains("/")))


def from_bases(text: Column) -> Column:
    """The same from text like `A/TT`; null if it is no genotype."""
    part = lambda i: F.when(F.regexp_extract(text, _PAIR, i) != ".", F.regexp_extract(text, _PAIR, i))
    one = F.when(text != ".", text)
    return F.when(text.rlike(_PAIR), _canonical(part(1), part(2), text.contains("|"))).when(text.rlike(G.ALT), F.struct(one.alias("a1"), one.alias("a2"), F.lit(True).alias("phased")))


def make_gt(genotype: Column, ref: Column, alts: Column) -> Column:
    """The indices of a diploid genotype as text; null if an allele is not among ref and alts."""
    at = lambda a: F.when(a.isNull(), ".").otherwise(F.when(F.array_contains(_alleles(ref, alts), a), (F.array_position(_alleles(ref, alts), a) - 1).cast("string")))
    return let(genotype, lambda g: F.concat(at(g["a1"]), F.when(g["phased"], "|").otherwise("/"), at(g["a2"])))


def strict_gt(genotype: Column, ref: Column, alts: Column) -> Column:
    """`make_gt`, but an allele that is not among ref and alts is an error; null stays null."""
    made = make_gt(genotype, ref, alts)
    return F.when(genotype.isNull() | made.isNotNull(), made).otherwise(F.raise_error(F.concat(F.lit("Unknown allele in "), render(genotype))).cast("string"))


def gt_index_ok(gt: Column, alts: Column) -> Column:
    """True if each part of a GT value is `.` or names an allele; true without a value."""
    named = lambda x: F.coalesce(x.rlike(_INDEX) & (x.try_cast("int") >= 0) & (x.try_cast("int") <= F.size(alts)), F.lit(False))
    return F.coalesce(F.forall(_parts(gt), lambda x: (x == ".") | named(x)), F.lit(True))


def is_homozygous(genotype: Column) -> Column:
    return genotype["a1"].eqNullSafe(genotype["a2"])


def is_no_call(genotype: Column) -> Column:
    return genotype["a1"].isNull() & genotype["a2"].isNull()


def allele_set(genotype: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(genotype["a1"], genotype["a2"])))


def render(genotype: Column) -> Column:
    g = genotype
    return F.when(g.isNotNull(), F.concat(F.coalesce(g["a1"], F.lit(".")), F.when(g["phased"], "|").otherwise("/"), F.coalesce(g["a2"], F.lit("."))))


def ploidy(gt: Column) -> Column:
    """Alleles of a GT value; 2 without one."""
    return F.when(gt.isNull(), 2).otherwise(F.size(_parts(gt)))


#: The largest 64-bit number stands for every larger count.
_MOST = 9223372036854775807


def expected_values(number: Column, n_alts: Column, n_ploidy: Column) -> Column:
    """How many values a property of this Number has; null if unbounded or unknown. G counts multisets of alleles."""

    def step(acc: Column, i: Column) -> Column:
        # Each step is a whole binomial; 38 digits hold the product as long as the last one is a long and the factor an int.
        more = F.floor((acc * (n_alts + i).cast("decimal(10,0)")).cast("decimal(38,0)") / i.cast("decimal(10,0)"))
        return F.when(acc >= _MOST, acc).otherwise(F.least(more.cast("decimal(38,0)"), F.lit(_MOST).cast("decimal(38,0)"))).cast("decimal(20,0)")

    combos = F.aggregate(F.sequence(F.lit(1), F.greatest(n_ploidy, F.lit(1))), F.lit(1).cast("decimal(20,0)"), step).cast("bigint")
    return (
        F.when(number == "A", n_alts.cast("long")).when(number == "R", (n_alts + 1).cast("long"))
        .when(number == "G", F.when(n_ploidy == 0, F.lit(1).cast("long")).otherwise(combos))
        .when(number.rlike(r"\A\d+\z"), number.try_cast("bigint"))
    )
