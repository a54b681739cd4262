"""Alleles and structural-variant codes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import grammar as G


def is_allele(a: Column) -> Column:
    return a.rlike(G.ALT)


def is_breakpoint(a: Column) -> Column:
    return a.contains("[") | a.contains("]")


def is_symbolic(a: Column) -> Column:
    return a.contains("<")


def is_deleted(a: Column) -> Column:
    return a == "*"


def primary_type(a: Column) -> Column:
    return (
        F.when(is_breakpoint(a), "BREAKPOINT").when(is_deleted(a), "DELETED").when(is_symbolic(a), "SYMBOLIC")
        .when(a == ".", "NO_VARIATION").when(F.length(a) == 1, "SINGLE_BASE").otherwise("MULTI_BASE")
    )


def allele_length(a: Column) -> Column:
    """Characters of an allele made of bases (dots count); null for breakends, symbols and deletions, which have none."""
    return F.when(~(is_breakpoint(a) | is_symbolic(a) | is_deleted(a)), F.length(a))


def _outside(a: Column) -> Column:
    return F.regexp_replace(a, "<[^>]*>", "")


def contains_base(a: Column, base: str) -> Column:
    return _outside(a).contains(base)


def is_ambiguous(a: Column) -> Column:
    return _outside(a).rlike("[Nn]")


def lowercase_bases(a: Column) -> Column:
    """Lower case outside `<...>`."""
    parts = F.regexp_extract_all(a, F.lit("(<[^>]*>|[^<]+|<)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("<"), p).otherwise(F.lower(p))), "")


def equal_ignoring_case(a: Column, b: Column) -> Column:
    """Equal but for the case of bases; names within `<...>` count as they are. False for null."""
    return F.coalesce(lowercase_bases(a) == lowercase_bases(b), F.lit(False))


def _or_error(value: Column, said: str, what: Column, kind: str) -> Column:
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(said), what.cast("string"))).cast(kind))


def strict_length(a: Column) -> Column:
    """`allele_length`, but an allele without one is an error."""
    return _or_error(allele_length(a), "No length: ", a, "int")


def strict_allele_at(ref: Column, alts: Column, i: Column) -> Column:
    """`allele_at`, but an index beyond the alleles is an error."""
    return _or_error(allele_at(ref, alts, i), "No allele ", i, "string")


def allele_at(ref: Column, alts: Column, i: Column) -> Column:
    """REF for 0, the i-th ALT from 1 on, null beyond."""
    return F.when(i >= 0, F.get(F.concat(F.array(ref), alts), i))


def sv_components(code: Column) -> Column:
    return F.split(code, ":", -1)


def sv_valid(code: Column) -> Column:
    """A code's first part is reserved, no part is empty, and reserved parts stand at their level below an allowed parent."""
    parts = sv_components(code)
    level = F.create_map(*[x for k, (n, _) in G.SV_CODES.items() for x in (F.lit(k), F.lit(n))])
    parents = F.create_map(*[x for k, (_, p) in G.SV_CODES.items() for x in (F.lit(k), F.array(*map(F.lit, p)).cast("array<string>"))])

    def part_ok(p: Column, i: Column) -> Column:
        above = F.get(parts, i - 1)
        at_level = level[p] == i
        family = (i == 0) | level[above].isNull() | F.array_contains(parents[p], above)
        return (p != "") & F.when(level[p].isNull(), i > 0).otherwise(at_level & family)

    return F.forall(F.transform(parts, lambda p, i: F.coalesce(part_ok(p, i), F.lit(False))), lambda x: x)


def sv_reserved(code: Column) -> Column:
    """The reserved code of each part, null for others."""
    return F.transform(sv_components(code), lambda p: F.when(p.isin(list(G.SV_CODES)), p))
