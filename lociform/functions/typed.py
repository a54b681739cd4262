"""Typed values from raw text: elements, lists, reserved and declared properties, and decimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import grammar as G

_SPARK_TYPE = {"Integer": "bigint", "Float": "double", "Flag": "boolean", "Character": "string", "String": "string"}


def decimal_ok(value: Column) -> Column:
    """True where text is a decimal whose scale fits into 32 bits: neither the exponent alone nor with the decimal places goes beyond."""
    exponent = F.substring_index(F.lower(value), "e", -1).try_cast("bigint")
    mantissa = F.substring_index(F.lower(value), "e", 1)
    places = F.when(mantissa.contains("."), F.length(mantissa) - F.instr(mantissa, ".")).otherwise(0)
    fits = lambda x: x.between(-(1 << 31), (1 << 31) - 1)
    scaled = F.coalesce(fits(exponent) & fits(places - exponent), F.lit(False))
    return value.rlike(G.DECIMAL) & F.when(value.contains("e") | value.contains("E"), scaled).otherwise(True)


def is_missing(value: Column) -> Column:
    return value.isNull() | (value == ".")


def element_ok(value: Column, kind: str) -> Column:
    """True where one non-missing value has the type's grammar."""
    if kind == "Integer":
        return value.rlike(G.INTEGER) & value.try_cast("bigint").isNotNull()
    if kind == "Float":
        return decimal_ok(value)
    if kind == "Character":
        return F.length(value) == 1
    if kind == "Flag":
        return value.rlike(r"\A\s*\z") | F.lower(value).isin("0", "1", "true", "false")
    return F.lit(True)


def element(value: Column, kind: str) -> Column:
    """The typed value; null if it is missing or has not the type's grammar."""
    if kind == "Flag":
        typed = ~F.lower(value).isin("0", "false")
    else:
        typed = value.try_cast(_SPARK_TYPE[kind])
    return F.when(is_missing(value) | ~element_ok(value, kind), F.lit(None)).otherwise(typed)


def convert(value: Column, kind: str, is_list: bool = False) -> Column:
    """A property's typed value: missing is null, also for lists; a list's empty or missing elements are null."""
    if not is_list:
        return element(value, kind)
    return F.when(~is_missing(value), F.transform(F.split(value, ",", -1), lambda v: F.when(v != "", element(v, kind))))


def convertible(value: Column, kind: str, is_list: bool = False) -> Column:
    """True where `convert` loses nothing."""
    if not is_list:
        return is_missing(value) | element_ok(value, kind)
    return is_missing(value) | F.forall(F.split(value, ",", -1), lambda v: (v == "") | (v == ".") | element_ok(v, kind))


def strict(value: Column, kind: str, is_list: bool = False) -> Column:
    """`convert`, but text that has not the type's grammar is an error."""
    made = f"array<{_SPARK_TYPE[kind]}>" if is_list else _SPARK_TYPE[kind]

    def typed(v: Column) -> Column:
        said = F.concat(F.lit("Not of type "), F.lit(kind), F.lit(": "), v)
        return F.when(convertible(v, kind, is_list), convert(v, kind, is_list)).otherwise(F.raise_error(said).cast(made))

    return _let(value, typed)  # the value may be long to work out, and stands here many times


def qual_ok(raw: Column) -> Column:
    """True for a missing value or a decimal."""
    return F.coalesce((raw == ".") | (raw == "") | decimal_ok(raw), F.lit(True))


def strict_qual(raw: Column) -> Column:
    """`qual`, but text that is no decimal is an error when it is read."""
    return F.when(qual_ok(raw), qual(raw)).otherwise(F.raise_error(F.concat(F.lit("QUAL is not a number: "), raw)).cast("double"))


def qual(raw: Column) -> Column:
    """QUAL as a double; null if missing or no decimal. A decimal beyond a double's range is infinite or zero: its text keeps all digits."""
    return F.when((raw != "") & decimal_ok(raw), raw.try_cast("double"))


def decimal_text(raw: Column) -> Column:
    """The canonical text of a decimal: plain where its exponent allows, else with an E; null if raw is no decimal or its exponent too large."""
    part = lambda i: F.regexp_extract(raw, r"\A([+-]?)(\d*)\.?(\d*)(?:[eE]([+-]?\d+))?\z", i)
    split = F.struct(
        part(1).alias("sign"), F.regexp_replace(F.concat(part(2), part(3)), r"\A0+(?=\d)", "").alias("digits"),
        (F.length(part(3)) - F.when(part(4) == "", F.lit(0)).otherwise(part(4).try_cast("bigint"))).alias("scale"),
    )

    def text(x: Column) -> Column:
        digits, scale, size = x["digits"], x["scale"], F.length(x["digits"]).cast("long")
        shift = size - 1 - scale  # exponent of the first digit
        sign = F.when((x["sign"] == "-") & (digits != "0"), "-").otherwise("")
        before, after = (size - scale).cast("int"), scale.cast("int")
        whole = F.when(size > scale, F.substring(digits, F.lit(1), before)).otherwise("0")
        rest = F.when(size > scale, F.substring(digits, before + 1, after)).otherwise(F.lpad(digits, F.greatest(after, F.lit(0)), F.lit("0")))
        plain = F.when(scale == 0, digits).otherwise(F.concat(whole, F.lit("."), rest))
        more = F.substring(digits, F.lit(2), F.length(digits))
        science = F.concat(F.substring(digits, 1, 1), F.when(more != "", F.concat(F.lit("."), more)).otherwise(""), F.lit("E"), F.when(shift >= 0, "+").otherwise(""), shift.cast("string"))
        return F.concat(sign, F.when((scale >= 0) & (shift >= -6), plain).otherwise(science))

    # Text in plain notation without leading zeros is canonical already.
    return F.when(raw.rlike(r"\A-?(0|[1-9]\d*)(\.\d{1,6})?\z") & ~raw.rlike(r"\A-0(\.0*)?\z"), raw).when(decimal_ok(raw), _let(split, text))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))
