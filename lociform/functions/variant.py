"""INFO as a VARIANT: taken apart once a record, read by key as often as one likes, and kept as one column of any set of keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import grammar as G
from . import typed as T
from .record import info


def info_variant(raw: Column) -> Column:
    """An object with the text of each key's values, joined by commas; a flag has empty text.

    Text of the usual shape becomes JSON by compiled string functions. Repeated keys, empty entries and empty values need the rules of
    `record.info`, whose result is turned to JSON instead.
    """
    escaped = F.replace(F.replace(raw, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    flags = F.regexp_replace(F.concat(F.lit(";"), escaped), r";([^;=]+)(?=;|\z)", ";$1=")
    pairs = F.regexp_replace(F.substring(flags, F.lit(2), F.length(flags)), "([^;=]+)=([^;]*)", '"$1":"$2"')
    quick = F.try_parse_json(F.concat(F.lit("{"), F.replace(pairs, F.lit(";"), F.lit(",")), F.lit("}")))  # null for repeated keys
    plain = ~raw.rlike(r";;|\A;|;\z|[=,](?=[;,]|\z)|(\A|;)=|[\x00-\x1f]")
    entries = F.map_from_entries(F.transform(info(raw), lambda e: F.struct(e["key"], F.array_join(e["values"], ","))))
    return F.when(raw == ".", F.parse_json(F.lit("{}"))).otherwise(F.coalesce(F.when(plain, quick), F.parse_json(F.to_json(entries))))


def variant_text(variant: Column, key: str) -> Column:
    """The text of a key's values; null without the key."""
    return F.try_variant_get(variant, f'$["{key}"]', "string")


def variant_info(variant: Column, key: str, kind: str | None = None, is_list: bool = False) -> Column:
    """A key's value in a type: by the catalogue of reserved keys, or as a header declares it. Text that is not of the type is null."""
    return T.convert(variant_text(variant, key), *(G.RESERVED_INFO[key] if kind is None else (kind, is_list)))
