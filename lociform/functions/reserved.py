"""Typed access to the reserved INFO and FORMAT keys, by the catalogue of the format and not by a file's header."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import grammar as G
from . import typed as T
from .record import info_text, info_values, sample_property


def _typed(raw: Column, kind: tuple[str, bool], strict: bool) -> Column:
    return T.strict(raw, *kind) if strict else T.convert(raw, *kind)


def info(entries: Column, key: str, strict: bool = True) -> Column:
    """A reserved INFO key's value in its type, lists as arrays; null without the key, true for a flag that is there.

    strict: text that is not of the type is an error when it is read (a list where one value belongs, a flag that stands twice);
    otherwise it is null.
    """
    return _typed(info_text(entries, key), G.RESERVED_INFO[key], strict)


def info_is_there(entries: Column, key: str) -> Column:
    return info_values(entries, key).isNotNull()


def sample(values: Column, keys: Column, key: str, strict: bool = True) -> Column:
    """A reserved FORMAT key's value of one sample in its type; null without the key."""
    return _typed(sample_property(values, keys, key), G.RESERVED_FORMAT[key], strict)


def all_info(entries: Column, strict: bool = False) -> Column:
    """A struct of all reserved INFO keys; Catalyst evaluates only those that are read."""
    return F.struct(*[info(entries, k, strict).alias(k) for k in G.RESERVED_INFO])


def all_of_sample(values: Column, keys: Column, strict: bool = False) -> Column:
    return F.struct(*[sample(values, keys, k, strict).alias(k) for k in G.RESERVED_FORMAT])
