"""Records: splitting, structural checks, normalisation of each field, INFO and samples, all as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import grammar as G


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: it becomes the variable of a one-element transform."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fields(line: Column, by: str = "\t") -> Column:
    """All parts, empty ones too. by: one character without a meaning in patterns, which splits without a pattern."""
    return F.split(line, by, -1)


def list_field(raw: Column, by: str) -> Column:
    """A `by`-separated list without empty parts; `.` is the empty list."""
    return F.when(raw == ".", F.array().cast("array<string>")).otherwise(F.filter(fields(raw, by), lambda x: x != ""))


def has_empty(raw: Column, by: str) -> Column:
    """True where list_field drops an empty part."""
    return F.exists(fields(raw, by), lambda x: x == "")


def _repeats(xs: Column) -> Column:
    return F.size(F.array_distinct(xs)) < F.size(xs)


def id_error(ids: Column) -> Column:
    return F.when(F.exists(ids, lambda x: x.rlike(r"[\s;]")), "ID_CHARACTER").when(_repeats(ids), "ID_DUPLICATE")


def alt_error(alts: Column) -> Column:
    return F.when(F.exists(alts, lambda x: ~x.rlike(G.ALT)), "ALT_GRAMMAR").when(F.array_contains(alts, ".") & (F.size(alts) > 1), "ALT_MISSING_COMBINED")


def filters(raw: Column) -> Column:
    """Filters that failed; PASS alone and `.` alone are none."""
    return F.when(raw == "PASS", F.array().cast("array<string>")).otherwise(F.filter(F.filter(fields(raw, ";"), lambda x: x != ""), lambda x: ~x.isin(".", "PASS")))


def _filter_parts(raw: Column) -> Column:
    return F.filter(fields(raw, ";"), lambda x: x != "")


def filters_applied(raw: Column) -> Column:
    return ~F.coalesce((F.size(_filter_parts(raw)) == 1) & (F.get(_filter_parts(raw), F.lit(0)) == "."), F.lit(False))


def filter_error(raw: Column) -> Column:
    parts = _filter_parts(raw)
    return (
        F.when(F.exists(parts, lambda x: x.rlike(r"\s")), "FILTER_WHITESPACE").when(F.array_contains(parts, "0"), "FILTER_ZERO")
        .when((F.size(parts) > 1) & (F.array_contains(parts, "PASS") | F.array_contains(parts, ".")), "FILTER_COMBINED")
    )


def filter_status(raw: Column) -> Column:
    return F.when(F.size(filters(raw)) > 0, "FAILED").when(filters_applied(raw), "PASSED").otherwise("NONE")


def format_error(keys: Column) -> Column:
    """Empty keys are kept and not checked."""
    named = F.filter(keys, lambda k: k != "")
    return (
        F.when(F.exists(named, lambda k: ~k.rlike(G.FORMAT_KEY)), "FORMAT_KEY").when(_repeats(named), "FORMAT_DUPLICATE")
        .when(F.array_position(keys, "GT") > 1, "FORMAT_GT_FIRST")
    )


def _is_genotype(text: Column) -> Column:
    """Allele numbers or dots, with a slash or a bar between two."""
    digits = lambda x: (x != "") & (F.translate(x, "0123456789", "") == "")
    return F.forall(F.split(F.translate(text, "|", "/"), "/", -1), lambda x: (x == ".") | digits(x))


def likelihood_list(tail: Column) -> Column:
    """A GLE value and what follows it, from text that starts with it; null if no GLE value starts there.

    The value is a list of genotype:likelihood, separated by commas. Each comma ends one, so the first piece with more
    than one colon holds the last of them and the colon that ends the value; without such a piece the value is all there is.
    """

    def taken(pieces: Column, last: Column) -> Column:
        bits = fields(F.get(pieces, last - 1), ":")
        is_pair = lambda p: F.coalesce((F.get(fields(p, ":"), F.lit(1)) != "") & _is_genotype(F.get(fields(p, ":"), F.lit(0))), F.lit(False))
        value = F.array_join(F.concat(F.slice(pieces, 1, last - 1), F.array(F.array_join(F.slice(bits, 1, 2), ":"))), ",")
        after = F.concat(F.array(F.array_join(F.slice(bits, 3, F.size(bits)), ":")), F.slice(pieces, last + 1, F.size(pieces)))
        more = F.when(F.size(bits) > 2, fields(F.array_join(after, ","), ":")).otherwise(F.array().cast("array<string>"))
        return F.when(F.forall(F.slice(pieces, 1, last), is_pair), F.concat(F.array(value), more))

    def in_pieces(pieces: Column) -> Column:
        ends = F.array_position(F.transform(pieces, lambda p: F.size(fields(p, ":")) > 2), True).cast("int")
        return let(F.when(ends > 0, ends).otherwise(F.size(pieces)), lambda last: taken(pieces, last))

    return let(fields(tail, ","), in_pieces)


def sample_values(text: Column, keys: Column) -> Column:
    """A sample's values along the keys: empty ones are `.`, dropped ones at the end are `.`, and a GLE value keeps its colons."""

    def filled(parts: Column) -> Column:
        full = F.transform(parts, lambda x: F.when(x == "", ".").otherwise(x))
        padded = F.concat(full, F.array_repeat(F.lit("."), F.greatest(F.size(keys) - F.size(parts), F.lit(0))))
        return F.when((F.size(parts) >= F.size(keys)) & ~F.array_contains(parts, ""), parts).otherwise(padded)

    def glued(parts: Column) -> Column:
        g = F.array_position(keys, "GLE").cast("int") - 1

        def with_tail(tail: Column) -> Column:
            return let(likelihood_list(tail), lambda found: F.when(found.isNotNull(), F.concat(F.slice(parts, 1, g), found)).otherwise(parts))

        return F.when(F.size(parts) > g, let(F.array_join(F.slice(parts, g + 1, F.size(parts)), ":"), with_tail)).otherwise(parts)

    plain = lambda parts: F.when(F.array_contains(keys, "GLE"), let(glued(parts), filled)).otherwise(filled(parts))
    # Text with all values and none of them empty is only split.
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    whole = (colons + 1 >= F.size(keys)) & ~F.array_contains(keys, "GLE") & ~(text.startswith(":") | text.endswith(":") | text.contains("::") | (text == ""))
    return F.when(whole, fields(text, ":")).otherwise(let(fields(text, ":"), plain))


def gt_text(text: Column, keys: Column) -> Column:
    """The GT value of a sample's text; null without GT, which is always the first key."""
    return F.when(F.get(keys, F.lit(0)) == "GT", F.when((text == "") | text.startswith(":"), ".").otherwise(F.substring_index(text, ":", 1)))


def sample_property(values: Column, keys: Column, key: str) -> Column:
    """The first value of a key; null without it."""
    at = F.array_position(keys, key).cast("int")
    return F.when(at > 0, F.get(values, at - 1))


def info(raw: Column) -> Column:
    """array<struct<key, values, is_flag>> in order of first appearance: repeated keys add up, a flag has one empty value."""
    entries = F.filter(F.when(raw == ".", F.array().cast("array<string>")).otherwise(fields(raw, ";")), lambda e: (e != "") & ~e.startswith("="))

    def pair(e: Column) -> Column:
        flag = ~e.contains("=")
        value = F.substring(e, F.instr(e, "=") + 1, F.length(e))
        values = F.transform(fields(value, ","), lambda v: F.when(v == "", ".").otherwise(v))
        return F.struct(F.when(flag, e).otherwise(F.substring_index(e, "=", 1)).alias("key"), F.when(flag, F.array(F.lit(""))).otherwise(values).alias("values"), flag.alias("is_flag"))

    def grouped(pairs: Column) -> Column:
        def of(k: Column) -> Column:
            own = lambda: F.filter(pairs, lambda p: p["key"] == k)
            return F.struct(k.alias("key"), F.flatten(F.transform(own(), lambda p: p["values"])).alias("values"), F.forall(own(), lambda p: p["is_flag"]).alias("is_flag"))

        names = F.transform(pairs, lambda p: p["key"])
        return F.when(F.size(F.array_distinct(names)) == F.size(names), pairs).otherwise(F.transform(F.array_distinct(names), of))

    return let(F.transform(entries, pair), grouped)


def info_error(entries: Column) -> Column:
    bad = F.exists(entries, lambda e: e["key"].rlike(r"[\s;=]") | F.exists(e["values"], lambda v: v.rlike(r"[\s;,]")))
    return F.when(bad, "INFO_CHARACTER")


def info_values(entries: Column, key: str) -> Column:
    """A key's values; null without it."""
    return F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))["values"]


def info_text_of(raw: Column, key: str) -> Column:
    """`info_text(info(raw), key)` without taking the other entries apart, where the key stands once with full values."""
    whole = F.concat(F.lit(";"), raw, F.lit(";"))
    at = F.instr(whole, f";{key}=")
    rest = F.substring(whole, at + len(key) + 2, F.length(whole))
    value = F.substring_index(rest, ";", 1)
    again = rest.contains(f";{key}=") | whole.contains(f";{key};")
    gaps = (value == "") | value.startswith(",") | value.endswith(",") | value.contains(",,")
    absent = (at == 0) & ~whole.contains(f";{key};") | (raw == ".")
    return F.when(absent, F.lit(None).cast("string")).when((at > 0) & ~again & ~gaps, value).otherwise(info_text(info(raw), key))


def info_has(raw: Column, key: str) -> Column:
    """True if INFO has the key, with or without a value."""
    whole = F.concat(F.lit(";"), raw, F.lit(";"))
    return (raw != ".") & (whole.contains(f";{key};") | whole.contains(f";{key}="))


def info_text(entries: Column, key: str) -> Column:
    return F.array_join(info_values(entries, key), ",")


def position(raw: Column) -> Column:
    return F.when(raw.rlike(G.INTEGER), raw.try_cast("bigint"))


def first_error(line: Column, parts: Column, keys: Column, n_columns: int, n_samples: int, skipped: Column | None = None) -> Column:
    """Code of the first check that fails, in the order in which the fields are checked; null for a good or skipped line."""
    at = lambda i: F.get(parts, F.lit(i))
    early = F.when(line.startswith("#"), "COMMENT").when(line.rlike(r"\A\s*\z"), "BLANK").when(F.size(parts) != n_columns, "COLUMN_COUNT")
    early = early.when(F.exists(F.slice(parts, 1, 8), lambda x: x == ""), "EMPTY_FIELD").when(position(at(1)).isNull(), "POS_NUMBER")
    # The commonest texts are good at sight; only others are taken apart.
    late = [
        F.when(at(0).rlike(r"\s"), "CHROM_WHITESPACE").when(position(at(1)) < 0, "POS_NEGATIVE"),
        F.when(~at(2).rlike(r"\A[^\s;]+\z"), id_error(list_field(at(2), ";"))),
        F.when(~at(3).rlike(G.REF), "REF_GRAMMAR"),
        F.when(~at(4).rlike(r"\A[ACGTNacgtn]+(,[ACGTNacgtn]+)*\z"), alt_error(list_field(at(4), ","))),
        F.when(~at(6).rlike(r"\A[A-Za-z]\w*\z"), filter_error(at(6))),
    ]
    if n_columns > 8:
        late.append(F.when(~at(8).isin("GT", "GT:DP", "GT:GQ"), format_error(keys)))
    if n_samples:
        parted = lambda s: F.when(F.array_contains(keys, "GLE"), F.size(sample_values(s, keys))).otherwise(F.size(fields(s, ":")))
        late.append(F.when(F.exists(F.slice(parts, 10, n_samples), lambda s: parted(s) > F.size(keys)), "SAMPLE_TOO_LONG"))
    found = F.coalesce(*late)
    if skipped is not None:
        found = F.when(~skipped, found)
    return F.coalesce(early, F.when(F.size(parts) == n_columns, found))


def warnings(parts: Column, n_samples: int) -> Column:
    """Codes of what is normalised."""
    at = lambda i: F.get(parts, F.lit(i))
    entries = F.when(at(7) == ".", F.array().cast("array<string>")).otherwise(fields(at(7), ";"))
    found = [
        F.when(has_empty(at(2), ";"), "ID_EMPTY"), F.when(has_empty(at(4), ","), "ALT_EMPTY"), F.when(has_empty(at(6), ";") | (at(6) != "PASS") & F.array_contains(_filter_parts(at(6)), "PASS"), "FILTER_EMPTY"),
        F.when(F.exists(entries, lambda e: (e == "") | e.startswith("=")), "INFO_EMPTY_ENTRY"),
        F.when(F.exists(entries, lambda e: e.contains("=") & has_empty(F.substring(e, F.instr(e, "=") + 1, F.length(e)), ",")), "INFO_EMPTY_VALUE"),
    ]
    if n_samples:
        found += [F.when(has_empty(at(8), ":"), "FORMAT_EMPTY"), F.when(F.exists(F.slice(parts, 10, n_samples), lambda s: has_empty(s, ":")), "SAMPLE_EMPTY")]
    return F.array_compact(F.array(*found))
