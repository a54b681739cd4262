"""The header of a variant file: parsed on the driver (it is a few lines), immutable, and viewable as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions import grammar as G

# Fixed values of the file format: structured sections, and the order in which they and their properties are written.
SECTIONS = ("INFO", "FILTER", "FORMAT", "ALT", "contig", "SAMPLE")
PROPERTY_ORDER = ("ID", "Number", "Type", "Description", "Source", "Version")
_ENTRY_PROPERTIES = {
    "INFO": {"ID", "Number", "Type", "Description", "Source", "Version"},
    "FORMAT": {"ID", "Number", "Type", "Description"},
    "ALT": {"ID", "Description"}, "FILTER": {"ID", "Description"}, "SAMPLE": {"ID", "Description"},
    "contig": {"ID", "length", "assembly", "md5", "species", "taxonomy", "URL"},
}
_TYPES = {"INFO": {"Integer", "Float", "Flag", "Character", "String"}, "FORMAT": {"Integer", "Float", "Character", "String"}}


class FormatError(ValueError):
    """Malformed input; the message names the line and the section where they are known."""

    def __init__(self, message: str, line: int | None = None, section: str | None = None):
        where = f"[Line #{line}] " if line is not None else ""
        super().__init__(f"{where}Error parsing {section}: {message}" if section else f"{where}{message}")
        self.line, self.section = line, section


def quote(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def unquote(text: str) -> str:
    if len(text) < 2 or text[0] != '"' or text[-1] != '"':
        return text
    return re.sub(r'\\([\\"])', r"\1", text[1:-1])


#: What matters in a list of properties: an escaped backslash or quote, a quote, a comma, an equal sign.
_MARK = re.compile(r'\\[\\"]|[",=]')


def split_properties(text: str) -> dict[str, str]:
    """`a=1,b="x,y"` as a dictionary: commas and equal signs within quotes are text, the last of equal keys wins.

    A quote opens or closes wherever it stands, unless it is escaped; one that nothing closes takes all that follows.
    """
    out: dict[str, str] = {}
    start, equals, quoted = 0, [], False
    for at, mark in [*((m.start(), m[0]) for m in _MARK.finditer(text)), (len(text), "")]:
        if mark == '"':
            quoted = not quoted
        elif mark == "=" and not quoted:
            equals.append(at)
        elif not mark or (mark == "," and not quoted):
            if len(equals) != 1:
                raise FormatError(f"{len(equals)} equal signs where one is needed: {text[start:at]}")
            out[text[start : equals[0]]] = text[equals[0] + 1 : at]
            start, equals = at + 1, []
    return out


def no_line_end(text: str | None) -> str | None:
    if text is not None and re.search("[\n\r]", text):
        raise FormatError("Line terminator in metadata")
    return text


@dataclass(frozen=True)
class Header:
    file_format: str = "VCFv4.2"
    entries: dict[str, dict[str | None, dict[str, str]]] = field(default_factory=lambda: {s: {} for s in SECTIONS})
    pedigree: tuple[dict[str, str], ...] = ()
    raw: tuple[tuple[str, str], ...] = ()
    columns: tuple[str, ...] = G.FIXED_COLUMNS
    warnings: tuple[str, ...] = ()
    lines: int = 0

    @property
    def samples(self) -> tuple[str, ...]:
        return self.columns[9:]

    def sample_index(self, name: str) -> int:
        return self.samples.index(name) if name in self.samples else -1

    def entry(self, section: str, id_: str) -> dict[str, str] | None:
        return self.entries[section].get(id_)

    def alt(self, id_: str) -> dict[str, str] | None:
        """By id, or by the id within angle brackets."""
        return self.entries["ALT"].get(id_) or self.entries["ALT"].get(id_.strip("<>"))

    def description(self, section: str, id_: str) -> str | None:
        got = (self.entry(section, id_) or {}).get("Description")
        return None if got is None else unquote(got)

    def value_type(self, section: str, id_: str) -> str | None:
        got = (self.entry(section, id_) or {}).get("Type")
        return got if got in _TYPES[section] else None

    def contig_length(self, id_: str) -> int:
        got = (self.entry("contig", id_) or {}).get("length", "")
        if not re.fullmatch(r"[+-]?[0-9]+", got):
            raise FormatError(f"Contig {id_} has no numeric length")
        return int(got)

    def number(self, section: str, id_: str) -> str | None:
        return (self.entry(section, id_) or {}).get("Number")

    def reserved_number(self, section: str, id_: str) -> str | None:
        """Number, if it is one of the letters or the dot that stand for a rule."""
        got = self.number(section, id_)
        return got if got in ("A", "R", "G", ".") else None

    def raw_property(self, section: str, id_: str, name: str) -> str | None:
        """As it is written: assembly, md5, taxonomy and URL of a contig, say."""
        return (self.entry(section, id_) or {}).get(name)

    def property(self, section: str, id_: str, name: str) -> str | None:
        """Without quotes: Source and Version of an INFO entry or species of a contig, say."""
        got = self.raw_property(section, id_, name)
        return None if got is None else unquote(got)

    def properties(self, section: str, id_: str) -> dict[str, str]:
        return {k: unquote(v) for k, v in (self.entry(section, id_) or {}).items()}

    def raw_values(self, key: str) -> list[str]:
        return [v for k, v in self.raw if k == key]

    def raw_keys(self) -> list[str]:
        return sorted({k for k, _ in self.raw})

    def with_entry(self, section: str, properties: dict[str, str]) -> Header:
        """A header with this entry, in place of one with the same ID."""
        for k, v in properties.items():
            no_line_end(k), no_line_end(v)
        return replace(self, entries=self.entries | {section: self.entries[section] | {properties.get("ID"): dict(properties)}})

    def without_entry(self, section: str, id_: str) -> Header:
        return replace(self, entries=self.entries | {section: {k: v for k, v in self.entries[section].items() if k != id_}})

    def with_property(self, section: str, id_: str, name: str, value: str | None, quoted: bool = True) -> Header:
        """A header whose entry has this property, quoted unless told otherwise, or is without it (null)."""
        props = {k: v for k, v in (self.entry(section, id_) or {"ID": id_}).items() if k != name or value is not None}
        return self.with_entry(section, props if value is None else props | {name: quote(value) if quoted else value})

    def with_raw(self, key: str, value: str) -> Header:
        if key == "pedigreeDB" and not re.fullmatch("<.*>", value):
            raise FormatError("pedigreeDB must be within angle brackets")
        return replace(self, raw=(*self.raw, (no_line_end(key), no_line_end(value))))

    def without_raw(self, key: str, value: str | None = None) -> Header:
        """A header without this value of the key, or without the key."""
        return replace(self, raw=tuple((k, v) for k, v in self.raw if k != key or value not in (None, v)))

    def with_pedigree(self, properties: dict[str, str]) -> Header:
        """A header with one more PEDIGREE entry; they need no ID, and equal ones may stand beside each other."""
        for k, v in properties.items():
            no_line_end(k), no_line_end(v)
        return replace(self, pedigree=(*self.pedigree, dict(properties)))

    def without_pedigree(self, properties: dict[str, str]) -> Header:
        """A header without the first PEDIGREE entry that has just these properties."""
        if properties not in self.pedigree:
            return self
        at = self.pedigree.index(properties)
        return replace(self, pedigree=self.pedigree[:at] + self.pedigree[at + 1 :])

    def with_file_format(self, text: str) -> Header:
        if not re.match(G.FILE_FORMAT.replace(r"\z", r"\Z"), text, re.ASCII):
            raise FormatError(f"Not a supported file format: {text}")
        return replace(self, file_format=text)

    def with_samples(self, names: Iterable[str]) -> Header:
        names = tuple(names)
        return replace(self, columns=(*G.FIXED_COLUMNS, *(("FORMAT", *names) if names else ())))

    def entries_df(self, spark: SparkSession) -> DataFrame:
        rows = [(s, i, p, n) for s in SECTIONS for n, (i, p) in enumerate(self.entries[s].items())] + [("PEDIGREE", p.get("ID"), p, n) for n, p in enumerate(self.pedigree)]
        return spark.createDataFrame(rows, "kind string, id string, props map<string,string>, ord int")

    def raw_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, v, n) for n, (k, v) in enumerate(self.raw)], "key string, value string, ord int")

    def columns_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.columns)), "idx int, name string")


def entry_warnings(section: str, props: dict[str, str]) -> list[str]:
    """What is odd about an entry, as codes."""
    out = [] if "ID" in props else ["ID_MISSING"]
    if section in _TYPES:
        if not re.fullmatch(r"[0-9]+|[ARG.]", props.get("Number", "")):
            out.append("NUMBER_INVALID")
        if props.get("Type") not in _TYPES[section]:
            out.append("TYPE_INVALID")
        if props.get("Type") == "Flag" and props.get("Number") != "0":
            out.append("FLAG_NUMBER")
    if section == "contig":
        out += [] if "assembly" in props else ["ASSEMBLY_MISSING"]
        out += [] if re.fullmatch(r"[+-]?[0-9]+", props.get("length", "")) else ["LENGTH_INVALID"]
    elif section != "PEDIGREE" and not re.fullmatch('".*"', props.get("Description", ""), re.DOTALL):
        out.append("DESCRIPTION_UNQUOTED")
    if section == "INFO":
        out += [f"{k.upper()}_UNQUOTED" for k in ("Source", "Version") if k in props and not re.fullmatch('".*"', props[k], re.DOTALL)]
    if section in _ENTRY_PROPERTIES and set(props) - _ENTRY_PROPERTIES[section]:
        out.append("PROPERTY_UNEXPECTED")
    return out


def _columns(line: str) -> tuple[str, ...]:
    names = tuple(line.split("\t"))
    if len(names) < 8 or names[:8] != G.FIXED_COLUMNS:
        raise FormatError(f"The column line must begin with {' '.join(G.FIXED_COLUMNS)}, with a tab between two names")
    if len(names) > 8 and names[8] != "FORMAT":
        raise FormatError("The ninth column must be FORMAT")
    if len(set(names[9:])) < len(names[9:]):
        raise FormatError("Duplicate sample name")
    return names


def parse_header(lines: Iterable[str]) -> Header:
    """The header of lines up to and with the column line; errors name their line."""
    file_format, entries, pedigree, raw, warned = None, {s: {} for s in SECTIONS}, [], [], []
    number = 0
    for number, line in enumerate(lines, 1):
        section = "metadata"
        try:
            if number == 1:
                if not line.startswith("##fileformat="):
                    raise FormatError("The first line must name the format as ##fileformat=VCFv4.x")
                file_format = Header().with_file_format(line[13:].strip()).file_format
            elif line.startswith("##fileformat="):
                raise FormatError("Duplicate fileformat")
            elif line.startswith("##"):
                key, eq, value = line[2:].partition("=")
                if not eq:
                    raise FormatError("Metadata has no equal sign")
                key, value = key.strip(), value.strip()
                if key not in (*SECTIONS, "PEDIGREE"):
                    raw.append((key, value))
                    continue
                if not (value.startswith("<") and value.endswith(">")):
                    raise FormatError(f"{key} must be within angle brackets")
                props = split_properties(value[1:-1])
                warned += [f"{key}:{w}" for w in entry_warnings(key, props)]
                if key == "PEDIGREE":
                    pedigree.append(props)
                elif props.get("ID") in entries[key]:
                    raise FormatError(f"Duplicate {key} {props.get('ID')}")
                else:
                    entries[key][props.get("ID")] = props
            elif line.startswith("#"):
                section = "column (# header)"
                columns = _columns(line)
                names, known = columns[9:], entries["SAMPLE"]
                if len(names) == len(known):
                    warned += [f"SAMPLE:UNDECLARED {n}" for n in names if n not in known]
                else:
                    warned.append("SAMPLE:COUNT")
                return Header(file_format, entries, tuple(pedigree), tuple(raw), columns, tuple(warned), number)
            else:
                raise FormatError("Data before the column header")
        except FormatError as e:
            raise FormatError(str(e), number, section) from None
    raise FormatError("No column header" if number else "The file is empty", number, "metadata")


def header_lines(header: Header) -> list[str]:
    """The header as text, entries in the order in which they came."""
    out = [f"##fileformat={header.file_format}"]

    def entry(section: str, props: dict[str, str]) -> str:
        keys = [k for k in PROPERTY_ORDER if k in props] + sorted(k for k in props if k not in PROPERTY_ORDER)
        return f"##{section}=<{','.join(f'{k}={props[k]}' for k in keys)}>"

    for section in SECTIONS:
        out += [entry(section, p) for p in header.entries[section].values()]
    out += [entry("PEDIGREE", p) for p in header.pedigree]
    out += [f"##{k}={v}" for k in header.raw_keys() for v in header.raw_values(k)]
    out.append("\t".join(header.columns))
    for line in out:
        no_line_end(line)
    return out


def validate_header(header: Header) -> None:
    """What must hold before a header is written; raises FormatError."""
    header.with_file_format(header.file_format)
    for section, props in [(s, p) for s in SECTIONS for p in header.entries[s].values()] + [("PEDIGREE", p) for p in header.pedigree]:
        for k, v in props.items():
            if not k or re.search("[,=]", k):
                raise FormatError(f"Invalid property name in {section}: {k}")
            if v is None or (not re.fullmatch('".*"', v, re.DOTALL) and re.search("[,=]", v)):
                raise FormatError(f"Invalid value of {k} in {section}: {v}")
            no_line_end(v)
    if any(not n or re.search("[\t\r\n]", n) for n in header.samples) or len(set(header.samples)) < len(header.samples):
        raise FormatError("Invalid sample names")
    for k, v in header.raw:
        no_line_end(k), no_line_end(v)
