import pytest

from lociform.plans.bridge import HEADER_TEXT
from lociform.sources.header import FormatError, Header, header_lines, parse_header, quote, split_properties, unquote, validate_header

COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"


def header(*lines, columns=COLUMNS):
    return parse_header(["##fileformat=VCFv4.2", *lines, columns])


def test_round_trip():
    lines = HEADER_TEXT.split("\n")
    h = parse_header(lines)
    assert parse_header(header_lines(h)).entries == h.entries
    assert h.samples == ("S1", "S2") and h.sample_index("S2") == 1 and h.sample_index("S3") == -1 and h.lines == len(lines)


@pytest.mark.parametrize("lines", [
    ["##fileformat=VCFv3.3", COLUMNS], ["", "##fileformat=VCFv4.2", COLUMNS], ["##fileformat=VCFv4.2", "##fileformat=VCFv4.2", COLUMNS], ["##fileformat=VCFv4.2", "chr1\t1", COLUMNS], ["##fileformat=VCFv4.2"], [],
    ["##fileformat=VCFv4.2", COLUMNS.replace("\t", " ")], ["##fileformat=VCFv4.2", COLUMNS + "\tINFO2\ta"], ["##fileformat=VCFv4.2", COLUMNS + "\tFORMAT\ta\ta"], ["##fileformat=VCFv4.2", "##INFO=ID=a", COLUMNS],
    ["##fileformat=VCFv4.2", "##FILTER=<ID=a>", "##FILTER=<ID=a>", COLUMNS], ["##fileformat=VCFv4.2", "##INFO=<ID=a=b>", COLUMNS], ["##fileformat=VCFv4.2", "##nothing", COLUMNS],
])
def test_bad_headers(lines):
    with pytest.raises(FormatError, match=r"\[Line #\d+\] Error parsing (metadata|column \(# header\))"):
        parse_header(lines)


def test_error_names_its_line():
    with pytest.raises(FormatError, match=r"\[Line #2\] Error parsing column .*#CHROM POS ID"):
        parse_header(["##fileformat=VCFv4.1", "#CHROM POS"])


def test_access_and_edits():
    h = header("##ALT=<ID=DEL,Description=\"a \\\"b\\\"\">", "##contig=<ID=1,length=12,assembly=x>", "##assembly=u", "##INFO=<ID=a,Number=1,Type=Odd,Description=\"d\">")
    assert h.alt("<DEL>") == h.alt("DEL") and h.description("ALT", "DEL") == 'a "b"' and h.contig_length("1") == 12
    assert h.raw_values("assembly") == ["u"] and h.value_type("INFO", "a") is None and "INFO:TYPE_INVALID" in h.warnings
    with pytest.raises(FormatError):
        h.contig_length("2")
    more = h.with_entry("FILTER", {"ID": "q", "Description": '"d"'}).with_samples(["x"])
    assert "##FILTER=<ID=q,Description=\"d\">" in header_lines(more) and header_lines(more)[-1].endswith("FORMAT\tx") and not h.entries["FILTER"]
    with pytest.raises(FormatError):
        h.with_raw("pedigreeDB", "x")
    with pytest.raises(FormatError):
        validate_header(h.with_entry("FILTER", {"ID": "q", "Description": "a,b"}))
    validate_header(more)


def test_quoting():
    for text in ("", 'a"b', "a\\b", '\\"', "x"):
        assert unquote(quote(text)) == text
    assert unquote('"') == '"'
    assert split_properties('a=1,b="x,=\\",y"') == {"a": "1", "b": '"x,=\\",y"'}


def test_frames(spark):
    h = parse_header(HEADER_TEXT.split("\n"))
    assert h.entries_df(spark).filter("kind = 'INFO'").count() == 4 and h.columns_df(spark).count() == 11
    assert Header().raw_df(spark).count() == 0


def split_by_rule(text):
    """The rule, a character at a time: quotes toggle, two escapes are text, commas and then equal signs split."""

    def cut(s, by):
        parts, now, quoted, i = [], "", False, 0
        while i < len(s):
            step = 2 if s[i : i + 2] in ("\\\\", '\\"') else 1
            if step == 1 and s[i] == by and not quoted:
                parts.append(now)
                now = ""
            else:
                quoted ^= step == 1 and s[i] == '"'
                now += s[i : i + step]
            i += step
        return [*parts, now]

    pairs = [cut(p, "=") for p in cut(text, ",")]
    return dict(pairs) if all(len(p) == 2 for p in pairs) else None


def test_splitter_on_random_strings():
    import random

    draw = random.Random(7)
    for _ in range(60_000):
        text = "".join(draw.choice('ab=,"\\') for _ in range(draw.randrange(14)))
        try:
            got = split_properties(text)
        except FormatError:
            got = None
        assert got == split_by_rule(text), text


def test_getters_and_quoting():
    h = header('##INFO=<ID=a,Number=G,Type=Integer,Description="d",Source="x y",Version="3">', '##contig=<ID=1,length=12,assembly=b,md5=m,species="Homo sapiens",taxonomy=t,URL=u>', columns=COLUMNS + "\tFORMAT\ts")
    assert (h.number("INFO", "a"), h.reserved_number("INFO", "a"), h.property("INFO", "a", "Source"), h.property("INFO", "a", "Version")) == ("G", "G", "x y", "3")
    assert [h.raw_property("contig", "1", k) for k in ("assembly", "md5", "taxonomy", "URL")] == list("bmtu") and h.property("contig", "1", "species") == "Homo sapiens"
    assert h.number("INFO", "b") is None and h.properties("contig", "1")["species"] == "Homo sapiens" and "SAMPLE:COUNT" in h.warnings
    more = h.with_property("INFO", "a", "Source", 'q"r').with_property("INFO", "a", "Version", None).with_property("INFO", "a", "Number", "1", quoted=False)
    assert more.entry("INFO", "a")["Source"] == '"q\\"r"' and more.property("INFO", "a", "Source") == 'q"r' and more.property("INFO", "a", "Version") is None and more.number("INFO", "a") == "1"
