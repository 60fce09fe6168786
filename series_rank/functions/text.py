"""Column expressions that turn landed text into numbers: labels, links, pages, series files."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a number in a landed cell.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITE = r"^[+-]?(?i:inf|infinity)$"

# The layout of a landed series file and of an attribute page.
SKIPPED_LINES = 10
HEADER_LINES = 9
FILE_COLUMNS = {
    "x": "Alpha",
    "y": "Cl",
    "d": "Cd",
    "dp": "Cdp",
    "m": "Cm",
    "top": "Top_Xtr",
    "bottom": "Bot_Xtr",
}
HEADER_KEYS = {"ratioMax": "Max Cl/Cd", "ratioMaxX": "Max Cl/Cd alpha"}
PAGE_METRICS = {
    "attr_a": r"Max thickness ([\d\.]+)% at ([\d\.]+)% chord",
    "attr_b": r"Max camber ([\d\.]+)% at ([\d\.]+)% chord",
}
LABEL_SEPARATOR = " - "
LINK_KEY = r"[?&]\w+=(.+)$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """*use* of a value that is computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def to_number(c: Column) -> Column:
    """Text to double, surrounding blanks and quotes removed; NULL when it is no number."""
    return stripped_number(strip(c))


def strip(c: Column) -> Column:
    return F.when(c.rlike(r"[\s\"]"), F.regexp_replace(c, r"^[\s\"]+|[\s\"]+$", "")).otherwise(c)


def stripped_number(t: Column) -> Column:
    # Only what holds a letter can be a form that casts but is no number here (1d, NaN).
    return F.when(~t.rlike("[A-Za-z]") | t.rlike(NUMBER) | t.rlike(INFINITE), t.try_cast("double"))


def split_label(label: Column, separator: str = LABEL_SEPARATOR) -> tuple[Column, Column]:
    """(id, description) at the first separator; an absent description is empty."""
    parts = F.split(label, separator.replace("|", r"\|"), 2)
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def extract_key(link: Column, pattern: str = LINK_KEY) -> Column:
    """First capture of the pattern, NULL when it does not match."""
    return F.nullif(F.regexp_extract(link, pattern, 1), F.lit(""))


def unescape(c: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def page_links(pages: DataFrame, html: str, keep: Sequence[str], container: str, occurrence: int = 1) -> DataFrame:
    """Anchors of the n-th container element as (…keep, place, label, href).

    Anchors whose label or address is empty are left out.
    """
    sections = F.regexp_extract_all(F.col(html), F.lit(rf"(?is)<{container}\b[^>]*>(.*?)</{container}>"), 1)
    anchor = F.lit(r"(?is)<a\b([^>]*)>(.*?)</a>")
    section = F.get(sections, F.lit(occurrence - 1))
    pairs = F.arrays_zip(
        F.regexp_extract_all(section, anchor, 1).alias("attributes"),
        F.regexp_extract_all(section, anchor, 2).alias("inner"),
    )
    found = pages.select(*keep, F.posexplode(F.transform(pairs, lambda p: F.struct(p["attributes"], p["inner"]))))
    return found.select(
        *keep,
        F.col("pos").cast("long").alias("place"),
        unescape(F.trim(F.regexp_replace(F.col("col.inner"), r"(?s)<[^>]*>", ""))).alias("label"),
        F.regexp_extract("col.attributes", r"(?i)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href"),
    ).where((F.length("label") > 0) & (F.length("href") > 0))


def page_text(html: Column) -> Column:
    """Visible text of a page: no comments, scripts, styles or tags, blanks collapsed."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = unescape(F.regexp_replace(t, r"(?s)<[^>]*>", " "))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def page_metrics(text: Column, patterns: Mapping[str, str] = PAGE_METRICS) -> dict[str, Column]:
    """``<name>_value`` and ``<name>_place`` from the two captures of each pattern."""
    out = {}
    for name, pattern in patterns.items():
        for group, suffix in ((1, "value"), (2, "place")):
            out[f"{name}_{suffix}"] = F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("double")
    return out


def lines(raw: Column) -> Column:
    return F.split(raw, "\r\n|\n|\r")


def cells(line: Column) -> Column:
    """Comma-separated cells; a cell that begins with a quote goes on to the closing one, commas included.

    A quote that is not closed in its line is an ordinary character.
    """
    # The comma put before the line makes every match begin with one; possessive, so that long cells need no stack.
    cell = r',(\s*+"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+)'
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(cell), 1)
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ","))


def n_cells(line: Column) -> Column:
    plain = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(","), F.lit(""))) + 1
    return F.when(F.contains(line, F.lit('"')), F.size(cells(line))).otherwise(plain)


def fields(line: Column) -> Column:
    """Cells without surrounding blanks and quotes."""
    return F.when(line.rlike(r"[\s\"]"), F.transform(cells(line), strip)).otherwise(F.split(line, ","))


def well_formed(body: Column, columns: Column) -> Column:
    """Lines with at most that many cells; blank lines and longer ones are dropped."""
    return F.filter(body, lambda v: (F.length(F.trim(v)) > 0) & (n_cells(v) <= columns))


def header_map(raw: Column, header_lines: int = HEADER_LINES) -> Column:
    """Key/value lines after the title line; the first of a repeated key wins."""
    return _header(lines(raw), header_lines)


def _header(all_lines: Column, header_lines: int) -> Column:
    block = well_formed(F.slice(all_lines, F.lit(2), F.lit(header_lines)), F.lit(2))

    def entry(f: Column) -> Column:
        return F.struct(F.get(f, F.lit(0)).alias("k"), F.get(f, F.lit(1)).alias("v"))

    def first(entries: Column) -> Column:
        keys = F.transform(entries, lambda e: e["k"])
        return bound(keys, lambda ks: F.filter(entries, lambda e, i: F.array_position(ks, e["k"]) == i + 1))

    return F.map_from_entries(bound(F.transform(block, lambda v: bound(fields(v), entry)), first))


@dataclass(frozen=True)
class SeriesFormat:
    """Layout of a series file: skipped lines, then a header line and the data lines."""

    skipped_lines: int = SKIPPED_LINES
    header_lines: int = HEADER_LINES
    columns: Mapping[str, str] = field(default_factory=lambda: dict(FILE_COLUMNS))
    header_keys: Mapping[str, str] = field(default_factory=lambda: dict(HEADER_KEYS))


def parse_series(landed: DataFrame, raw: str = "raw", layout: SeriesFormat | None = None) -> DataFrame:
    """Replace the raw text by one array per column and the header numbers.

    A file without one of the required columns gives no row; a cell that is no
    number is NULL; a header key that is absent is NULL.
    """
    layout = layout or SeriesFormat()
    kept = [c for c in landed.columns if c != raw]
    required = F.array(*(F.lit(c) for c in layout.columns.values()))

    def rest(a: Column, start: int) -> Column:
        return F.slice(a, F.lit(start), F.greatest(F.size(a) - (start - 1), F.lit(0)))

    def body(data: Column, width: Column) -> Column:
        # As many cells as n_cells counts.
        return F.filter(F.transform(rest(data, 2), fields), lambda r: F.size(r) <= width)

    def whole(all_lines: Column, data: Column, names: Column) -> Column:
        # Found once a file: where each column stands, and the cells of its lines.
        places = F.transform(required, lambda c: (F.array_position(names, c) - 1).cast("int"))
        found = F.struct(
            places.alias("at"),
            bound(n_cells(F.get(data, F.lit(0))), lambda width: body(data, width)).alias("rows"),
            _header(all_lines, layout.header_lines).alias("header"),
        )
        return F.when(F.size(F.array_except(required, names)) == 0, found)

    def parsed(all_lines: Column) -> Column:
        data = F.filter(rest(all_lines, layout.skipped_lines + 1), lambda v: F.length(F.trim(v)) > 0)
        first = lambda d: fields(F.coalesce(F.get(d, F.lit(0)), F.lit("")))
        return bound(data, lambda d: bound(first(d), lambda names: whole(all_lines, d, names)))

    # A filter after it would have the texts taken apart a second time.
    files = F.filter(F.transform(F.array(lines(F.col(raw))), parsed), lambda p: p.isNotNull())
    found = landed.select(*kept, F.explode(files).alias("_file"))
    place = {label: n for n, label in enumerate(layout.columns.values())}

    def column(label: str) -> Column:
        at = F.col("_file.at")[place[label]]
        return F.transform(F.transform("_file.rows", lambda r: F.get(r, at)), stripped_number)

    return found.select(
        *kept,
        *(to_number(F.try_element_at("_file.header", F.lit(k))).alias(n) for n, k in layout.header_keys.items()),
        *(column(label).alias(n) for n, label in layout.columns.items()),
    )
