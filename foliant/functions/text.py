"""Scalar functions on text as column expressions; Arrow functions only for Unicode normalisation."""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.config import EXT_GROUPS, METHOD_LABELS

TRIM = r"^[\s\x{00A0}\x{FEFF}\x{3000}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{1680}]+|[\s\x{00A0}\x{FEFF}\x{3000}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{1680}]+$"
# Named entities that are decoded, in order; the ampersand last
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "middot": "·", "mdash": "—", "ndash": "–", "hellip": "…", "ldquo": "“", "rdquo": "”", "amp": "&"}
# Elements whose end is a line break
BLOCKS = "p div li tr h[1-6] section article blockquote dd dt pre figcaption title caption".split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _replace_all(column: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        column = F.regexp_replace(column, pattern, by)
    return column


# Fixed values below: the patterns of cleaning and of stripping markup, in the order in which they apply


def clean_text(column: Column | str) -> Column:
    """Text without control, private-use and replacement characters, with white space evened out; null stays null."""
    return _replace_all(
        _col(column),
        [
            (r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}]", " "),
            (r"[\x{E000}-\x{F8FF}\x{FFFD}]", ""),
            (r"[ \t\x{00A0}]+", " "),
            (" ?\n ?", "\n"),
            ("\n{3,}", "\n\n"),
            (TRIM, ""),
        ],
    )


def decode_entities(column: Column | str) -> Column:
    """Named entities of the fixed list and numeric ones; others stay as they are."""
    column = numeric_entities(_col(column))
    for name, by in ENTITIES.items():
        column = F.regexp_replace(column, f"(?i)&{name};", by)
    return column


def _from_number(code: int) -> str:
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else ""


def _numeric(text: str) -> str:
    import re

    text = re.sub(r"&#x([0-9a-fA-F]+);", lambda m: _from_number(int(m[1], 16)), text)
    return re.sub(r"&#([0-9]+);", lambda m: _from_number(int(m[1])), text)


def _arrow(function, name: str):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else function(t) for t in texts.to_pylist()], pa.string())

    run.__name__ = name
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")


def numeric_entities(column: Column) -> Column:
    """Entities by number, hexadecimal ones first; numbers that are no characters go.

    Each different entity of a text is replaced everywhere at once; the ampersand's comes
    last, so that none is decoded twice.
    """

    def char(number: Column) -> Column:
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        code = F.when(valid, number).otherwise(F.lit(63))
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("")

    def decoded(text: Column, pattern: str, number) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        mark = lambda e: F.struct((number(e) == 38).alias("last"), e.alias("e"), char(number(e)).alias("c"))
        return F.aggregate(F.array_sort(F.transform(found, mark)), text, lambda acc, m: F.replace(acc, m["e"], m["c"]))

    def value(e: Column, skip: int, base: int) -> Column:
        """The number of an entity, -1 where it has more digits than any character's."""
        digits = F.regexp_replace(F.substring(e, skip, F.length(e) - skip), "^0+", "")
        return F.when(F.length(digits) > 7, F.lit(-1)).otherwise(F.conv(F.concat(F.lit("0"), F.substring(digits, 1, 7)), base, 10)).cast("long")

    column = decoded(column, "&#x[0-9a-fA-F]+;", lambda e: value(e, 4, 16))
    return decoded(column, "&#[0-9]+;", lambda e: value(e, 3, 10))


def strip_markup(column: Column | str) -> Column:
    """HTML or XML as plain text: scripts, styles, comments and tags go, block ends become line breaks."""
    column = _replace_all(
        _col(column),
        [
            (r"(?is)<script.*?</script>", " "),
            (r"(?is)<style.*?</style>", " "),
            (r"(?s)<!--.*?-->", " "),
            (r"(?s)<\?.*?\?>", " "),
            (r"(?i)<br\s*/?>", "\n"),
            (rf"(?i)</(?:{'|'.join(BLOCKS)})>", "\n"),
            (r"(?i)</t[dh]>", "\t"),
            (r"(?i)<li[^>]*>", "\n· "),
            (r"<[^>]+>", ""),
        ],
    )
    return decode_entities(column)


def fold(text: str | None) -> str:
    """NFKC, then lower case: the form that indexing and queries share."""
    return unicodedata.normalize("NFKC", text).lower() if text else ""


def fold_units(text: str | None) -> tuple[str, list[int]]:
    """``fold`` of each character by itself, with the place in ``text`` of every character of the result."""
    if not text:
        return "", []
    if text.isascii():
        return text.lower(), list(range(len(text)))
    parts = [fold(c) for c in text]
    return "".join(parts), [i for i, p in enumerate(parts) for _ in p]


def folded(column: Column | str) -> Column:
    """``fold`` of a string column; null becomes empty."""
    return F.coalesce(_arrow(fold, "fold")(_col(column)), F.lit(""))


def folded_units(column: Column | str) -> Column:
    """``fold_units`` of a string column, without the places; null becomes empty."""
    return F.coalesce(_arrow(lambda t: fold_units(t)[0], "fold_units")(_col(column)), F.lit(""))


def escape_html(column: Column | str) -> Column:
    """Markup characters as entities; null becomes empty."""
    column = F.coalesce(_col(column), F.lit(""))
    for char, by in {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}.items():
        column = F.replace(column, F.lit(char), F.lit(by))
    return column


def highlight(text: str | None, ranges: list[tuple[int, int]], css: str = "") -> str:
    """Escaped text with each range in a mark element; a range that begins inside the one before is left out."""
    escape = lambda s: html.escape(s).replace("&#x27;", "&#39;")
    out, done = [], 0
    for start, end in ranges or []:
        if start >= done:
            out += [escape((text or "")[done:start]), f'<mark class="{css}">', escape((text or "")[start:end]), "</mark>"]
            done = end
    return "".join([*out, escape((text or "")[done:])])


def highlight_html(text: Column | str, ranges: Column | str, css: str = "") -> Column:
    """``highlight`` as a fold over an array of structs (start, end)."""
    text = F.coalesce(_col(text), F.lit(""))
    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("int").alias("done"))
    piece = lambda a, b: escape_html(F.substring(text, a + 1, b - a))

    def step(acc, r):
        start, end = r["start"].cast("int"), r["end"].cast("int")
        grown = F.concat(acc["out"], piece(acc["done"], start), F.lit(f'<mark class="{css}">'), piece(start, end), F.lit("</mark>"))
        return F.when(start < acc["done"], acc).otherwise(F.struct(grown.alias("out"), end.alias("done")))

    return F.aggregate(F.coalesce(_col(ranges), F.array()), empty, step, lambda acc: F.concat(acc["out"], piece(acc["done"], F.length(text))))


def format_bytes(column: Column | str) -> Column:
    """A size with its unit: whole bytes, one decimal below 100, none from there on; null and 0 are ``0 B``."""
    n = _col(column).cast("double")
    scaled = lambda k: F.when(n / k >= 100, F.format_string("%.0f", n / k)).otherwise(F.format_string("%.1f", n / k))
    unit = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for power, name in ((1, "KB"), (2, "MB")):
        unit = unit.when(n < 1024.0 ** (power + 1), F.concat(scaled(1024.0**power), F.lit(f" {name}")))
    return F.when(n.isNull() | (n == 0), F.lit("0 B")).otherwise(unit.otherwise(F.concat(scaled(1024.0**3), F.lit(" GB"))))


def format_time(millis: Column | str, now: int) -> Column:
    """A time relative to ``now`` (epoch milliseconds) up to 30 days, then its UTC date; null and 0 are empty."""
    t = _col(millis).cast("long")
    ago = F.lit(now) - t
    count = lambda unit, word: F.concat(F.floor(ago / unit).cast("string"), F.lit(word))
    day = F.date_format(F.expr("DATE'1970-01-01'") + F.floor(t / 86_400_000).cast("int"), "yyyy-MM-dd")
    return (
        F.when(t.isNull() | (t == 0), "")
        .when(ago < 60_000, "刚刚")
        .when(ago < 3_600_000, count(60_000, " 分钟前"))
        .when(ago < 86_400_000, count(3_600_000, " 小时前"))
        .when(ago < 30 * 86_400_000, count(86_400_000, " 天前"))
        .otherwise(day)
    )


def format_count(column: Column | str) -> Column:
    """A whole number with thousands separators; null is 0."""
    return F.format_number(F.coalesce(_col(column), F.lit(0)).cast("long"), 0)


def percent(part: Column | str, whole: Column | str) -> Column:
    """``part`` of ``whole`` in whole percent, halves up; 0% of nothing."""
    a, b = _col(part), _col(whole)
    return F.concat(F.when(b.isNull() | (b == 0), F.lit(0)).otherwise(F.floor(a * 100 / b + 0.5)).cast("string"), F.lit("%"))


def group_of_ext(column: Column | str) -> Column:
    """The extension's group by a literal map; ``other`` for unknown and null ones."""
    pairs = [F.lit(x) for group, members in EXT_GROUPS.items() for e in members for x in (e, group)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(F.coalesce(_col(column), F.lit("")))), F.lit("other"))


def method_line(counts: Column | str) -> Column:
    """Labels and counts of an array of structs (method, n), in its order."""
    labels = F.create_map(*[F.lit(x) for pair in METHOD_LABELS.items() for x in pair])
    one = lambda m: F.concat(F.coalesce(F.element_at(labels, m["method"]), m["method"]), F.lit(" "), m["n"].cast("string"))
    return F.concat_ws(" · ", F.transform(_col(counts), one))


def file_url(path: Column | str) -> Column:
    """A file URL; characters that URLs keep stay, others are percent-encoded as UTF-8."""
    coded = F.url_encode(_col(path))
    back = {r"\+": "%20", "%2F": "/", "%3A": ":", "%40": "@", "%26": "&", "%3D": "=", r"%2B": "+", r"%24": r"\$", "%2C": ",", "%3B": ";", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}
    return F.concat(F.lit("file://"), _replace_all(coded, list(back.items())))


def thumbnail_urls(library: str, item: Column | str, file_name: Column | str) -> Column:
    """The URLs at which an item's thumbnail may lie: png, then jpg."""
    stem = F.regexp_replace(_col(file_name), r"\.[^.]+$", "")
    base = F.concat(F.lit(f"{library}/images/"), _col(item), F.lit(".info/"), stem, F.lit("_thumbnail."))
    return F.array(*[file_url(F.concat(base, F.lit(e))) for e in ("png", "jpg")])
