"""Body text of files: bytes in, (text, method, warning) out.

Binary formats are read by Python functions over Arrow batches of ``binaryFile`` rows, each
format by its own reader; an exception in one file becomes that row's warning. Formats
without text, thumbnails and metadata aren't opened.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
import io
import re
from typing import NamedTuple
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import BLOCKS, ENTITIES, _numeric

# Extensions read as plain text
PLAIN = set(
    """txt md markdown csv tsv json jsonl ndjson xml yaml yml log srt vtt ass tex bib py js jsx ts tsx mjs cjs java
c h cpp hpp cc cs go rs rb php swift kt scala sh zsh bash bat ps1 sql r m jl lua pl ini conf cfg toml env
properties gitignore dockerfile makefile cmake diff patch nfo smi sami""".split()
)
# Extensions without body text
SKIPPED = set(
    """png jpg jpeg gif webp bmp tif tiff heic avif svg mp4 mov avi mkv webm flv m4v wmv mp3 wav flac aac m4a ogg
ttf otf woff woff2 psd ai sketch fig blend obj fbx stl 3ds zip rar 7z tar gz bz2 xz dmg pkg exe dll so dylib iso""".split()
)
LEGACY = {"doc", "xls", "ppt", "wps", "et", "dps"}
# warnings
NO_PDF = "没有 PDF 解析器，跳过 PDF 正文"
LEGACY_SOME, LEGACY_NONE = "旧版二进制格式，正文为近似提取", "旧版二进制格式，未能提取正文"
UNREADABLE = "文件无法读取"


#: bytes of a file to its pages, by extension
Readers = dict[str, Callable[[bytes], Iterable]]


class Extracted(NamedTuple):
    text: str
    method: str
    warning: str


# ---------------------------------------------------------------- text from bytes


def decode_bytes(data: bytes) -> str:
    """By byte order mark, else UTF-8, else GBK if more than 0.3 % of the characters are broken and GBK breaks fewer."""
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            text = data[len(mark) :].decode(codec, "replace")
            if codec != "utf-8":
                return text
            data = data[len(mark) :]
            break
    text = data.decode("utf-8", "replace")
    broken = text.count("\ufffd")
    if broken > 0.003 * max(1, len(text)):
        other = data.decode("gb18030", "replace")
        if other.count("\ufffd") < broken:
            return other
    return text


_TRIM = re.compile(r"^[\s\ufeff]+|[\s\ufeff]+$")


def tidy(text: str) -> str:
    """The Python twin of the column function that cleans text."""
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", text or "")
    text = re.sub("[\ue000-\uf8ff\ufffd]", "", text)
    text = re.sub("[ \t\xa0]+", " ", text)
    text = re.sub(" ?\n ?", "\n", text)
    return _TRIM.sub("", re.sub("\n{3,}", "\n\n", text))


def entities(text: str) -> str:
    """Numeric and named entities decoded; unknown ones stay."""
    if "&" not in text:
        return text
    text = _numeric(text)
    for name, by in ENTITIES.items():
        text = re.sub(f"&{name};", lambda _, by=by: by, text, flags=re.IGNORECASE)
    return text


_TAG = re.compile(r"<(/?)([A-Za-z][\w:.-]*)([^>]*)>|<[^>]+>")


def flatten(xml: str, ends: dict[str, str], starts: dict[str, str] | None = None, drop: tuple[str, ...] = (), other: str = "") -> str:
    """Markup as text in one scan: what an element's end or start stands for, dropped elements with all they hold."""
    for name in drop:
        xml = re.sub(rf"<{name}\b.*?</{name}>", " ", xml, flags=re.DOTALL)
    starts = starts or {}

    def text_of(m: re.Match) -> str:
        name = m[2]
        if name is None:
            return other
        return ends.get(name, other) if m[1] else starts.get(name, other)

    return entities(_TAG.sub(text_of, xml))


_HTML_BLOCK = re.compile(rf"(?:{'|'.join(BLOCKS)})", re.IGNORECASE)


def html_text(page: str) -> str:
    """The Python twin of the column function that strips markup."""
    for pattern in (r"<script.*?</script>", r"<style.*?</style>", r"<!--.*?-->", r"<\?.*?\?>"):
        page = re.sub(pattern, " ", page, flags=re.DOTALL | re.IGNORECASE)

    def text_of(m: re.Match) -> str:
        name, closing = (m[2] or "").lower(), m[1]
        if name == "br" and not closing and not m[3].strip(" \t\n/"):
            return "\n"
        if closing and not m[3]:
            return "\n" if _HTML_BLOCK.fullmatch(name) else "\t" if name in ("td", "th") else ""
        return "\n· " if not closing and name.startswith("li") else ""

    return entities(_TAG.sub(text_of, page))


# ---------------------------------------------------------------- archives


class Archive:
    """The entries of a ZIP file (stored or deflated, ZIP64 too) in archive order; encrypted ones raise."""

    def __init__(self, data: bytes):
        self.file = zipfile.ZipFile(io.BytesIO(data))
        self.names = [i.filename for i in self.file.infolist() if not i.is_dir()]

    def text(self, name: str) -> str:
        return decode_bytes(self.file.read(name))

    def named(self, pattern: str) -> list[str]:
        rx = re.compile(pattern)
        return [n for n in self.names if rx.fullmatch(n)]


# Fixed values below: the parts of each format and the elements that stand for breaks and tabs


def docx_text(z: Archive) -> str:
    """Body, then headers, footers, notes and comments in archive order, then the document properties."""
    parts = [n for n in ["word/document.xml"] if n in z.names] + z.named(r"word/(?:(?:header|footer)\d*|footnotes|endnotes|comments)\.xml")
    ends = {"w:p": "\n", "w:tc": "\t", "w:tr": "\n", "w:tbl": "\n", "w:tab": "\t", "w:br": "\n"}
    out = []
    for name in parts:
        text = flatten(z.text(name), {k: ends[k] for k in ("w:p", "w:tc", "w:tr", "w:tbl")}, {"w:tab": "\t", "w:br": "\n"}, drop=("w:instrText",))
        text = re.sub(r"[ \t]*\n[ \t]*", "\n", text.replace("\0", ""))
        if text.strip():
            out.append(text)
    if "docProps/core.xml" in z.names:
        core = z.text("docProps/core.xml")
        found = (re.search(rf"<{tag}[^>]*>(.*?)</{tag}>", core, re.DOTALL | re.IGNORECASE) for tag in ("dc:title", "dc:subject", "dc:description", "cp:keywords", "dc:creator"))
        about = [entities(m[1]) for m in found if m and m[1].strip()]
        if about:
            out.append(" ".join(about))
    return "\n".join(out)


def pptx_text(z: Archive) -> str:
    """Slides by number, then notes in archive order."""
    number = lambda n: int(re.search(r"\d+", n)[0])
    names = sorted(z.named(r"ppt/slides/slide\d+\.xml"), key=number) + z.named(r"ppt/notesSlides/notesSlide\d+\.xml")
    texts = (flatten(z.text(n), {"a:p": "\n"}, {"a:br": "\n"}).strip() for n in names)
    return "\n".join(t for t in texts if t)


def _runs(xml: str) -> list[str]:
    return [entities(t) for t in re.findall(r"<t\b[^>/]*>(.*?)</t>", xml, re.DOTALL)]


def xlsx_text(z: Archive) -> str:
    """Sheet names, then each sheet's cells; shared strings without phonetic guides."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.names:
        for body in re.findall(r"<si\b[^>/]*>(.*?)</si>", z.text("xl/sharedStrings.xml"), re.DOTALL):
            shared.append("".join(_runs(re.sub(r"<rPh\b.*?</rPh>", "", body, flags=re.DOTALL))))
    out = []
    if "xl/workbook.xml" in z.names:
        out.append(" ".join(re.findall(r'<sheet\b[^>]*?\bname="([^"]*)"', z.text("xl/workbook.xml"))))
    for name in z.named(r"xl/worksheets/sheet\d*\.xml"):
        cells = []
        # an empty cell closes itself and has no value
        for attributes, body in re.findall(r"<c\b((?:[^>/]|/(?!>))*)>(.*?)</c>", z.text(name), re.DOTALL):
            kind = re.search(r'\bt="([^"]+)"', attributes)
            if kind and kind[1] == "inlineStr":
                cells += _runs(body)[:1]
                continue
            value = re.search(r"<v\b[^>]*>(.*?)</v>", body, re.DOTALL)
            value = entities(value[1]) if value else ""
            if kind and kind[1] == "s":
                cells += shared[int(value) : int(value) + 1] if value.strip().isdigit() else []
            elif value:
                cells.append(value)
        if cells:
            out.append(" ".join(cells))
    return "\n".join(out)


def odf_xml_text(xml: str) -> str:
    return flatten(xml, {"text:p": "\n", "text:h": "\n", "table:table-cell": "\t", "table:table-row": "\n"}, {"text:s": " ", "text:tab": "\t"})


def odf_text(z: Archive) -> str:
    return odf_xml_text(z.text("content.xml")) if "content.xml" in z.names else ""


def epub_text(z: Archive, max_chars: int) -> str:
    """Pages in archive order until ``max_chars`` are read."""
    out, total = [], 0
    for name in z.names:
        if re.search(r"\.(?:x?html?|xml)$", name, re.IGNORECASE):
            text = html_text(z.text(name))
            if text.strip():
                out.append(text.strip())
                total += len(text)
            if total >= max_chars:
                break
    return "\n".join(out)


# ---------------------------------------------------------------- RTF

# RTF groups that hold no text
RTF_DROPPED = set("fonttbl colortbl stylesheet listtable listoverridetable generator info pict themedata colorschememapping latentstyles rsidtbl xmlnstbl filetbl revtbl datastore mmathPr".split())
_RTF = re.compile(r"\\u(-?\d+) ?\??|\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)?[ \n]?|\\(.)|([{}])|([^\\{}]+)", re.DOTALL)


def rtf_text(source: str) -> str:
    """One scan with a stack of groups: hidden groups are skipped, runs of byte escapes are decoded as GBK if that works."""
    out: list[str] = []
    raw = bytearray()
    hidden = [False]
    opened = False  # directly after an opening brace

    def flush() -> None:
        if raw:
            text = raw.decode("gb18030", "replace")
            out.append(text if text.count("\ufffd") < 0.05 * len(raw) else raw.decode("latin-1"))
            raw.clear()

    for uni, byte, word, _, symbol, brace, plain in _RTF.findall(source):
        if brace == "{":
            hidden.append(hidden[-1])
        elif brace and len(hidden) > 1:
            hidden.pop()
        elif opened and (symbol == "*" or word in RTF_DROPPED):
            hidden[-1] = True
        if not hidden[-1] and not brace:
            if byte:
                raw.append(int(byte, 16))
            else:
                flush()
                if uni:
                    code = int(uni) % 65536
                    out.append("" if 0xD800 <= code <= 0xDFFF else chr(code))
                elif word:
                    out.append({"par": "\n", "line": "\n", "tab": "\t"}.get(word, ""))
                elif symbol in ("\\", "{", "}"):
                    out.append(symbol)
                elif plain:
                    out.append(plain.replace("\r", "").replace("\n", ""))
        opened = brace == "{"
    flush()
    return "".join(out)


# ---------------------------------------------------------------- old binary formats

# Characters that count as readable in old binary files, and the shortest runs
_WIDE_RUN = re.compile("[\t\n\r\x20-\x7e\u3000-\u303f\u4e00-\u9fff\uff00-\uffef]{4,}")
_GBK_RUN = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\x81-\xfe][\x40-\xfe])+")
_GOOD = re.compile("[\u4e00-\u9fff0-9A-Za-z ]")


def legacy_text(data: bytes) -> str:
    """Runs of readable characters, read both as UTF-16 and as GBK; approximate."""
    wide = _WIDE_RUN.findall(data[: len(data) // 2 * 2].decode("utf-16-le", "replace"))
    narrow = [r.decode("gb18030", "replace") for r in _GBK_RUN.findall(data) if len(r) >= 6]
    kept: dict[str, str] = {}
    for run in wide + narrow:
        run = re.sub("[\x00-\x1f]", " ", run).strip()
        if len(run) >= 4 and len(_GOOD.findall(run)) >= 0.7 * len(run):
            kept.setdefault(run[:24], run)
        if len(kept) > 800:
            break
    return "\n".join(kept.values())


def looks_like_text(data: bytes) -> bool:
    """No zero byte and over 90 % printable among the first 8192; an empty file doesn't."""
    head = data[:8192]
    printable = sum(b >= 0x80 or 0x20 <= b <= 0x7E or b in (9, 10, 13) for b in head)
    return bool(head) and 0 not in head and printable > 0.9 * len(head)


# ---------------------------------------------------------------- dispatch

_ZIPPED: dict[str, tuple[str, Callable]] = {
    "docx": ("ooxml", docx_text), "pptx": ("ooxml", pptx_text), "xlsx": ("ooxml", xlsx_text),
    "odt": ("odf", odf_text), "ods": ("odf", odf_text), "odp": ("odf", odf_text),
}


def join_pages(pages: Iterable, max_chars: int) -> str:
    """Pages of positioned text as one text.

    A page is an iterable of (text, y, ends line): a line break stands where y moves by
    more than 4 and after a piece that ends its line; a y of None moves nothing. Pages are
    joined by line breaks, until ``max_chars`` are read.
    """
    out, total = [], 0
    for page in pages:
        parts, before = [], None
        for text, y, ends in page:
            if before is not None and y is not None and abs(y - before) > 4:
                parts.append("\n")
            parts.append(text + "\n" if ends else text)
            before = y
        out.append("".join(parts))
        total += len(out[-1])
        if total >= max_chars:
            break
    return "\n".join(out)


def extract(data: bytes | None, ext: str | None, max_chars: int = 200_000, readers: Readers | None = None) -> Extracted:
    """The body text of one file, cut to ``max_chars`` code points.

    Files that can't be read as their format get the method ``error`` and a warning.
    ``readers`` gives formats that aren't built in a function from bytes to pages as
    ``join_pages`` takes them; without one for ``pdf``, PDFs have no text, and a warning
    says so. Flat ODF is read as the XML that it is.
    """
    ext = (ext or "").lower()
    if data is None:
        return Extracted("", "skip", UNREADABLE)
    if readers and ext in readers:
        try:
            return Extracted(tidy(join_pages(readers[ext](data), max_chars))[:max_chars], ext, "")
        except Exception as e:
            return Extracted("", ext, f"{ext.upper()} 解析失败：{e}")
    if ext in SKIPPED:
        return Extracted("", "skip", "")
    warning = ""
    try:
        if ext == "pdf":
            return Extracted("", "pdf", NO_PDF)
        if ext in _ZIPPED:
            method, read = _ZIPPED[ext]
            text = read(Archive(data))
        elif ext == "fodt":
            method, text = "odf", odf_xml_text(decode_bytes(data))
        elif ext == "epub":
            method, text = "epub", epub_text(Archive(data), max_chars)
        elif ext == "rtf":
            method, text = "rtf", rtf_text(decode_bytes(data))
        elif ext in ("html", "htm", "xhtml"):
            method, text = "utf8", html_text(decode_bytes(data))
        elif ext in LEGACY:
            method, text = "legacy-binary", legacy_text(data)
            warning = LEGACY_SOME if text else LEGACY_NONE
        elif ext in PLAIN or looks_like_text(data):
            method, text = "utf8", decode_bytes(data)
        else:
            return Extracted("", "skip", "")
        return Extracted(tidy(text)[:max_chars], method, warning)
    except Exception as e:
        return Extracted("", "error", f"{ext or '未知格式'} 提取失败：{e}")


def extract_column(content, ext, max_chars: int, readers: Readers | None = None):
    """``extract`` as a struct column (text, method, warning)."""

    def run(data: pd.Series, kind: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(None if d is None else bytes(d), e, max_chars, readers) for d, e in zip(data, kind)], columns=Extracted._fields)

    run.__annotations__ = {"data": pd.Series, "kind": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "text string, method string, warning string")(content, ext)


def suffix(path: Column | str) -> Column:
    """A path's own extension in lower case, empty if it has none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def readable(path: Column | str, readers: Readers | None = None) -> Column:
    """Whether a file's extension says that it may hold text; files without one may."""
    return ~suffix(path).isin(*sorted((SKIPPED | {"pdf"}) - set(readers or ())))


def extract_files(items: DataFrame, files: DataFrame | None, max_chars: int, max_size: int, readers: Readers | None = None) -> DataFrame:
    """``items`` (path, ext, size) with content, method and warn from ``files`` (path, content).

    Bytes become text where they are read, and only the text is joined to the items; just
    files without an extension of their own meet their items first, as these say what they
    are. Formats without text need no file. Files over ``max_size`` aren't read: they keep
    their metadata and get a warning.
    """
    from foliant.functions.text import format_bytes

    small = items.filter(F.col("size") <= max_size)
    # what needs no bytes: formats without text, and empty files, which listings leave out
    blank = F.when(readable("path", readers) | (F.col("path") == ""), F.when(F.col("size") == 0, F.lit(b""))).otherwise(F.lit(b"\0"))
    if files is None:
        read = small.withColumn("_e", extract_column(blank, F.col("ext"), max_chars, readers))
    else:
        kinds = suffix("path")
        bare = files.filter(kinds == "").join(small.filter(suffix("path") == "").select("path", "ext"), "path").select("path", extract_column(F.col("content"), F.col("ext"), max_chars, readers).alias("_t"))
        own = files.filter(kinds != "").select("path", extract_column(F.col("content"), kinds, max_chars, readers).alias("_t"))
        read = small.join(own.unionByName(bare), "path", "left")
        read = read.withColumn("_e", F.when(F.col("_t").isNotNull(), F.col("_t")).otherwise(extract_column(F.when(F.col("_t").isNull(), blank), F.col("ext"), max_chars, readers)))
    read = read.select(*items.columns, F.col("_e.text").alias("content"), F.col("_e.method").alias("method"), F.col("_e.warning").alias("warn"))
    note = F.concat(F.lit("文件超过 "), format_bytes(F.lit(max_size)), F.lit("，仅索引元数据"))
    large = items.filter(F.coalesce(F.col("size") > max_size, F.lit(True))).select(*items.columns, F.lit("").alias("content"), F.lit("skip").alias("method"), note.alias("warn"))
    return read.unionByName(large)
