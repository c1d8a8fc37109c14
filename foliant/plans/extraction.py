"""Queries on the body text of file formats, over invented files given inline, with the texts they hold as SQL."""

from __future__ import annotations

from collections.abc import Callable
import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import clean_text
from foliant.sources.extract import LEGACY_NONE, LEGACY_SOME, NO_PDF, UNREADABLE, extract_column, extract_files, join_pages




def _archive(parts: dict[str, str], how: int = zipfile.ZIP_STORED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", how) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


#: of each query: (name, extension, bytes or None, text, method, warning)
FILES: dict[str, list[tuple[str, str | None, bytes | None, str, str, str]]] = {
    "extract_plain": [
        ("utf-8", "txt", "harbour 港口\r\n\r\n\r\n\r\nlight\t\tship ".encode(), "harbour 港口\r\n\r\n\r\n\r\nlight ship", "utf8", ""),
        ("byte order mark", "md", "# 灯塔\n\n\n\nend".encode("utf-8-sig"), "# 灯塔\n\nend", "utf8", ""),
        ("utf-16 little", "csv", b"\xff\xfe" + "buoy,浮标".encode("utf-16-le"), "buoy,浮标", "utf8", ""),
        ("utf-16 big", "log", b"\xfe\xff" + "tide 潮".encode("utf-16-be"), "tide 潮", "utf8", ""),
        ("gbk", "csv", "码头,吃水\n渔船,三米\n".encode("gbk"), "码头,吃水\n渔船,三米", "utf8", ""),
        ("no text", "txt", b"", "", "utf8", ""),
        ("unreadable", "txt", None, "", "skip", UNREADABLE),
        ("control characters", "json", b'{"a":\x01 "\xee\x80\x80b"}', '{"a": "b"}', "utf8", ""),
    ],
    "extract_html": [
        ("page", "html", "<html><head><title>Quay</title><style>p{}</style></head><body><h1>One</h1><p>a &lt; b&nbsp;&amp; c&#33;</p><ul><li>x</li></ul><script>no()</script></body></html>".encode(), "Quay\nOne\na < b & c!\n\n· x", "utf8", ""),
        ("rows", "htm", b"<table><tr><td>1</td><td>2</td></tr></table><!-- gone --><br/>end", "1 2\n\nend", "utf8", ""),
    ],
    "extract_office": [
        ("docx", "docx", _archive({"word/document.xml": "<w:body><w:p><w:r><w:t>Mast &amp; sail</w:t><w:tab/><w:t>桅</w:t></w:r></w:p><w:p><w:instrText> PAGE </w:instrText><w:t>two</w:t><w:br/><w:t>three</w:t></w:p></w:body>", "word/header2.xml": "<w:p><w:t>head</w:t></w:p>", "docProps/core.xml": "<dc:title>Ropes</dc:title><dc:creator>Nobody</dc:creator>"}, zipfile.ZIP_DEFLATED), "Mast & sail 桅\ntwo\nthree\n\nhead\n\nRopes Nobody", "ooxml", ""),
        ("pptx", "pptx", _archive({"ppt/slides/slide11.xml": "<a:p><a:t>last</a:t></a:p>", "ppt/slides/slide3.xml": "<a:p><a:t>first</a:t><a:br/><a:t>line</a:t></a:p>", "ppt/notesSlides/notesSlide1.xml": "<a:p><a:t>note</a:t></a:p>"}), "first\nline\nlast\nnote", "ooxml", ""),
        ("xlsx", "xlsx", _archive({"xl/sharedStrings.xml": "<sst><si><t>anchor</t></si><si><r><t>鱼</t></r><r><t>网</t></r><rPh><t>yu</t></rPh></si></sst>", "xl/workbook.xml": '<sheets><sheet name="Hold" sheetId="1"/><sheet name="货" sheetId="2"/></sheets>', "xl/worksheets/sheet1.xml": '<row><c t="s"><v>1</v></c><c><v>12.5</v></c><c s="1"/><c t="inlineStr"><is><t>in&gt;</t></is></c></row>', "xl/worksheets/sheet2.xml": '<row><c t="s"><v>0</v></c><c t="s"><v>7</v></c></row>'}), "Hold 货\n鱼网 12.5 in>\nanchor", "ooxml", ""),
        ("not an archive", "docx", b"plain", "", "error", "docx 提取失败：File is not a zip file"),
    ],
    "extract_open_documents": [
        ("odt", "odt", _archive({"content.xml": "<office:text><text:h>Log</text:h><text:p>day<text:s/>1<text:tab/>fog</text:p></office:text>"}), "Log\nday 1 fog", "odf", ""),
        ("ods", "ods", _archive({"content.xml": "<table:table-row><table:table-cell><text:p>a</text:p></table:table-cell><table:table-cell><text:p>b</text:p></table:table-cell></table:table-row>"}), "a\nb", "odf", ""),
        ("odp without content", "odp", _archive({"meta.xml": "<x/>"}), "", "odf", ""),
        ("flat", "fodt", "<office:text><text:p>平</text:p></office:text>".encode(), "平", "odf", ""),
        ("epub", "epub", _archive({"mimetype": "application/epub+zip", "b/2.xhtml": "<p>Second</p>", "b/1.html": "<style>x</style><p>First</p>"}), "Second\nFirst", "epub", ""),
    ],
    "extract_rtf": [
        ("groups", "rtf", rb"{\rtf1{\fonttbl{\f0 Made Up;}}{\*\generator z;}North \{1\}\par South\tab end}", "North {1}\nSouth end", "rtf", ""),
        ("bytes and numbers", "rtf", b"{\\rtf1 " + "".join(rf"\'{b:02x}" for b in "海图".encode("gbk")).encode() + b" \\u28023?\\line x}", "海图 海\nx", "rtf", ""),
    ],
    "extract_other": [
        ("old document", "doc", b"\xd0\xcf\x11\xe0" + b"\0" * 6 + "grey seals 1987".encode("utf-16-le") + b"\0\0\1\0", "grey seals 1987", "legacy-binary", LEGACY_SOME),
        ("old and empty", "xls", b"\0\1\0\1", "", "legacy-binary", LEGACY_NONE),
        ("unknown text", "zzz", "kelp forest".encode(), "kelp forest", "utf8", ""),
        ("no extension", None, b"sandbar", "sandbar", "utf8", ""),
        ("unknown binary", "zzz", b"kelp\0forest", "", "skip", ""),
        ("hardly printable", "zzz", b"abcdefgh\x01\x02", "", "skip", ""),
        ("picture", "png", b"\x89PNG", "", "skip", ""),
        ("pdf without reader", "pdf", b"%PDF-1.7", "", "pdf", NO_PDF),
    ],
}


def _extract(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, at: str) -> DataFrame:
        rows = spark.createDataFrame([(n, e, d) for n, e, d, *_ in FILES[name]], "name string, ext string, data binary")
        return rows.select("name", extract_column(F.col("data"), F.col("ext"), 200_000).alias("e")).select("name", "e.*")

    return run


def extract_documents(spark: SparkSession, at: str) -> DataFrame:
    """The library's texts as files of their own, read back and tidied; those over a size limit keep their metadata."""
    documents = spark.read.parquet(f"{at}/documents.parquet").filter(F.col("text").isNotNull())
    files = documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    items = documents.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lit("txt").alias("ext"), F.octet_length("text").cast("long").alias("size"))
    read = extract_files(items, files, 1_000_000, LARGEST)
    return read.select("doc_id", F.md5("content").alias("digest"), F.length("content").alias("n_chars"), "method", "warn")


LARGEST = 20_000


def extract_tidied(spark: SparkSession, at: str) -> DataFrame:
    """The column function that cleans text, over the whole texts."""
    documents = spark.read.parquet(f"{at}/documents.parquet")
    return documents.select("doc_id", F.md5(clean_text("text")).alias("digest"))


PAGES = [("two lines", [[("Fog", 700.0, False), ("horn", 690.0, False)]]), ("one line", [[("Fog", 700.0, False), ("horn", 697.0, False)]]), ("ends", [[("Fog", 700.0, True), ("horn", 700.0, False)]]), ("pages", [[("a", 1.0, False)], [], [("b", 500.0, False)]]), ("no place", [[("a", None, False), ("b", 9.0, False)]])]


def extract_pages(spark: SparkSession, at: str) -> DataFrame:
    """Pages as a reader for PDFs gives them, joined."""
    return spark.createDataFrame([(name, join_pages(pages, 1000)) for name, pages in PAGES], "name string, text string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _extract(name) for name in FILES} | {f.__name__: f for f in (extract_documents, extract_tidied, extract_pages)}


def _literal(value: str) -> str:
    """A text as SQL, with line breaks and tabs spelled out."""
    out = "'" + value.replace("'", "''") + "'"
    for char in "\r\n\t":
        out = out.replace(char, f"' || chr({ord(char)}) || '")
    return out


def oracle_sql() -> dict[str, str]:
    from foliant.plans.text_search import _CLEAN, _SPACE, _replaced

    values = {name: ", ".join(f"({', '.join(_literal(x) for x in (n, text, method, warning))})" for n, _, _, text, method, warning in rows) for name, rows in FILES.items()}
    tidy = _replaced(_replaced("text", _CLEAN), [(f"^{_SPACE}", "", "g"), (f"{_SPACE}$", "", "g")])
    return {name: f"SELECT * FROM (VALUES {rows}) v(name, text, method, warning)" for name, rows in values.items()} | {
        "extract_documents": f"""SELECT doc_id, md5(CASE WHEN strlen(text) <= {LARGEST} THEN {tidy} ELSE '' END) AS digest, CASE WHEN strlen(text) <= {LARGEST} THEN length({tidy}) ELSE 0 END::INTEGER AS n_chars,
  CASE WHEN strlen(text) <= {LARGEST} THEN 'utf8' ELSE 'skip' END AS method, CASE WHEN strlen(text) <= {LARGEST} THEN '' ELSE '文件超过 19.5 KB，仅索引元数据' END AS warn FROM documents WHERE text IS NOT NULL""",
        "extract_tidied": f"SELECT doc_id, md5({tidy}) AS digest FROM documents",
        "extract_pages": "SELECT * FROM (VALUES ('two lines', 'Fog' || chr(10) || 'horn'), ('one line', 'Foghorn'), ('ends', 'Fog' || chr(10) || 'horn'), ('pages', 'a' || chr(10) || chr(10) || 'b'), ('no place', 'ab')) v(name, text)",
    }
