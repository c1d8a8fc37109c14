"""A small made-up library on disk, with a file of each format."""

import io
import json
import zipfile


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


DOCX = archive(**{
    "word/footer1.xml": "<w:p><w:t>页脚文字</w:t><w:instrText> PAGE </w:instrText></w:p>",
    "word/document.xml": "<?xml version='1.0'?><w:body><w:p><w:r><w:t>正文第一段</w:t><w:tab/><w:t>A &amp; B</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>格</w:t></w:p></w:tc></w:tr></w:tbl></w:body>",
    "docProps/core.xml": "<dc:title>文档标题</dc:title><dc:creator> </dc:creator>",
})
PPTX = archive(**{"ppt/slides/slide10.xml": "<a:p><a:t>ten</a:t></a:p>", "ppt/slides/slide2.xml": "<a:p><a:t>two</a:t><a:br/><a:t>more</a:t></a:p>", "ppt/notesSlides/notesSlide1.xml": "<a:p><a:t>备注</a:t></a:p>"})
XLSX = archive(**{
    "xl/sharedStrings.xml": "<sst><si><t>甲</t><rPh><t>jia</t></rPh></si><si><r><t xml:space='preserve'>乙 </t></r><r><t>丙</t></r></si></sst>",
    "xl/workbook.xml": '<sheets><sheet name="计数" sheetId="1"/></sheets>',
    "xl/worksheets/sheet1.xml": '<row><c r="A1" t="s"><v>1</v></c><c r="B1" s="2"/><c r="C1"><v>4.5</v></c><c r="D1" t="inlineStr"><is><t>in&lt;</t></is></c><c t="s"><v>0</v></c><c t="s"><v>99</v></c></row>',
})
ODT = archive(**{"content.xml": "<office:text><text:h>题</text:h><text:p>tea<text:s/>7<text:tab/>x</text:p></office:text>"})
EPUB = archive(**{"mimetype": "application/epub+zip", "OEBPS/c1.xhtml": "<html><style>p{}</style><p>第一章</p></html>", "OEBPS/c2.html": "<p>第二章</p>"})
RTF = rb"{\rtf1\ansi{\fonttbl{\f0 Invented Sans;}}{\*\generator x;}\f0 " + "".join(rf"\'{b:02x}" for b in "中文报告".encode("gbk")).encode() + rb"\par tail \{x\} " + b"\\" + b"u20013?" + rb"\tab end}"
LEGACY = b"\xd0\xcf\x11\xe0" + b"\0" * 8 + "旧文档正文内容".encode("utf-16-le") + b"\0\0\1\0"
FILES = {
    "D1": ("a.docx", DOCX), "P1": ("b.pptx", PPTX), "X1": ("c.xlsx", XLSX), "O1": ("d.odt", ODT), "E1": ("e.epub", EPUB), "R1": ("f.rtf", RTF),
    "C1": ("g.csv", "名称,值\n样品,1\n".encode()), "C2": ("h.csv", "货架,余量\n青瓷碗,42\n".encode("gbk")), "M1": ("i.md", "# 方法\n\n\n\ntext".encode("utf-8-sig")),
    "H1": ("j.html", "<title>页面标题</title><script>var hidden</script><p>body</p>".encode()), "F1": ("k.pdf", b"%PDF-1.4"), "L1": ("l.doc", LEGACY),
    "B1": ("m.docx", b"not a zip"), "U1": ("n.unknown", b"plain words"), "U2": ("o.bin", b"\0\1\2"), "I1": ("p.PNG", b"\x89PNG"), "T1": ("q.txt", b""),
}


def write(root, skip=(), extra=()):
    (root / "images").mkdir(parents=True, exist_ok=True)
    (root / "metadata.json").write_text(json.dumps({"folders": [{"id": "KF1", "name": "文件夹甲"}, {"id": "KF2", "name": None}]}), encoding="utf-8")
    for k, (item, (name, data)) in enumerate([*FILES.items(), *extra]):
        if item in skip:
            continue
        d = root / "images" / f"{item}.info"
        d.mkdir(exist_ok=True)
        meta = {"id": item, "name": f"名称 {item}", "ext": name.rpartition(".")[2], "url": "", "annotation": "", "size": len(data), "btime": 5, "mtime": 6, "modificationTime": 7, "tags": ["标签"] * (k % 2), "folders": ["KF1", "KF2", "KF9"][: k % 4], "isDeleted": item == "U2"}
        (d / "metadata.json").write_text(json.dumps(meta, ensure_ascii=False), encoding="utf-8")
        (d / name).write_bytes(data)
        (d / f"{name.rpartition('.')[0]}_thumbnail.png").write_bytes(b"x")
    bad = root / "images" / "BAD.info"
    bad.mkdir(exist_ok=True)
    (bad / "metadata.json").write_text("{ not json")
    (bad / "x.txt").write_text("x")
    none = root / "images" / "NONE.info"
    none.mkdir(exist_ok=True)
    (none / "metadata.json").write_text('{"id": "NONE", "name": "no payload"}')
