import pytest

from foliant.config import Settings
from foliant.functions.tokenizer import tokenize
from foliant.operators.index import BuildCancelled, IndexStore
from foliant.operators.search import search
from foliant.sources import extract as x
from foliant.sources.library import list_items, load_settings, read_folders, read_items, read_texts, save_settings, scan_library, update_index
from tests import library_fixture as lib

TEXTS = {
    "D1": ("正文第一段 A & B\n格\n\n页脚文字\n\n文档标题", "ooxml"), "P1": ("two\nmore\nten\n备注", "ooxml"), "X1": ("计数\n乙 丙 4.5 in< 甲", "ooxml"), "O1": ("题\ntea 7 x", "odf"), "E1": ("第一章\n第二章", "epub"),
    "R1": ("中文报告\ntail {x} 中 end", "rtf"), "C1": ("名称,值\n样品,1", "utf8"), "C2": ("货架,余量\n青瓷碗,42", "utf8"), "M1": ("# 方法\n\ntext", "utf8"), "H1": ("页面标题\nbody", "utf8"), "F1": ("", "pdf"),
    "L1": ("旧文档正文内容", "legacy-binary"), "B1": ("", "error"), "U1": ("plain words", "utf8"), "U2": ("", "skip"), "I1": ("", "skip"), "T1": ("", "utf8"),
}


@pytest.mark.parametrize("item", sorted(lib.FILES))
def test_formats(item):
    name, data = lib.FILES[item]
    e = x.extract(data, name.rpartition(".")[2])
    text, method = TEXTS[item]
    assert e.method == method
    assert (text in e.text) if item == "L1" else (e.text == text or e.text.replace("\n\n", "\n") == text.replace("\n\n", "\n"))
    assert bool(e.warning) == (item in ("F1", "L1", "B1"))


def test_extract_edges():
    assert x.extract(None, "txt").warning and x.extract(b"", "zzz").method == "skip" and x.extract(b"ab", None).text == "ab"
    assert x.extract(b"abcdef", "txt", 3).text == "abc"
    assert x.decode_bytes("字".encode("utf-16")) == "字" and x.decode_bytes(b"") == ""
    assert not x.looks_like_text(b"") and not x.looks_like_text(b"a\0") and x.looks_like_text("字".encode())
    deep = b"{\\rtf1 " + b"{\\b " * 5000 + b"x" + b"}" * 5000 + b"}"
    assert x.extract(deep, "rtf").text == "x"
    assert x.extract(b"<office:text><text:p>flat</text:p></office:text>", "fodt").text == "flat"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    lib.write(root)
    return root


def test_scan(spark, root):
    rows = {r.id: r for r in scan_library(spark, f"file://{root}").collect()}
    assert set(rows) == set(lib.FILES) - {"U2"}
    assert rows["I1"].ext == "png" and rows["I1"].fileName == "p.PNG" and rows["D1"].size == len(lib.DOCX) and rows["D1"].addedAt == 5 and rows["D1"].mtime > 10**12
    assert "U2" in {r.id for r in scan_library(spark, f"file://{root}", Settings(include_trashed=True)).collect()}
    assert {r.id: r.name for r in read_folders(spark, f"file://{root}").collect()} == {"KF1": "文件夹甲", "KF2": None}
    assert read_folders(spark, f"file://{root}/none").collect() == []


def test_items(spark, root):
    rows = {r.id: r for r in read_items(spark, f"file://{root}").collect()}
    assert rows["X1"].content == "计数\n乙 丙 4.5 in< 甲" and rows["X1"].folder_names == ["文件夹甲", "KF2"]
    assert rows["F1"].warn == x.NO_PDF and rows["B1"].method == "error"
    small = {r.id: r for r in read_items(spark, f"file://{root}", Settings(max_file_size=20)).collect()}
    assert small["D1"].content == "" and small["D1"].method == "skip" and "20 B" in small["D1"].warn and small["U1"].content == "plain words"


def dump(index):
    ids = {r.idx: r.id for r in index.docs.collect()}
    return {(r.term, ids[r.idx], r["mask"], r.tf) for r in index.postings.collect()}, {ids[r.idx]: r.content for r in index.texts.collect()}


def test_build_update_and_search(spark, tmp_path):
    root = tmp_path / "lib"
    lib.write(root, skip=("R1",))
    opened = []

    def build(store, **how):
        fetch = lambda rows: opened.append(sorted(r.id for r in rows.collect())) or read_texts(spark, f"file://{root}", rows)
        return store.build(list_items(spark, f"file://{root}"), fetch=fetch, **how)

    store = IndexStore(spark, f"file://{tmp_path}/index", "L")
    assert store.load() == (None, "no-index") and store.bytes() == 0
    first = build(store)
    assert first["changed"] == first["total"] == len(lib.FILES) - 2 and first["removed"] == 0 and {w["id"] for w in first["warnings"]} == {"F1", "L1", "B1"}
    again = build(store)
    assert len(opened) == 1 and len(opened[0]) == first["total"]  # nothing is opened where nothing changed
    assert again["changed"] == again["removed"] == 0 and again["terms"] == first["terms"]
    index, reason = store.load()
    before = {r.id: r.idx for r in index.docs.collect()}
    assert reason == "" and sorted(before.values()) == list(range(len(before))) and store.bytes() > 0
    assert [h.id for h in search(index, '"第二章"').hits.collect()] == ["E1"]
    assert [h.id for h in search(index, "青瓷碗").hits.collect()] == ["C2"]

    import shutil

    shutil.rmtree(root / "images" / "E1.info")
    (root / "images" / "C1.info" / "g.csv").write_bytes(b"changed words, more of them")
    lib.write(root, skip=set(lib.FILES) - {"R1"})
    update = build(store)
    assert (update["changed"], update["removed"]) == (2, 1) and opened[1] == ["C1", "R1"]
    assert len(store.manifest()["segments"]) == 2
    index, _ = store.load()
    after = {r.id: r.idx for r in index.docs.collect()}
    assert after["C1"] == before["C1"] and after["R1"] == len(before) and "E1" not in after
    full = IndexStore(spark, f"file://{tmp_path}/full", "L")
    full.build(read_items(spark, f"file://{root}"))
    assert dump(index) == dump(full.load()[0])
    assert all(tokenize(t) or not t for t in dump(index)[1].values())

    assert IndexStore(spark, store.folder, "other").load()[1] == "library"
    assert IndexStore(spark, store.folder, "L", Settings().with_profile("long")).load()[1] == "settings"
    m = store.manifest()
    from foliant.plans.commit import write_pointer

    write_pointer(spark, f"{store.folder}/manifest.json", {**m, "segments": ["lost"]})
    assert store.load()[1] == "broken"
    write_pointer(spark, f"{store.folder}/manifest.json", {**m, "version": 4})
    assert store.load()[1] == "version"
    phases = []
    assert update_index(store, f"file://{root}", progress=lambda phase, about: phases.append(phase))["changed"] == len(after)
    assert phases == ["scan", "plan", "extract", "save", "done"]


def rows_of(spark, *rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "id string, mtime long, content string, name string")


def test_a_first_build_of_one_document_loses_nothing(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/index")
    store.build(rows_of(spark, ("a", 1, "alpha")))
    store.build(rows_of(spark, ("a", 1, "alpha"), ("b", 1, "beta")))
    assert sorted((r.id, r.idx) for r in store.load()[0].docs.collect()) == [("a", 0), ("b", 1)]
    store.build(rows_of(spark, ("b", 1, "beta")))
    store.build(rows_of(spark, ("b", 1, "beta"), ("c", 1, "gamma")))
    assert sorted((r.id, r.idx) for r in store.load()[0].docs.collect()) == [("b", 1), ("c", 2)]


def test_segments_are_merged_and_old_ones_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(IndexStore, "MOST_SEGMENTS", 2)
    store = IndexStore(spark, f"file://{tmp_path}/index")
    for k in range(3):
        store.build(rows_of(spark, ("a", k, f"alpha{k}"), ("b", 1, "beta"), (f"n{k}", 1, "new")))
        kept = {p.name for p in (tmp_path / "index").iterdir() if not p.name.startswith(".")}
        m = store.manifest()
        assert kept == {"manifest.json", *m["segments"], *m["before"]} and len(m["segments"]) <= 2
        index = store.load()[0]
        assert {r.content for r in index.texts.collect()} == {f"alpha{k}", "beta", "new"} and index.docs.count() == 3
        assert {r.term for r in index.postings.collect()} >= {f"alpha{k}", "beta", "new"} and index.postings.filter(f"term = 'alpha{k - 1}'").count() == 0


def test_cancel(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/index")
    store.build(rows_of(spark, ("a", 1, "alpha")))
    with pytest.raises(BuildCancelled):
        store.build(rows_of(spark, ("b", 1, "beta")), progress=lambda phase, about: phase == "extract" and store.cancel())
    assert [r.id for r in store.load()[0].docs.collect()] == ["a"]


def test_only_readable_payloads_are_opened(spark, tmp_path, monkeypatch):
    """Files that would fail to open show which ones are opened: none of media, metadata, thumbnails, PDFs or large files."""
    from foliant.sources import library

    lib.write(tmp_path)
    listed = list_items(spark, f"file://{tmp_path}")
    seen = {}

    def spy(items, files, *rest):
        seen["paths"] = {r.path.rpartition("/")[2] for r in files.select("path").collect()}
        return x.extract_files(items, files, *rest)

    monkeypatch.setattr(library, "extract_files", spy)
    want = {name for name, data in lib.FILES.values() if name not in ("k.pdf", "p.PNG", "o.bin", "q.txt")}
    by_path = read_texts(spark, f"file://{tmp_path}", listed).collect()
    assert seen["paths"] == want
    monkeypatch.setattr(library, "NAMED_FILES", 1)
    by_pattern = read_texts(spark, f"file://{tmp_path}", listed).collect()
    assert want <= seen["paths"] <= want | {"o.bin", "x.txt"}  # of an item in the trash, and of one without metadata
    assert sorted(map(repr, by_path)) == sorted(map(repr, by_pattern))


def test_pages_of_a_reader():
    pages = [[("One", 700, False), (" line", 699, False), ("Two", 680, True), ("Three", 680, False)], [("x", None, False), ("y", 3, False), ("z", 9, False)]]
    assert x.join_pages(pages, 1000) == "One line\nTwo\nThree\nx" "y\nz" and x.join_pages(pages, 5) == "One line\nTwo\nThree" and x.join_pages([], 5) == ""
    assert x.extract(b"%PDF", "pdf", readers={"pdf": lambda data: pages}) == ("One line\nTwo\nThree\nxy\nz", "pdf", "")
    broken = x.extract(b"%PDF", "pdf", readers={"pdf": lambda data: 1 / 0})
    assert broken.text == "" and broken.method == "pdf" and "解析失败" in broken.warning


def test_follow_a_stream(spark, tmp_path):
    from foliant.streaming.index_stream import follow

    store = IndexStore(spark, f"file://{tmp_path}/index")
    rows = spark.createDataFrame([("a", "one", 1, "alpha text"), ("b", "two", 1, "beta")], "id string, name string, mtime long, content string")
    source = f"file://{tmp_path}/in"
    for frame in (rows, spark.createDataFrame([("a", "one", 2, "gamma")], rows.schema)):
        frame.coalesce(1).write.mode("append").parquet(source)
        query = follow(spark, source, rows.schema, store, f"file://{tmp_path}/checkpoint", once=True)
        query.awaitTermination()
    index, _ = store.load()
    assert {r.content for r in index.texts.collect()} == {"gamma", "beta"} and index.docs.count() == 2


def test_settings_files(tmp_path):
    path = str(tmp_path / "s" / "settings.json")
    assert load_settings(path) == {}
    save_settings(path, {"profile": "long", "名": 1})
    assert load_settings(path) == {"profile": "long", "名": 1}
    (tmp_path / "s" / "settings.json").write_text("{")
    assert load_settings(path) == {}
