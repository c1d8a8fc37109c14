from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from foliant.config import Settings, group_of
from foliant.functions import text as fn
from foliant.functions.tokenizer import query_terms, term_array, tokenize
from foliant.operators.snippet import find_ranges, make_snippet, ranges_of, snippet_of
from foliant.sources.extract import html_text, tidy


def one(spark, column, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).coalesce(1).select(column).collect()]


@pytest.mark.parametrize(
    "text, terms",
    [
        ("", {}), (None, {}), ("scRNA-seq IL-1β 3.5 a/b", {"scrna-seq": 1, "il-1β": 1, "3.5": 1, "a/b": 1}),
        ("a--b bc--de -fg- h'", {"bc": 1, "de": 1, "fg": 1}), ("深度学", {"深": 1, "度": 1, "学": 1, "深度": 1, "度学": 1}),
        ("我的鼠", {"鼠": 1, "我的": 1, "的鼠": 1}), ("鼠", {"鼠": 1}), ("7 x 77", {"7": 1, "77": 1}), ("ＡＢ ab", {"ab": 2}),
        ("the constructor of it", {"constructor": 1}), ("привет", {}), ("かな", {"か": 1, "な": 1, "かな": 1}), ("term*", {"term": 1}),
    ],
)
def test_tokenize(text, terms):
    assert tokenize(text) == terms


ALPHABET = "aB1 -_./+'的中文字éΣβ\n。ＡКな😀𠀀"


def test_column_equals_twin(spark):
    @settings(max_examples=25, deadline=None)
    @given(st.lists(st.text(alphabet=ALPHABET, max_size=25), min_size=1, max_size=20))
    def run(texts):
        got = one(spark, term_array("x"), *texts)
        assert [Counter(g) for g in got] == [tokenize(t) for t in texts]

    run()


def test_bulk_counts_equal_twin(monkeypatch):
    import pyarrow as pa

    from foliant.functions import termcount

    monkeypatch.setattr(termcount, "SLICE_BYTES", 40)
    monkeypatch.setattr(termcount, "SLICE_ROWS", 7)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.tuples(st.one_of(st.none(), st.text(alphabet=ALPHABET, max_size=25)), st.text(alphabet=ALPHABET, max_size=12)), max_size=20))
    def run(rows):
        want = {}
        for k, row in enumerate(rows):
            for bit, text in zip((1, 16), row):
                for term, tf in tokenize(text).items():
                    mask, n = want.get((k, term), (0, 0))
                    want[k, term] = (mask | bit, n + tf)
        got, count = {}, 0
        columns = [pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)]
        for row, base, term, mask, tf in termcount.count_terms(columns, [1, 16]):
            count += len(row)
            got |= {(int(r) + base, t): (int(m), int(f)) for r, t, m, f in zip(row, term.to_pylist(), mask, tf)}
        assert got == want and count == len(got)

    run()


def test_very_long_runs(spark):
    texts = ["a-" * 30_000 + "a", "字" * 20_000, "x" * 100_000, None]
    assert [Counter(g) for g in one(spark, term_array("x"), *texts)] == [tokenize(t) for t in texts]


def test_query_terms_in_order():
    assert query_terms("b2 a1 b2 c3") == ["b2", "a1", "c3"]


def test_clean_and_strip_twins(spark):
    texts = ["a\0b\x07 � \t\xa0 c \n d\n\n\n\n e ", "﻿ x　", "", None, "a\n \nb"]
    assert one(spark, fn.clean_text("x"), *texts) == [None if t is None else tidy(t) for t in texts]
    pages = [
        "<html><script>x<y</script><P>a&amp;lt;b<br />c</p><td>1</TD><li class=x>q</li>&#65;&#x4e2d;&#0;&copy;&NBSP;z<!-- n --><?p ?></html>",
        "<STYLE>p{}</style>t<b>u</b>", "&lt;b&gt; &#55296; &#9999999;", "no markup", "",
    ]
    assert one(spark, fn.strip_markup("x"), *pages) == [html_text(p) for p in pages]
    assert html_text(pages[0]) == " a&lt;b\nc\n1\t\n· q\nA中&copy; z  "


def test_formats(spark):
    sizes = one(spark, fn.format_bytes("x"), 0, None, 5, 1023, 1024, 1536, 102400, 121344, 1 << 20, 5 << 30, 5 << 40, schema="x long")
    assert sizes == ["0 B", "0 B", "5 B", "1023 B", "1.0 KB", "1.5 KB", "100 KB", "119 KB", "1.0 MB", "5.0 GB", "5120 GB"]
    now = 1_700_000_000_000
    shown = one(spark, fn.format_time("x", now), 0, None, now - 59_999, now - 60_000, now - 3_600_000, now - 86_400_000, now - 30 * 86_400_000, schema="x long")
    assert shown == ["", "", "刚刚", "1 分钟前", "1 小时前", "1 天前", "2023-10-15"]
    frame = spark.createDataFrame([(1, 8), (5, 1000), (1, 0), (1, None)], "a long, b long")
    assert [r[0] for r in frame.select(fn.percent("a", "b")).collect()] == ["13%", "1%", "0%", "0%"]
    assert one(spark, fn.format_count("x"), 1234567, None, schema="x long") == ["1,234,567", "0"]
    assert one(spark, fn.escape_html("x"), "<a b=\"c\">&'", None) == ["&lt;a b=&quot;c&quot;&gt;&amp;&#39;", ""]
    assert one(spark, fn.group_of_ext("x"), "PDF", "doc", "zzz", "", None) == ["pdf", "word", "other", "other", "other"]
    assert group_of("R") == "text" and group_of(None) == "other"
    line = spark.range(1).select(fn.method_line(F.array(F.struct(F.lit("pdf").alias("method"), F.lit(3).alias("n")), F.struct(F.lit("zz").alias("method"), F.lit(1).alias("n")))))
    assert line.first()[0] == "PDF 3 · zz 1"
    assert one(spark, fn.file_url("x"), "/a b/中#?.txt") == ["file:///a%20b/%E4%B8%AD%23%3F.txt"]
    assert spark.range(1).select(fn.thumbnail_urls("/lib", F.lit("ID"), F.lit("x.y.pdf"))).first()[0] == ["file:///lib/images/ID.info/x.y_thumbnail.png", "file:///lib/images/ID.info/x.y_thumbnail.jpg"]


def test_settings():
    s = Settings()
    assert s.signature() == "1000000|209715200|0"
    assert s.with_profile("long").signature() == "20000000|268435456|0"
    assert s.with_profile("none such") == s


def test_ranges():
    assert find_ranges("aaa", ["aa"]) == [(0, 3)]
    assert find_ranges("abcab", ["ab", "c"]) == [(0, 5)]
    assert find_ranges("ＡＢ x ab", ["ab"]) == [(0, 2), (5, 7)]
    assert find_ranges("ﬁne", ["f", "i"]) == [(0, 1)]
    assert find_ranges(None, ["a"]) == find_ranges("x", []) == find_ranges("x", [""]) == []


def test_snippets():
    text = "x" * 50 + "hit" + "y" * 300 + "hit hit" + "z" * 300
    s = make_snippet(text, ["hit"], 100)
    assert s.text.count("hit") == 2 and s.truncated_head and s.truncated_tail and [s.text[a:b] for a, b in s.ranges] == ["hit", "hit"]
    assert make_snippet("abc", ["q"], 2) == ("ab", [], False, True)
    assert make_snippet(None, ["q"], 2) == ("", [], False, False)
    first = make_snippet("hit" + "." * 500 + "hit", ["hit"], 100)
    assert not first.truncated_head and first.truncated_tail
    assert make_snippet("." * 500 + "hit", ["hit"], 100).text.endswith("hit")


def test_snippet_columns(spark):
    texts = ["a hit b", "", None, "x" * 300]
    assert [r and r.text for r in one(spark, snippet_of(F.col("x"), ["hit"]), *texts)] == ["a hit b", None, None, "x" * 260]
    html = one(spark, fn.highlight_html("x", ranges_of(F.col("x"), ["hit", "<"]), "m"), "a<hit>b", "none", "", None)
    assert html == [fn.highlight("a<hit>b", [(1, 5)], "m"), "none", "", ""] and html[0] == 'a<mark class="m">&lt;hit</mark>&gt;b'
    assert fn.highlight("abcd", [(0, 2), (1, 3)], "") == '<mark class="">ab</mark>cd'


def test_numeric_entities_equal_twin(spark):
    samples = ["&#65;&#x42;&#X43;", "&#38;#66; &#x26;#67;", "&#0;&#xD800;&#x110000;&#1114111;", "&#99999999999999999999999999999999999999999999;&#xFFFFFFFFFFFFFFFFFFFFFFFF;", "&#128512;&#x1F600;", "&#65", "&#38;&#38;lt;", None, "", "no entity", "&#65;&#65;&#066;"]
    got = one(spark, fn.numeric_entities(F.col("x")), *samples)
    assert got == [None if s is None else fn._numeric(s) for s in samples]


def test_staged_tables_go_with_their_block(spark, tmp_path):
    from pathlib import Path

    from foliant.plans import stage

    outer = stage.stage(spark.range(3), "kept")
    with stage.scratch():
        a, b = stage.at_once(lambda: stage.stage(spark.range(2), "a"), lambda: stage.stage(spark.range(4), "b"))
        assert (a.count(), b.count()) == (2, 4)
        paths = [Path(f.removeprefix("file://")).parent for f in a.inputFiles() + b.inputFiles()]
    assert not any(p.exists() for p in paths) and outer.count() == 3
    with pytest.raises(ZeroDivisionError):
        stage.at_once(lambda: 1, lambda: 1 / 0)
