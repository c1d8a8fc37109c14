from foliant.operators.query import Filters, parse_query
from foliant.operators.search import explain_empty


def test_words_and_phrases():
    q = parse_query(' deep  "Exact Phrase" 神经网络 ')
    assert q.raw == 'deep  "Exact Phrase" 神经网络'
    assert q.terms[:3] == ["exact", "phrase", "deep"] and "神经" in q.terms and "网" in q.terms
    assert q.literals == ["exact phrase", "神经网络"] and q.surfaces == ["Exact Phrase", "deep", "神经网络"]


def test_filters():
    q = parse_query("ext:.PDF type:Word type:zzz TAG:a folder:b star:>=4 star:3 size:9 star:x")
    assert q.filters == Filters(["pdf", "zzz"], ["word"], ["a"], ["b"], 3) and q.terms == []


def test_negatives():
    q = parse_query("a1 -文稿 -word -")
    assert q.terms == ["a1"] and q.neg_terms == ["文", "稿", "文稿", "word"] and q.neg_literals == ["文稿"] and q.neg_surfaces == ["文稿"]
    assert q.surfaces == ["a1", "-"]


def test_han_literals():
    assert parse_query("かな").literals == parse_query("字").literals == parse_query("中文ab").literals == []
    assert parse_query("一" * 13).literals == [] and parse_query("一" * 12).literals == ["一" * 12]


def test_quirk_minus_before_phrase_requires_it():
    q = parse_query('-"some phrase"')
    assert q.terms == ["some", "phrase"] and q.literals == ["some phrase"] and q.neg_terms == [] and q.surfaces == ["some phrase", "-"]


def test_quirk_minus_before_filter_is_ignored():
    assert parse_query("-ext:pdf").filters.exts == ["pdf"]


def test_quirk_quoted_filter_value():
    q = parse_query('tag:"two words"')
    assert q.filters.tags == [] and q.terms == ["two", "words", "tag"]


def test_quirk_stars():
    assert parse_query("star:<3").filters.star_min == 0 == parse_query("star:5 star:<=2").filters.star_min
    assert parse_query("star:=2").filters.star_min == parse_query("star:>2").filters.star_min == 2


def test_quirk_no_wildcard():
    assert parse_query("term*").terms == ["term"]


def test_blank():
    for text in (None, "", "  "):
        q = parse_query(text)
        assert q.terms == [] and not q.filters


def test_merge():
    a = Filters(["pdf"], [], ["x"], [], 2).merged(Filters(["pdf", "doc"], ["word"], [], ["f"], 1))
    assert a == Filters(["pdf", "doc"], ["word"], ["x"], ["f"], 2) and Filters().merged(None) == Filters()


def test_empty_results_are_explained():
    f = Filters(exts=["pdf"])
    assert explain_empty(0, True, 3, f) == "phrase" and explain_empty(0, False, 3, f) == "filter"
    assert explain_empty(0, True, 0, Filters()) == explain_empty(2, True, 3, f) == ""
