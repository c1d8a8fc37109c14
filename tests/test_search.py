import math

import pytest

from foliant.config import FIELD_LABELS, K1, MASK, WEIGHTS
from foliant.functions.tokenizer import tokenize
from foliant.operators import facets
from foliant.operators.index import build_postings, complete
from foliant.operators.query import Filters
from foliant.operators.search import Index, search

# id, name, annotation, tags, folders, url, ext, star, mtime, content, warn
ROWS = [
    (0, "deep survey", "", ["ml", "教材"], ["papers"], "", "pdf", 5, 50, "a deep network survey of networks", ""),
    (1, "网络综述", "deep note", ["ml"], ["papers"], "http://deep.example/net", "docx", 3, 70, "深度学习方法 network network", "page 12 broken"),
    (2, "survey", "", [], ["inbox"], "", "txt", 0, 70, "network only, and 度深学习", "page 7 broken"),
    (3, "other", "", ["ML notes"], [], "", "csv", 4, 10, "nothing here", ""),
    (4, "<b>deep</b> network", "", [], ["papers"], "", "xyz", 1, 90, "", "lost"),
    (5, "deep network again", "", ["教材"], ["inbox"], "", "pdf", 2, 90, "深度学习 deep network deep", ""),
]
FIELDS = "id name annotation tags folders url ext star mtime content warn".split()


@pytest.fixture(scope="module")
def index(spark):
    rows = complete(spark.createDataFrame([(f"i{r[0]}", *r[1:]) for r in ROWS], "id string, name string, annotation string, tags array<string>, folders array<string>, url string, ext string, star int, mtime long, content string, warn string"))
    rows = rows.withColumn("idx", rows.id.substr(2, 9).cast("long")).withColumn("cLen", rows.content.isNotNull().cast("long")).cache()
    return Index(rows.drop("content"), build_postings(rows), rows.select("idx", "content"))


def postings():
    out = {}
    for r in ROWS:
        row = dict(zip(FIELDS, r))
        for f, bit in MASK.items():
            text = " ".join(row[f]) if f in ("tags", "folders") else row[f]
            for term, tf in tokenize(text).items():
                mask, n = out.get((term, r[0]), (0, 0))
                out[term, r[0]] = (mask | bit, n + tf)
    return out


def weigh(terms):
    """idx -> (score, mask, matched) over any of the terms, by the formula."""
    post, out = postings(), {}
    for t in terms:
        df = sum(x == t for x, _ in post)
        for (x, i), (mask, tf) in post.items():
            if x == t:
                w = sum(WEIGHTS[f] for f in WEIGHTS if mask & MASK[f]) + (1.2 * tf / (tf + 1) if mask & MASK["content"] else 0)
                s, m, n = out.get(i, (0.0, 0, 0))
                out[i] = (s + math.log(1 + (len(ROWS) - df + 0.5) / (df + 0.5)) * w / (w + K1), m | mask, n + 1)
    return out


def ids(result):
    return [r.idx for r in result.hits.orderBy("rank").collect()]


def test_postings(index):
    assert {(r.term, r.idx): (r["mask"], r.tf) for r in index.postings.collect()} == postings()


def test_all_terms(index):
    r = search(index, "deep network")
    want = {i: v for i, v in weigh(["deep", "network"]).items() if v[2] == 2}
    hits = r.hits.collect()
    assert {h.idx for h in hits} == set(want)
    for h in hits:
        boost = 1.8 if "deep network" in ROWS[h.idx][1] else 1
        assert math.isclose(h.score, want[h.idx][0] * boost, abs_tol=1e-9) and h["mask"] == want[h.idx][1] and not h.partial
        assert h.fields == [label for f, label in FIELD_LABELS.items() if h["mask"] & MASK[f]]
    s = r.summary.first()
    assert (s["mode"], s.total, s.candidates, s.partials) == ("and", len(want), len(want), 0)


def test_any_term_after_failure(index):
    r = search(index, "deep nothing survey")
    want = weigh(["deep", "nothing", "survey"])
    hits = {h.idx: h for h in r.hits.collect()}
    assert set(hits) == set(want) and all(h.partial for h in hits.values())
    for i, h in hits.items():
        assert math.isclose(h.score, want[i][0] * (0.35 + 0.65 * want[i][2] / 3), abs_tol=1e-9)
    assert r.summary.first().mode == "or"


def test_unknown_term_lowers_the_denominator(index):
    hits = {h.idx: h.partial for h in search(index, "deep network unknownterm").hits.collect()}
    both = {i for i, v in weigh(["deep", "network"]).items() if v[2] == 2}
    assert all(partial == (i not in both) for i, partial in hits.items())
    assert ids(search(index, "unknownterm")) == []


def test_filters_do_not_change_the_mode(index):
    r = search(index, "deep network ext:csv")
    assert ids(r) == [] and r.summary.first().mode == "and"


@pytest.mark.parametrize(
    "query, found",
    [
        ("deep -again", {0, 1, 4}), ("deep -network", set()), ("deep ext:pdf", {0, 5}), ("deep type:word", {1}), ("deep type:xyz", {4}), ("deep tag:ML", {0, 1}),
        ("deep tag:ml tag:教", {0}), ("deep folder:PAP", {0, 1, 4}), ("deep star:>=3", {0, 1}), ("deep star:<3", {0, 1, 4, 5}), ("deep type:other", set()),
        ("深度学习", {1, 5}), ('"deep network"', {0, 5}), ('"network survey"', {0}), ('"no such words"', set()), ("network -学习", {0, 4}), ("survey -度深", {0}), ('deep "deep note"', {1}),
    ],
)
def test_which_documents(index, query, found):
    assert set(ids(search(index, query))) == found


def test_literal_must_be_verbatim(index):
    s = search(index, "深度学习").summary.first()
    assert s.total == 2 and s.candidates >= 2
    assert ids(search(index, "教材")) == []  # only in tags


def test_orders(index):
    assert ids(search(index, "deep", sort="mtime")) == [4, 5, 1, 0]
    assert ids(search(index, "deep", sort="name_binary")) == [4, 5, 0, 1]
    assert set(ids(search(index, "deep", sort="name"))) == {0, 1, 4, 5}
    assert ids(search(index, "")) == [4, 5, 1, 2, 0, 3]
    assert ids(search(index, "-deep the type:pdf", sort="name_binary")) == [5, 0]
    assert ids(search(index, "", limit=2)) == [4, 5]
    assert search(index, "", limit=2).summary.first().total == 6


def test_phrase_score_is_raised_for_display_only(index):
    plain = {h.idx: h.score for h in search(index, "deep network").hits.collect()}
    phrase = {h.idx: h.score for h in search(index, '"deep network"').hits.collect()}
    assert math.isclose(phrase[0], plain[0] * 1.25, abs_tol=1e-8)


def test_extra_filters(index):
    assert set(ids(search(index, "deep", Filters(groups=["pdf"], star_min=3)))) == {0}


def test_snippets(index):
    hit = {h.idx: h for h in search(index, "deep network").hits.collect()}
    assert [hit[0].snip.text[r.start : r.end] for r in hit[0].snip.ranges] == ["deep", "network", "network"]
    assert hit[4].snip is None and [(r.start, r.end) for r in hit[4].name_ranges] == [(3, 7), (12, 19)]
    assert hit[1].group == "word"


def test_facets(index):
    assert [tuple(r) for r in facets.top_values(index.docs, "tags", 2).collect()] == [("ml", 2), ("教材", 2)]
    assert {r.group: r.n for r in facets.by_group(index.docs).collect()} == {"pdf": 2, "word": 1, "text": 1, "excel": 1, "other": 1}
    assert {r.method: r.n for r in facets.by_method(index.docs).collect()} == {"skip": 6}
    warned = [tuple(r) for r in facets.grouped_warnings(index.docs).collect()]
    assert warned == [("lost", 1, "lost", "<b>deep</b> network.xyz"), ("page N broken", 2, "page 12 broken", "网络综述.docx")]
    empty = Index(index.docs.limit(0), index.postings.limit(0), index.texts.limit(0))
    assert facets.overview(empty.docs, empty.postings).first().coverage == "0%"
    assert ids(search(empty, "deep")) == [] and ids(search(empty, "")) == []
