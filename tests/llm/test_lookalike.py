import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa
import pytest

from foliant.llm import lookalike


def form(*texts):
    return lookalike.visual_array(pa.array(texts, pa.string())).to_pylist()


@pytest.mark.parametrize(
    "a, b",
    [
        ("Lot‑8", "Lot-8"), ("ＡＢ１", "AB1"), ("café", "café"), ("арс", "apc"), ("a​b﻿­", "ab"), ("a b　c", "a b c"), ("⼿", "手"), ("北", "北"), ("K", "K"),
        ("ё", "ë"), ("한", "한"), ("ｶ", "カ"), ("ế", "ế"), ("ậ", "ậ"), ("Ν", "N"), ("i︎", "i"), ("Å", "Å"),
    ],
)
def test_same_look(a, b):
    x, y = form(a, b)
    assert x == y


@pytest.mark.parametrize("a, b", [("a", "A"), ("e", "é"), ("-", "—"), ("a", "α"), ("1", "l"), ("a b", "ab"), ("．", "。"), ("²", "2"), ("ﬁ", "fi"), ("ß", "ss")])
def test_other_look(a, b):
    x, y = form(a, b)
    assert x != y


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", categories=("L", "M", "N", "P", "Z")), max_size=8), max_size=5))
def test_rule_by_rule(texts):
    """Against the rules applied character by character, with the standard library's NFC."""
    t = lookalike.tables()

    def one(s):
        out = []
        for c in s:
            cp = ord(c)
            if t["changed"][cp]:
                k, n = int(t["begin"][cp]), int(t["count"][cp])
                out += map(chr, t["flat"][k : k + n].tolist())
            else:
                out.append(c)
        return unicodedata.normalize("NFC", "".join(out))

    assert [unicodedata.normalize("NFC", x) for x in form(*texts)] == [one(s) for s in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeouAEỌ̧̀́̂̈ͅ한각 中", max_size=12))
def test_composition_is_nfc(text):
    assert form(text) == [unicodedata.normalize("NFC", text)]


def test_nulls_and_empties():
    assert form(None, "", "​", "a", None) == [None, "", "", "a", None]
    assert form() == []


def test_idempotent_on_all_characters():
    every = "".join(chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000)
    once = form(*[every[k : k + 97] for k in range(0, len(every), 97)])
    assert form(*once) == once


def test_pairs(spark):
    rows = [("name", "1", "ab"), ("name", "2", "a​b"), ("name", "3", "ab"), ("name", "3", "ab"), ("annotation", "4", "а‍b"), ("name", None, "аb"), ("name", "5", None), ("name", "6", ""), ("name", "7", "​"), ("annotation", "2", "ab")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "field string, id string, text string, look string")
    got = sorted(tuple(r) for r in lookalike.same_look_pairs(frame).collect())
    assert got == [("annotation", "2", "4"), ("name", "1", "2"), ("name", "2", "3")]
    assert lookalike.same_look_pairs(frame.limit(0)).collect() == []


def test_values(spark):
    values = spark.createDataFrame([("1", "ＰＤＦ"), ("1", "ＰＤＦ"), ("2", "PDF"), ("3", "pdf"), ("4", None)], "id string, text string")
    listed = spark.createDataFrame([("PDF",), ("PDF",), (None,)], "value string")
    assert [tuple(r) for r in lookalike.same_look_values(values, listed).collect()] == [("1", "PDF")]


def test_classes_count_the_pairs(spark):
    rows = [("name", "1", "ab"), ("name", "2", "a\u200bb"), ("name", "3", "ab"), ("name", "4", "x"), ("annotation", "4", "\u0430b"), ("annotation", "2", "ab"), ("name", "5", None), ("name", "6", ""), ("name", None, "ab"), ("name", "4", "x")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "field string, id string, text string, links int")
    got = {(r.field, r.id): (r.class_id, r.links) for r in lookalike.same_look_classes(frame).collect()}
    assert got == {("name", "1"): ("1", 1), ("name", "2"): ("1", 2), ("name", "3"): ("1", 1), ("name", "4"): ("4", 0), ("annotation", "4"): ("2", 1), ("annotation", "2"): ("2", 1)}
    pairs = lookalike.same_look_pairs(frame).collect()
    assert sum(n for _, n in got.values()) == 2 * len(pairs)
    assert lookalike.same_look_classes(frame.limit(0)).collect() == []
