"""One consistent writing for texts that look the same.

Arrow text is copied to code-point arrays. Lookup tables give each character its
expansion: nothing for characters without a mark, the common width, the decomposed form,
the plain space or hyphen, the Latin letter of the same shape. Expansion offsets place
the results; marks are put into canonical order and composed with their letters by array
operations over all rows at once.
"""

from __future__ import annotations

from functools import lru_cache
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.textbuf import MAX_CP, byte_view, code_points, row_slices, rows_to_strings
from foliant.plans.skew import salted_join, salted_lookup
from foliant.plans.stage import stage

SLICE_BYTES = 4_000_000

# Characters that leave no mark (the default-ignorable code points), as first-last
NO_MARK = """00AD 034F 061C 115F-1160 17B4-17B5 180B-180F 200B-200F 202A-202E 2060-206F 3164 FE00-FE0F FEFF FFA0
FFF0-FFF8 1BCA0-1BCA3 1D173-1D17A E0000-E0FFF 0000-0008 000E-001F 007F-0084 0086-009F"""
# Hyphens that look like the plain one
HYPHENS = "2010 2011 FE63 FF0D"
# Letters of other scripts, each followed by the Latin letter of the same shape
SAME_SHAPE = """
АA ВB СC ЕE ԌG НH ІI ЈJ КK МM ОO РP ԚQ ЅS ТT ԜW ХX ҮY
аa сc ԁd еe һh іi јj ӏl оo рp ԛq ѕs ѵv ԝw хx уy
ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ οo νv ϲc ϳj
ՕO օo սu հh ոn ցg զq
µμ
"""


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Expansion table (begin, count, flat), combining classes, and compositions as sorted pairs."""
    single: dict[int, int] = {}
    for pair in SAME_SHAPE.split():
        single[ord(pair[0])] = ord(pair[1])
    for h in HYPHENS.split():
        single[int(h, 16)] = 0x2D
    gone: set[int] = set()
    for part in NO_MARK.split():
        lo, _, hi = part.partition("-")
        gone.update(range(int(lo, 16), int(hi or lo, 16) + 1))
    special: dict[int, list[int]] = {cp: [] for cp in gone}
    ccc = np.zeros(MAX_CP, np.uint8)
    pairs: list[tuple[int, int, int]] = []

    def last(cp: int) -> list[int]:
        """Of a fully decomposed character."""
        if cp in gone:
            return []
        return [single.get(cp, cp)]

    for cp in range(MAX_CP):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if kind[0] == "M":
            ccc[cp] = unicodedata.combining(c)
        if cp in gone:
            continue
        if kind == "Zs" and cp != 0x1680:
            special[cp] = [0x20]
            continue
        how = unicodedata.decomposition(c)
        if 0xAC00 <= cp <= 0xD7A3:
            continue
        wide = c
        if how.startswith(("<wide>", "<narrow>")) or (how.startswith("<compat>") and 0x2E80 <= cp <= 0x2FDF):
            wide = chr(int(how.split()[1], 16))
        elif how and how[0] != "<" and " " in how and unicodedata.normalize("NFC", c) == c:
            a, b = (int(x, 16) for x in how.split())
            pairs.append((a, b, cp))
        out = [y for x in unicodedata.normalize("NFD", wide) for y in last(ord(x))]
        if out != [cp]:
            special[cp] = out
    known = {(a, b): cp for a, b, cp in pairs}
    keys = np.array([a << 21 | b for a, b in known], np.int64)
    order = np.argsort(keys)
    begin, count = np.zeros(MAX_CP, np.int32), np.ones(MAX_CP, np.int8)
    flat: list[int] = []
    for cp, out in special.items():
        begin[cp], count[cp] = len(flat), len(out)
        flat.extend(out)
    changed = np.zeros(MAX_CP, bool)
    changed[list(special)] = True
    return {"begin": begin, "count": count, "flat": np.array(flat, np.uint32), "changed": changed, "ccc": ccc, "keys": keys[order], "values": np.array(list(known.values()), np.uint32)[order]}


def _expand(cps: np.ndarray, bounds: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    counts = t["count"][cps].astype(np.int64)
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(counts, out=ends[1:])
    out = np.repeat(cps, counts)
    special = t["changed"][cps]
    where = np.repeat(special, counts)
    source = np.repeat(t["begin"][cps] - ends[:-1], counts) + np.arange(ends[-1])
    out[where] = t["flat"][source[where]]
    return out, ends[bounds]


def _order_marks(cps: np.ndarray, ccc: np.ndarray, row_first: np.ndarray) -> np.ndarray:
    late = np.flatnonzero((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & ~row_first[1 : len(cps)]) + 1
    if not len(late):
        return cps
    cluster = np.cumsum((ccc == 0) | row_first[: len(cps)])
    touched = np.isin(cluster, cluster[late])
    at = np.flatnonzero(touched)
    order = np.lexsort((np.where(ccc[at] == 0, -1, ccc[at].astype(np.int16)), cluster[at]))
    cps = cps.copy()
    cps[at] = cps[at][order]
    return cps


def _composed(left: np.ndarray, right: np.ndarray, t: dict) -> np.ndarray:
    """The composition of each pair, 0 where there is none; Hangul by its rule."""
    key = left.astype(np.int64) << 21 | right
    at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
    out = np.where(t["keys"][at] == key, t["values"][at], 0).astype(np.uint32)
    a, b = left.astype(np.int64), right.astype(np.int64)
    lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
    out = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, out)
    lvt = (a >= 0xAC00) & (a <= 0xD7A3) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
    return np.where(lvt, a + b - 0x11A7, out).astype(np.uint32)


def _compose(cps: np.ndarray, bounds: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    row_first = np.zeros(len(cps) + 1, bool)
    row_first[bounds] = True
    cps = _order_marks(cps, t["ccc"][cps], row_first)
    while len(cps) > 1:
        ccc = t["ccc"][cps]
        k = np.arange(len(cps))
        starter = np.maximum.accumulate(np.where((ccc == 0) | row_first[: len(cps)], k, 0))
        # the starter before each character; a character that is itself a starter pairs with the one right before it
        before = np.where(ccc == 0, k - 1, starter)
        ok = (k > 0) & ~row_first[: len(cps)] & (before >= 0)
        ok &= (before == k - 1) | (np.r_[0, ccc[:-1]] < ccc)
        at = np.flatnonzero(ok)
        at = at[ccc[before[at]] == 0]
        new = _composed(cps[before[at]], cps[at], t)
        hit = new > 0
        at, new = at[hit], new[hit]
        if not len(at):
            break
        base, first = np.unique(before[at], return_index=True)
        at, new = at[first], new[first]
        # a character that is swallowed here can't be a base in the same round
        free = ~np.isin(base, at)
        base, at, new = base[free], at[free], new[free]
        cps = cps.copy()
        cps[base] = new
        keep = np.ones(len(cps), bool)
        keep[at] = False
        moved = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(keep, out=moved[1:])
        cps, bounds = cps[keep], moved[bounds]
        row_first = np.zeros(len(cps) + 1, bool)
        row_first[bounds] = True
    return cps, bounds


def visual_array(column: pa.Array) -> pa.Array:
    """The consistent writing of each text of an Arrow array; nulls stay null."""
    t = tables()
    raw, offsets = byte_view(column)
    valid = np.asarray(column.is_valid())
    out = []
    for lo, hi in row_slices(np.diff(offsets), SLICE_BYTES):
        cps, bounds = code_points(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        cps, bounds = _compose(*_expand(cps, bounds, t), t)
        out.append(rows_to_strings(cps, bounds, valid[lo:hi]))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def visual_form(column: Column | str) -> Column:
    """The consistent writing of a string column: texts that look the same become equal.

    Characters without a mark go; width, kinds of space and hyphen, the coding of accents
    and ideographs, and the script of letters of the same shape are made one. Case,
    accents, and all other letters and punctuation stay. Null stays null, an empty text
    empty; a text of characters without a mark only becomes empty.
    """

    def run(texts: pa.Array) -> pa.Array:
        return visual_array(texts)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(column)


def same_look_pairs(texts: DataFrame) -> DataFrame:
    """(field, a, b), a < b: ids of (field, id, text) rows whose non-empty texts look the same but are stored differently.

    Pairs are formed between the different writings of one look and only then carried to
    the ids that hold them, so equal texts are never paired, however many rows hold one; a
    look or a text that many rows hold is joined with salted keys. Rows with a null id or
    text are left out, repeated rows count once.
    """
    rows = stage(texts.filter(F.col("id").isNotNull() & (F.col("text") != "")).select("field", "id", "text").distinct(), "texts")
    looks = stage(rows.select("text").distinct().withColumn("look", visual_form("text")), "looks")
    several = looks.groupBy("look").agg(F.min("text").alias("lo"), F.max("text").alias("hi"), F.count("*").alias("weight")).filter(F.col("lo") != F.col("hi")).select("look", "weight")
    looks = stage(salted_lookup(looks, several, ["look"], "weight", spread=["text"]).drop("weight"), "several")
    x, y = looks.select("look", F.col("text").alias("x")), looks.select("look", F.col("text").alias("y"))
    writings = salted_join(x, y, ["look"], ["x"]).filter(F.col("x") < F.col("y")).select("x", "y")
    held = stage(rows.join(looks.select("text"), "text", "left_semi"), "held")
    left = held.select("field", F.col("id").alias("i"), F.col("text").alias("x"))
    right = held.select("field", F.col("id").alias("j"), F.col("text").alias("y"))
    met = salted_join(salted_join(left, writings, ["x"], ["i"]), right, ["field", "y"], ["i"]).filter(F.col("i") != F.col("j"))
    return met.select("field", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def same_look_classes(texts: DataFrame) -> DataFrame:
    """(field, id, class_id, links): the smallest id whose text of the field looks the same, and how many ids' texts look the same but are stored differently.

    One row for each (field, id) with a non-empty text, so the size of a class costs
    nothing; ``id`` must have one text in a field. Only counts are shuffled by look.
    """
    rows = stage(texts.filter(F.col("id").isNotNull() & (F.col("text") != "")).select("field", "id", "text").distinct().withColumn("look", visual_form("text")), "looks")
    writings = rows.groupBy("field", "look", "text").agg(F.count("*").alias("same"), F.min("id").alias("least"))
    classes = writings.groupBy("field", "look").agg(F.sum("same").alias("all"), F.min("least").alias("class_id"))
    counted = salted_lookup(writings.drop("least"), classes, ["field", "look"], "all", spread=["text"])
    met = salted_lookup(rows, counted.drop("look"), ["field", "text"], "same", spread=["id"])
    return met.select("field", "id", "class_id", (F.col("all") - F.col("same")).alias("links"))


def same_look_values(values: DataFrame, listed: DataFrame) -> DataFrame:
    """(id, value): pairs of an id of ``values`` (id, text) and a value of ``listed`` (value) that looks like its text but is stored differently."""
    rows = stage(values.filter(F.col("id").isNotNull() & (F.col("text") != "")).select("id", "text").distinct(), "values")
    looks = rows.select("text").distinct().withColumn("look", visual_form("text"))
    known = listed.filter(F.col("value") != "").select("value").distinct().withColumn("look", visual_form("value"))
    met = stage(looks.join(known, "look").filter(F.col("text") != F.col("value")).select("text", "value"), "met")
    return salted_join(rows, met, ["text"], ["id"]).select("id", "value").distinct()
