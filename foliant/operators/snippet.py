"""Match ranges and snippets of the few hits that are shown."""

from __future__ import annotations

from bisect import bisect_left
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.config import SNIPPET_CHARS
from foliant.functions.text import fold, fold_units

RANGE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SNIPPET = T.StructType([T.StructField("text", T.StringType()), T.StructField("ranges", RANGE), T.StructField("truncated_head", T.BooleanType()), T.StructField("truncated_tail", T.BooleanType())])


class Snippet(NamedTuple):
    text: str
    ranges: list[tuple[int, int]]
    truncated_head: bool
    truncated_tail: bool


def find_ranges(text: str | None, surfaces: list[str]) -> list[tuple[int, int]]:
    """Half-open ranges of ``text`` (in code points) where any surface occurs, folded; overlapping and adjacent ones united."""
    shape, place = fold_units(text)
    found = []
    for surface in surfaces:
        needle = fold(surface)
        at = shape.find(needle) if needle else -1
        while at >= 0:
            found.append((place[at], place[at + len(needle) - 1] + 1))
            at = shape.find(needle, at + 1)
    united: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if united and start <= united[-1][1]:
            united[-1] = (united[-1][0], max(end, united[-1][1]))
        else:
            united.append((start, end))
    return united


def make_snippet(text: str | None, surfaces: list[str], size: int = SNIPPET_CHARS) -> Snippet:
    """The window of ``size`` code points with most matches, the earliest of several; the head where nothing matches."""
    text = text or ""
    ranges = find_ranges(text, surfaces)
    if not ranges:
        return Snippet(text[:size], [], False, len(text) > size)
    starts = [start for start, _ in ranges]
    latest = max(0, len(text) - size)
    windows = [min(max(0, start - int(size * 0.35)), latest) for start in starts]
    inside = lambda w: bisect_left(starts, w + size) - bisect_left(starts, w)
    begin = max(windows, key=lambda w: (inside(w), -windows.index(w)))
    end = min(len(text), begin + size)
    shown = [(s - begin, min(e, end) - begin) for s, e in ranges if begin <= s < end]
    return Snippet(text[begin:end], shown, begin > 0, end < len(text))


def ranges_of(column: Column, surfaces: list[str]) -> Column:
    """``find_ranges`` of a string column."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in find_ranges(t, surfaces)])

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, RANGE)(column)


def snippet_of(column: Column, surfaces: list[str], size: int = SNIPPET_CHARS) -> Column:
    """``make_snippet`` of a string column; null where the text is null or empty."""

    def run(texts: pd.Series) -> pd.DataFrame:
        made = [make_snippet(t, surfaces, size) for t in texts]
        return pd.DataFrame({"text": [s.text for s in made], "ranges": [[{"start": a, "end": b} for a, b in s.ranges] for s in made], "truncated_head": [s.truncated_head for s in made], "truncated_tail": [s.truncated_tail for s in made]})

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.when(column.isNotNull() & (column != ""), F.pandas_udf(run, SNIPPET)(F.coalesce(column, F.lit(""))))
