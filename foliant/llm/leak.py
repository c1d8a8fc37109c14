"""Evaluation passages inside a training corpus.

Items that stand in a text nearly whole are found by edit distance. A CGK random walk
embeds the window of an item's size: at step j the output is the character under the
pointer, and a random bit of (j, character) says whether the pointer moves on, so a window
with few edits falls back into step and small edit distances become small Hamming
distances. A key samples coordinates of the embedding; each repetition has its own random
bits and coordinates, and begins its walk at another place of the item, to the right or to
the left, so that an edit spoils few of them. Places of a text that have the key of an item
are candidates, and a banded edit distance over the whole item decides.

Items of which a text holds only parts have no item-sized window within few edits: half an
item is a leak by definition. Those are found by the shortest stretches that count, as
windows of that length looked up in an index of the items' windows and compared as text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
import math
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.textbuf import byte_view, code_points, row_slices
from foliant.llm.spans import window_hashes

SLICE_CHARS = 400_000
#: folded characters of items that are broadcast together (some 60 bytes each); more items mean more passes over the corpus
BLOCK_CHARS = 2_000_000
#: coordinates come from so many steps of a walk
STEPS = 24
#: after the second step and after this one, places that no item can match are dropped
PRUNE = 5
#: an item may have one edit for so many characters; also the least length of items that are looked for whole
CHARS_PER_EDIT = 40
#: candidates whose edit distance is computed together
TOGETHER = 4096
PAD = 32


def folding_table() -> np.ndarray:
    """Per code point its lower-case letter or digit in common width, 0 for everything else.

    Letters and digits of planes without any map to 0 by lying outside the table.
    """
    table = np.zeros(0x33480, np.uint32)
    for cp in range(len(table)):
        c = chr(cp)
        if not c.isalnum():
            continue
        kind = unicodedata.decomposition(c)
        if kind.startswith(("<wide>", "<narrow>")):
            c = chr(int(kind.split()[1], 16))
        low = c.lower()
        table[cp] = ord(low) if len(low) == 1 else ord(c)
    return table


def fold(cps: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the letters and digits of texts, folded, with new row bounds."""
    out = table[np.minimum(cps, len(table) - 1)]
    out[cps >= len(table)] = 0
    keep = out != 0
    at = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return out[keep], at[bounds]


def _random_words(values: np.ndarray, seed: int) -> np.ndarray:
    x = (values.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """A bitmap with a place for each key, of at least 64 places a key, and the shift that gives a key's place."""
    size = min(27, max(14, math.ceil(math.log2(64 * max(1, len(keys))))))
    shift = np.uint64(64 - size)
    held = np.zeros(1 << size, bool)
    held[(keys * np.uint64(0x9E3779B97F4A7C15)) >> shift] = True
    return held, shift


def _has(filter_: tuple[np.ndarray, np.uint64], keys: np.ndarray) -> np.ndarray:
    held, shift = filter_
    return held[(keys * np.uint64(0x9E3779B97F4A7C15)) >> shift]


class Lists:
    """Values by key: equal keys share one list."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.values = values[order]
        self.keys, self.begin, self.count = np.unique(keys[order], return_index=True, return_counts=True)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The list of each key, -1 where there is none."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, -1) if len(self.keys) else np.full(len(keys), -1)

    def expand(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``lists``, value) of all values of the lists."""
        count = self.count[lists]
        where = np.repeat(np.arange(len(lists)), count)
        within = np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count)
        return where, self.values[self.begin[lists][where] + within]


class Walk:
    """One repetition: the random bits, the sampled coordinates, and where in an item the walk begins."""

    def __init__(self, number: int, of: int, samples: int = 8):
        self.seed = number + 1
        self.share = number / max(1, of - 1)
        self.sign = 1 if self.share < 0.5 else -1
        rng = np.random.default_rng(self.seed)
        early = [0, 1, *rng.choice(np.arange(2, PRUNE), 2, replace=False)]
        late = rng.choice(np.arange(PRUNE, STEPS), samples - len(early), replace=False)
        self.sampled = {int(j) for j in [*early, *late]}
        self.table: np.ndarray | None = None

    def pivots(self, sizes: np.ndarray) -> np.ndarray:
        return np.floor(self.share * sizes).astype(np.int64)

    def prepare(self) -> None:
        """The random word of each character; its upper half has the bits that move the pointer."""
        if self.table is None:
            self.table = _random_words(np.arange(0x33480, dtype=np.uint64), self.seed)
            self.half = (self.table >> np.uint64(32)).astype(np.uint32)

    def second(self, padded: np.ndarray) -> np.ndarray:
        """The first two coordinates of the walks from all places of a text with ``PAD`` blanks on either side, as one number."""
        self.prepare()
        n = len(padded) - 2 * PAD + 1
        at = PAD if self.sign > 0 else PAD - 1
        half = self.half[padded[at - 1 : at + n + 1]]
        here, next_ = half[1 : n + 1], half[2 : n + 2] if self.sign > 0 else half[:n]
        after = np.where((here & np.uint32(1)).astype(bool), next_, here)
        return (here * np.uint32(0x9E3779B1) ^ after) * np.uint32(0x85EBCA77)

    def go(self, padded: np.ndarray, places: np.ndarray, begin: int, end: int, pointer: np.ndarray | None = None, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Steps ``begin`` to ``end`` of the walks from ``places``, which are boundaries between characters: (pointers into ``padded``, keys so far)."""
        self.prepare()
        if pointer is None:
            pointer = places + (PAD if self.sign > 0 else PAD - 1)
            key = np.zeros(len(places), np.uint64)
        for j in range(begin, end):
            word = self.table[padded[pointer]]
            if j in self.sampled:
                key = (key ^ word) * np.uint64(0x9FB21C651E98DF25)
                key ^= key >> np.uint64(32)
            pointer = pointer + self.sign * ((word >> np.uint64(32 + j)) & np.uint64(1)).astype(pointer.dtype)
        return pointer, key


def padded(chars: np.ndarray) -> np.ndarray:
    blank = np.zeros(PAD, np.uint32)
    return np.concatenate([blank, chars, blank])


@dataclass
class ItemBlock:
    """Some items as one folded text, with the index of their windows and the keys of each repetition."""

    ids: np.ndarray
    chars: np.ndarray
    bounds: np.ndarray
    window: int
    stretches: Lists  # hash of each window of the shortest stretch: where it begins
    stretch_filter: tuple
    walks: list[tuple[Walk, np.ndarray, tuple, Lists]]  # walk, filters after the second step and at PRUNE, key: item

    def limits(self) -> np.ndarray:
        """The edits that are allowed for each item; -1 for items too short to be looked for whole."""
        size = np.diff(self.bounds)
        return np.where(size >= CHARS_PER_EDIT, size // CHARS_PER_EDIT, -1)


def make_block(ids: list, texts: list[str], table: np.ndarray, window: int, walks: list[Walk]) -> ItemBlock:
    cps = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    bounds = np.r_[0, np.cumsum([len(c) for c in cps])].astype(np.int64)
    chars, bounds = fold(np.concatenate(cps) if cps else np.zeros(0, np.uint32), bounds, table)
    h = window_hashes(chars, window)
    item = np.searchsorted(bounds, np.arange(len(h)), side="right") - 1
    starts = np.flatnonzero(np.arange(len(h)) + window <= bounds[item + 1])
    stretches = Lists(h[starts], starts)
    whole = np.flatnonzero(np.diff(bounds) >= CHARS_PER_EDIT)
    keyed = []
    room = padded(chars)
    for walk in walks:
        places = bounds[whole] + walk.pivots(np.diff(bounds)[whole])
        pairs = np.zeros(1 << 20, bool)
        pairs[walk.second(room)[places] >> np.uint32(12)] = True
        pointer, early = walk.go(room, places, 0, PRUNE)
        _, key = walk.go(room, places, PRUNE, STEPS, pointer, early)
        keyed.append((walk, pairs, _bits(early), Lists(key, whole)))
    return ItemBlock(np.array(ids, object), chars, bounds, window, stretches, _bits(stretches.keys), keyed)


def prefix_distance(a: np.ndarray, size: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Least edit distance of each row's first ``size`` characters of ``a`` to any prefix of the same row of ``b``, ``most + 1`` where it is greater.

    Banded, all rows at once; ``b`` must be at least ``most`` columns wider than ``a``.
    """
    n, far = len(a), most + 1
    band = np.arange(-most, most + 1)
    row = np.broadcast_to(np.where(band >= 0, band, far), (n, len(band))).astype(np.int32)
    out = np.where(size == 0, 0, far).astype(np.int32)
    padded = np.concatenate([np.full((n, most), 0xFFFFFFFF, np.uint32), b], axis=1)
    for i in range(1, int(size.max(initial=0)) + 1):
        # column k of the band is the prefix of length i + band[k]
        there = padded[:, i - 1 : i - 1 + len(band)]
        new = row + (there != a[:, i - 1, None])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new[:, i + band < 0] = far
        if i <= most:
            new[:, most - i] = np.minimum(i, far)
        new = np.minimum.accumulate(new - band, axis=1) + band
        row = np.minimum(new, far)
        ended = size == i
        if ended.any():
            out[ended] = row[ended].min(axis=1)
    return out


def _gathered(chars: np.ndarray, at: np.ndarray, size: np.ndarray, width: int, sign: int, blank: int) -> np.ndarray:
    """Rows of ``width`` characters from ``at`` on, to the right or to the left, ``blank`` behind the first ``size``."""
    k = np.arange(width)
    index = at[:, None] + k if sign > 0 else at[:, None] - 1 - k
    inside = k < size[:, None]
    return np.where(inside, chars[np.where(inside, index, 0)], np.uint32(blank))


def edit_distances(chars: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: ItemBlock, item: np.ndarray, pivot: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Least edit distance of each item to a stretch of its text (``lo`` to ``hi``) that the place cuts where the pivot cuts the item; above ``most`` where it is greater."""
    limit = int(most.max())
    begin, size = block.bounds[item], np.diff(block.bounds)[item]
    sides = []
    for sign, part, room in ((1, size - pivot, hi - place), (-1, pivot, place - lo)):
        width = int(part.max())
        a = _gathered(block.chars, begin + pivot, part, width, sign, 0xFFFFFFFE)
        b = _gathered(chars, place, np.minimum(room, part + limit), width + limit, sign, 0xFFFFFFFF)
        sides.append((a, part, b, ((a == b[:, :width]) | (np.arange(width) >= part[:, None])).all(axis=1)))
    total = np.zeros(len(place), np.int32)
    far = ~(sides[0][3] & sides[1][3])
    if far.any():
        for a, part, b, _ in sides:
            total[far] += prefix_distance(a[far], part[far], b[far], limit)
    return total


def _whole(chars: np.ndarray, bounds: np.ndarray, begin: int, end: int, block: ItemBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, edits) of items that stand in texts nearly whole, looked for at the places from ``begin`` to ``end``."""
    best: dict[tuple[int, int], int] = {}
    limits, sizes = block.limits(), np.diff(block.bounds)
    base = max(0, begin - PAD)
    around = chars[base : end + PAD]
    met: list[tuple[np.ndarray, ...]] = []

    def decide() -> None:
        """Compute the edit distances of the candidates so far."""
        if not met:
            return
        place, item, pivot, row = (np.concatenate(x) for x in zip(*met))
        met.clear()
        # of each text and item one candidate first: most often it stands there unchanged, and the rest needn't be looked at
        _, first = np.unique(row * len(sizes) + item, return_index=True)
        rest = np.setdiff1d(np.arange(len(place)), first, assume_unique=True)
        for some in (first, rest):
            some = some[np.array([best.get(c, 1) > 0 for c in zip(row[some].tolist(), item[some].tolist())], bool)]
            step = max(16, (1 << 22) // max(1, int(sizes[item[some]].max(initial=1))))
            for at in range(0, len(some), step):
                x = some[at : at + step]
                d = edit_distances(chars, place[x], bounds[row[x]], bounds[row[x] + 1], block, item[x], pivot[x], limits[item[x]])
                for r, i, edits in zip(row[x].tolist(), item[x].tolist(), d.tolist()):
                    if edits <= limits[i]:
                        best[r, i] = min(edits, best.get((r, i), edits))

    held = 0
    room = padded(around)
    for walk, pairs, early, lists in block.walks:
        if not len(lists.keys):
            continue
        places = np.flatnonzero(pairs[walk.second(room)[begin - base : end - base] >> np.uint32(12)]) + (begin - base)
        pointer, key = walk.go(room, places, 0, PRUNE)
        near = np.flatnonzero(_has(early, key))
        places = places[near]
        _, key = walk.go(room, places, PRUNE, STEPS, pointer[near], key[near])
        found = lists.find(key)
        places, found = places[found >= 0] + base, found[found >= 0]
        for k in range(0, len(places), TOGETHER):  # a key's list has at most one entry for each item
            where, item = lists.expand(found[k : k + TOGETHER])
            place = places[k : k + TOGETHER][where]
            # a place between two texts belongs to the one that the walk enters
            row = np.searchsorted(bounds, place - (walk.sign < 0), side="right") - 1
            ok = (row >= 0) & (row < len(bounds) - 1)
            met.append((place[ok], item[ok], walk.pivots(sizes[item])[ok], row[ok]))
            held += int(ok.sum())
            if held >= TOGETHER:
                decide()
                held = 0
    decide()
    out = np.array([(r, i, d) for (r, i), d in best.items()], np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def _stretches(chars: np.ndarray, bounds: np.ndarray, block: ItemBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, characters of the item in stretches of the window's length or more that the text holds)."""
    window = block.window
    none = np.zeros(0, np.int64)
    if not len(block.stretches.keys):
        return none, none, none
    reach = np.arange(window)
    met: list[np.ndarray] = []
    for cut in range(0, max(0, len(chars) - window + 1), 2 * SLICE_CHARS):
        part = chars[cut : cut + 2 * SLICE_CHARS + window - 1]
        h = window_hashes(part, window)
        at = np.flatnonzero(_has(block.stretch_filter, h))
        found = block.stretches.find(h[at])
        at, found = at[found >= 0], found[found >= 0]
        row = np.searchsorted(bounds, at + cut, side="right") - 1
        whole = at + cut + window <= bounds[row + 1]
        at, found, row = at[whole], found[whole], row[whole]
        for k in range(0, len(at), SLICE_CHARS):
            p, f, r = at[k : k + SLICE_CHARS], found[k : k + SLICE_CHARS], row[k : k + SLICE_CHARS]
            # equal windows have equal text: one of each list stands for all
            same = (part[p[:, None] + reach] == block.chars[block.stretches.values[block.stretches.begin[f]][:, None] + reach]).all(axis=1)
            met.append(np.unique(r[same] * len(block.stretches.keys) + f[same]))
    code = np.unique(np.concatenate(met)) if met else none
    if not len(code):
        return none, none, none
    rows, lists = code // len(block.stretches.keys), code % len(block.stretches.keys)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # rows are taken together while their starts stay within bounds; one row has at most every window of the items
    cuts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    sizes = np.add.reduceat(block.stretches.count[lists], cuts)
    ends = np.r_[cuts, len(rows)]
    for a, b in row_slices(sizes, SLICE_CHARS):
        where, start = block.stretches.expand(lists[ends[a] : ends[b]])
        row = rows[ends[a] : ends[b]][where]
        order = np.lexsort((start, row))
        row, start = row[order], start[order]
        item = np.searchsorted(block.bounds, start, side="right") - 1
        new = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])]
        covered = np.where(new, window, np.minimum(np.r_[0, np.diff(start)], window))
        at = np.flatnonzero(new)
        out.append((row[at], item[at], np.add.reduceat(covered, at)))
    return tuple(np.concatenate(x) for x in zip(*out))


def leaks_of(column: pa.Array, block: ItemBlock, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, covered, edits) of a batch of texts; covered is 0 or edits -1 where only the other search found the item."""
    raw, offsets = byte_view(column)
    parts = []
    for lo, hi in row_slices(np.diff(offsets), 3 * SLICE_CHARS):
        cps, bounds = code_points(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        chars, bounds = fold(cps, bounds, table)
        row, item, covered = _stretches(chars, bounds, block)
        parts.append((row + lo, item, covered, np.full(len(row), -1, np.int64)))
        for begin in range(0, len(chars) + 1, 2 * SLICE_CHARS):
            row, item, edits = _whole(chars, bounds, begin, min(len(chars) + 1, begin + 2 * SLICE_CHARS), block)
            parts.append((row + lo, item, np.zeros(len(row), np.int64), edits))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4


def repetitions(recall: float = 0.95) -> int:
    """Repetitions until an item with as many edits as are allowed collides at least once with the wanted probability.

    A repetition fails if an edit falls into the stretch of about STEPS / 2 characters that
    its coordinates come from, so with one edit for CHARS_PER_EDIT characters it succeeds
    with (1 - STEPS / 2 / length) ** edits, about exp(-STEPS / 2 / CHARS_PER_EDIT).
    """
    p = math.exp(-STEPS / 2 / CHARS_PER_EDIT) * 0.75  # a quarter off for stretches that are longer
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[tuple[list, list[str]]]:
    """Items, streamed to the driver in blocks of bounded size."""
    ids, texts, size = [], [], 0
    chosen = items.select(items[key].alias("id"), items[text].alias("text")).filter(F.col("id").isNotNull() & (F.length("text") > 0)).distinct()
    for row in chosen.toLocalIterator():
        if ids and size + len(row.text) > BLOCK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.id)
        texts.append(row.text)
        size += len(row.text)
    if ids:
        yield ids, texts


def find_leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, window: int = 20, recall: float = 0.95) -> DataFrame:
    """(key, item_key, covered, item_chars, edits) of every text that holds an item nearly whole or stretches of it.

    Only letters and digits count, ignoring case and width. ``edits`` is the edit distance
    between the item and the nearest stretch of the text that was found, null where it is
    above one edit for ``CHARS_PER_EDIT`` characters or the item is shorter than that;
    ``recall`` says which share of those is wanted (a test measures it). ``covered`` is the
    number of the item's letters and digits that lie in windows of at least ``window``
    characters which also stand in the text; it is exact. Null and empty texts and items hold
    nothing; null keys take no part; a repeated row gives its result once, and an item id
    with several texts one row for each length. Items are broadcast in blocks of at most
    ``BLOCK_CHARS``; texts stay where they are read and are never cut short.
    """
    spark = corpus.sparkSession
    table = folding_table()
    n = repetitions(recall)
    walks = [Walk(k, n) for k in range(n)]
    c = corpus.select(corpus[key].alias("key"), corpus[text].alias("text")).filter(F.col("key").isNotNull() & F.col("text").isNotNull())
    kind, item_kind = c.schema["key"].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    shape = f"key {kind}, item {item_kind}, covered long, edits long, item_chars long"

    def scan(ids: list, texts: list[str]) -> DataFrame:
        shared = spark.sparkContext.broadcast((table, make_block(ids, texts, table, window, walks)))

        def run(batches):
            table, block = shared.value
            size = np.diff(block.bounds)
            for batch in batches:
                row, item, covered, edits = leaks_of(batch.column(1), block, table)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array(block.ids[item].tolist()), pa.array(covered), pa.array(edits, mask=edits < 0), pa.array(size[item])], ["key", "item", "covered", "edits", "item_chars"]
                    )

        return c.mapInArrow(run, shape)

    parts = [scan(*b) for b in _blocks(items, item_key, item_text)] or [spark.createDataFrame([], shape)]
    found = reduce(DataFrame.unionByName, parts).groupBy("key", "item", "item_chars").agg(F.max("covered").alias("covered"), F.min("edits").alias("edits"))
    return found.select(F.col("key").alias(key), F.col("item").alias(item_key), "covered", "item_chars", "edits")


def leaked(leaks: DataFrame, window: int = 20) -> DataFrame:
    """The leaks that hold at least half of their item in stretches of the window's length or more.

    An item of m characters found within d edits is in at most d + 1 verbatim pieces; as
    m >= 2 * window * d, one is long enough and the others lose at most window * d <= m / 2
    characters. So every item found nearly whole is a case, and its stretches need no count.
    """
    near = F.col("edits") * 2 * window <= F.col("item_chars")
    return leaks.filter((F.col("item_chars") > 0) & ((F.col("covered") * 2 >= F.col("item_chars")) | F.coalesce(near, F.lit(False))))
