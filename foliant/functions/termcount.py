"""Terms and their counts of whole documents, by array operations over Arrow batches.

The same terms as the column expression and the Python twin give, but counted per document
where the text is read: runs, characters and pairs of characters are found on code-point
buffers, words by Arrow's dictionary encoding, and one sort per slice counts them all. A
document leaves a task as one row per term, so building postings needs no shuffle.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.functions.text import fold
from foliant.functions.textbuf import MAX_CP, byte_view, code_points, row_slices, rows_to_strings
from foliant.functions.tokenizer import CJK_RANGES, JOINERS, STOP_WORDS, WORD_RANGES

SLICE_BYTES = 2_000_000
SLICE_ROWS = 1 << 18
PAIR, WORD = 1 << 42, 1 << 43
CODE_BITS = 44


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Per code point: 1 CJK, 2 word, 3 joiner, 0 separator."""
    kinds = np.zeros(MAX_CP, np.uint8)
    for k, ranges in ((1, CJK_RANGES), (2, WORD_RANGES)):
        for r in ranges.split():
            lo, hi = (int(x, 16) for x in r.split("-"))
            kinds[lo : hi + 1] = k
    kinds[[ord(c) for c in JOINERS]] = 3
    return kinds


def _stop_codes() -> tuple[np.ndarray, set[bytes]]:
    return np.array([ord(w) for w in STOP_WORDS if len(w) == 1]), {w.encode() for w in STOP_WORDS}


def _slice_terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code) of every term of a slice, stop words left out, and the dictionary of its words."""
    cps, rows = code_points(raw, offsets)
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.binary())
    kind = _classes()[cps]
    first = np.zeros(n + 1, bool)
    first[rows] = True
    # a joiner between two word characters of one row belongs to the word
    word = kind == 2
    j = np.flatnonzero(kind == 3)
    j = j[(j > 0) & (j < n - 1)]
    j = j[word[j - 1] & word[j + 1] & ~first[j] & ~first[j + 1]]
    word[j] = True
    row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    stop_chars, stop_words = _stop_codes()

    cjk = np.flatnonzero(kind == 1)
    two = cjk[:-1][(cjk[1:] == cjk[:-1] + 1) & ~first[cjk[1:]]] if len(cjk) else cjk
    pairs = (cps[two].astype(np.int64) << 21 | cps[two + 1]) + PAIR if len(two) else np.zeros(0, np.int64)
    single = cjk[~np.isin(cps[cjk], stop_chars)]

    edge = np.zeros(n + 1, bool)
    edge[1:n] = word[1:] != word[:-1]
    edge |= first
    edge[0], edge[n] = True, True
    cut = np.flatnonzero(edge)
    lead = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    parts = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(lead[cut].astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
    begins = cut[:-1]
    is_word = word[begins]
    coded = parts.take(pa.array(np.flatnonzero(is_word))).dictionary_encode()
    known = coded.dictionary
    good = np.array([w not in stop_words and (len(w.decode()) > 1 or w.isdigit()) for w in known.to_pylist()], bool)
    index = coded.indices.to_numpy().astype(np.int64)
    kept = good[index] if len(index) else np.zeros(0, bool)
    code = np.concatenate([cps[single].astype(np.int64), pairs, index[kept] + WORD])
    row = np.concatenate([row_of[single], row_of[two], row_of[begins[is_word][kept]]])
    return row, code, known


def _strings(code: np.ndarray, words: pa.Array) -> pa.Array:
    """The terms that codes stand for."""
    word, pair = code >= WORD, (code >= PAIR) & (code < WORD)
    plain = ~word & ~pair
    order = np.empty(len(code), np.int64)
    at = np.concatenate([np.flatnonzero(plain), np.flatnonzero(pair), np.flatnonzero(word)])
    order[at] = np.arange(len(code))
    two = code[pair] - PAIR
    both = np.stack([two >> 21, two & 0x1FFFFF], 1).reshape(-1)
    parts = [
        rows_to_strings(code[plain].astype(np.uint32), np.arange(plain.sum() + 1)),
        rows_to_strings(both.astype(np.uint32), np.arange(pair.sum() + 1) * 2),
        words.take(pa.array(code[word] - WORD)).cast(pa.string()),
    ]
    return pa.concat_arrays(parts).take(pa.array(order))


def count_terms(columns: list[pa.Array], masks: list[int], normalise: bool = True):
    """Yields (row, first row of its slice, term, mask, tf): a row's term once, the columns it occurs in, and how often in all."""
    n = len(columns[0])
    for lo in range(0, n, SLICE_ROWS):
        parts = []
        for column in columns:
            texts = column.slice(lo, SLICE_ROWS)
            values = texts.to_pylist()
            parts.append(pa.array([fold(t) if normalise else (t or "").lower() for t in values], pa.large_string()))
        views = [byte_view(p) for p in parts]
        total = sum(np.diff(off) for _, off in views)
        for a, b in row_slices(total, SLICE_BYTES):
            raw = np.concatenate([r[off[a] : off[b]] for r, off in views])
            lengths = np.concatenate([np.diff(off[a : b + 1]) for _, off in views])
            row, code, words = _slice_terms(raw, np.r_[0, np.cumsum(lengths)])
            if not len(row):
                continue
            field, row = row // (b - a), row % (b - a)
            key = row << CODE_BITS | code
            order = np.argsort(key, kind="stable")
            key = key[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            bits = np.array(masks, np.int32)[field[order]]
            yield key[at] >> CODE_BITS, a + lo, _strings(key[at] & ((1 << CODE_BITS) - 1), words), np.bitwise_or.reduceat(bits, at), np.diff(np.r_[at, len(key)])


def term_counts(frame: DataFrame, key: str, fields: dict[str, tuple[int, object]], normalise: bool = True) -> DataFrame:
    """(term, key, mask, tf) for each row of ``frame``; ``fields`` gives each field's mask bit and text column.

    No shuffle: counts are per row, so a key that stands in several rows has several counts.
    Null and empty texts have no terms; without ``normalise`` texts are only lower-cased.
    """
    masks = [bit for bit, _ in fields.values()]

    def run(batches):
        for batch in batches:
            for row, base, term, mask, tf in count_terms(batch.columns[1:], masks, normalise):
                yield pa.RecordBatch.from_arrays([term, batch.column(0).take(pa.array(row + base)), pa.array(mask), pa.array(tf.astype(np.int64))], ["term", "key", "mask", "tf"])

    picked = frame.select(frame[key].alias("key"), *[column.alias(f"f{k}") for k, (_, column) in enumerate(fields.values())])
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"term string, key {kind}, mask int, tf long").withColumnRenamed("key", key)
