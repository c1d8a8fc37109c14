"""Byte-level BPE encoding of a whole corpus.

Pre-tokens are cut with array operations over code-point buffers, distinct
pre-tokens are found by Arrow's dictionary encoding, and only pre-tokens that a
worker hasn't met yet are merged. Merging uses one rank queue for all pending
pre-tokens together: a bucket of linked-list positions per merge rank, and a
hierarchical bitmap whose find-first-set gives the next rank. All positions of a
rank are merged at once; entries whose pair has changed meanwhile are stale and
skipped. Cost depends on the number of bytes and of ranks in use, not on the
square of the longest pre-token.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.functions.textbuf import byte_view, char_classes, code_points, row_slices

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: code points handled in one piece by a worker; bounds its memory
SLICE_CHARS = 1_000_000
#: bytes of words that a worker remembers, with what goes with them, before it starts afresh; bounds its memory, not the result
CACHE_BYTES = 200_000_000
#: about what a word takes besides its bytes and ids
WORD_BYTES = 150


class RankBitmap:
    """A set of ranks with find-first-set over 64-way words in levels."""

    def __init__(self, size: int):
        self.levels = []
        while True:
            size = (size + 63) >> 6
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, rank: int) -> None:
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            if level[word] & bit:
                return
            level[word] |= bit
            rank = word

    def discard(self, rank: int) -> None:
        for level in self.levels:
            word = rank >> 6
            level[word] &= ~(1 << (rank & 63))
            if level[word]:
                return
            rank = word

    def first(self) -> int:
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return -1
            at = (at << 6) + (word & -word).bit_length() - 1
        return at


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies, inverted.

    Printable Latin-1 bytes stand for themselves; the others follow from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        table[chr(0x100 + k)] = b
    return table


class BytePairEncoder:
    """Encodes batches of distinct byte strings with the merges of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = np.zeros(256, np.int32)
        for char, byte in printable_bytes().items():
            self.byte_ids[byte] = vocab[char]
        self.width = max(vocab.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank = keys[order], order.astype(np.int32)
        if not len(keys):
            self.keys, self.key_rank = np.array([-1]), np.array([-1], np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where there is none; a symbol of -1 pairs with nothing."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.key_rank[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids per word)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        # position n is a sentinel with the symbol -1
        sym = np.empty(n + 1, np.int32)
        sym[:n], sym[n] = self.byte_ids[data], -1
        nxt = np.arange(1, n + 2, dtype=np.int32)
        prv = np.arange(-1, n, dtype=np.int32)
        some = lengths > 0
        nxt[ends[some] - 1], prv[begins[some]] = n, n
        nxt[n] = prv[n] = n

        buckets: dict[int, list[np.ndarray]] = {}
        queue = RankBitmap(len(self.merged) or 1)

        def push(at: np.ndarray) -> None:
            rank = self.ranks(sym[at], sym[nxt[at]])
            keep = rank >= 0
            rank, at = rank[keep], at[keep]
            if not len(at):
                return
            if len(at) > 1:
                order = np.argsort(rank, kind="stable")
                rank, at = rank[order], at[order]
                cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
            else:
                cuts = [0, 1]
            for lo, hi, r in zip(cuts, cuts[1:], rank[cuts[:-1]].tolist()):
                if r in buckets:
                    buckets[r].append(at[lo:hi])
                else:
                    buckets[r] = [at[lo:hi]]
                    queue.add(r)

        push(np.arange(n, dtype=np.int32))
        while (r := queue.first()) >= 0:
            queue.discard(r)
            parts = buckets.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (sym[nxt[at]] == b)]
            if not len(at):
                continue
            if len(parts) > 1 or a == b:
                at = np.unique(at)
            if a == b and len(at) > 1:
                # of overlapping pairs the leftmost goes first: every second one of a chain
                fresh = np.r_[True, at[1:] != nxt[at[:-1]]]
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(fresh, k, 0))) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = self.merged[r], -1
            nxt[at] = after
            prv[after] = at
            before = prv[at]
            before = before[before < n]
            push(np.concatenate([before, at[after < n]]))
        alive = sym[:n] >= 0
        count = np.zeros(n + 1, np.int64)
        np.cumsum(alive, out=count[1:])
        return sym[:n][alive], count[ends] - count[begins]


def pretoken_starts(cps: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Code-point positions at which a pre-token begins.

    The cut is that of the byte-level pattern: contractions, then runs of letters,
    of numbers and of other characters, each with one space before it, then runs of
    white space without the last one if something follows.
    """
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[cps]
    first = np.zeros(n + 1, bool)
    first[rows] = True
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run |= first[:n]
    starts = run.copy()
    # the last white space before something else of the same row begins a pre-token
    follows = np.flatnonzero(run & (kind != 3) & ~first[:n])
    follows = follows[kind[follows - 1] == 3]
    starts[follows - 1] = True
    starts[follows[cps[follows - 1] == 0x20]] = False
    # contractions: a lone apostrophe that begins a pre-token, and letters after it
    q = np.flatnonzero(run & (cps == 0x27))
    q = q[(q + 1 < n)]
    q = q[starts[q] & run[q + 1] & ~first[q + 1] & (kind[q + 1] == 1)]
    if len(q):
        c1 = cps[q + 1]
        has2 = (q + 2 < n) & ~first[np.minimum(q + 2, n)]
        c2 = np.where(has2, cps[np.minimum(q + 2, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        size = np.where(one, 1, np.where(two, 2, 0))
        q, size = q[size > 0], size[size > 0]
        starts[q + 1] = False
        rest = q + 1 + size
        rest = rest[rest < n]
        starts[rest[kind[rest] == 1]] = True
    return np.flatnonzero(starts)


class CorpusEncoder:
    """Encodes Arrow batches of texts; keeps what it knows of words between batches."""

    def __init__(self, path: str):
        self.bpe = BytePairEncoder(path)
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.begin = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)

    def learn(self, words: list[bytes]) -> None:
        ids, counts = self.bpe.encode(words)
        lo = len(self.known) - len(words)
        hi = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while hi > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[lo:hi] = self.used + np.cumsum(counts) - counts
        self.count[lo:hi] = counts
        self.used += len(ids)

    def encode(self, column: pa.Array) -> Iterator[pa.Array]:
        """The id lists of a column's texts, in arrays of consecutive rows, one at a time.

        New words of consecutive slices are merged together, but no slice is begun while
        more than ``CACHE_BYTES`` are held.
        """
        raw, offsets = byte_view(column)
        pending: list[bytes] = []
        pieces: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in row_slices(np.diff(offsets), 2 * SLICE_CHARS):
            if self.held > CACHE_BYTES:
                yield from self._ids(pending, pieces)
                pending, pieces = [], []
                self.reset()
            part = raw[offsets[lo] : offsets[hi]]
            off = offsets[lo : hi + 1] - offsets[lo]
            cps, rows = code_points(part, off)
            starts = pretoken_starts(cps, rows)
            lead = np.flatnonzero((part & 0xC0) != 0x80)
            at = np.append(lead[starts], len(part)).astype(np.int32)
            tokens = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(part.tobytes())])
            coded = tokens.dictionary_encode()
            ids = []
            for word in coded.dictionary.to_pylist():
                k = self.known.get(word)
                if k is None:
                    k = self.known[word] = len(self.known)
                    pending.append(word)
                    self.held += 5 * len(word) + WORD_BYTES  # a word has at most one id of four bytes for each byte
                ids.append(k)
            words = np.array(ids, np.int32)[coded.indices.to_numpy()]
            pieces.append((words, np.searchsorted(starts, rows)))
        yield from self._ids(pending, pieces)

    def _ids(self, pending: list[bytes], pieces: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.Array]:
        if pending:
            self.learn(pending)
        for words, bounds in pieces:
            counts = self.count[words]
            ends = np.zeros(len(words) + 1, np.int64)
            np.cumsum(counts, out=ends[1:])
            source = np.repeat(self.begin[words] - ends[:-1], counts)
            source += np.arange(ends[-1])
            rows = ends[bounds]
            yield pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(self.flat[source]))


@lru_cache(maxsize=2)
def _encoder(path: str) -> CorpusEncoder:
    return CorpusEncoder(path)


def default_vocabulary() -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return DEFAULT_VOCABULARY


def encode_corpus(texts: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(key, ids) for every row, without special tokens.

    An empty text and a null text both have the empty list of ids; a null key stays
    null. Repeated rows are encoded each. ``vocabulary`` must be readable on every
    executor. No shuffle: rows stay where they are read.
    """
    path = os.path.realpath(vocabulary or default_vocabulary())

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            done = 0
            for ids in encoder.encode(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(ids)), ids], ["key", "ids"])
                done += len(ids)

    picked = texts.select(texts[key].alias("key"), texts[text].alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
