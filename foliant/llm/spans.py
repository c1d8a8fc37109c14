"""Long exact spans that several records share, by level-wise doubling.

Level one: windows of half the wanted length. Of each possible span only its anchor is
looked at, the window with the smallest hash among the span's windows: equal spans have
equal anchors, and a text has about one anchor for 80 positions. Anchors that one text
alone holds are dropped. Level two: the neighbouring spans with one anchor form a run, a
stretch of text given by its two ends, and only runs around surviving anchors go on, with
a digest of their text. Runs of equal text are one class. Classes share spans in part only
where one anchor has several of them; only there are the single spans of twice the anchor's
length compared, one representative for each class. Longer windows can't add to the result,
so the doubling ends with the wanted length.

A text is read once for its runs, and those that represent a class with rivals are read
once more. No row stands for a single position unless its neighbourhood is disputed.
"""

from __future__ import annotations

from collections.abc import Iterator
import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.textbuf import byte_view, code_points, row_slices
from foliant.plans.skew import bounded_lookup, salted_join, salted_lookup
from foliant.plans.stage import at_once, stage

SLICE_CHARS = 400_000
#: bits of a position within a piece, which is at most four slices and an overlap long
PLACE = 21


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def window_hashes(cps: np.ndarray, length: int) -> np.ndarray:
    """Hash of each window of ``length`` code points, by doubling an odd base length."""
    base, doublings = length, 0
    while base % 2 == 0:
        base, doublings = base // 2, doublings + 1
    n = len(cps) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    one = cps.astype(np.uint64)
    one += np.uint64(1)
    one *= np.uint64(0x94D049BB133111EB)
    one ^= one >> np.uint64(31)
    h = one
    for j in range(1, base):
        h = _mix(h[: len(one) - j], one[j:])
    for _ in range(doublings):
        h = _mix(h[:-base], h[base:])
        base *= 2
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of ``width`` values, by doubling."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    if done < width:
        values = np.minimum(values[: len(values) - (width - done)], values[width - done :])
    return values


class Piece(NamedTuple):
    cps: np.ndarray
    rows: np.ndarray  # row of each part
    bounds: np.ndarray  # first code point of each part, and the end
    origin: np.ndarray  # of each part's first code point in its text


def pieces(column: pa.Array, overlap: int) -> Iterator[Piece]:
    """Texts of at least ``overlap + 1`` code points in bounded pieces; longer texts are cut with that overlap."""
    raw, offsets = byte_view(column)
    for lo, hi in row_slices(np.diff(offsets), 3 * SLICE_CHARS):
        cps, bounds = code_points(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        if len(cps) <= 4 * SLICE_CHARS:
            yield Piece(cps, np.arange(lo, hi), bounds, np.zeros(hi - lo, np.int64))
            continue
        for k in range(hi - lo):
            own = cps[bounds[k] : bounds[k + 1]]
            for at in range(0, max(1, len(own) - overlap), SLICE_CHARS):
                part = own[at : at + SLICE_CHARS + overlap]
                yield Piece(part, np.array([lo + k]), np.array([0, len(part)]), np.array([at]))


def _span_starts(piece: Piece, min_chars: int) -> np.ndarray:
    """True where a span of ``min_chars`` fits."""
    edge = np.zeros(len(piece.cps) + 1, np.int32)
    last = piece.bounds[1:] - min_chars + 1
    fits = last > piece.bounds[:-1]
    np.add.at(edge, piece.bounds[:-1][fits], 1)
    np.add.at(edge, last[fits], -1)
    return np.cumsum(edge[:-1]) > 0


def runs_of(piece: Piece, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(start, number, anchor, part, hash of all half-length windows, first of its part) of the runs of spans with one anchor."""
    half = min_chars // 2
    at = np.flatnonzero(_span_starts(piece, min_chars))
    if not len(at):
        return None
    h = window_hashes(piece.cps, half)
    place = np.uint64((1 << PLACE) - 1)
    # the hash's upper bits and the position: the least is the leftmost of the smallest windows
    least = sliding_least((h & ~place) | np.arange(len(h), dtype=np.uint64), min_chars - half + 1)
    anchor = (least[at] & place).astype(np.int64)
    part = np.searchsorted(piece.bounds, at, side="right") - 1
    opens = np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])]
    k = np.flatnonzero(opens)
    first = np.r_[True, part[k][1:] != part[k][:-1]]
    return at[k], np.diff(np.r_[k, len(at)]), anchor[k], part[k], h, first


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _runs(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, c1, c2, at, n, o, h, d1, d2, prev, head) of all runs.

    A run starts at ``at`` and has ``n`` spans; its anchor, of hash ``h``, begins ``o``
    behind ``at``; ``d1`` and ``d2`` are a digest of its text. ``prev`` is the hash of the
    span one to the left of the run, null where there is none, and ``head`` marks the first run of a text.
    """
    half = min_chars // 2

    def run(batches):
        for batch in batches:
            for piece in pieces(batch.column(3), min_chars - 1):
                found = runs_of(piece, min_chars)
                if found is None:
                    continue
                at, n, anchor, part, h, first = found
                view = memoryview(np.ascontiguousarray(piece.cps)).cast("B")
                digest = b"".join(hashlib.blake2b(view[4 * a : 4 * b], digest_size=16).digest() for a, b in zip(at.tolist(), (at + n + min_chars - 1).tolist()))
                digest = np.frombuffer(digest, np.int64).reshape(-1, 2)
                left = np.maximum(at - 1, 0)
                prev = pa.array(_mix(h[left], h[left + half]).view(np.int64), mask=first)
                origin = piece.origin[part]
                take = pa.array(piece.rows[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).take(take) for k in range(3)), pa.array(at - piece.bounds[part] + origin), pa.array(n.astype(np.int32)), pa.array((anchor - at).astype(np.int32)),
                        _signed(h[anchor]), pa.array(digest[:, 0]), pa.array(digest[:, 1]), prev, pa.array(first & (origin == 0)),
                    ],
                    ["doc", "c1", "c2", "at", "n", "o", "h", "d1", "d2", "prev", "head"],
                )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, c1 long, c2 long, at long, n int, o int, h long, d1 long, d2 long, prev long, head boolean")


def _identified(texts: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(doc, c1, c2, text) of texts long enough; c1 and c2 are two halves of the text's digest."""
    t = texts.select(texts[key].alias("doc"), texts[text].alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") >= min_chars))
    digest = F.md5("text")
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return t.select("doc", half(1).alias("c1"), half(17).alias("c2"), "text")


def _spans(classes: DataFrame, min_chars: int) -> DataFrame:
    """(cid, lo, hi, h, off, w, prev) of every span of the classes' texts: its anchor begins ``off`` behind it, ``prev`` is the span one to the left within the run."""

    def run(batches):
        for batch in batches:
            o, n = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            for piece in pieces(batch.column(6), min_chars - 1):
                starts = np.flatnonzero(_span_starts(piece, min_chars))
                if not len(starts):
                    continue
                h = window_hashes(piece.cps, min_chars // 2)
                part = np.searchsorted(piece.bounds, starts, side="right") - 1
                w = _mix(h[starts], h[starts + min_chars // 2])
                inner = starts > piece.bounds[part]
                prev = pa.array(np.r_[np.uint64(0), w[:-1]].view(np.int64), mask=~inner)
                row = piece.rows[part]
                take = pa.array(row)
                off = o[row] - (starts - piece.bounds[part])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(4)), pa.array(off.astype(np.int32)), _signed(w), prev], ["cid", "lo", "hi", "h", "off", "w", "prev"])

    kind = classes.schema["lo"].dataType.simpleString()
    return classes.select("cid", "lo", "hi", "h", "o", "n", "run").mapInArrow(run, f"cid long, lo {kind}, hi {kind}, h long, off int, w long, prev long")


class SharedSpans(NamedTuple):
    runs: DataFrame  # (doc, at, n, o, prev, h, d1, d2) of runs whose anchor several texts hold; doc stands for all copies of its text
    classes: DataFrame  # (h, d1, d2, lo, hi): runs of equal text, with the least and the greatest of their documents
    rivals: DataFrame  # (cid, h, d1, d2, o, run): classes with an anchor that other classes have too
    spans: DataFrame  # (cid, rep, h, off, w, prev): spans that rivals of different documents share; rep is the smallest class of the span
    copies: DataFrame  # (rep, doc): documents of texts that are stored more than once, rep the smallest of them


def shared_spans(texts: DataFrame, key: str, text: str, min_chars: int = 320) -> SharedSpans:
    """Spans of at least ``min_chars`` (an even number) code points that different texts hold, exactly as stored.

    Exact copies are collapsed first: only the document with the smallest key of each text
    takes part, and ``copies`` lists the rest. Null texts, null keys and texts shorter than
    ``min_chars`` take no part. A row stored again counts once. A key should have one text: of a
    key with several, what holds for one of them holds for the key and for that text's copies. Anchors and spans are found by
    64-bit hashes; runs of one class have the same 128-bit BLAKE2 digest, and what classes
    share is compared as text before it counts. Anchors and spans that a third of all
    documents hold are aggregated in parts and joined with salted keys.
    """
    if min_chars % 2:
        raise ValueError("min_chars must be even")
    docs = _identified(texts, key, text, min_chars)
    runs = stage(_runs(docs, min_chars), "runs")
    copies, shared = at_once(lambda: _copies(runs), lambda: _levels(docs, runs, min_chars))
    return SharedSpans(*shared, copies)


def _copies(runs: DataFrame) -> DataFrame:
    """(rep, doc) of the texts that several documents hold, whole."""
    several = runs.filter("head").groupBy("c1", "c2").agg(F.min("doc").alias("rep"), F.max("doc").alias("last"), F.count("*").alias("weight")).filter(F.col("rep") != F.col("last"))
    return stage(salted_lookup(runs.filter("head").select("doc", "c1", "c2"), stage(several.drop("last"), "several"), ["c1", "c2"], "weight", spread=["doc"]).select("rep", "doc").distinct(), "copies")


def _levels(docs: DataFrame, runs: DataFrame, min_chars: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(runs, classes, rivals, spans) as ``SharedSpans`` has them."""
    # level one: anchors that different texts hold
    repeated = (
        runs.groupBy("h")
        .agg(F.min("c1").alias("a1"), F.max("c1").alias("b1"), F.min("c2").alias("a2"), F.max("c2").alias("b2"), F.count("*").alias("weight"))
        .filter((F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2")))
        .select("h", "weight")
    )
    alive = salted_lookup(runs.drop("head"), stage(repeated, "anchors"), ["h"], "weight", spread=["c1", "at"]).drop("weight")
    alive = stage(alive.groupBy("c1", "c2", "at", "n", "o", "h", "d1", "d2", "prev").agg(F.min("doc").alias("doc")), "alive")

    # level two: whole runs, and single spans where an anchor has rival runs
    classes = stage(alive.groupBy("h", "d1", "d2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("n").alias("n"), F.min("o").alias("o"), F.min(F.struct("doc", "at", "c1", "c2")).alias("first")), "classes")
    rival = classes.groupBy("h").agg(F.count("*").alias("weight")).filter(F.col("weight") > 1)
    rivals = salted_lookup(classes, stage(rival, "rival"), ["h"], "weight", spread=["d1"]).drop("weight")
    wanted = rivals.select("first.doc", "first.c1", "first.c2", F.struct("h", "d1", "d2", "lo", "hi", "n", "o", F.col("first.at").alias("at")).alias("run"))
    size = classes.count()  # there are at most as many rivals
    text = ["doc", "c1", "c2"]  # a key may have several texts
    wanted = wanted.groupBy(*text).agg(F.collect_list("run").alias("runs"))
    cut = lambda r: F.substring(F.col("text"), r["at"].cast("int") + 1, r["n"] + (min_chars - 1))
    held = bounded_lookup(docs, wanted, text, 88, n=size)
    held = held.select(F.explode(F.transform("runs", lambda r: F.struct(*[r[c].alias(c) for c in ("h", "d1", "d2", "lo", "hi", "n", "o")], cut(r).alias("run")))).alias("r")).select("r.*")
    # a row stored again would give its runs twice
    rivals = stage(held.groupBy("h", "d1", "d2").agg(F.min(F.struct("lo", "hi", "n", "o", "run")).alias("r")).select("h", "d1", "d2", "r.*").withColumn("cid", F.monotonically_increasing_id()), "rivals")
    spans = stage(_spans(rivals, min_chars), "spans")
    where = ["h", "off", "w"]
    shared = spans.groupBy(*where).agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"), F.min("cid").alias("rep"), F.max("cid").alias("_last"), F.count("*").alias("weight")).filter((F.col("_lo") != F.col("_hi")) & (F.col("rep") != F.col("_last")))
    met = stage(salted_lookup(spans.drop("lo", "hi"), stage(shared.drop("_lo", "_hi", "_last"), "shared"), where, "weight", spread=["cid"]).drop("weight"), "met")
    return alive, classes, rivals, _verified(met, rivals, min_chars)


def _verified(met: DataFrame, rivals: DataFrame, min_chars: int) -> DataFrame:
    """The spans whose text equals that of the smallest class of the span.

    All spans of two classes hold the anchor, so what lies between two equal spans is equal
    as well: one comparison of the whole stretch decides for all spans of the two classes.
    """
    own = met.filter(F.col("cid") == F.col("rep"))
    others = met.filter(F.col("cid") != F.col("rep"))
    reach = others.groupBy("cid", "rep").agg(F.min("off").alias("near"), F.max("off").alias("far"))
    texts = rivals.select("cid", "o", "run")
    reach = reach.join(texts, "cid").join(texts.select(F.col("cid").alias("rep"), F.col("o").alias("rep_o"), F.col("run").alias("rep_run")), "rep")
    stretch = lambda run, o: F.substring(F.col(run), F.col(o) - F.col("far") + 1, F.col("far") - F.col("near") + min_chars)
    equal = reach.filter(stretch("run", "o") == stretch("rep_run", "rep_o")).select("cid", "rep")
    return own.unionByName(others.join(equal, ["cid", "rep"], "left_semi").select(own.columns))


def fork_pairs(rows: DataFrame, group: list[str], member: str, prev: Column) -> DataFrame:
    """(a, b), a < b, of members of a group that differ in ``prev``, where a null differs from everything.

    Members that agree on what stands to the left are paired there already. Every member
    outside the group's largest class of equal ``prev`` meets the whole group, so at most
    four times as many rows are made as there are pairs that differ.
    """
    own = F.when(prev.isNull(), F.xxhash64(F.col(member).cast("string"), F.lit("no left neighbour"))).otherwise(prev)
    rows = stage(rows.select(*group, F.col(member).alias("m"), own.alias("p")).distinct(), "members")
    sizes = rows.groupBy(*group, "p").agg(F.count("*").alias("size"))
    forks = sizes.groupBy(*group).agg(F.max(F.struct("size", "p")).alias("top"), F.min("p").alias("x"), F.max("p").alias("y"), F.sum("size").alias("weight")).filter(F.col("x") != F.col("y"))
    forks = stage(forks.select(*group, F.col("top.p").alias("top"), "weight"), "forks")
    ends = stage(salted_lookup(rows, forks, group, "weight", spread=["m"]).drop("weight"), "ends")
    a = ends.filter(F.col("p") != F.col("top")).select(*group, F.col("m").alias("a"), F.col("p").alias("pa"))
    b = ends.select(*group, F.col("m").alias("b"), F.col("p").alias("pb"))
    pairs = salted_join(a, b, group, ["a"]).filter((F.col("pa") != F.col("pb")) & (F.col("a") != F.col("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def span_pairs(shared: SharedSpans) -> DataFrame:
    """(doc_id_a, doc_id_b), doc_id_a < doc_id_b: all pairs of documents that share a span, copies included.

    Documents of one class are paired where their common stretch begins, classes at the
    first span that they share within a run, and copies are put in last.
    """
    name = ["h", "d1", "d2"]
    many = shared.classes.filter(F.col("lo") != F.col("hi")).select(*name)
    alike, rivals, members = at_once(
        lambda: fork_pairs(salted_join(shared.runs, many, name, ["doc"]), name, "doc", F.col("prev")),
        lambda: fork_pairs(shared.spans, ["h", "off", "w"], "cid", F.col("prev")),
        lambda: stage(salted_join(shared.runs.select(*name, "doc"), shared.rivals.select(*name, "cid"), name, ["doc"]).select("cid", "doc").distinct(), "class members"),
    )
    wide = salted_join(rivals.withColumnRenamed("a", "cid"), members, ["cid"], ["b"]).select(F.col("doc").alias("a"), F.col("b").alias("cid"))
    wide = salted_join(wide.distinct(), members, ["cid"], ["a"]).select("a", F.col("doc").alias("b")).filter(F.col("a") != F.col("b"))
    pairs = stage(alike.unionByName(wide.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "pairs")
    return with_copies(pairs, shared.copies).select(F.col("x").alias("doc_id_a"), F.col("y").alias("doc_id_b"))


def with_copies(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """(x, y), x < y: pairs (a, b) of representatives carried to all their copies, and the pairs within copies."""
    reps = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    held = copies.unionByName(reps.join(copies.select(F.col("rep").alias("doc")), "doc", "left_anti").select(F.col("doc").alias("rep"), "doc"))
    held = stage(held, "held")
    wide = salted_join(pairs.withColumnRenamed("a", "rep"), held, ["rep"], ["b"]).select(F.col("doc").alias("x"), F.col("b").alias("rep"))
    wide = salted_join(wide, held, ["rep"], ["x"]).select("x", F.col("doc").alias("y"))
    same = salted_join(copies.withColumnRenamed("doc", "x"), copies.withColumnRenamed("doc", "y"), ["rep"], ["x"]).filter(F.col("x") < F.col("y")).select("x", "y")
    both = wide.unionByName(same).filter(F.col("x") != F.col("y"))
    return both.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def shared_amount(texts: DataFrame, key: str, text: str, shared: SharedSpans, min_chars: int = 320) -> DataFrame:
    """(key, n_chars, shared_chars, copy_of): how much of each document lies in spans that another document holds.

    One row per distinct key; a null text has n_chars 0. A text stored more than once is
    shared throughout, if it is long enough, and ``copy_of`` names the smallest document
    that holds it, null for texts stored once.
    """
    name = ["h", "d1", "d2"]
    reach = shared.spans.groupBy("cid").agg(F.min("off").alias("near"), F.max("off").alias("far"))
    parts = shared.rivals.join(reach, "cid").select(*name, F.col("o") - F.col("far"), F.col("o") - F.col("near")).toDF(*name, "from", "to")
    whole = shared.classes.filter(F.col("lo") != F.col("hi")).select(*name, F.lit(0).alias("from"), (F.col("n") - 1).alias("to"))
    covers = stage(whole.unionByName(parts).groupBy(*name).agg(F.min("from").alias("from"), F.max("to").alias("to")), "covers")
    cover = salted_join(shared.runs.select(*name, "doc", "at"), covers, name, ["doc"])
    cover = cover.select("doc", (F.col("at") + F.col("from")).alias("begin"), (F.col("at") + F.col("to") + min_chars).alias("end")).distinct()
    # a document's stretches in order: each adds what lies behind all before it
    before = Window.partitionBy("doc").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("end").over(before), F.lit(0))
    new = F.greatest(F.lit(0).cast("long"), F.col("end") - F.greatest(seen, F.col("begin")))
    part = cover.withColumn("new", new).groupBy("doc").agg(F.sum("new").alias("part"))
    same = shared.copies.groupBy("doc").agg(F.min("rep").alias("copy_of"))
    docs = texts.select(texts[key].alias("doc"), F.coalesce(F.length(texts[text]), F.lit(0)).cast("long").alias("n_chars")).filter(F.col("doc").isNotNull()).groupBy("doc").agg(F.max("n_chars").alias("n_chars"))
    return (
        docs.join(part, "doc", "left")
        .join(same, "doc", "left")
        .select(F.col("doc").alias(key), "n_chars", F.when(F.col("copy_of").isNotNull(), F.col("n_chars")).otherwise(F.coalesce("part", F.lit(0))).cast("long").alias("shared_chars"), "copy_of")
    )
