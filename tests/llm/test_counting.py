from collections import Counter, defaultdict
from itertools import combinations
import math
import random

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import distinct, frequency, together


def occurrences(seed, n=4000):
    rng = random.Random(seed)
    rows = [("t", "hot" if rng.random() < 0.35 else f"w{int(rng.paretovariate(0.6)) % 900}", rng.choice([1, 1 << 40]) * rng.randrange(700), rng.choice([1, 2, 3, 4, 900])) for _ in range(n)]
    return rows + [("t", None, 1, 1), ("t", "", 1, 1), ("t", "x", None, 1), ("u", "hot", 1, None), ("u", "hot", 1, 7), ("u", "hot", -5, 1), (None, "hot", 10**12, 1)]


def test_frequencies(spark, monkeypatch):
    monkeypatch.setattr(frequency, "HELD_ROWS", 500)
    rows = occurrences(1)
    frame = spark.createDataFrame([(*r, 0, True) for r in rows], "field string, term string, record long, n int, slot int, heavy boolean").repartition(3)
    most = defaultdict(int)
    for f, t, r, n in rows:
        if f and t and r is not None:
            most[f, t, r] = max(most[f, t, r], 1 if n is None else n)
    records, total = Counter((f, t) for f, t, _ in most), Counter()
    for (f, t, _), n in most.items():
        total[f, t] += n
    counted = lambda frame: {(r.field, r.term): (r.n_occurrences, r.n_records) for r in frame.collect()}
    found, size = frequency.frequencies_and_records(frame)
    assert counted(found) == {k: (total[k], records[k]) for k in records}
    assert size.first()["size"] == len({r for _, _, r, _ in rows if r is not None})
    once = spark.createDataFrame([(f, t, str(r), n) for (f, t, r), n in most.items()], "field string, term string, record string, n int")
    assert counted(frequency.term_frequencies(once, unique=True)) == counted(found)
    assert frequency.term_frequencies(frame.limit(0)).collect() == []


def test_blocks_pack_and_unite():
    """Rows of one record in several blocks, small and large numbers."""
    slot = np.array([0, 0, 0, 1, 1, 0], np.int32)
    record, n = np.array([5, 70_000, 5, 5, -1, 6]), np.array([1, 300, 9, 1, 1, 1])
    slots, blocks, low, ns = frequency._packed(slot, record, n)
    assert list(zip(slots.tolist(), blocks.tolist())) == [(0, 0), (0, 1), (1, -1), (1, 0)]
    assert [np.frombuffer(x, np.uint16).tolist() for x in low] == [[5, 6], [4464], [65535], [5]] and [len(x) for x in ns] == [2, 8, 0, 0]
    assert all(len(x) == 0 for x in frequency._packed(slot[:0], record[:0], n[:0]))


def test_marks(spark):
    counts = spark.createDataFrame([("t", "a", 1, 1), ("t", "b", 5, 2), ("t", "c", 5, 3), ("u", "d", 1, 1)], "field string, term string, n_occurrences long, n_records long")
    sizes = spark.createDataFrame([("t", 10), ("u", 4)], "field string, size long")
    assert {r.term: r.mark for r in frequency.mark_useless(counts, sizes).collect()} == {"a": "rare", "b": None, "c": "common", "d": "common"}


def test_residual_idf(spark):
    seen = {(t, str(r)): n for _, t, r, n in occurrences(2) if t and r and n}
    frame = spark.createDataFrame([("t", t, r, n, 5) for (t, r), n in seen.items()], "field string, term string, record string, tf long, other int")
    df, cf = Counter(t for t, _ in seen), Counter()
    for (t, _), n in seen.items():
        cf[t] += n
    rows = distinct.residual_idf(frame, 700).collect()
    assert len(rows) == len(seen)
    for r in rows:
        want = -math.log2(df[r.term] / 700) + math.log2(1 - math.exp(-cf[r.term] / 700))
        assert abs(r.ridf - want) < 1e-9 and abs(r.score - r.tf * want) < 1e-8 and (r.df, r.cf) == (df[r.term], cf[r.term])
    assert distinct.residual_idf(frame.limit(0), 700).collect() == []


def test_no_case_falls_below_the_bound(spark):
    for n in (1, 2, 5, 12, 14, 1000):
        bound = spark.range(1).select(distinct.least_ridf(F.lit(n), 3, 12).alias("b")).first().b
        for df in range(2, min(12, n) + 1):
            for cf in (df + 2, df + 3, 5 * df + 7, 1000 * df):
                assert math.log2((1 - math.exp(-cf / n)) / (df / n)) >= bound


def test_codes_beyond_32_bits(spark, monkeypatch):
    """With codes of two bits every pair has its tile."""
    monkeypatch.setattr(together, "CODE_BITS", 2)
    rng = random.Random(5)
    baskets = [sorted(rng.sample(range(40), rng.randint(2, 9))) for _ in range(60)]
    frame = spark.createDataFrame([(b,) for b in baskets], "codes array<long>")
    want = Counter(p for b in baskets for p in combinations(b, 2))
    low = 0xFFFFFFFF
    got = {((r.tile >> 32 << 2) + (r.pair >> 32), ((r.tile & low) << 2) + (r.pair & low)): r.n for r in together.merge_runs(together.pair_runs(frame)).collect()}
    assert got == want


def test_pairs(spark, monkeypatch):
    monkeypatch.setattr(together, "RUN_PAIRS", 100)
    rng = random.Random(3)
    baskets = {str(k): {"hot"} | {f"v{int(rng.paretovariate(0.8)) % 40}" for _ in range(rng.randint(0, 8))} for k in range(200)} | {"big": {f"v{k}" for k in range(60)}, "one": {"v1"}}
    rows = [(f, r, v, 1) for f in ("a", "b") for r, vs in baskets.items() for v in vs for _ in range(2) if f == "a" or r != "big"] + [("a", None, "x", 1), ("a", "1", None, 1), ("a", "1", "", 1)]
    frame = spark.createDataFrame(rows, "field string, record string, value string, code int")
    for least in (1, 5):
        got = {(r.field, r.a, r.b): r for r in together.pairs_together(frame, 202, least).collect()}
        for f in ("a", "b"):
            held = {r: vs for r, vs in baskets.items() if f == "a" or r != "big"}
            single = Counter(v for vs in held.values() for v in vs)
            both = {k: n for k, n in Counter(p for vs in held.values() for p in combinations(sorted(vs), 2)).items() if n >= least}
            assert {k[1:]: r.n for k, r in got.items() if k[0] == f} == both
            for (a, b), n in both.items():
                r = got[f, a, b]
                rest = 202 - single[a] - single[b] + n
                odds = (n + 0.5) * (rest + 0.5) / ((single[a] - n + 0.5) * (single[b] - n + 0.5))
                assert (r.n_a, r.n_b) == (single[a], single[b]) and math.isclose(r.odds_ratio, odds) and math.isclose(r.lift, n * 202 / single[a] / single[b])
    assert together.pairs_together(frame.limit(0), 202).collect() == []
