from collections import defaultdict
import random

from foliant.llm import spans
from foliant.plans import skew


def brute(rows, n):
    held = defaultdict(set)
    texts = {(d, t) for d, t in rows if d is not None and t is not None}
    for d, t in texts:
        for i in range(len(t) - n + 1):
            held[t[i : i + n]].add(d)
    pairs = {(a, b) for s in held.values() for a in s for b in s if a < b}
    cover = {}
    for d, t in texts:
        c = set()
        for i in range(len(t) - n + 1):
            if len(held[t[i : i + n]]) > 1:
                c.update(range(i, i + n))
        cover[d] = len(c)
    return pairs, cover


def check(spark, rows, n=16):
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc long, text string, hash long, h1 long")
    shared = spans.shared_spans(frame, "doc", "text", n)
    pairs, cover = brute(rows, n)
    got = [tuple(r) for r in spans.span_pairs(shared).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    amount = {r.doc: r.shared_chars for r in spans.shared_amount(frame, "doc", "text", shared, n).collect()}
    assert {d: amount[d] for d in cover} == cover
    return pairs


def corpus(seed, docs, alphabet="abcdefgh"):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    chunks = [text(rng.randint(14, 40)) for _ in range(8)]
    return [(k, "".join(rng.choice([text(rng.randint(0, 20)), rng.choice(chunks)]) for _ in range(rng.randint(0, 6)))) for k in range(docs)]


def test_random_corpora(spark):
    assert check(spark, corpus(2, 60, "ab字🙂"))
    check(spark, corpus(3, 40, "ab"))


def test_length_is_exact(spark):
    run = "0123456789abcdef"
    assert check(spark, [(1, "x" + run + "y"), (2, "p" + run + "q"), (3, "w" + run[:15] + "z"), (4, run)]) == {(1, 2), (1, 4), (2, 4)}


def test_repetitive_and_copies(spark):
    rows = [(1, "a" * 100), (2, "a" * 40), (3, "ab" * 30), (4, "ab" * 30), (5, "ba" * 20), (6, None), (7, ""), (8, "short"), (None, "a" * 50), (1, "a" * 100)]
    assert check(spark, rows)


def test_hot_group(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_HEAVY", 1)
    head = "a header that a third of all texts have"
    rows = [(k, (head if k % 3 == 0 else "") + f"{k:09d}" * 3) for k in range(90)]
    assert len(check(spark, rows)) >= 30 * 29 / 2


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghij") for _ in range(3000))
    column = __import__("pyarrow").array([long, None, "x" * 5])
    monkeypatch.setattr(spans, "SLICE_CHARS", 100)
    seen = [(p.rows.tolist(), p.origin.tolist(), len(p.cps)) for p in spans.pieces(column, 15)]
    starts = {o + k for rows, origin, n in seen if rows == [0] for o in origin for k in range(n - 15)}
    assert starts == set(range(len(long) - 15))


def test_near_copies(spark):
    """Copies with an edit each, close together and apart, at the ends and in the middle."""
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh") for _ in range(200))
    rows = [(k, base[: 7 * k] + "#" + base[7 * k + 1 :]) for k in range(25)] + [(40, base[20:90]), (41, base[60:76]), (42, base[60:75]), (43, base[::-1])]
    assert check(spark, rows)


def test_a_key_with_several_texts(spark):
    rows = corpus(5, 12) + corpus(6, 12)
    frame = spark.createDataFrame(rows, "doc long, text string")
    got = {tuple(r) for r in spans.span_pairs(spans.shared_spans(frame, "doc", "text", 16)).collect()}
    assert got == brute(rows, 16)[0]


def test_rows_made_for_near_copies_grow_with_the_result(spark, monkeypatch):
    """What the join of fork groups gives before it is filtered stays within a constant of the pairs."""
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh") for _ in range(3000))
    made = []
    monkeypatch.setattr(spans, "salted_join", lambda a, b, on, spread: made.append(skew.salted_join(a, b, on, spread)) or made[-1])
    for n in (10, 20):
        made.clear()
        frame = spark.createDataFrame([(k, base[: 140 * k + 50] + "#" + base[140 * k + 51 :]) for k in range(n)], "doc long, text string")
        pairs = spans.span_pairs(spans.shared_spans(frame, "doc", "text", 32)).count()
        assert pairs == n * (n - 1) // 2 and sum(f.count() for f in made if "pa" in f.columns) < 12 * pairs


def test_nothing_shared(spark):
    assert check(spark, [(1, "0123456789abcdefghijk"), (2, "kjihgfedcba9876543210")]) == set()
    assert check(spark, [(1, None)]) == set()
