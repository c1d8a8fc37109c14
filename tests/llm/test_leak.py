from collections import defaultdict
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import leak


def folded(s):
    return "".join(c for c in unicodedata.normalize("NFKC", s or "").lower() if c.isalnum())


def brute(docs, items, w=20):
    out = {}
    for i, t in items:
        t = folded(t)
        grams = defaultdict(list)
        for o in range(len(t) - w + 1):
            grams[t[o : o + w]].append(o)
        for d, text in docs:
            text = folded(text)
            cover = set()
            for p in range(len(text) - w + 1):
                for o in grams.get(text[p : p + w], ()):
                    cover.update(range(o, o + w))
            if cover and d is not None and i is not None:
                out[(d, i, len(t))] = max(len(cover), out.get((d, i, len(t)), 0))
    return out


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(*x, "q") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*x, "q") for x in items], "item_id long, text string, key string")
    rows = leak.find_leaks(d, "doc_id", "text", i, "item_id", "text", **more).collect()
    got = {(r[0], r[1], r.item_chars): r.covered for r in rows if r.covered}
    assert len(rows) == len({(r[0], r[1], r.item_chars) for r in rows})
    return got


def planted(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefghij 字文ÄＡ１。,") for _ in range(n))
    items = [(k, word(rng.randint(30, 200))) for k in range(12)] + [(90, None), (91, ""), (92, "。，"), (93, "short")]
    docs = [(1, None), (2, ""), (3, "x")]
    for k in range(60):
        text = word(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(items[:12])[1]
            a = rng.randrange(len(t))
            piece = t[a : a + rng.randint(10, 150)]
            text += rng.choice([piece, piece.upper(), " ".join(piece)]) + word(10)
        docs.append((10 + k, text))
    return docs, items


def test_against_brute_force(spark):
    docs, items = planted(3)
    truth = brute(docs, items)
    assert truth and run(spark, docs, items) == truth


def test_blocks_of_items(spark, monkeypatch):
    docs, items = planted(4)
    monkeypatch.setattr(leak, "BLOCK_CHARS", 300)
    assert run(spark, docs, items) == brute(docs, items)


def matched(docs, items, **more):
    table = leak.folding_table()
    n = leak.repetitions(**more)
    block = leak.make_block([i for i, _ in items], [t for _, t in items], table, 20, [leak.Walk(k, n) for k in range(n)])
    out = {}
    for row, item, covered, edits in zip(*leak.leaks_of(pa.array([t for _, t in docs], pa.string()), block, table)):
        c, e = out.get((docs[row][0], items[item][0]), (0, -1))
        out[docs[row][0], items[item][0]] = max(c, covered), max(e, edits)
    return out


def test_small_slices(monkeypatch):
    monkeypatch.setattr(leak, "SLICE_CHARS", 50)
    docs, items = planted(5)
    items = [x for x in items if x[1]]
    size = {i: len(folded(t)) for i, t in items}
    assert {(d, i, size[i]): c for (d, i), (c, _) in matched(docs, items).items() if c} == brute(docs, items)


def test_no_items_and_no_documents(spark):
    assert run(spark, [(1, "a" * 50)], [(1, None)]) == {}
    assert run(spark, [(1, None)], [(1, "a" * 50)]) == {}


def test_ties_and_repeats(spark):
    passage = "abcdefghijklmnopqrstuvwxyz0123456789"
    docs = [(1, passage * 3), (1, passage * 3), (2, "z" * 1000)]
    items = [(5, passage), (5, passage), (6, "z" * 40)]
    assert run(spark, docs, items) == brute(docs, items)


def test_repetitive_texts_make_no_pairs_of_places(monkeypatch):
    """Every place of the text equals every place of the item; only lists are made."""
    most = []
    expand = leak.Lists.expand
    monkeypatch.setattr(leak.Lists, "expand", lambda self, lists: most.append(int(self.count[lists].sum())) or expand(self, lists))
    got = matched([(1, "a" * 300_000)], [(1, "a" * 2000)])
    assert got == {(1, 1): (2000, 0)} and max(most) < 10_000


def distance(a, b, free=False):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row) if free else row[-1]


def test_prefix_distance():
    rng = random.Random(2)
    for most in (0, 1, 2, 5):
        pairs = []
        for _ in range(150):
            a = [rng.randint(0, 3) for _ in range(rng.randint(0, 12))]
            b = list(a) + [rng.randint(0, 3) for _ in range(most)]
            for _ in range(rng.randint(0, 3)):
                if b:
                    b[rng.randrange(len(b))] = 9
            pairs.append((a, b[: len(a) + most]))
        size = np.array([len(a) for a, _ in pairs])
        wide = np.zeros((len(pairs), 12), np.uint32)
        text = np.full((len(pairs), 12 + most), 77, np.uint32)
        for k, (a, b) in enumerate(pairs):
            wide[k, : len(a)], text[k, : len(b)] = a, b
        want = [min(most + 1, distance(a, b + [77] * (12 + most - len(b)), True)) for a, b in pairs]
        assert leak.prefix_distance(wide, size, text, most).tolist() == want


def edited(text, edits, rng, kinds):
    out = list(text)
    for _ in range(edits):
        kind, k = rng.choice(kinds), rng.randrange(len(out))
        if kind == "replace":
            out[k] = "0"
        elif kind == "insert":
            out.insert(k, "1")
        else:
            del out[k]
    return "".join(out)


@pytest.mark.parametrize("kinds", [("replace",), ("insert",), ("delete",), ("replace", "insert", "delete")])
@pytest.mark.parametrize("edits", [0, 1, 2, 3, 5])
def test_recall_of_items_with_edits(edits, kinds):
    """Items with as many edits as are allowed, in the middle of other text: nine of ten at least are found, with their distance."""
    rng = random.Random(edits)
    size = max(leak.CHARS_PER_EDIT, leak.CHARS_PER_EDIT * edits)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    items = [(k, word(rng.randint(size, size + 30))) for k in range(200)]
    docs = [(k, word(rng.randint(0, 60)) + edited(t, edits, rng, kinds) + word(rng.randint(0, 60))) for k, t in items]
    got = matched(docs, items)
    found = {k: e for (d, k), (_, e) in got.items() if d == k and e >= 0}
    assert len(found) >= 0.9 * len(items) and all(e <= edits for e in found.values())


def test_items_found_whole_are_cases(spark):
    """The edit distance alone decides, and agrees with the count of the stretches."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(k, word(rng.randint(40, 160))) for k in range(60)]
    docs = [(k, word(20) + edited(t, rng.randint(0, len(t) // 40), rng, ("replace", "insert", "delete")) + word(20)) for k, t in items]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = leak.find_leaks(d, "doc_id", "text", i, "item_id", "text").collect()
    near = [r for r in rows if r.edits is not None]
    assert len(near) > 50 and all(2 * r.covered >= r.item_chars for r in near)
    frame = spark.createDataFrame([(0, 100, 2), (0, 100, 3), (0, 100, None), (50, 100, None), (0, 0, None)], "covered long, item_chars long, edits long")
    assert sorted((r.covered, r.edits) for r in leak.leaked(frame).collect() if r.edits) == [(0, 2)] and leak.leaked(frame).count() == 2
