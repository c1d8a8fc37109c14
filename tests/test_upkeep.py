from pathlib import Path
import random

import pytest

from foliant.operators.orphans import PARENTS, REFERENCES, PendingOrphans, library_batches, probe
from foliant.plans import skew
from foliant.plans.commit import read_pointer, write_pointer
from foliant.plans.skew import bounded_lookup, heavy_keys, salted_join, salted_lookup
from foliant.streaming.incremental import Manifest, present_files, replay_builds


@pytest.fixture()
def folder(tmp_path):
    return f"file://{tmp_path}"


def listing(spark, **files):
    return spark.createDataFrame([(k, v, len(v)) for k, v in files.items()] or [], "id string, mtime string, size long")


def changes(manifest, batch):
    return sorted((r.id, r.change) for r in manifest.changes(batch).collect())


def test_pointer(spark, folder):
    path = f"{folder}/deep/P.json"
    assert read_pointer(spark, path) is None
    for k in (1, 2):
        write_pointer(spark, path, {"k": k, "名": "字"})
        assert read_pointer(spark, path) == {"k": k, "名": "字"}


def test_manifest_runs(spark, folder):
    m = Manifest(spark, folder, ["mtime", "size"])
    m.run(listing(spark, a="1", b="1"), "b1")
    assert changes(m, "b1") == [("a", "new"), ("b", "new")]
    m.run(listing(spark, a="1", b="22", c="1"), "b2")
    assert changes(m, "b2") == [("b", "changed"), ("c", "new")]
    m.run(listing(spark, c="1"), "b3")
    assert changes(m, "b3") == [("a", "gone"), ("b", "gone")]
    m.run(listing(spark), "b4")
    assert changes(m, "b4") == [("c", "gone")] and all(m.committed(f"b{k}") for k in (1, 2, 3, 4)) and not m.committed("b5")


def test_manifest_pointer_stays_small(spark, folder, monkeypatch):
    monkeypatch.setattr(Manifest, "MOST_DELTAS", 2)
    m = Manifest(spark, folder, ["mtime", "size"])
    for k in range(5):
        m.run(listing(spark, a=str(k), b="1", **{f"n/{k}": "1"}), f"b {k}/x")
        assert len(m._pointer()["batches"]) < 2
        assert sorted(r.id for r in m.files().collect()) == ["a", "b", f"n/{k}"]
    assert changes(m, "b 4/x") == [("a", "changed"), ("n/3", "gone"), ("n/4", "new")]
    assert all(m.committed(f"b {k}/x") for k in range(5))
    m.run(listing(spark), "b 0/x")  # committed long ago
    assert m.files().count() == 3
    assert len(list(Path(folder.removeprefix("file://"), "base").iterdir())) == 1


def test_failure_before_commit_skips_and_repeats_nothing(spark, folder):
    m = Manifest(spark, folder, ["mtime", "size"])
    m.run(listing(spark, a="1"), "b1")
    m.prepare(listing(spark, a="2", z="1"), "b2")  # fails here
    assert m.committed("b1") and not m.committed("b2")
    m.run(listing(spark, a="2", c="1"), "b3")
    assert changes(m, "b3") == [("a", "changed"), ("c", "new")]
    m.run(listing(spark, a="3", c="1"), "b2")  # the failed batch comes again
    assert changes(m, "b2") == [("a", "changed")]
    before = changes(m, "b2")
    m.run(listing(spark, q="9"), "b2")  # committed already
    assert changes(m, "b2") == before


def test_nulls_in_state(spark, folder):
    m = Manifest(spark, folder, ["mtime", "size"])
    rows = lambda *r: spark.createDataFrame(list(r), "id string, mtime string, size long")
    m.run(rows(("a", None, 1), ("b", "x", None)), "1")
    m.run(rows(("a", None, 1), ("b", None, None)), "2")
    assert changes(m, "2") == [("b", "changed")]


def test_present_files(spark):
    rows = [("a", 1, False, 1), ("a", 2, None, 5), ("b", 1, False, 1), ("b", 2, True, 2), ("c", 7, None, None), (None, 1, False, 1), ("d", 1, False, 3), ("d", 1, False, 3)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "id string, size int, isDeleted boolean, seen_at int, last string")
    assert sorted((r.id, r.size) for r in present_files(frame, "id", "seen_at", "isDeleted", ["size"]).collect()) == [("a", 2), ("c", 7), ("d", 1)]


def test_replay_against_brute_force(spark, folder):
    rng = random.Random(4)
    status = {1: "failed", 2: "ok", 3: "cancelled", 4: "ok", 5: "ok", 6: "failed", 7: "ok"}
    scans = [(r, f"f{rng.randrange(30)}", rng.randint(1, 2), rng.choice([1, None]), rng.choice(["pdf", "PDF"]), rng.choice([True, False, None]), t) for r in status if r != 5 for t in range(40)]
    frame = spark.createDataFrame(scans, "run_no int, id string, mtime long, size long, ext string, isDeleted boolean, seen_at long")
    builds = spark.createDataFrame(list(status.items()), "run_no int, status string")
    want, previous = set(), None
    for r in sorted(k for k, s in status.items() if s == "ok"):
        last = {x[1]: x for x in sorted((x for x in scans if x[0] == r), key=lambda x: x[6])}
        state = {k: (x[2], x[3], x[4].lower()) for k, x in last.items() if not x[5]}
        if previous is not None:
            want |= {(r, k) for k in state.keys() | previous.keys() if state.get(k) != previous.get(k)}
        previous = state
    assert {(x.run_no, x.id) for x in replay_builds(frame, builds, folder).collect()} == want
    assert replay_builds(frame, builds.limit(0), folder + "/none").collect() == []


def refs(spark, *rows):
    return spark.createDataFrame([(s, k, "item", r, None, "2020-01") for s, k, r in rows], REFERENCES)


def parents(spark, *rows):
    import datetime as dt

    gone = dt.datetime(2021, 1, 1)
    return spark.createDataFrame([("item", r, None, None if alive else gone) for r, alive in rows], PARENTS)


def keys(frame):
    return sorted((r.src_key, r.ref) for r in frame.collect())


def test_orphans_wait_resolve_and_reopen(spark, folder):
    state = PendingOrphans(spark, folder)
    assert keys(state.state().pending) == []
    assert keys(state.apply(refs(spark, ("d", "1", "a"), ("d", "2", "b"), ("d", "2", "b"), ("d", "3", None)), parents(spark, ("a", True)))) == [("2", "b")]
    assert keys(state.apply(refs(spark), parents(spark, ("b", True)))) == []
    assert keys(state.apply(refs(spark, ("d", "4", "c")), parents(spark, ("a", False)))) == [("1", "a"), ("4", "c")]
    assert [(r.src, r.period, r.n_references, r.n_orphans) for r in state.snapshot().collect()] == [("d", "2020-01", 3, 2)]
    assert keys(state.apply(refs(spark), parents(spark, ("a", True), ("c", True)))) == []


def test_orphans_incremental_equals_full(spark, folder):
    """Batches with arrivals, deletions and replaced references; buckets that no batch touches stay where they are."""
    rng = random.Random(8)
    state = PendingOrphans(spark, folder + "/inc", buckets=5)
    alive, every = {}, {}
    for _ in range(3):
        new = {(str(rng.randrange(60)), f"p{rng.randrange(12)}") for _ in range(20)}
        moved = {f"p{rng.randrange(12)}": rng.random() < 0.6 for _ in range(5)}
        gone = {str(rng.randrange(60)) for _ in range(15)}
        alive |= moved
        every = {x: None for x in every if x[0] not in gone} | {x: None for x in new}
        replaced = spark.createDataFrame([("d", k) for k in gone], "src string, src_key string")
        pending = keys(state.apply(refs(spark, *(("d", *x) for x in new)), parents(spark, *moved.items()), replaced))
        assert pending == sorted((k, r) for k, r in every if not alive.get(r))
        assert keys(state.state().references) == sorted(every)
    before = state._pointer()["parts"]
    state.apply(refs(spark, ("d", "1", "p1")), parents(spark))
    after = state._pointer()["parts"]
    assert all(len(set(after[t].items()) - set(before[t].items())) <= 1 for t in after)
    assert not state.apply(refs(spark), parents(spark, *((f"p{k}", True) for k in range(12)))).count()


def test_library_batches_in_order(spark, folder):
    """Items that move, are deleted and come back, folders removed before and after, texts that come before their item."""
    import datetime as dt

    ms = lambda y, m=6: int(dt.datetime(y, m, 1, tzinfo=dt.UTC).timestamp() * 1000)
    d = lambda y, m=6: dt.datetime(y, m, 1)
    metadata = [("a", ["f"], False, ms(2015)), ("a", ["g", None, "g"], False, ms(2021)), ("b", ["f"], True, ms(2020)), ("b", ["f"], False, ms(2022)), ("c", ["f"], False, ms(2020)), ("c", [], True, ms(2021)), ("n", ["f"], None, None), (None, ["f"], False, ms(2020))]
    folders = [("f", d(2014), d(2021, 1)), ("g", d(2021, 7), None), ("f", d(2022, 7), None), ("x", None, None)]
    docs = [(1, "a", ms(2015)), (2, "b", ms(2015)), (3, "c", ms(2020)), (4, None, ms(2020)), (5, "z", None)]
    texts = [(1, "b", d(2015)), (2, "n", d(2020)), (3, None, None)]
    frames = (
        spark.createDataFrame(metadata, "id string, folders array<string>, isDeleted boolean, modificationTime long"),
        spark.createDataFrame(docs, "idx long, id string, addedAt long"),
        spark.createDataFrame(texts, "doc_id long, item_id string, added_at timestamp_ntz"),
        spark.createDataFrame(folders, "id string, created_at timestamp_ntz, removed_at timestamp_ntz"),
    )
    state, seen = PendingOrphans(spark, folder, 3), []
    for batch in library_batches(*frames, years=3):
        seen.append(sorted((r.src, r.src_key, r.ref) for r in state.apply(*batch).collect()))
    ever = [("docs", "5", "z"), ("metadata", "n", "f")]
    assert seen == [
        sorted([*ever, ("docs", "2", "b"), ("documents", "1", "b")]),
        sorted([*ever, ("docs", "2", "b"), ("documents", "1", "b")]),
        sorted([*ever, ("docs", "2", "b"), ("documents", "1", "b"), ("docs", "3", "c"), ("metadata", "a", "g")]),
        sorted([*ever, ("docs", "3", "c"), ("metadata", "a", "g"), ("metadata", "b", "f")]),
    ]


def test_lifetimes(spark):
    import datetime as dt

    d = lambda y: dt.datetime(y, 1, 1)
    p = spark.createDataFrame([("folder", "f", d(2000), d(2005)), ("folder", "f", d(2010), None)], PARENTS)
    r = spark.createDataFrame([("m", str(y), "folder", "f", d(y), None) for y in (1999, 2000, 2004, 2005, 2007, 2010, 2020)] + [("m", "x", "item", "f", d(2020), None)], REFERENCES)
    assert sorted(x.src_key for x in probe(r, p).collect()) == ["1999", "2005", "2007", "x"]


def test_skewed_joins(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_HEAVY", 1)
    rng = random.Random(1)
    left = spark.createDataFrame([(k, "hot" if rng.random() < 0.4 else f"k{rng.randrange(500)}" if k % 7 else None) for k in range(3000)], "n long, k string")
    look = left.filter("k is not null").groupBy("k").count().filter("k <> 'k3'")
    plain = sorted(map(tuple, left.join(look, "k").select("n", "k", "count").collect()))
    assert sorted(map(tuple, salted_lookup(left, look, ["k"], "count", 8, ["n"]).select("n", "k", "count").collect())) == plain
    assert sorted(map(tuple, bounded_lookup(left, look, ["k"], 1 << 30).select("n", "k", "count").collect())) == plain
    outer = salted_lookup(left, look, ["k"], salts=8, how="left")
    assert outer.count() == 3000 and outer.filter("count is null").count() == left.filter("k is null or k = 'k3'").count()
    assert heavy_keys(look, "count", 0.3).count() == 1
    both = left.select("k", (left.n % 5).alias("m")).distinct()
    plain = sorted(map(tuple, left.join(both, "k").select("n", "k", "m").collect()))
    for least in (1, 10**6):
        monkeypatch.setattr(skew, "LEAST_HEAVY", least)
        assert sorted(map(tuple, salted_join(left, both, ["k"], ["n"], 8).select("n", "k", "m").collect())) == plain
