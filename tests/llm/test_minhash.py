from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stagewise.llm import minhash
from stagewise.llm.common import words_of

from .conftest import ODD_ROWS, words


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    for a, b in {(a, b) for group in by.values() for a in group for b in group if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def result(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame).collect()}


def test_groups_chains_and_shared_passages(documents):
    r, rows = random.Random(3), []
    base = words(5, 120)
    rows.append((50, " ".join(base)))
    for i in range(60):  # near copies of one text, some beyond the threshold
        copy = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 6])):
            copy[r.randrange(len(copy))] = f"x{r.random():.9f}"
        rows.append((100 + i, " ".join(copy)))
    chain = list(base)
    for i in range(12):  # each step is near the last, not the first
        chain = chain[4:] + words(900 + i, 4)
        rows.append((300 - i, " ".join(chain)))
    passage = words(6, 60)
    rows += [(400 + i, " ".join(words(1000 + i, 50) + passage)) for i in range(40)]
    rows += [(600 + i, "Exactly   the SAME words, again and again, here") for i in range(30)]
    rows += [(700, "a b"), (701, "A\tb"), (702, "a b c"), (703, ""), (704, None)]
    assert result(documents(rows)) == brute(rows)


def test_odd_rows(documents):
    got = minhash.near_duplicates(documents(ODD_ROWS)).collect()
    assert len(got) == len(ODD_ROWS)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == by[2][:0] + [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert by[4] == [(1, 4, True)] and by[5] == [(1, 4, False)]
    assert by[None] == [(2, None, True)] and by[6] == [(2, 6, True)]
    assert {c for _, c, _ in by[7]} == {7}


def test_empty_table(documents):
    assert minhash.near_duplicates(documents([])).collect() == []


def test_repeated_ids_join_their_classes(documents):
    rows = [(5, "p q r s t u v"), (9, "p q r s t u v"), (9, "k l m n o p q w"), (12, "k l m n o p q w")]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(documents(rows)).collect()}
    assert got == {(5, 5), (9, 5), (12, 5)}


def test_large_buckets_are_cut_into_cells(documents, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 3)
    base, rows = words(8, 80), []
    for i in range(30):
        copy = list(base)
        for j in range(1 + i % 5):
            copy[(7 * i + 11 * j) % 80] = f"y{i}z{j}"
        rows.append((1000 - i, " ".join(copy)))
    assert result(documents(rows)) == brute(rows)


def test_pairs_at_the_threshold_are_not_lost_to_signatures():
    chance = sum(math.comb(400, i) * 0.75**i * 0.25 ** (400 - i) for i in range(minhash.AGREE))
    assert chance < 1e-7  # the banding loses 2e-5


def _cell(rows, full):
    return minhash._compare(pa.table({k: [r[k] for r in rows] for k in rows[0]}), pa.table({k: [r[k] for r in full] for k in full[0]}))


def _member(i, c, left, n=100):
    return {"key": 5 << 32, "ub": 0, "kb": 0, "n": n, "c": c, "main": 1, "id": i, "v": 0, "left": left, "right": True}


def test_pairs_below_the_mean_of_the_signatures_meet_their_sets():
    one, two = np.zeros(400, np.uint8), np.zeros(400, np.uint8)
    two[:145] = 1  # 255 values agree
    full = [{"own": i, "version": 0, "signature": s.tobytes(), "short": [5] * 40, "shingles": list(range(f, f + 100))}
            for i, s, f in ((1, one, 0), (2, two, 14))]  # 86 common of 114
    assert _cell([_member(1, 1, False), _member(2, 2, True)], full).to_pylist() == [{"a": 1, "b": 2}]
    full[1]["shingles"] = list(range(15, 115))  # 85 of 115
    assert _cell([_member(1, 1, False), _member(2, 2, True)], full).num_rows == 0


def test_a_cell_gives_fewer_links_than_members():
    """All pairs of 90 texts are near: one link joins each to the rest, whatever number of buckets they share."""
    full = [{"own": i, "version": 0, "signature": bytes(400), "short": list(range(5, 45)), "shingles": list(range(100))} for i in range(1, 91)]
    rows = [{**_member(i, i, i > 1), "key": k << 32, "main": 1} for i in range(1, 91) for k in range(5, 9)]
    got = _cell(rows, full).to_pylist()
    assert len(got) == 89 and {x for r in got for x in r.values()} == set(range(1, 91))


def _chain(spark, first, last):
    return spark.range(first, last).selectExpr("id AS a", "id + 1 AS b")


def test_long_chains_of_links_end_in_few_turns(shipped, monkeypatch):
    names, write = [], minhash.Scratch.write
    monkeypatch.setattr(minhash.Scratch, "write", lambda self, frame, name, **o: names.append(name) or write(self, frame, name, **o))
    got = minhash.components(_chain(shipped, 1, 60).union(_chain(shipped, 100, 130)), minhash.Scratch(shipped, "test"), "cc").collect()
    assert {r.id: r.component for r in got} == {i: 1 if i <= 60 else 100 for i in [*range(1, 61), *range(100, 131)]}
    assert len(got) == 91 and len(names) < 20


def test_copies_and_settled_texts_make_no_links(documents, monkeypatch):
    """Only representatives are linked; components that grow together later are linked by their ids alone."""
    seen, real = [], minhash.components
    monkeypatch.setattr(minhash, "components", lambda edges, *rest: seen.append({x for r in edges.collect() for x in r}) or real(edges, *rest))
    base = words(41, 80)
    near = lambda *at: " ".join("q%d" % i if i in at else w for i, w in enumerate(base))
    rows = [(10, near()), (20, near(5)), *((100 + i, near()) for i in range(30))]
    assert result(documents(rows)) == brute(rows)
    assert seen == [{10, 20}]


def test_many_partitions_make_few_tasks(documents, shipped):
    """Every shuffle is a task per partition, however few the rows are."""
    base, rows = words(42, 80), []
    for i in range(40):
        rows.append((i, " ".join("y%dz%d" % (i, j) if j % 40 == i % 40 or j == 7 * i % 80 else w for j, w in enumerate(base))))
    rows += [(100 + i, " ".join(base)) for i in range(10)]
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: shipped.conf.get(k) for k in settings}
    context, tracker = shipped.sparkContext, shipped.sparkContext.statusTracker()
    try:
        for k, v in settings.items():
            shipped.conf.set(k, v)
        context.setJobGroup("minhash-tasks", "tasks of one call")
        assert result(documents(rows)) == brute(rows)
        stages = {s for job in tracker.getJobIdsForGroup("minhash-tasks") for s in tracker.getJobInfo(job).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            shipped.conf.set(k, v)
    assert 0 < tasks < 1000


def test_texts_of_one_id_are_all_looked_at(documents):
    """The second text of an id is near to others that its first is not."""
    one, two = words(31, 100), words(32, 100)
    near = lambda w, j: " ".join([f"q{j}" if i == 11 * j % 100 else x for i, x in enumerate(w)])
    rows = [(50, " ".join(one)), (50, " ".join(two)), (60, near(one, 1)), (61, near(two, 2)), (62, near(two, 3))]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(documents(rows)).collect()}
    assert got == {(50, 50), (60, 50), (61, 50), (62, 50)}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB é\n\t\x0b\x1c 😀.")), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    found = words_of([t.encode() for t in texts]) if texts else None
    if texts:
        want = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))]
        got = [(int(d), found.data[a:b].tobytes().decode()) for d, a, b in zip(found.doc, found.start, found.end)]
        assert got == want
        same = defaultdict(set)
        for (_, w), h in zip(want, found.hash):
            same[w].add(int(h))
        assert all(len(v) == 1 for v in same.values()) and len({h for v in same.values() for h in v}) == len(same)


def test_min_and_max_estimate_similarity():
    a = np.unique(np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    b = np.unique(np.arange(250, 1250, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x, y = minhash.signatures([a, b])
    assert abs((x == y).mean() - 0.6) < 0.1
