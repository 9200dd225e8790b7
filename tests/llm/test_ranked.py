from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stagewise.llm import ranked
from stagewise.llm.ranked import Shard, ranked_search

from .conftest import ODD_ROWS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t, *_ in rows]
    size = [sum(b.values()) for _, b in bags]
    count, length = sum(n > 0 for n in size), sum(size)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, want in asked.items():
        scored = []
        for (doc, bag), n in zip(bags, size):
            m = 100 - 90 + (90 * n * count) // length if n else 0
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in want if bag[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, count):
    r = random.Random(seed)
    names = [f"w{i}" for i in range(60)]
    return [(i, " ".join(r.choices(names, weights=[1 / (j + 1) for j in range(60)], k=r.randint(0, 60)))) for i in range(count)]


def result(docs, items, k=10):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search(docs, items, k).collect()), key=repr)


def asked(spark, items):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id long, score long")


def test_all_documents_by_shards_and_blocks(documents, shipped, monkeypatch):
    rows = corpus(1, 700) + [(5000 + i, "w1 w40 w59") for i in range(40)]  # ties by the dozen
    items = [(i, " ".join(f"W{(i * 7 + j * j) % 64}" for j in range(12))) for i in range(20)] + [(50, "w1, w40; w59!")]
    for postings, block in ((4_000_000, 200_000), (500, 40)):
        monkeypatch.setattr(ranked, "SHARD_POSTINGS", postings)
        monkeypatch.setattr(ranked, "BLOCK_TERMS", block)
        assert result(documents(rows).repartition(3), asked(shipped, items)) == brute(rows, items)


def test_odd_rows(documents, shipped):
    rows = ODD_ROWS + [(None, "one two"), (4, "one two"), (9, "naïve NAÏVE naÏve a\x00b x-y_z")]
    items = [(1, None), (2, ""), (3, "One two"), (3, "three"), (None, "naïve b"), (5, "Ïx absent"), (6, "naÏve y"), (7, "one"), (7, "one")]
    got = result(documents(rows), asked(shipped, items))
    assert got == brute(rows, items) and {g[0] for g in got} == {None, 3, 6, 7}
    ranks = [g[1] for g in got if g[0] == 3]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))


def test_empty_tables(documents, shipped):
    assert result(documents([]), asked(shipped, [(1, "a")])) == []
    assert result(documents([(1, "a")]), asked(shipped, [])) == []
    assert result(documents([(1, None), (2, "--")]), asked(shipped, [(1, "a")])) == []


def shard(seed, docs, lists):
    r = np.random.default_rng(seed)
    dense = r.random((docs, lists)) < 0.6
    doc, term = np.nonzero(dense)
    return Shard(r.integers(0, 5000, lists), r.integers(80, 2000, docs), doc, term, r.integers(1, 9, len(doc)))


def full_scores(lists, terms):
    total = Counter()
    for t in terms:
        for at in range(lists.bounds[t], lists.bounds[t + 1]):
            total[int(lists.doc[at])] += int(lists.impact[at])
    return total


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(1, 8), st.integers(1, 12))
def test_a_stop_holds_the_best_with_all_ties(seed, docs, lists, k):
    index = shard(seed, docs, lists)
    want = full_scores(index, range(lists))
    doc, score, _ = index.search(np.arange(lists), k)
    assert all(want[int(d)] == s for d, s in zip(doc, score)) and len(set(doc)) == len(doc)
    cut = sorted(want.values(), reverse=True)[:k]
    if cut and cut[-1] > 0:
        assert {d for d, s in want.items() if s >= cut[-1]} <= set(map(int, doc))


def test_it_stops_early_and_not_at_an_equal_threshold():
    n = 20_000
    tf = np.ones(2 * n, np.int64)
    doc, term = np.repeat(np.arange(n), 2), np.tile([0, 1], n)
    index = Shard(np.array([10, 10]), np.arange(80, 80 + 8 * n, 8), doc, term, tf)
    assert index.search(np.array([0, 1]), 5)[2] < 100
    level = Shard(np.array([10, 10]), np.full(n, 80), doc, term, tf)  # all scores are equal: none may be left out
    assert level.search(np.array([0, 1]), 5)[2] == n


def test_best_positions_lie_beyond_the_last_read():
    """Direct access marks places that were not read: the second list is never read to the end of its run."""
    marked = np.array([True] * 9000 + [False, True])
    assert ranked._run(marked, 3) == 9000 and ranked._run(marked, 9001) == 9002
