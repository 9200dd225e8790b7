"""Benchmark decontamination by greedy string tiling.

Tokens are lower-case runs of letters and digits.  Runs of ``SEED`` tokens that a text shares
with a benchmark item are the join; what they seed is tiled: again and again the longest match
that is not marked yet, found by the rolling hashes and lengthened along its diagonal, is marked
in both, down to ``SEED`` tokens.  A text that covers ``COVERAGE`` of an item's tokens, in
whatever order its passages stand, is contaminated.

The benchmark is taken in blocks of at most ``BLOCK_BYTES`` of text, each collected and sent to
the tasks; every block meets all texts, whose own pass is narrow, and the worst item per text is
kept.  So its size may grow, and what is broadcast does not.

Defined results: null and empty texts, and null, empty or token-free items match nothing; an
item of fewer than ``SEED`` tokens has to be found whole; of items covered alike the smallest id
is named; rows without an id and repeated ids are judged row by row; an empty benchmark
contaminates nothing; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import Words, grams, pieces, words_of

SEED = 5
COVERAGE = 0.5
BLOCK_BYTES = 16 << 20

_SPLIT = np.ones(256, bool)
_SPLIT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def token_hashes(texts: list[str]) -> tuple[np.ndarray, Words]:
    """Text index of every token, and the tokens."""
    words = words_of([t.lower().encode() for t in texts], _SPLIT)
    return words.doc, words


class Index(NamedTuple):
    ids: list[int]
    tokens: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # run length -> sorted hashes, item, place


def build_index(items: list[tuple[int, str]]) -> Index:
    items = sorted((i, t) for i, t in items if i is not None and t)
    doc, words = token_hashes([t for _, t in items]) if items else (np.zeros(0, int), None)
    many = np.bincount(doc, minlength=len(items)) if items else np.zeros(0, int)
    first = np.cumsum(many) - many
    seeds = {}
    for k in sorted({min(SEED, int(n)) for n in many if n}):
        hashes, at = grams(words, k)
        own = doc[at]
        fits = (many[own] == k) | (k == SEED)
        hashes, at, own = hashes[fits], at[fits], own[fits]
        order = np.argsort(hashes, kind="stable")
        seeds[k] = hashes[order], own[order], (at - first[own])[order]
    return Index([i for i, _ in items], [words.hash[f : f + n] for f, n in zip(first, many)], seeds)


def tile(matches: list[tuple[int, int, int]], least: int) -> int:
    """Tokens covered by greedy tiling; ``matches`` are maximal ``(length, text place, item place)``.

    A match that lost tokens to longer ones comes back as the runs that are left of it.
    """
    heap = [(-n, a, b) for n, a, b in matches]
    heapq.heapify(heap)
    text_marked, item_marked, covered = set(), set(), 0
    while heap:
        n, a, b = heapq.heappop(heap)
        free = [a + i not in text_marked and b + i not in item_marked for i in range(-n)]
        if all(free):
            text_marked.update(range(a, a - n))
            item_marked.update(range(b, b - n))
            covered -= n
            continue
        start = None
        for i, ok in enumerate([*free, False]):
            if ok and start is None:
                start = i
            elif not ok and start is not None:
                if i - start >= least:
                    heapq.heappush(heap, (start - i, a + start, b + start))
                start = None
    return covered


def worst_items(texts: list[str], index: Index) -> list[tuple[float, int | None]]:
    """Per text the largest coverage and the item it is of."""
    found: list[tuple[float, int | None]] = [(0.0, None)] * len(texts)
    if not index.ids or not any(texts):
        return found
    doc, words = token_hashes(texts)
    first = np.searchsorted(doc, np.arange(len(texts)))
    diagonals: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for k, (hashes, items, places) in index.seeds.items():
        own, at = grams(words, k)
        low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
        for i in np.flatnonzero(high > low).tolist():
            d = int(doc[at[i]])
            p = int(at[i] - first[d])
            for j in range(low[i], high[i]):
                diagonals[d, int(items[j])][p - int(places[j])].append(p)
    for (d, item), lines in sorted(diagonals.items()):
        size = len(index.tokens[item])
        k, matches = min(SEED, size), []
        for shift, starts in lines.items():
            begin = last = starts[0]
            for p in [*starts[1:], None]:
                if p is None or p != last + 1:
                    matches.append((last - begin + k, begin, begin - shift))
                    begin = p
                last = p
        coverage = tile(matches, k) / size
        if coverage > found[d][0]:
            found[d] = coverage, index.ids[item]
    return found


def _blocks(benchmark: DataFrame) -> list[Index]:
    """The benchmark in blocks of a bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id"), F.lit(count))
    return [build_index([(r.item_id, r.text) for r in items.filter(block == i).collect()]) for i in range(count)]


def _judge(index):
    def judge(text: pa.Array) -> pa.Array:
        out = []
        for begin, end in pieces(text):
            out += worst_items([t or "" for t in text.slice(begin, end - begin).to_pylist()], index.value)
        return pa.StructArray.from_arrays(
            [pa.array([c for c, _ in out], pa.float64()), pa.array([i for _, i in out], pa.int64())], ["coverage", "item_id"])

    return judge


def worst_match(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> Column:
    """A column with ``coverage`` and ``item_id`` of the worst item for a text column of ``docs``."""
    context = docs.sparkSession.sparkContext
    found = []
    for index in _blocks(benchmark):
        udf = F.arrow_udf(_judge(context.broadcast(index)), "struct<coverage: double, item_id: long>").asNondeterministic()
        found.append(udf(F.col(text).cast("string")))
    best = found[0]
    for other in found[1:]:
        larger = (other["coverage"] > best["coverage"]) | ((other["coverage"] == best["coverage"]) & (other["item_id"] < best["item_id"]))
        best = F.when(larger, other).otherwise(best)
    return best


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, coverage, contaminated, kept`` of every row of ``docs``."""
    judged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    judged = judged.select("doc_id", worst_match(judged, benchmark).alias("worst"))
    found = judged.select("doc_id", F.col("worst.item_id").alias("item_id"), F.col("worst.coverage").alias("coverage"))
    bad = F.col("coverage") >= COVERAGE
    return found.select("doc_id", "item_id", "coverage", bad.alias("contaminated"), (~bad).alias("kept"))
