"""Ranked lexical search by best positions.

One pass over the documents finds the terms that the items of a block ask for; document
frequencies and lengths are summed over all documents.  Documents are then taken shard by shard,
each a run of rows with a bounded number of postings, and every shard is searched by the Best
Position Algorithm: each term has its documents in the order of their impact.  All lists of an
item are read in step; a document that turns up is scored at once by direct access to every
list, and its places in them are marked.  A list's best position is the end of its unbroken run
of marked places, which lies beyond the last one read, so the threshold, the sum of the impacts
just behind the best positions, falls faster than one of last-read places.  A shard stops where
the threshold lies strictly below its k-th score, or nothing is left; so equal scores are never
cut off.  The best k of all shards hold the best k of all documents.

Words are told apart by 64-bit hashes and length.  Items are asked in blocks of a bounded number of terms, each
one pass over the documents; what goes through the driver is one block's terms.

Defined results: null and empty texts have no terms and are never found; every row is a document
of its own, rows without an id rank behind equal scores; rows of one ``item_id`` are one item
with the terms of all of them, and a null ``item_id`` is an item as well; an item without a
document above 0 has no rows; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.common import Scratch, ragged, slices, words_of

TOP = 10
#: Terms of one block of items, about; and postings of one shard.
BLOCK_TERMS = 200_000
SHARD_POSTINGS = 4_000_000
#: Places read of each list in a first step; every step reads twice as many as the last.
STEP = 16

SEPARATOR = np.zeros(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    SEPARATOR[_low : _high + 1] = True


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        words = words_of(texts, SEPARATOR)
        distinct, first = np.unique(np.stack([words.doc.astype(np.uint64), words.hash]), axis=1, return_index=True)
        rows = words.doc[first]
        yield pa.RecordBatch.from_arrays([
            batch.column("item_id").take(pa.array(rows)),
            pa.array(distinct[1].view(np.int64), pa.int64()),
            pa.array(words.end[first] - words.start[first], pa.int64()),
        ], ["item_id", "hash", "length"])


@dataclass
class Block:
    """Terms that the items of a block ask for, and which item asks for which."""

    hashes: np.ndarray  # ascending
    lengths: np.ndarray
    asked: list[np.ndarray]  # by item

    def find(self, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that are terms, and the term each is."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.lengths[at] == lengths))
        return hit, at[hit]


def _postings(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            words = words_of(texts, SEPARATOR)
            hit, term = block.find(words.hash, words.end - words.start)
            pair, tf = np.unique(words.doc[hit] * len(block.hashes) + term, return_counts=True)
            doc, term = np.divmod(pair, len(block.hashes))
            per = np.bincount(doc, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.bincount(words.doc, minlength=len(texts)), pa.int64()),
                ragged(term, per, pa.int32()), ragged(tf, per, pa.int64()),
            ], ["doc_id", "n", "terms", "tfs"])

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def _counts(terms: int):
    """Of each partition: documents by term, then at ``terms`` the documents with a term and at ``terms + 1`` their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms + 2, np.int64)
        for batch in batches:
            total[:terms] += np.bincount(_flat(batch.column("terms"))[0], minlength=terms)
            n = batch.column("n").to_numpy()
            total[terms:] += (n > 0).sum(), n.sum()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["slot", "amount"])

    return run


class Shard:
    """Impact lists of some documents, by term."""

    def __init__(self, weight: np.ndarray, norm: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray):
        """``norm`` is 8 * m of every document; postings come in the order of documents."""
        tf = tf.astype(np.int64)
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + norm[doc]))
        order = np.argsort(term, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.bounds = np.searchsorted(term[order], np.arange(len(weight) + 1))
        falling = np.lexsort((self.doc, -self.impact, term[order]))
        self.falling = falling  # places of the impact order, as indexes into doc and impact
        self.place = np.empty(len(falling), np.int64)
        self.place[falling] = np.arange(len(falling)) - self.bounds[term[order][falling]]

    def search(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores that hold the best ``k`` with all their ties; and how many were looked at."""
        spans = [(self.bounds[t], self.bounds[t + 1]) for t in terms]
        spans = [(a, b) for a, b in spans if b > a and self.impact[self.falling[a]] > 0]
        marked = [np.zeros(b - a, bool) for a, b in spans]
        best, depth, step = [0] * len(spans), 0, STEP
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while spans:
            read = [self.doc[self.falling[a + depth : min(b, a + depth + step)]] for a, b in spans]
            fresh = np.setdiff1d(np.concatenate(read), docs)
            score = np.zeros(len(fresh), np.int64)
            threshold = 0
            for i, (a, b) in enumerate(spans):
                at = np.searchsorted(self.doc[a:b], fresh)
                at[at == b - a] = 0
                hit = self.doc[a + at] == fresh
                at = a + at[hit]
                score[hit] += self.impact[at]
                marked[i][self.place[at]] = True
                best[i] = _run(marked[i], best[i])
                if best[i] < b - a:
                    threshold += int(self.impact[self.falling[a + best[i]]])
            docs, scores = np.concatenate([docs, fresh]), np.concatenate([scores, score])
            kth = np.partition(scores, -k)[-k] if len(scores) >= k else -1
            if threshold < kth or threshold == 0:
                break
            depth, step = depth + step, step * 2
        return docs, scores, len(docs)


def _run(marked: np.ndarray, start: int) -> int:
    """The first place from ``start`` on that is not marked."""
    while start < len(marked):
        window = marked[start : start + 4096]
        if not window.all():
            return start + int(window.argmin())
        start += len(window)
    return start


def _search(block: Block, weight: np.ndarray, count: int, length: int, k: int):
    def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        ids, n = whole.column("doc_id").combine_chunks(), whole.column("n").to_numpy()
        term, per = _flat(whole.column("terms").combine_chunks())
        tf, _ = _flat(whole.column("tfs").combine_chunks())
        norm = 8 * (100 - 90 + (90 * n * count) // length)
        lists = Shard(weight, norm, np.repeat(np.arange(len(n)), per), term, tf)
        missing, key = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
        items, rows, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for item, terms in enumerate(block.asked):
            doc, score, _ = lists.search(terms, k)
            doc, score = doc[score > 0], score[score > 0]
            top = np.lexsort((key[doc], missing[doc], -score))[:k]
            items.append(np.full(len(top), item))
            rows.append(doc[top])
            scores.append(score[top])
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate(items), pa.int64()), ids.take(pa.array(np.concatenate(rows))),
            pa.array(np.concatenate(scores), pa.int64())], ["item", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings = [], 0
        for batch in batches:
            held.append(batch)
            postings += len(batch.column("terms").flatten())
            if postings >= SHARD_POSTINGS:
                yield shard(held)
                held, postings = [], 0
        if held:
            yield shard(held)

    return run


def _blocks(items: DataFrame, scratch: Scratch) -> Iterator[tuple[list, Block]]:
    """The items as blocks of about ``BLOCK_TERMS`` terms."""
    terms = (items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
             .mapInArrow(_item_terms, "item_id long, hash long, length long").distinct())
    terms = scratch.write(terms, "items")
    many = -(-terms.count() // BLOCK_TERMS)
    for number in range(many):
        rows = (terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(many)) == number)
                .groupBy("item_id").agg(F.collect_list(F.struct("hash", "length")).alias("terms")).collect())
        if not rows:
            continue
        pairs = np.array([[t.hash, t.length] for r in rows for t in r.terms], np.int64)
        hashes, lengths = pairs[:, 0].copy().view(np.uint64), pairs[:, 1]
        known, first, term = np.unique(hashes, return_index=True, return_inverse=True)
        asked = np.split(term, np.cumsum([len(r.terms) for r in rows])[:-1])
        yield [r.item_id for r in rows], Block(known, lengths[first], asked)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best ``k`` documents of every item."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ranked")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for number, (ids, block) in enumerate(_blocks(items, scratch)):
        rows = texts.mapInArrow(_postings(block), "doc_id long, n long, terms array<int>, tfs array<long>")
        rows = scratch.write(rows, f"postings{number}")
        size = len(block.hashes)
        counts = np.zeros(size + 2, np.int64)
        for slot, amount in (rows.mapInArrow(_counts(size), "slot long, amount long")
                             .groupBy("slot").agg(F.sum("amount")).collect()):
            counts[slot] = amount
        count, length = int(counts[size]), int(counts[size + 1])
        if not length:
            continue
        weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(df) + 1))) for df in counts[:size]], np.int64)
        best = rows.mapInArrow(_search(block, weight, count, length, k), "item long, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")
        best = best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
        found = found.unionByName(scratch.write(best, f"found{number}"))
        scratch.drop(f"postings{number}")
    return found


RANKED_SQL = r"""
WITH w AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
d AS (SELECT r, doc_id, count(*) AS n FROM w GROUP BY r, doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM d),
m AS (SELECT r, doc_id, 100 - 90 + (90 * n * docs) // len AS m FROM d, s),
tf AS (SELECT r, term, count(*) AS tf FROM w GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wt AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, s),
sc AS (
  SELECT item_id, m.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN wt USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, m.r, doc_id),
rk AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM sc WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM rk WHERE rank <= 10
"""
