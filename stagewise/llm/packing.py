"""Packing documents into sequences by minimum bin slack.

Pieces of one length can stand for each other, so bins are planned on the histogram of
lengths (at most ``capacity`` numbers, whatever the corpus) and not on documents.  A bin takes
the longest length left, and a subset-sum dynamic program over a bitset finds the fullest
combination of the others; the combination is removed as often as the counts allow.  Every
piece then finds its place from its rank among pieces of its length: counts per written part
and length are summed up into offsets, so no length, however common, meets in one task.

The plan has at most a few combinations per length, each of under ``sqrt(2 * capacity)``
different lengths, which bounds what is sent to the tasks.

Defined results: null and empty texts give the end id alone; a text longer than the capacity
is cut into full pieces and one rest; rows without an id and repeated ids are packed like any
other row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.common import Scratch, slices, small_batches
from stagewise.llm.encode import TEXT_BYTES, encoder

CAPACITY = 4096
#: The counts by part and length are broadcast up to so many rows of 24 bytes, and joined by a shuffle beyond.
SMALL_ROWS = 1_000_000


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """The fullest combination of at most ``room``; ``lengths`` in descending order."""
    reach, mask, taken = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        left = min(counts[length], room // length)
        copies = 1
        while left > 0:
            copies = min(copies, left)
            taken.append((reach, length, copies))
            reach |= (reach << (length * copies)) & mask
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    fill, chosen = reach.bit_length() - 1, {}
    for before, length, copies in reversed(taken):
        if not before >> fill & 1:
            chosen[length] = chosen.get(length, 0) + copies
            fill -= length * copies
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``(how many bins, copies of each length in such a bin)``, until no piece is left."""
    counts, plan = {k: v for k, v in histogram.items() if v}, []
    lengths = sorted(counts, reverse=True)
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        room = capacity - longest
        chosen = fullest(room, [x for x in lengths if x <= room and counts[x]], counts)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in chosen.items())
        for x, n in chosen.items():
            counts[x] -= n * times
        plan.append((times, chosen))
        lengths = [x for x in lengths if counts[x]]
    return plan


def _pieces(path: str, end_id: int, capacity: int):
    closing = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, ranks = encoder(path).flat, TaskContext.get().partitionId(), {}
        for batch, texts in slices(batches, most=TEXT_BYTES):
            rows, begin = [], 0
            ids, ends = encode(texts)
            for doc, end in zip(batch.column("doc_id").to_pylist(), ends.tolist()):
                own, begin = ids[begin:end].tobytes() + closing, end
                for piece, at in enumerate(range(0, len(own), 4 * capacity)):
                    data = own[at : at + 4 * capacity]
                    length = len(data) // 4
                    rank = ranks.get(length, 0)
                    ranks[length] = rank + 1
                    rows.append((doc, piece, at // 4, length, zlib.crc32(data), data, part, rank))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "rank"])

    return cut


_CUT = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, rank long"


def _places(plan: list[tuple[int, dict[int, int]]], capacity: int):
    """From length and rank to sequence and offset: ranks of a length are dealt to bins in plan order."""
    rows, first = {}, 0
    for times, chosen in plan:
        offset = 0
        for length in sorted(chosen, reverse=True):
            own = rows.setdefault(length, [[0], [], [], []])
            own[0].append(own[0][-1] + times * chosen[length])
            own[1].append(first)
            own[2].append(chosen[length])
            own[3].append(offset)
            offset += length * chosen[length]
        first += times
    order = sorted(rows)
    # one array over all lengths; a length's ranks are moved past those of the shorter ones
    base, ends, total = np.zeros(capacity + 1, np.int64), [], 0
    for length in order:
        base[length] = total
        ends.append(total + np.array(rows[length][0][1:], np.int64))
        total += rows[length][0][-1]
    begins = np.concatenate([np.zeros(0, np.int64), *(total_base + np.array(rows[x][0][:-1], np.int64)
                                                      for x, total_base in ((x, base[x]) for x in order))])
    ends = np.concatenate([np.zeros(0, np.int64), *ends])
    sequence, copies, offset = (np.concatenate([np.zeros(0, np.int64), *(np.array(rows[x][i], np.int64) for x in order)])
                                for i in (1, 2, 3))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        size = length.to_numpy(zero_copy_only=False)
        at = base[size] + rank.to_numpy(zero_copy_only=False)
        i = np.searchsorted(ends, at, "right")
        within = at - begins[i]
        return pa.StructArray.from_arrays(
            [pa.array(sequence[i] + within // copies[i]), pa.array(offset[i] + within % copies[i] * size)],
            ["sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset`` of every piece."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.write(rows.mapInArrow(_pieces(tokenizer, end_id, capacity), _CUT), "pieces", compression="zstd")

    # one row per part and length; counted again where it is read, as a file per shuffle partition costs more
    counted = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    found = counted.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).collect()
    place = _places(plan_bins({r.length: r.n for r in found}, capacity), capacity)
    earlier = Window.partitionBy("length").orderBy("part")
    before = counted.select("part", "length", (F.sum("n").over(earlier) - F.col("n")).alias("before"))
    if sum(r.parts for r in found) <= SMALL_ROWS:
        before = F.broadcast(before)
    ranked = pieces.join(before, ["part", "length"]).withColumn("at", place("length", F.col("rank") + F.col("before")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "ids",
                         F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))
