"""Token ids as files coded with a static range asymmetric numeral system.

A *segment* holds one shared frequency table and independent blocks.  A block holds whole
documents: their ids and lengths, the lanes' states, checkpoints and the coded words, each
under a checksum.  Token ``t`` of a block belongs to lane ``t % LANES``; all lanes take a
step at once.  A checkpoint has the states and the place in the coded words before its step,
so parts of a block can be decoded side by side.

The files are Parquet containers with one segment per row, written by Spark's committer in
ascending order of id: file ``part`` of the table has the ids of its range of documents.

Defined results: null texts have the end id only; rows without an id come first; rows that
repeat an id each keep their own ids, ordered by text; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.common import Scratch, slices, small_batches
from stagewise.llm.encode import TEXT_BYTES, encoder

LANES = 2048
BITS = 20  # of the sum of a table's frequencies
LOW = np.uint64(1 << 31)
BLOCK_TOKENS, SEGMENT_TOKENS = 1 << 18, 1 << 22
CHECKPOINT_STEPS = 64
MAGIC = b"SWRANS01"
_W, _B, _M = np.uint64(32), np.uint64(BITS), np.uint64((1 << BITS) - 1)


class DamagedFile(ValueError):
    """A checksum or a length of a segment does not fit its bytes."""


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of ``2**BITS``, at least 1 where there is a count."""
    total = 1 << BITS
    if np.count_nonzero(counts) > total:
        raise ValueError("more symbols than the table has room for")
    scaled = np.where(counts > 0, np.maximum(1, counts * total // max(1, counts.sum())), 0).astype(np.int64)
    rest = total - int(scaled.sum())
    order = np.argsort(-scaled, kind="stable")
    while rest and len(order):
        for i in order:
            step = rest if rest > 0 else max(rest, 1 - int(scaled[i]))
            scaled[i] += step
            rest -= step
            if not rest:
                break
    return scaled


def encode_block(ids: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(coded words, checkpoint states, checkpoint places)``; the first checkpoint is the start."""
    steps = -(-len(ids) // LANES)
    state = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = [np.empty(0, np.uint32)] * steps
    marks = []
    f_all, c_all = freq[ids].astype(np.uint64), cum[ids].astype(np.uint64)
    limit = f_all << np.uint64(63 - BITS)
    for k in range(steps - 1, -1, -1):
        at = slice(k * LANES, min(len(ids), (k + 1) * LANES))
        f, x = f_all[at], state[: at.stop - at.start]
        full = x >= limit[at]
        words[k] = x[full].astype(np.uint32)
        x = np.where(full, x >> _W, x)
        q = x // f
        state[: len(x)] = (q << _B) + (x - q * f) + c_all[at]
        if k % CHECKPOINT_STEPS == 0:
            marks.append(state.copy())
    place = np.cumsum([0, *map(len, words)])[:-1:CHECKPOINT_STEPS] if steps else np.zeros(0, np.int64)
    states = np.array(marks[::-1], np.uint64).reshape(-1, LANES)
    return np.concatenate([np.empty(0, np.uint32), *words]), states, place.astype(np.uint64)


def decode_steps(words: np.ndarray, state: np.ndarray, place: int, count: int,
                 symbols: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> np.ndarray:
    """``count`` ids from a checkpoint on; ``symbols`` has the symbol of each slot."""
    out = np.empty(count, np.uint32)
    state = state.copy()
    for begin in range(0, count, LANES):
        n = min(LANES, count - begin)
        x = state[:n]
        slot = x & _M
        s = symbols[slot]
        out[begin : begin + n] = s
        x = freq[s] * (x >> _B) + slot - cum[s]
        short = x < LOW
        need = int(np.count_nonzero(short))
        if need:
            x[short] = (x[short] << _W) | words[place : place + need]
            place += need
        state[:n] = x
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their sizes, and a checksum."""
    body = b"".join(struct.pack("<cQ", a.dtype.char.encode(), a.size) + a.tobytes() for a in arrays)
    return struct.pack("<QI", len(body), zlib.crc32(body)) + body


def _unpack(data: memoryview, at: int) -> tuple[list[np.ndarray], int]:
    try:
        size, check = struct.unpack_from("<QI", data, at)
        body = data[at + 12 : at + 12 + size]
        if len(body) != size or zlib.crc32(body) != check:
            raise DamagedFile(f"checksum at byte {at}")
        arrays, i = [], 0
        while i < size:
            kind, n = struct.unpack_from("<cQ", body, i)
            array = np.frombuffer(body, np.dtype(kind.decode()), n, i + 9)
            arrays.append(array)
            i += 9 + array.nbytes
        return arrays, at + 12 + size
    except (struct.error, TypeError) as error:
        raise DamagedFile(str(error)) from error


def encode_segment(docs: list[tuple[int, bool, np.ndarray]]) -> bytes:
    """A segment of ``(id, id is null, token ids)`` in the order given."""
    every = np.concatenate([np.empty(0, np.uint32), *(ids for _, _, ids in docs)])
    counts = np.bincount(every).astype(np.int64) if len(every) else np.zeros(0, np.int64)
    freq = frequencies(counts)
    cum = np.cumsum(freq) - freq
    used = np.flatnonzero(freq).astype(np.uint32)
    blocks, begin, size = [], 0, 0
    for i, (_, _, ids) in enumerate(docs):
        size += len(ids)
        if size >= BLOCK_TOKENS or i + 1 == len(docs):
            own = docs[begin : i + 1]
            tokens = np.concatenate([np.empty(0, np.uint32), *(ids for _, _, ids in own)])
            words, states, places = encode_block(tokens, freq, cum)
            blocks.append(_pack(np.array([d[0] for d in own], np.int64), np.array([d[1] for d in own], np.uint8),
                                np.array([len(d[2]) for d in own], np.uint64), states.ravel(), places, words))
            begin, size = i + 1, 0
    head = _pack(used, freq[used].astype(np.uint32), np.array([len(every), len(docs)], np.uint64),
                 np.array([len(b) for b in blocks], np.uint64))
    return MAGIC + head + b"".join(blocks)


def decode_segment(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block ``(document ids, which are null, lengths, token ids)``."""
    view = memoryview(data)
    if bytes(view[:8]) != MAGIC:
        raise DamagedFile("not a segment")
    (used, freqs, totals, sizes), at = _unpack(view, 8)
    width = int(used[-1]) + 1 if len(used) else 0
    freq = np.zeros(width, np.uint64)
    freq[used] = freqs
    cum = np.cumsum(freq) - freq
    symbols = np.repeat(used, freqs)
    seen = 0
    for size in sizes:
        (docs, null, lengths, states, places, words), end = _unpack(view, at)
        if end - at != size:
            raise DamagedFile(f"block at byte {at}")
        at, count = end, int(lengths.sum())
        states, part = states.reshape(-1, LANES), CHECKPOINT_STEPS * LANES
        ids = [decode_steps(words, states[i], int(places[i]), min(part, count - i * part), symbols, freq, cum)
               for i in range(len(places))]
        yield docs, null, lengths, np.concatenate([np.empty(0, np.uint32), *ids])
        seen += count
    if seen != int(totals[0]):
        raise DamagedFile("tokens are missing")


_FILES = "part int, segment int, first_token long, n_tokens long, n_docs long, data binary"


def _writer(path: str, end_id: int):
    closing = np.array([end_id], "<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).flat
        part, segment, first, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([size], pa.int64()), pa.array([len(held)], pa.int64()),
                 pa.array([encode_segment(held)], pa.binary())],
                ["part", "segment", "first_token", "n_tokens", "n_docs", "data"])

        for batch, texts in slices(batches, most=TEXT_BYTES):
            ids, ends = encode(texts)
            at = 0
            for doc, end in zip(batch.column("doc_id").to_pylist(), ends.tolist()):
                tokens, at = np.append(ids[at:end], closing), end
                held.append((0 if doc is None else doc, doc is None, tokens))
                size += len(tokens)
                if size >= SEGMENT_TOKENS:
                    yield close()
                    segment, first, held, size = segment + 1, first + size, [], 0
        if held:
            yield close()

    return write


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, scratch: Scratch) -> DataFrame:
    """The files' table: segments of every document's ids in ascending order of ``doc_id``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a repeated id stays in one part only if the range is cut by id alone
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return scratch.write(ordered.mapInArrow(_writer(tokenizer, end_id), _FILES), "files", compression="none")


_READ = "part int, doc_id long, local long, n_tokens long, ids_crc32 long, ids binary"


def _reader(with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, at = batch.column("part")[row].as_py(), batch.column("first_token")[row].as_py()
                for docs, null, lengths, ids in decode_segment(batch.column("data")[row].as_py()):
                    ends = np.cumsum(lengths.astype(np.int64))
                    begins = ends - lengths.astype(np.int64)
                    data = ids.astype("<u4").tobytes()
                    own = [data[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(docs), part, np.int32)), pa.array(docs, mask=null.astype(bool)),
                         pa.array(begins + at), pa.array(lengths.astype(np.int64)),
                         pa.array([zlib.crc32(x) for x in own], pa.int64()),
                         pa.array(own if with_ids else [None] * len(own), pa.binary())],
                        ["part", "doc_id", "local", "n_tokens", "ids_crc32", "ids"])
                    at += int(lengths.sum())

    return read


def read_token_files(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of every document in the files."""
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per file, not per document
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    found = files.select("part", "first_token", "data").mapInArrow(_reader(with_ids), _READ)
    return (found.join(before, "part")
            .select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "ids"))


def token_files(docs: DataFrame, tokenizer: str, end_id: int, with_ids: bool = True) -> DataFrame:
    """Write the files and read them back."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "rans")
    return read_token_files(write_token_files(docs, tokenizer, end_id, scratch), with_ids)
