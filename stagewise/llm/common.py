"""Written tables that cut lineage, and vectorised words of many texts at once.

Null texts are empty texts.  Words are runs of bytes other than ``\\x20 \\x09-\\x0D``; as
UTF-8 never uses these bytes inside a character, this is the same cut as on code points.
"""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from pathlib import Path
from typing import NamedTuple, TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from stagewise.session import workspace

T = TypeVar("T")
U64 = np.uint64
#: Texts are worked on in slices of about so many bytes, which bounds a task's memory.
SLICE_BYTES = 1 << 20


_shipped: set[str] = set()
#: Texts are long: batches to Python workers end at these bytes, where the session has Spark's own setting.
_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH[0], _BATCH[1]) == _BATCH[1]:
        spark.conf.set(_BATCH[0], _BATCH[2])
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        name = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(name)
        _shipped.add(context.applicationId)


#: A reader of Parquet keeps a batch of whole texts in one array, so fewer rows, and fewer bytes to a worker, spare the heap.
_SMALL = (("spark.sql.parquet.columnarReaderBatchSize", "4096", "256"), (_BATCH[0], _BATCH[2], "4m"))


def small_batches(spark: SparkSession) -> None:
    """Batches for operators that send every whole text to a worker, where the session has no setting of its own."""
    for name, usual, small in _SMALL:
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, small)


class Scratch:
    """Tables of one operator call, in the folder that all executors share."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{workspace(spark)}/llm/{name}-{uuid.uuid4().hex}"

    def write(self, frame: DataFrame, name: str, **options: str) -> DataFrame:
        """The frame as a written table: a lost executor re-runs nothing before it."""
        path = f"{self.root}/{name}"
        frame.write.options(**options).parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing lazy reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            at = path(f"{self.root}/{name}")
            at.getFileSystem(conf).delete(at, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit hangs on every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(count: int, seed: int) -> np.ndarray:
    """``count`` odd 64-bit numbers, the same in every process."""
    start = U64((seed * 0x9E3779B97F4A7C15) % 2**64)
    return mix(np.arange(1, count + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + start) | U64(1)


_BYTE = seeds(256, 1)
_STEP = U64(0x9FB21C651E98DF25)
_BACK = U64(pow(0x9FB21C651E98DF25, -1, 2**64))
_powers: list[np.ndarray] = []

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for ``n`` bytes; only those of an ordinary slice are kept."""
    if not _powers or n > len(_powers[0]):
        grown = []
        for base in (_STEP, _BACK):
            row = np.full(max(n, 2 * SLICE_BYTES), base, U64)
            row[0] = 1
            grown.append(np.multiply.accumulate(row))
        if _powers or n > 2 * SLICE_BYTES:
            return grown[0][:n], grown[1][:n]
        _powers[:] = grown
    return _powers[0][:n], _powers[1][:n]


_held: dict[tuple, object] = {}


def held(key: tuple, build: Callable[[], T]) -> T:
    """What a worker keeps from task to task: the model it worked with last, and no other."""
    if key not in _held:
        _held.clear()
        free()
        _held[key] = build()
    return _held[key]


def free() -> None:
    """Give unused memory of this worker back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only with this C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Words(NamedTuple):
    """Words of several texts: the text each is in, where it lies in ``data``, its hash."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    first: np.ndarray  # first byte of each text in data


def words_of(texts: list[bytes], space: np.ndarray = SPACE, lower: bool = True) -> Words:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.cumsum(lengths) - lengths
    if lower:
        data = LOWER[data]
    gap = space[data]
    gap[first[1:] - 1] = True  # a text ends here, whatever the separators are
    gap[-1] = True
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    power, back = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * power[:-1], out=total[1:])
    hashed = mix((total[end] - total[start]) * back[start] + (end - start).astype(U64))
    return Words(np.searchsorted(first, start, "right") - 1, start, end, hashed, data, first)


def grams(words: Words, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside one text, and the word each starts at."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    weight = seeds(k, seed)
    total = np.full(n, U64(k))
    for j in range(k):
        total += words.hash[j : j + n] * weight[j]
    at = np.flatnonzero(words.doc[:n] == words.doc[k - 1 :])
    return mix(total[at]), at


def pieces(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Begin and end of runs with about ``most`` bytes of text each; a longer text comes alone."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    begin = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of the batches with about ``most`` bytes of text each; a longer text comes alone."""
    for batch in batches:
        column = batch.column(text)
        for begin, end in pieces(column, most):
            part = column.slice(begin, end - begin).cast(pa.large_binary())
            yield batch.slice(begin, end - begin), [t or b"" for t in part.to_pylist()]


def by_pieces(texts: pa.Array, work: Callable[[list[str | None]], pa.Array], kind: pa.DataType) -> pa.Array:
    """``work`` over a column, a piece at a time."""
    done = [work(texts.slice(a, b - a).to_pylist()) for a, b in pieces(texts)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
