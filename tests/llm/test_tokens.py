from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stagewise.llm import encode as encoding
from stagewise.llm import packing, rans
from stagewise.llm.encode import Encoder
from stagewise.llm.queries import tokenizer_file

from .conftest import ODD_ROWS, words

ROWS = [*ODD_ROWS, (20, "<|endoftext|> don't ΣΑΣ İstanbul ½ é a b 'll x.y, “q” …"), (21, "ab. ab, AB ab.. ab.,")]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_by_word_is_the_library(plain):
    texts = [t or "" for _, t in ROWS] + [" ".join(words(i, 300)).title() for i in range(5)]
    encode = Encoder(tokenizer_file())
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode.ids(texts)] == [plain(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_encoded_as_by_the_library(text):
    from tokenizers import Tokenizer

    global _both
    try:
        tokenizer, encode = _both
    except NameError:
        tokenizer, encode = _both = Tokenizer.from_file(tokenizer_file()), Encoder(tokenizer_file())
    assert np.frombuffer(encode.ids([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


_PARTS = [*"abzAMSTZ'.,-!<|>019 \n\t\r\x0b\x1c\x00", *"éÉßÀÞþ×÷ÿªºµÄöẞİıΣςЖŒ漢한½", "\u0300", "\u0307", "\u0331", "\u0338",
          "\u00a0", "\u2028", "\u093c", "\u0958", "\u212b", "'LL", "don't", "e.g.", "<|endoftext|>", "<|ENDOFTEXT|>"]
_CALM = [x for x in _PARTS if "<" not in x and "|" not in x and not "\u0300" <= x <= "\u037f"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_PARTS), max_size=30) | st.lists(st.sampled_from(_CALM), max_size=30), max_size=5))
def test_pieces_end_where_the_tokens_of_the_library_end(parts):
    from tokenizers import Tokenizer

    global _both
    try:
        tokenizer, encode = _both
    except NameError:
        tokenizer, encode = _both = Tokenizer.from_file(tokenizer_file()), Encoder(tokenizer_file())
    texts = ["".join(x) for x in parts]
    ids, ends = encode.flat([t.encode() for t in texts])
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for x in want for i in x]
    assert ends.tolist() == np.cumsum([len(x) for x in want]).tolist()


class _Counted:
    """A tokenizer that keeps what it is sent."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, []

    def encode_batch_fast(self, lines, **options):
        self.calls.append(list(lines))
        return self.tokenizer.encode_batch_fast(lines, **options)


def test_the_library_gets_each_piece_once_and_a_bounded_call_at_a_time():
    encode = Encoder(tokenizer_file())
    encode.tokenizer = _Counted(encode.tokenizer)
    many = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(9000)]
    text = " ".join(f"{w} {w}. {w.title()}, {w.upper()}!" for w in many)
    ids = encode.ids([text])[0]
    calls = encode.tokenizer.calls
    sent = [w for call in calls for line in call for w in line.split(" ")]
    assert len(sent) == len(set(sent)) == len(many) + 3
    assert max(len(call) for call in calls) <= 20
    assert max(len(line.split(" ")) for call in calls for line in call) <= 200
    assert encode.ids([text])[0] == ids and len(encode.tokenizer.calls) == len(calls)


def test_long_pieces_are_not_remembered():
    encode = Encoder(tokenizer_file())
    encode.ids(["A1" * 5000 + " short"])
    assert "short" in encode.new
    assert max(map(len, [*encode.new, *encode.old])) <= 64


def test_a_long_text_is_encoded_in_parts(plain, monkeypatch):
    monkeypatch.setattr("stagewise.llm.encode.TEXT_BYTES", 50)
    encode, sizes, cut = Encoder(tokenizer_file()), [], encoding.cut
    monkeypatch.setattr(encoding, "cut", lambda texts: sizes.append(sum(map(len, texts))) or cut(texts))
    for text in (" ".join(words(1, 300)), "\n\t ".join(words(2, 90)) + " ", " " * 200, "é" * 90, "x" * 70 + " a\t" + "y" * 80 + "\n"):
        sizes.clear()
        assert np.frombuffer(encode.ids([text])[0], "<u4").tolist() == plain(text)
        assert max(sizes) <= max(50, max(map(len, text.encode().split())) if text.strip() else 0)
        assert len(sizes) > 1 or " " not in text


def test_memory_of_words_is_bounded(plain, monkeypatch):
    monkeypatch.setattr("stagewise.llm.encode.REMEMBERED", 50)
    encode, texts = Encoder(tokenizer_file()), [" ".join(words(i, 40)) for i in range(20)]
    for t in texts * 2:
        assert np.frombuffer(encode.ids([t])[0], "<u4").tolist() == plain(t)
    assert len(encode.new) < 50 + 200 and len(encode.old) < 50 + 200


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60_000), max_size=50), min_size=1, max_size=8))
def test_segments_come_back(docs):
    rows = [(i - 3, i == 0, np.array(d, np.uint32)) for i, d in enumerate(docs)]
    back = [(d, bool(z), n) for docs_, null, lengths, ids in rans.decode_segment(rans.encode_segment(rows))
            for d, z, n in zip(docs_.tolist(), null.tolist(), np.split(ids, np.cumsum(lengths.astype(int))[:-1]))]
    assert [(d, z, n.tolist()) for d, z, n in back] == [(d, z, n.tolist()) for d, z, n in rows]


def test_blocks_checkpoints_and_damage(monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_TOKENS", 5000)
    monkeypatch.setattr(rans, "CHECKPOINT_STEPS", 2)
    r = np.random.default_rng(1)
    docs = [(i, False, (r.zipf(1.3, 9000) % 49_000).astype(np.uint32)) for i in range(4)]
    data = rans.encode_segment(docs)
    blocks = list(rans.decode_segment(data))
    assert len(blocks) == 4 and all((b[3] == d[2]).all() for b, d in zip(blocks, docs))
    for at in (3, 40, len(data) // 2, len(data) - 5):
        broken = bytearray(data)
        broken[at] ^= 255
        with pytest.raises(rans.DamagedFile):
            list(rans.decode_segment(bytes(broken)))
    with pytest.raises(rans.DamagedFile):
        list(rans.decode_segment(data[:-7]))


def test_files_are_smaller_than_the_ids():
    ids = (np.random.default_rng(2).zipf(1.3, 400_000) % 3_000).astype(np.uint32)
    counts = np.bincount(ids)
    entropy = -(counts[counts > 0] * np.log2(counts[counts > 0] / len(ids))).sum() / 8
    assert len(rans.encode_segment([(1, False, ids)])) < 1.2 * entropy + 60_000


def test_a_checkpoint_decodes_alone():
    ids = np.arange(rans.LANES * 200, dtype=np.uint32) % 777
    freq = rans.frequencies(np.bincount(ids).astype(np.int64))
    cum = np.cumsum(freq) - freq
    coded, states, places = rans.encode_block(ids, freq, cum)
    symbols = np.repeat(np.arange(777, dtype=np.uint32), freq)
    step = rans.CHECKPOINT_STEPS * rans.LANES
    got = rans.decode_steps(coded, states[1], int(places[1]), step, symbols, freq.astype(np.uint64), cum.astype(np.uint64))
    assert (got == ids[step : 2 * step]).all()


def test_token_files(documents, plain):
    got = rans.token_files(documents(ROWS), tokenizer_file(), 2).collect()
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for doc, text in ordered:
        ids = np.array([*plain(text), 2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    assert sorted((tuple(r[:4]) + (bytes(r.ids),) for r in got), key=lambda r: r[1]) == want


def test_empty_tables(documents):
    assert rans.token_files(documents([]), tokenizer_file(), 2).collect() == []
    assert packing.pack(documents([]), tokenizer_file(), 1).collect() == []


def sequences(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.sequence_id].append((r.offset, r.length))
    return out


def gapless(sequence, capacity):
    end = 0
    for offset, length in sorted(sequence):
        if offset != end:
            return False
        end += length
    return end <= capacity


@pytest.mark.parametrize("capacity", [16, 64, 4096])
def test_packing(documents, plain, capacity):
    rows = ROWS + [(100 + i, " ".join(words(i, 1 + i % 37))) for i in range(120)]
    got = packing.pack(documents(rows), tokenizer_file(), 1, capacity).collect()
    want = []
    for doc, text in rows:
        ids = np.array([*plain(text), 1], "<u4")
        want += [(doc, p, a, len(ids[a : a + capacity]), ids[a : a + capacity].tobytes()) for p, a in enumerate(range(0, len(ids), capacity))]
    key = lambda r: (r[0] is None, r[0] or 0, r[4], r[1])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got), key=key) == sorted(want, key=key)
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in got)
    bins = sequences(got)
    assert all(gapless(s, capacity) for s in bins.values())
    assert len(bins) <= -(-sum(r.length for r in got) // capacity) + 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), min_size=1, max_size=5), st.integers(0, 30))
def test_fullest_is_the_fullest(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1)}
    chosen = packing.fullest(room, sorted(counts, reverse=True), counts)
    assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)
    assert all(n <= counts[k] for k, n in chosen.items())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 9), max_size=8))
def test_a_plan_uses_every_piece_once(histogram):
    used = defaultdict(int)
    for times, chosen in packing.plan_bins(dict(histogram), 20):
        assert times > 0 and sum(k * n for k, n in chosen.items()) <= 20
        for k, n in chosen.items():
            used[k] += n * times
    assert used == histogram


def test_counts_are_not_written(documents, monkeypatch):
    written, write = [], packing.Scratch.write
    monkeypatch.setattr(packing.Scratch, "write", lambda self, frame, name, **o: written.append(name) or write(self, frame, name, **o))
    rows = [(i, " ".join(words(i, 1 + i % 7))) for i in range(40)]
    assert len(packing.pack(documents(rows), tokenizer_file(), 1).collect()) == 40
    assert written == ["pieces"]


def test_texts_are_read_in_small_batches(documents, spark):
    rows, arrow = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {k: spark.conf.get(k, None) for k in (rows, arrow)}
    try:
        for own, want in (("4096", "256"), ("1000", "1000")):
            spark.conf.set(rows, own)
            spark.conf.set(arrow, "8m")
            packing.pack(documents([(1, "a b")]), tokenizer_file(), 1)
            assert (spark.conf.get(rows), spark.conf.get(arrow)) == (want, "4m")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
