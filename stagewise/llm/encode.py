"""Token ids of whole texts with a tokenizer file, piece by piece with a bounded memory of pieces.

Holds for tokenizers that drop white space, lower-case letters and end a token where letters
end: what stands between two blanks, and what follows a letter's run, is then encoded alike
alone and in its text.  A slice of texts is cut into pieces at once, and the library gets each
different piece once.  Pieces of letters only are sent to it many in a line; as each ends in a
token that closes a word, the ids are cut apart there.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from stagewise.llm.common import LOWER, held

#: Pieces remembered in each of two generations, per Python worker, and the longest of them.
REMEMBERED, LONGEST = 150_000, 64
#: Texts are encoded in slices of about so many bytes: a larger slice sends fewer pieces twice.
TEXT_BYTES = 4 << 20
#: Words of letters in a line, and lines or other pieces in a call of the library.
LINE, CALL = 200, 20
_AFTER = re.compile(rb"[ \n\t]")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[:128] = ~_LETTER[:128]
#: First bytes of U+0300 to U+037F: such marks join a letter before them, after case is lost.
_JOINS = np.zeros(256, bool)
_JOINS[[0xCC, 0xCD]] = True


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes without blanks, bounds of the pieces in them, pieces before the end of each text)``.

    A piece ends at a blank, and where an ASCII byte other than a letter follows a letter of
    Latin-1.  Letters of Latin-1 are lower-cased.  Where a special token or a joining mark may
    stand, pieces end at blanks only and keep their case.
    """
    whole = b" ".join(texts) + b" "
    data = np.frombuffer(whole, np.uint8)
    blank = _BLANK[data]
    at = np.flatnonzero(blank)
    last = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    last -= np.searchsorted(at, last)
    data = data[~blank]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = True
    edge[at - np.arange(len(at))] = True
    if b"<|" not in whole and not _JOINS[data].any():
        data = LOWER[data]
        letter = _LETTER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3) + 1
        byte = data[lead]
        data[lead] = byte + 0x20 * ((byte <= 0x9E) & (byte != 0x97)).astype(np.uint8)
        letter[lead] = (byte != 0x97) & (byte != 0xB7)
        edge[1:-1] |= letter[:-1] & _MARK[data[1:]]
    bounds = np.flatnonzero(edge)
    return data, bounds, np.searchsorted(bounds, last)


def parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts of at most ``TEXT_BYTES`` that end at blanks; a longer run without one stays whole."""
    begin = 0
    while len(text) - begin > TEXT_BYTES:
        end = max(text.rfind(b, begin, begin + TEXT_BYTES) for b in (b" ", b"\n", b"\t"))
        if end < begin:
            later = _AFTER.search(text, begin)
            if later is None:
                break
            end = later.start()
        yield text[begin:end]
        begin = end + 1
    yield text[begin:]


class Encoder:
    """``ids(texts)``: the ids of each text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        end = model["end_of_word_suffix"]
        self.closes = np.zeros(1 + max(model["vocab"].values()), bool)
        self.closes[[i for t, i in model["vocab"].items() if t.endswith(end)]] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _call(self, lines: list[str]) -> list[np.ndarray]:
        found = []
        for i in range(0, len(lines), CALL):
            batch = self.tokenizer.encode_batch_fast(lines[i : i + CALL], add_special_tokens=False)
            found += [np.array(e.ids, "<u4") for e in batch]
        return found

    def _each(self, words: list[str]) -> list[bytes]:
        return [x.tobytes() for x in self._call(words)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters: one pre-token each, so one closing token each."""
        lines, done = [words[i : i + LINE] for i in range(0, len(words), LINE)], []
        for line, ids in zip(lines, self._call([" ".join(line) for line in lines])):
            end = np.flatnonzero(self.closes[ids[ids < len(self.closes)]]) + 1
            if len(end) != len(line) or end[-1] != len(ids):
                done += self._each(line)
                continue
            data, at = ids.tobytes(), [0, *(end * 4).tolist()]
            done += [data[a:b] for a, b in zip(at[:-1], at[1:])]
        return done

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of different pieces."""
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        found = list(map(new.get, words))
        letters, other = [], []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            word = words[i]
            if word in old:
                found[i] = new[word] = old[word]
            else:
                (letters if word.isalpha() else other).append(i)
        for places, encode in ((letters, self._letters), (other, self._each)):
            fresh = [words[i] for i in places]
            for i, word, ids in zip(places, fresh, encode(fresh)):
                found[i] = ids
                if len(new) <= REMEMBERED and len(word) <= LONGEST:
                    new[word] = ids
        return found

    def flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's ids end in it."""
        if len(texts) == 1 and len(texts[0]) > TEXT_BYTES:
            ids = np.concatenate([self._slice([part])[0] for part in parts(texts[0])])
            return ids, np.array([len(ids)])
        return self._slice(texts)

    def _slice(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data, bounds, last = cut(texts)
        if len(bounds) == 1:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        pieces = pa.Array.from_buffers(pa.binary(), len(bounds) - 1,
                                       [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy()
        known = self._known(coded.dictionary.cast(pa.string()).to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, known), np.int32, len(known)) // 4
        ids = np.frombuffer(b"".join(known), "<u4")
        counts = sizes[which]
        ends = np.cumsum(counts, dtype=np.int64)
        # a token's place among the known ids: where its piece's ids begin there, and its number in the piece
        place = np.repeat((np.cumsum(sizes, dtype=np.int64) - sizes)[which] - (ends - counts), counts)
        place += np.arange(len(place))
        return ids[place], np.concatenate([np.zeros(1, np.int64), ends])[last]

    def ids(self, texts: list[str]) -> list[bytes]:
        found, ends = self.flat([t.encode("utf-8") for t in texts])
        data, at = found.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(at[:-1], at[1:])]


def encoder(path: str) -> Encoder:
    """The encoder of this worker for a file."""
    return held(("encoder", path), lambda: Encoder(path))
