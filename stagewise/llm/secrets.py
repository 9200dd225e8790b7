"""Secret scans: three base patterns, and a linear-chain conditional random field.

Tokens are words.  A token's features are its own shape, alphabet, length and variety, those of
its neighbours, and one feature of the file: how much of it is code-like.  Tags are outside,
begin and inside.  The field is trained on a bounded sample of texts (``MAX_TRAIN``, a fixed
choice by hash of the id), tagged by the base patterns, by gradient ascent on its likelihood,
and decodes every whole text by Viterbi.

Decoding is exact and still fast: where a token's score for *outside* exceeds its best other
score by more than all that transitions can make up for, every best path is outside there, so
only the runs between such tokens need the dynamic program.  Tokens of like values score alike
and are numbered once, so every token of a text is scored by a few array operations.  Whether
every plain word between plain words is outside, whatever its form, is worked out once per
field; if so, texts of plain words alone are not scored.

A tagged span is reported as kind ``crf`` without the quotes and punctuation around it, if it
overlaps no base span.

Defined results: null and empty texts have no spans; rows without an id and repeated ids are
scanned row by row; without any base match to learn from, base spans alone are reported; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import by_pieces, held, slices

KINDS = ("assign", "access", "hex", "crf")
MAX_TRAIN = 800
PRIOR = 8.0
TOKENS_KEPT = 200_000  # tokens a scanner remembers from text to text
MASK = "[SECRET]"

# The base patterns.  A greedy run with a least length finds the same runs as a
# run of any length whose short matches are dropped; for "assign" short ones are dropped after.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"[!-~]{24,}")  # runs of hexadecimal digits lie inside words
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

Span = tuple[int, int, int]  # start, end, place in KINDS


def base_spans(text: str) -> list[Span]:
    """Base matches by start, then kind.  The tests in front of a pattern are what any match of it needs."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [(w.start() + m.start(), w.start() + m.end(), 2) for w in _LONG.finditer(text) for m in _HEX.finditer(w[0])]
    return sorted(found, key=lambda s: (s[0], s[2]))


# --- features ----------------------------------------------------------------------

OUT, BEGIN, IN = 0, 1, 2
SLOTS = ("shape", "alphabet", "length", "variety", "key")
SIZE = 1 << 11  # weights per slot and place, by hash of the value
_KEY = re.compile(r"(pass(word|wd)?|secret|token|api_?key|credential|auth|bearer|private)", re.I)
_NAMES = frozenset("password passwd pwd secret token apikey key credential credentials auth bearer".split())
_MARKS = "\"'`,;:()[]{}<>.!?%*#$&|"
_ODD = re.compile(r"[^A-Za-zÀ-ÖØ-öø-ɏ\x20\x09-\x0D.,;!?()%*#$&|]")
#: All values that plain words can have.
PLAIN = tuple((form, "word", size, "", (name, False, False, False))
              for form in ("a", "A", "Aa", "aA") for size in range(13) for name in (False, True))


def token_values(token: str) -> tuple:
    """One value per slot.  Plain words differ by form, length and mark alone."""
    core = token.strip(_MARKS)
    if not _ODD.search(token):
        form = "a" if core.islower() else "A" if core.isupper() else "Aa" if core[:1].isupper() else "aA"
        return form, "word", min(12, len(core) // 4), "", (core.lower() in _NAMES, False, False, False)
    key = bool(_KEY.search(token))
    shape = re.sub(r"(.)\1+", r"\1", "".join(
        "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else "x" if c.isalpha() else c for c in token[:64]))[:8]
    letters, digits = sum(map(str.isalpha, core)), sum(map(str.isdigit, core))
    alphabet = ("hex" if digits and re.fullmatch(r"[0-9a-f]+", core) else "upper" if digits and re.fullmatch(r"[A-Z0-9]+", core)
                else "mixed" if digits and letters and re.fullmatch(r"[A-Za-z0-9+/_=-]+", core)
                else "digits" if digits and not letters else "word" if letters == len(core) and core else "other")
    counts = Counter(core)
    entropy = -sum(n / len(core) * math.log2(n / len(core)) for n in counts.values()) if core else 0.0
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:]))
    return (shape, alphabet, min(12, len(core) // 4), (round(entropy), min(3, switches // 2)),
            (key, "=" in token, token[-1:] in ":=", token in ("=", ":")))


def slots_of(values: tuple) -> tuple[int, ...]:
    """The place of each value in its slot's table."""
    return tuple(int.from_bytes(hashlib.blake2b(f"{s}{v!r}".encode(), digest_size=4).digest(), "little") % SIZE
                 for s, v in zip(SLOTS, values))


def file_feature(text: str) -> int:
    """How code-like a text is, in four steps of the number of equals signs per character."""
    code = text.count("=")
    return 0 if not code else 1 if code * 1000 < len(text) else 2 if code * 100 < len(text) else 3


class Field(NamedTuple):
    near: np.ndarray  # place (before, own, after), slot, value, tag
    file: np.ndarray  # step, tag
    move: np.ndarray  # from, to

    def scores(self, values: tuple) -> np.ndarray:
        """What a token adds to the tags of the token after it, its own, and the one before it."""
        slots = slots_of(values)
        return np.array([sum(self.near[place, i, v] for i, v in enumerate(slots)) for place in range(3)])


def _emissions(near: np.ndarray, slots: np.ndarray, place: np.ndarray, file: np.ndarray) -> np.ndarray:
    score = file.copy()
    for p in range(3):
        for s in range(len(SLOTS)):
            score += np.where(place[..., p, None], near[p, s][slots[:, :, p, s]], 0)
    return score


def train(examples: list[tuple[str, list[Span]]], window: int = 3, turns: int = 150, rate: float = 0.15, ridge: float = 0.02) -> Field:
    """Gradient ascent with adapted steps on the penalised likelihood of windows around spans and other odd tokens."""
    if isinstance(examples, Sample):
        examples = examples.widened()
    tables: dict[str, tuple[int, ...]] = {}
    runs = []
    for text, spans in examples:
        found = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        tokens = [text[a:b] for a, b in found]
        tags = np.zeros(len(tokens), np.int64)
        for a, b, _ in spans:
            own = [i for i, (s, e) in enumerate(found) if s < b and a < e]
            # the name before an assigned value is no part of the secret
            own = [i for i in own if len(own) == 1 or not _KEY.search(tokens[i]) and tokens[i] not in ("=", ":")]
            for k, i in enumerate(own):
                if tags[i] == OUT:
                    tags[i] = BEGIN if k == 0 else IN
        odd = [i for i, t in enumerate(tokens) if tags[i] or any(map(str.isdigit, t)) or len(t) > 20]
        if tokens:
            odd.append(len(tokens) // 2)  # plain prose
        step, end = file_feature(text), -1
        for i in odd:
            if i <= end:
                continue
            begin, end = max(0, i - window), min(len(tokens), i + window + 1)
            runs.append((tokens, tags, begin, end, step))
            end -= 1
    long = 2 * window + 1
    n = len(runs)
    slots, place = np.zeros((n, long, 3, len(SLOTS)), np.int64), np.zeros((n, long, 3), bool)
    gold, valid, steps = np.zeros((n, long), np.int64), np.zeros((n, long), bool), np.zeros(n, np.int64)
    for r, (tokens, tags, begin, end, step) in enumerate(runs):
        steps[r] = step
        for k, i in enumerate(range(begin, end)):
            valid[r, k], gold[r, k] = True, tags[i]
            for p, j in enumerate((i - 1, i, i + 1)):
                if 0 <= j < len(tokens):
                    if tokens[j] not in tables:
                        tables[tokens[j]] = slots_of(token_values(tokens[j]))
                    slots[r, k, p], place[r, k, p] = tables[tokens[j]], True
    near, file, move = np.zeros((3, len(SLOTS), SIZE, 3)), np.zeros((4, 3)), np.zeros((3, 3))
    parts = (near, file, move)
    # the weights' prior mean: words of letters alone are outside
    word = slots_of(PLAIN[0])[1]
    near[1, 1, word, OUT] = PRIOR
    means = (near.copy(), 0.0, 0.0)
    drift, spread = ([np.zeros_like(w) for w in parts] for _ in range(2))
    hot = np.eye(3)[gold] * valid[..., None]
    pair_gold = np.einsum("rti,rtj->ij", hot[:, :-1], hot[:, 1:])
    for turn in range(1, turns + 1):
        score = _emissions(near, slots, place, np.repeat(file[steps][:, None], long, axis=1))
        # forward and backward over all windows at once
        alpha, beta = np.zeros((n, long, 3)), np.zeros((n, long, 3))
        alpha[:, 0] = score[:, 0]
        for t in range(1, long):
            step = alpha[:, t - 1, :, None] + move
            top = step.max(axis=1, keepdims=True)
            new = top[:, 0] + np.log(np.exp(step - top).sum(axis=1)) + score[:, t]
            alpha[:, t] = np.where(valid[:, t, None], new, alpha[:, t - 1])
        for t in range(long - 2, -1, -1):
            step = (beta[:, t + 1] + score[:, t + 1])[:, None, :] + move
            top = step.max(axis=2, keepdims=True)
            new = top[..., 0] + np.log(np.exp(step - top).sum(axis=2))
            beta[:, t] = np.where(valid[:, t + 1, None], new, 0)
        end = alpha[:, -1]
        top = end.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(end - top).sum(axis=1))
        chance = np.exp(alpha + beta - total[:, None, None]) * valid[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + move + (score + beta)[:, 1:, None, :] - total[:, None, None, None])
        pair = (pair * valid[:, 1:, None, None]).sum(axis=(0, 1))
        lack = hot - chance
        grads = [np.zeros_like(near), np.zeros_like(file), pair_gold - pair]
        for p in range(3):
            for s in range(len(SLOTS)):
                at = place[..., p]
                for tag in range(3):
                    grads[0][p, s, :, tag] = np.bincount(slots[:, :, p, s][at], lack[..., tag][at], SIZE)
        np.add.at(grads[1], steps, lack.sum(axis=1))
        for w, g, m, v, mean in zip(parts, grads, drift, spread, means):
            g -= ridge * (w - mean)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)
    return Field(near, file, move)


# --- decoding ----------------------------------------------------------------------

def viterbi(score: np.ndarray, move: np.ndarray) -> list[int]:
    """The best tags; of equal ones the first, outside before begin before inside."""
    best, back = score[0], []
    for row in score[1:]:
        step = best[:, None] + move
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + row
    tags = [int(best.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


class _Numbers(dict):
    """Numbers of tokens, worked out once each."""

    def __init__(self, number):
        self.number = number

    def __missing__(self, token: bytes) -> int:
        self[token] = found = self.number(token)
        return found


class Scanner:
    """Spans of texts under one trained field."""

    def __init__(self, field: Field | None):
        self.field, self.known, self.rows, self.table = field, {}, [], np.zeros((0, 3, 3))
        self.numbers = _Numbers(self._number)
        if field is not None:
            # a tag in the middle touches two transitions; no choice of tags gains more than this
            self.slack = 2 * float(field.move.max() - field.move.min())
            plain = np.array([field.scores(v) for v in PLAIN])
            lead = plain[:, :, OUT, None] - plain[:, :, 1:]  # of outside over each other tag
            file = field.file[:, OUT, None] - field.file[:, 1:]
            # a neighbour may be missing, which adds nothing
            least = lead[:, 1].min(axis=0) + np.minimum(0, lead[:, 0].min(axis=0)) + np.minimum(0, lead[:, 2].min(axis=0))
            self.plain_is_outside = bool((least + file.min(axis=0) > self.slack).all())

    def _number(self, token: bytes) -> int:
        """The number of a token's values; its scores are in that row."""
        values = token_values(token.decode("utf-8", "surrogatepass"))
        if (found := self.known.get(values)) is None:
            found = self.known[values] = len(self.rows)
            self.rows.append(self.field.scores(values))
        return found

    def _scores(self, tokens: list[bytes]) -> np.ndarray:
        """One row per token and one column per tag, without the file's part."""
        if len(self.numbers) > TOKENS_KEPT or len(self.rows) > TOKENS_KEPT:
            self.numbers.clear()
            self.known.clear()
            self.rows.clear()
            self.table = np.zeros((0, 3, 3))
        own = np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :])])
        score = self.table[own, 1]
        score[1:] += self.table[own[:-1], 0]
        score[:-1] += self.table[own[1:], 2]
        return score

    def tagged(self, text: str) -> list[tuple[int, int]]:
        """Start and end of each run of begin and inside."""
        if self.field is None or not text:
            return []
        if self.plain_is_outside and not _ODD.search(text):
            return []
        tokens = text.encode("utf-8", "surrogatepass").split()  # by the white space of _WORD
        if not tokens:
            return []
        score = self._scores(tokens) + self.field.file[file_feature(text)]
        n, open_at = len(tokens), np.flatnonzero(score[:, OUT] - score[:, 1:].max(axis=1) <= self.slack).tolist()
        if not open_at:
            return []
        places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        loose = {i: score[i] for i in open_at}
        # runs of such tokens; what stands beside a run is outside on every best path
        out: list[tuple[int, int]] = []
        for i in sorted(loose):
            if i - 1 in loose:
                continue
            end = i
            while end in loose:
                end += 1
            run = np.array([loose[k] for k in range(i, end)])
            run[0] += self.field.move[OUT] if i else 0
            run[-1] += self.field.move[:, OUT] if end < n else 0
            tags = viterbi(run, self.field.move)
            for k, tag in zip(range(i, end), tags):
                if tag == IN and k > i and tags[k - i - 1] != OUT:
                    out[-1] = out[-1][0], places[k][1]
                elif tag != OUT:
                    out.append(places[k])
        return out

    def spans(self, text: str) -> list[Span]:
        """Base spans and those the field adds, by start and kind."""
        found = base_spans(text)
        for a, b in self.tagged(text):
            while a < b and text[a] in _MARKS + "=":
                a += 1
            while a < b and text[b - 1] in _MARKS:
                b -= 1
            if a < b and all(e <= a or b <= s for s, e, _ in found):
                found.append((a, b, 3))
        return sorted(found, key=lambda s: (s[0], s[2]))


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span masked once, overlapping ones together."""
    out, at = [], 0
    for a, b, _ in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]])


def _scanner(field: Field | None, key: str) -> Scanner:
    return held(("scanner", key), lambda: Scanner(field))


def _key(field: Field | None) -> str:
    return "" if field is None else hashlib.sha1(b"".join(x.tobytes() for x in field)).hexdigest()


_HASHES = 1 << 53
#: Phrases round a secret that no base pattern knows; the name may be missing.
FRAMES = ("my {name} is {value} and", "{name} {value}", "use {name} {value} for this", "({value})", "{value}", "with {value} as {name}")
_CUES = ("password", "key", "token", "secret", "bearer", "auth", "credential")
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
NEGATIVES = 120  # texts that ordinary odd tokens are put into
AROUND = 160  # characters of context kept on each side


def ordinary(text: str) -> tuple[str, list[Span]]:
    """Words of a text with odd tokens in between that are no secrets: figures, times, mail and page addresses, short names."""
    words = text.split()[:60]
    if not words:
        return "", []
    draw = random.Random(zlib.crc32(text[:400].encode()))
    some = lambda: re.sub(r"[^A-Za-z]", "", draw.choice(words)).lower()[:9] or "x"
    n = lambda digits: str(draw.randint(10 ** (digits - 1), 10**digits - 1))
    made = []
    for w in words:
        made.append(w)
        if draw.random() < 0.3:
            made.append(draw.choice([
                f"{n(1)}.{n(2)}.{n(1)}", f"{n(2)}:{n(2)}", f"{n(2)}.{n(2)}.{n(4)}", f"{n(4)}-{n(2)}-{n(2)}", f"{n(3)},{n(3)}", f"({n(3)})-{n(4)}",
                f"{some()}{n(draw.randint(1, 3))}", f"{some()[:3]}{n(2)}_{n(2)}", f"{some()}.{some()}@{some()}.{some()[:3]}", f"{some()}=1",
                f"https://{some()}.{some()}.{some()[:3]}/{some()}/{some()}{n(2)}?{some()[:2]}={n(2)}", f"/{some()}/{some()}_{some()}.{some()[:3]}",
                f"{some()}-{some()}-{some()}-{some()}", f"{n(1)}{some()[:2]}", f"{some()}_{some()}_{n(4)}"]))
    made = " ".join(made)
    return made, base_spans(made)


def varied(text: str, spans: list[Span], each: int = 3) -> list[tuple[str, list[Span]]]:
    """The base matches of a text again in other words: their names masked or moved into a phrase, their
    alphabet mixed, a short type in front.  What the field then learns by is shape and neighbours."""
    out = []
    for a, b, kind in spans:
        value = _ASSIGN.fullmatch(text, a, b)[2] if kind == 0 else text[a:b]
        if len(value) < 8:
            continue
        left, right = text[max(0, a - AROUND) : a], text[b : b + AROUND]
        left, right = left[left.find(" ") + 1 :] if a > AROUND else left, right[: right.rfind(" ") + 1] if len(right) == AROUND else right
        draw = random.Random(zlib.crc32(f"{value}{a}".encode()))
        for _ in range(each):
            long = draw.randint(10, 40)
            own = value if draw.random() < 0.3 else "".join(draw.choice(_ALPHABET) for _ in range(long))
            if not any(map(str.isdigit, own)):
                own += str(draw.randint(10, 99))
            if draw.random() < 0.3:
                own = "".join(draw.choice(_ALPHABET[:26]) for _ in range(draw.randint(2, 4))) + draw.choice("_-") + own
            frame = draw.choice(FRAMES).format(name=draw.choice(_CUES), value="\0")
            before, after = frame.split("\0")
            made = f"{left.rstrip()} {before}{own}{after} {right.lstrip()}"
            at = len(left.rstrip()) + 1 + len(before)
            hit = (at, at + len(own), 3)
            out.append((made, sorted([hit, *[s for s in base_spans(made) if s[1] <= at or s[0] >= hit[1]]])))
    return out


class Sample(list):
    """Examples drawn from documents, whose labels are the base patterns alone: training adds what these cannot show."""

    def widened(self) -> list[tuple[str, list[Span]]]:
        return [*self, *(made for text, spans in self for made in varied(text, spans)), *(ordinary(t) for t, _ in self[-NEGATIVES:])]


def fit(docs: DataFrame) -> Field | None:
    """A field from a bounded sample: about ``MAX_TRAIN`` texts with a base match, and as many without,
    none of them of 20,000 characters or more."""
    text = F.col("text")
    rows = docs.select(text.cast("string").alias("text")).filter(text.isNotNull() & (F.length("text") < 20_000))
    hit = (text.contains("=") | text.contains(":")) & text.rlike(
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""")
    hit |= text.contains("AKIA") & text.rlike("AKIA[A-Z0-9]{16}")
    hit |= text.rlike("[0-9a-f]{24}")
    # texts of the smallest hashes are a fixed choice at every size; of copies one is enough
    place = F.pmod(F.xxhash64("text"), F.lit(_HASHES))
    seen = rows.agg(F.approx_count_distinct(F.when(hit, place), 0.02), F.approx_count_distinct(F.when(~hit, place), 0.02)).first()
    bound = [int(_HASHES * min(1.0, 1.3 * MAX_TRAIN / max(1, n))) for n in seen]
    near = rows.select("text", place.alias("o"), hit.alias("hit")).filter(F.col("o") < max(bound))
    near = near.filter(F.col("o") < F.when(F.col("hit"), bound[0]).otherwise(bound[1]))
    drawn = near.groupBy("o", "hit").agg(F.min("text").alias("text")).collect()
    chosen = [r.text for want in (True, False)
              for r in sorted((r for r in drawn if r.hit == want), key=lambda r: r.o)[:MAX_TRAIN]]
    examples = [(t, base_spans(t)) for t in dict.fromkeys(chosen)]
    if not any(spans for _, spans in examples):
        return None
    return train(Sample(examples))


def _scan(field: Field | None):
    key = _key(field)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(field, key)
        for batch, texts in slices(batches):
            rows = []
            for text in texts:
                spans = scanner.spans(text.decode())
                many = [sum(k == kind for _, _, k in spans) for kind in range(4)]
                base = [s for s in spans if s[2] < 3]
                rows.append((*many, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(spans)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()] * 2)] if rows else [
                pa.array([], t) for t in [pa.int64()] * 4 + [pa.string()] * 2]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"])

    return scan


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(fit(docs)), "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, "
                                             "base_sha256 string, spans string")


def redact_udf(field: Field | None):
    """text -> text without secrets, as a column."""
    key = _key(field)

    def mask(text: pa.Array) -> pa.Array:
        scanner = _scanner(field, key)
        return by_pieces(text, lambda part: pa.array([None if t is None else redact(t, scanner.spans(t)) for t in part], pa.string()), pa.string())

    return F.arrow_udf(mask, "string")
