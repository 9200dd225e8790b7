"""Language identification by the nearest of several centroids per language.

A text becomes counts of its letter bigrams and trigrams, hashed to ``DIMENSIONS``, damped,
weighted by inverse document frequency over all learning rows, and scaled to length 1.  Per
language a bounded sample is clustered by cosine into ``CENTROIDS`` centres.  The language of
the nearest centre is predicted; a cosine below what all but 1 % of that centre's own texts
reach marks the row as rejected.

Learned from text and language alone; the sample has about ``MAX_PER_LANGUAGE`` rows of each
language, a fixed choice by hash of the id.  Document frequencies cover all learning rows.

Defined results: null texts and texts without a letter are ``und`` with score 0.0; without
any learning row everything is ``und``; ties go to the language first in the alphabet; rows
without an id and repeated ids are predicted row by row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import U64, slices

DIMENSIONS = 1 << 12
CENTROIDS = 4
MAX_PER_LANGUAGE = 1500
REJECT_SHARE = 0.01
UNKNOWN = "und"
#: Texts are counted in groups of so many, which bounds the table of counts.
GROUP = 256

_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _letter:
        table = np.fromiter((chr(i).isalpha() for i in range(0x30000)), bool, 0x30000)
        _letter.append(table)
    return _letter[0]


def counts(texts: list[str]) -> np.ndarray:
    """Per text the counts of its hashed n-grams, as a dense table."""
    lower = [t.lower() for t in texts]
    joined = "".join(f" {t} " for t in lower)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 2 for t in lower), np.int64, len(lower))
    points = np.where(_letters()[np.minimum(points, 0x2FFFF)], points, 32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64) * DIMENSIONS, lengths)
    # runs of other characters in a text are one blank
    keep = np.flatnonzero(np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32) | (doc[1:] != doc[:-1])]))
    points, doc = points[keep].astype(U64), doc[keep]
    out = np.zeros(len(texts) * DIMENSIONS, np.float32)
    shift = U64(64 - 12)
    two = points[:-1] * U64(0x9E3779B97F4A7C15) + points[1:] * U64(0xC2B2AE3D27D4EB4F)
    same = doc[:-1] == doc[1:]
    cell = (two >> shift).astype(np.int64) + doc[1:]
    out += np.bincount(cell[same], minlength=len(out))
    three = (two[:-1] ^ (two[:-1] >> U64(29))) * U64(0xBF58476D1CE4E5B9) + points[2:] * U64(0x94D049BB133111EB)
    cell = (three >> shift).astype(np.int64) + doc[2:]
    out += np.bincount(cell[same[1:] & same[:-1]], minlength=len(out))
    return out.reshape(len(texts), DIMENSIONS)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts(texts)) * idf
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch, raw in slices(batches):
        texts = [t.decode("utf-8") for t in raw]
        for i in range(0, len(texts), GROUP):
            found += (counts(texts[i : i + GROUP]) > 0).sum(axis=0)
        n += len(texts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate([[n], found]))], ["cell", "n"])


class Model(NamedTuple):
    idf: np.ndarray
    centres: np.ndarray
    langs: list[str]  # of each centre
    least: np.ndarray  # cosine below which a text of this centre is rejected


def _cluster(idf: np.ndarray):
    def cluster(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """Spherical k-means from far-apart starts."""
        frame = frame.sort_values("doc_id", kind="stable")
        texts = frame["text"].tolist()
        x = np.concatenate([vectors(texts[i : i + GROUP], idf) for i in range(0, len(texts), GROUP)]).astype(np.float32)
        centres = [x.mean(axis=0)]
        while len(centres) < min(CENTROIDS, len(x)):
            near = (x @ np.array(centres).T).max(axis=1)
            centres.append(x[np.argsort(near, kind="stable")[len(x) // 20]])  # far away, but no outlier
        centre = np.array(centres)
        for _ in range(12):
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
            own = (x @ centre.T).argmax(axis=1)
            centre = np.array([x[own == i].mean(axis=0) if (own == i).any() else centre[i] for i in range(len(centre))])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        cosine = x @ centre.T
        own = cosine.argmax(axis=1)
        least = [float(np.quantile(cosine[own == i, i], REJECT_SHARE)) if (own == i).any() else 0.0 for i in range(len(centre))]
        return pd.DataFrame({"lang": key[0], "least": least, "centre": [c.tolist() for c in centre]})

    return cluster


def train(docs: DataFrame) -> Model | None:
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang"))
            .filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(~held_out()))
    found = {r.cell: r.n for r in rows.mapInArrow(_frequencies, "cell long, n long")
             .groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    if not found.get(-1):
        return None
    idf = np.log((1 + found[-1]) / (1 + np.array([found[i] for i in range(DIMENSIONS)]))) + 1
    many = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.create_map(*[F.lit(x) for lang, n in many.items() for x in (lang, min(1.0, MAX_PER_LANGUAGE / n))])
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    sample = sample.filter(F.regexp_like("text", F.lit(r"\p{L}")))
    centres = sorted(sample.groupBy("lang").applyInPandas(
        _cluster(idf), "lang string, least double, centre array<float>").collect(), key=lambda r: (r.lang, r.centre))
    if not centres:
        return None
    return Model(idf, np.array([r.centre for r in centres]), [r.lang for r in centres], np.array([r.least for r in centres]))


def _predict(model: Model | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches):
            texts = [t.decode("utf-8") for t in raw]
            known = np.array([model is not None and has_letter(t) for t in texts], bool)
            lang = np.full(len(texts), UNKNOWN, object)
            score, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
            at = np.flatnonzero(known)
            for i in range(0, len(at), GROUP):
                own = at[i : i + GROUP]
                cosine = vectors([texts[j] for j in own], model.idf) @ model.centres.T
                best = cosine.argmax(axis=1)
                top = cosine[np.arange(len(own)), best]
                lang[own] = np.array(model.langs, object)[best]
                score[own] = np.clip(top, 0, 1)
                rejected[own] = top < model.least[best]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                ["doc_id", "lang_pred", "score", "rejected"])

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row of ``docs``."""
    model = train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
