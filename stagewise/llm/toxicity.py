"""Toxicity by a weighted grammar of finite-state transducers.

Words become symbols: insult, threat, target, negation, report, other.  Three transducers run
over a clause and are composed into one: *negation* turns an insult or threat within three
words of a negator into a negated one, *reported speech* turns what follows a reporting verb or
stands in quotes into a reported one, *target* marks what lies within four words of an address.
The composition gives each insulting or threatening word of a clause one of the classes below,
with the word's learned weight; a clause scores per class, and a logistic model over the matched
clauses of a text gives its score.

Learned from labelled rows (at most ``MAX_LABELLED``, a fixed choice by hash of the id): the
lexicon, as log odds of words and word beginnings, and the logistic weights.  Everything else
runs on all rows.  Ids, language and source are no inputs.

Defined results: null and empty texts score as texts without a match; rows of ``labels`` whose
id or label is null or that repeat an id with both labels teach nothing; without labels every
score is the fallback 0.0; repeated ids are scored row by row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import by_pieces

MAX_LABELLED = 20_000
MAX_LEXICON = 20_000
PREFIX = 4
MIN_DOCS, MIN_ODDS = 4, 2.5

# Function words of the grammar in English, German, French and Spanish.
THREAT = frozenset("kill killed hurt destroy beat stab shoot burn murder töten umbringen schlagen vernichten "
                   "tuer frapper détruire brûler matar golpear destruir quemar".split())
TARGET = frozenset("you your yours yourself u ur they them these those du dich dir euch ihr sie tu toi te vous "
                   "ton votre eux usted ustedes vosotros vos ti ellos".split())
NEGATION = frozenset("not no never none neither nor without cannot isn't aren't don't nicht kein keine nie niemals "
                     "ohne ne pas jamais aucun sans nunca jamás sin ningún".split())
REPORT = frozenset("said says say saying told tells called calls wrote writes claimed quoted reported sagte sagt "
                   "schrieb nannte meinte dit disait écrit appelle dijo dice escribió llamó".split())

CLASSES = ("insult", "targeted", "negated", "reported", "threat", "targeted_threat")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n\"“”«»]")
_ENDS, _QUOTES = frozenset(".!?;:\n"), frozenset("\"“”«»")


class Transducer(NamedTuple):
    """``step[state][symbol] -> (state, symbol)``; symbols not listed pass unchanged."""

    start: object
    step: object


def negation(window: int = 3) -> Transducer:
    def step(left: int, symbol: str) -> tuple[int, str]:
        if symbol == "N":
            return window, symbol
        if left and symbol in "IT":
            return left - 1, "n"
        return max(0, left - 1), symbol

    return Transducer(0, step)


def reported() -> Transducer:
    def step(state: tuple[bool, bool], symbol: str) -> tuple[tuple[bool, bool], str]:
        told, quoted = state
        if symbol == "R":
            return (True, quoted), symbol
        if symbol == "Q":
            return (told, not quoted), symbol
        return state, "r" if (told or quoted) and symbol in "IT" else symbol

    return Transducer((False, False), step)


def target(window: int = 4) -> Transducer:
    def step(left: int, symbol: str) -> tuple[int, str]:
        if symbol == "G":
            return window, symbol
        marked = {"I": "J", "T": "U"}.get(symbol, symbol) if left else symbol
        return max(0, left - 1), marked

    return Transducer(0, step)


def compose(*parts: Transducer) -> Transducer:
    """One transducer that feeds each part's output to the next; its moves are tabled as they are met."""
    table: dict = {}

    def step(states: tuple, symbol: str) -> tuple[tuple, str]:
        if (known := table.get((states, symbol))) is None:
            after, out = [], symbol
            for part, state in zip(parts, states):
                state, out = part.step(state, out)
                after.append(state)
            known = table[states, symbol] = tuple(after), out
        return known

    return Transducer(tuple(p.start for p in parts), step)


GRAMMAR = compose(negation(), reported(), target())
_CLASS = {"I": 0, "J": 1, "n": 2, "r": 3, "T": 4, "U": 5}


class Model(NamedTuple):
    lexicon: dict[str, float]  # words, and beginnings as "beginning*"
    weights: np.ndarray
    trained: bool


def lexicon_weight(word: str, lexicon: dict[str, float]) -> float:
    return lexicon.get(word) or (lexicon.get(word[:PREFIX] + "*", 0.0) if len(word) > PREFIX else 0.0)


def features(text: str, lexicon: dict[str, float]) -> np.ndarray:
    """Per class the matched clauses' weight, then the strongest clause, their number and their share."""
    out = np.zeros(len(CLASSES) + 3)
    tokens = _TOKEN.findall(text.lower())
    weights = [lexicon_weight(w, lexicon) for w in tokens]
    if not any(weights) and not THREAT.intersection(tokens):
        return out
    state, clause, words = GRAMMAR.start, np.zeros(len(CLASSES)), 0
    strongest = matched = 0.0
    for token, weight in zip([*tokens, "."], [*weights, 0.0]):
        if token in _ENDS:
            if clause.any():
                out[: len(CLASSES)] += clause
                strongest, matched = max(strongest, clause.sum()), matched + 1
                clause[:] = 0
            (_, (_, quoted), _), state = state, GRAMMAR.start
            if quoted and token != "\n":  # a quotation may hold several clauses
                state = (state[0], (False, True), state[2])
            continue
        words += 1
        if weight:
            symbol = "I"
        elif token in _QUOTES:
            symbol = "Q"
        elif token in NEGATION:
            symbol = "N"
        elif token in REPORT:
            symbol = "R"
        elif token in TARGET:
            symbol = "G"
        elif token in THREAT:
            symbol, weight = "T", 1.0
        else:
            symbol = "O"
        state, symbol = GRAMMAR.step(state, symbol)
        if symbol in _CLASS:
            clause[_CLASS[symbol]] += weight
    out[: len(CLASSES)] = np.log1p(out[: len(CLASSES)])
    out[len(CLASSES) :] = strongest, math.log1p(matched), min(1.0, 20 * matched / max(words, 1))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, turns: int = 40) -> np.ndarray:
    """Newton steps on the penalised likelihood; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _terms(text: pa.Array) -> pa.Array:
    """Distinct words of a text, and the beginnings of the longer ones."""
    out = []
    for t in text.to_pylist():
        words = {w for w in _TOKEN.findall((t or "").lower()) if len(w) > 1}
        out.append([*words, *{w[:PREFIX] + "*" for w in words if len(w) > PREFIX}])
    return pa.array(out, pa.list_(pa.string()))


def _feature_udf(lexicon: dict[str, float]):
    @F.arrow_udf("array<double>")
    def extract(text: pa.Array) -> pa.Array:
        return pa.array([features(t or "", lexicon).tolist() for t in text.to_pylist()], pa.list_(pa.float64()))

    return extract


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the labelled rows that are not held out."""
    label = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out())
             .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
             .filter("toxic = most").drop("most"))
    share = min(1.0, MAX_LABELLED / max(1, label.count()))
    label = label.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(label), "doc_id")
            # copies of a text are one example, or what they share by chance would look like a rule
            .groupBy("toxic", F.xxhash64("text").alias("copy")).agg(F.min_by("text", "doc_id").alias("text")))
    # label has at most about MAX_LABELLED rows of two numbers, hence the hint
    terms = (rows.select("toxic", F.explode(F.arrow_udf(_terms, "array<string>")("text")).alias("term")).groupBy("term")
             .agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")))
    totals = rows.agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).first()
    pos, n = totals.pos or 0, totals.n
    if not pos or pos == n:
        return Model({}, np.zeros(len(CLASSES) + 4), False)
    odds = (F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("n") - F.col("pos") + 0.5) / (n - pos + 1.0)))
    least = max(MIN_DOCS, pos // 200)
    strong = (terms.filter(F.col("pos") >= least).withColumn("odds", odds).filter(F.col("odds") >= MIN_ODDS)
              .orderBy(F.desc(F.col("odds") * F.log1p("pos")), "term").limit(MAX_LEXICON).select("term", "odds"))
    lexicon = {r.term: float(r.odds) for r in strong.collect()}
    seen = rows.select("toxic", _feature_udf(lexicon)("text").alias("x")).collect()
    x, y = np.array([r.x for r in seen]), np.array([r.toxic for r in seen], float)
    return Model(lexicon, fit_logistic(x, y), True)


def score_udf(model: Model):
    """text -> score, as a column."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        if not model.trained:
            return pa.array(np.zeros(len(text)))

        def part(texts: list[str | None]) -> pa.Array:
            x = np.array([features(t or "", model.lexicon) for t in texts])
            z = x @ model.weights[:-1] + model.weights[-1]
            return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return by_pieces(text, part, pa.float64())

    return score.asNondeterministic()  # so that it runs once a row


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    model = train(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         score_udf(model)(F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
