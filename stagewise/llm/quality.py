"""Quality rules by host: base measures per text, failure rates per host, verdicts joined back.

Every text gets the base measures.  For each rule the failures are summed per host; over all
hosts a beta prior is fitted to the rates by moments, and a host's rate is shrunk to
``(failures + alpha) / (texts + alpha + beta)``, so a host of few texts is judged mostly by
what is usual.  A host is rejected when, for any rule, its rate lies clearly above the usual one: the
shrunk rate less ``DEVIATIONS`` of its posterior is still more than ``LIFT`` times the prior's mean
(or, where failing is usual, more than halfway from that mean to one).  Where all hosts are alike no
host is rejected, whatever their rate.

Defined results: null and empty texts have no words and fail the base rule; a null host is a
host of its own; rows without an id and repeated ids are measured row by row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import Scratch, grams, slices, words_of

WINDOW = 5
LIFT, DEVIATIONS = 2.0, 3.0
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

#: rule -> condition on the measures
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("short", "repeats")


def measures(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of each text."""
    n = len(texts)
    words = words_of(texts, lower=False)
    data = words.data
    text_of = np.zeros(len(data), np.int64)
    text_of[words.first[1:]] = 1
    text_of = np.cumsum(text_of)
    point = (data & 0xC0) != 0x80  # the first byte of each code point
    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[words.start] = 1
    in_word[words.end] = -1
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)

    hashes, at = grams(words, WINDOW)
    covered = np.zeros(len(words.doc) + 1, np.int64)
    if len(hashes):
        doc = words.doc[at]
        order = np.lexsort((hashes, doc))
        same = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(hashes), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + WINDOW, -1)
    repeated = np.cumsum(covered[:-1]) > 0

    lines, doubled = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        own = [x for x in text.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
        lines[i], doubled[i] = len(own), len(own) - len(set(own))
    return {
        "n_words": np.bincount(words.doc, minlength=n),
        "word_chars": np.bincount(text_of[point & in_word], minlength=n),
        "n_symbols": np.bincount(text_of[_SYMBOL[data]], minlength=n),
        "n_dup_lines": doubled,
        "n_repeat_words": np.bincount(words.doc[repeated], minlength=n),
        "n_lines": lines,
    }


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        found = measures(texts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("host"), *(pa.array(found[m], pa.int64()) for m in MEASURES)],
            ["doc_id", "host", *MEASURES])


def _prior(rule: str) -> list[Column]:
    """Mean and concentration of a beta prior by moments, each host weighed alike.

    The spread that binomial noise alone would make is taken off first; without any spread
    left the prior is as strong as 1000 texts.
    """
    rate, n = F.col(f"f_{rule}") / F.col("n"), F.col("n")
    mean, spread = F.avg(rate), F.var_pop(rate)
    noise = mean * (1 - mean) * F.avg(1 / n)
    strength = F.when(spread > noise, mean * (1 - mean) / (spread - noise) - 1).otherwise(F.lit(1000.0))
    return [mean.alias(f"m_{rule}"), F.greatest(F.lit(1.0), F.least(F.lit(1000.0), strength)).alias(f"s_{rule}")]


def host_rates(measured: DataFrame) -> DataFrame:
    """Per host: texts, shrunk rate of each rule, verdict."""
    fails = [F.sum(F.expr(rule).cast("long")).alias(f"f_{name}") for name, rule in RULES.items()]
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), *fails)
    # the prior is one row, read with each host and never by the driver
    prior = hosts.agg(F.struct(*[c for name in RULES for c in _prior(name)]).alias("p")).scalar()
    judged = hosts.select("host", "n", *[
        ((F.col(f"f_{x}") + prior[f"m_{x}"] * prior[f"s_{x}"]) / (F.col("n") + prior[f"s_{x}"])).alias(f"rate_{x}") for x in RULES])
    kept = F.lit(True)
    for x in RULES:
        rate, mean = F.col(f"rate_{x}"), prior[f"m_{x}"]
        spread = F.sqrt(rate * (1 - rate) / (F.col("n") + prior[f"s_{x}"] + 1))
        kept &= rate - DEVIATIONS * spread <= F.least(LIFT * mean, (1 + mean) / 2)
    return judged.withColumn("host_kept", kept)


def quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"),
                       F.col("text").cast("string").alias("text"))
    schema = "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES)
    measured = scratch.write(rows.mapInArrow(_measure, schema), "measures")
    failed = F.expr(" OR ".join(f"({RULES[r]})" for r in BASE))
    verdict = host_rates(measured).select(F.col("host").alias("judged"), "host_kept")
    joined = measured.join(verdict, F.col("host").eqNullSafe(F.col("judged")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), (~failed & F.col("host_kept")).alias("kept"))


_SQL_MEASURES = r"""
base AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
word AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w,
                generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM base),
gram AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS times FROM (
           SELECT r, i, list(w) OVER five AS g, count(*) OVER five AS long FROM word
           WINDOW five AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE long = 5),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM gram, range(5) AS x(k) WHERE times > 1 GROUP BY r),
total AS (SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM word GROUP BY r),
line AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
         FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM base) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT base.r, doc_id, host, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
      FROM base LEFT JOIN total USING (r) LEFT JOIN rep USING (r) LEFT JOIN line USING (r))"""


def quality_sql() -> str:
    fails = ", ".join(f"sum(({rule})::INT) AS f_{name}" for name, rule in RULES.items())
    prior = ", ".join(
        f"avg(f_{x} / n) AS m_{x}, greatest(1.0, least(1000.0, CASE WHEN var_pop(f_{x} / n) > avg(f_{x} / n) * (1 - avg(f_{x} / n)) * avg(1 / n) "
        f"THEN avg(f_{x} / n) * (1 - avg(f_{x} / n)) / (var_pop(f_{x} / n) - avg(f_{x} / n) * (1 - avg(f_{x} / n)) * avg(1 / n)) - 1 ELSE 1000.0 END)) AS s_{x}"
        for x in RULES)
    shrunk = ", ".join(f"(f_{x} + m_{x} * s_{x}) / (n + s_{x}) AS r_{x}" for x in RULES)
    fine = " AND ".join(f"r_{x} - {DEVIATIONS} * sqrt(r_{x} * (1 - r_{x}) / (n + s_{x} + 1)) <= least({LIFT} * m_{x}, (1 + m_{x}) / 2)"
                        for x in RULES)
    failed = "(" + " OR ".join(RULES[r] for r in BASE) + ")"
    return f"""WITH {_SQL_MEASURES},
h AS (SELECT host, count(*) AS n, {fails} FROM m GROUP BY host), p AS (SELECT {prior} FROM h),
u AS (SELECT *, {shrunk} FROM h, p), v AS (SELECT host, {fine} AS host_kept FROM u)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed,
       NOT {failed} AND host_kept AS kept
FROM m JOIN v ON m.host IS NOT DISTINCT FROM v.host"""
