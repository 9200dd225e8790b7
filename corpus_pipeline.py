"""From raw documents to packed training sequences, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; its
result is written as Parquet and read again.  All but the last return the columns of ``docs``.

1. toxicity: documents scored 0.5 or more go;
2. near duplicates: the smallest id of each group stays; rows that repeat an id are judged each by
   its own text, so only equal or linked ones go;
3. decontamination: documents that cover half of a benchmark item go;
4. secrets: spans are masked in the text, and ``n_chars`` follows; no document goes;
5. packing: pieces of at most 4096 tokens with their place in a sequence.

Null texts are kept until packing, where they are an end id alone; rows without an id are never
duplicates; an empty table passes through as an empty table; clashing extra columns pass along.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.llm.common import Scratch, ship
from stagewise.llm.decontam import COVERAGE, worst_match
from stagewise.llm.minhash import near_duplicates
from stagewise.llm.packing import pack
from stagewise.llm.queries import table, tokenizer_file
from stagewise.llm.secrets import fit, redact_udf
from stagewise.llm.toxicity import score_udf, train

#: Ids to drop are broadcast up to so many rows of 8 bytes, and joined by a shuffle beyond.
SMALL_IDS = 2_000_000
_MARK = "corpus_pipeline_mark"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.withColumn(_MARK, score_udf(model)(F.col("text").cast("string")))
    return scored.filter(F.col(_MARK) < 0.5).drop(_MARK)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch, rows, key = Scratch(spark, "dedup"), docs, "doc_id"
    again = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not again.isEmpty():
        # of equal rows of an id one stays; then rows are numbered in the order of ids, and judged one by one
        again = scratch.write(again, "again")
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        first = (docs.join(again, "doc_id", "left_semi").groupBy("doc_id", F.col("text").alias(_MARK))
                 .agg(F.min(F.struct("text", *others)).alias("r")).select("doc_id", "r.*").select(docs.columns))
        rows = docs.join(again, "doc_id", "left_anti").unionByName(first).orderBy("doc_id", "text")
        key = _MARK
        rows = scratch.write(rows.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "rows")
    found = scratch.write(near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")), "found")
    gone = found.filter("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    if gone.count() <= SMALL_IDS:
        gone = F.broadcast(gone)
    return rows.join(gone, key, "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = docs.withColumn(_MARK, worst_match(docs, table(spark, sf_dir, "benchmark")))
    return judged.filter(F.col(_MARK)["coverage"] < COVERAGE).drop(_MARK)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = docs.withColumn("text", redact_udf(fit(docs))(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        same = F.col("text").isNull()
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))
    return masked.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_file(), end_id=1)


def _ready(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with executors and batch sizes made ready for it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _ready(drop_toxic)),
    ("near_duplicates", _ready(drop_near_duplicates)),
    ("decontamination", _ready(drop_contaminated)),
    ("secrets", _ready(mask_secrets)),
    ("packing", _ready(pack_sequences)),
]

#: Learned models, signatures and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
