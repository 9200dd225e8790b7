"""Foreign keys checked against filters of bits.

The keys of a parent become one row: an array of 64-bit words, in which a bit stands for a key.
Words are put together by ``bit_or`` where the parent is read, so what is shuffled is a word per 64
keys and task, never a key.  Each fact is then read once, and every key looks up its bit.

A key has a bit of its own while the parents' keys span at most ``SPAN`` numbers: then a key without
its bit has no parent and one with it has, and nothing is left to be joined.  Over a wider span keys
share bits.  A key whose bit is clear still has no parent; a key that shares a set bit is suspect
until it met the parents themselves, and only such keys, counted first, are joined to them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.schemas import FACT_TIME, FOREIGN_KEYS
from stagewise.star import Star

#: Bits of one filter at most: 2**26 bits are 8 MB, in every task.
SPAN = 1 << 26


@dataclass(frozen=True)
class KeyFilter:
    """Bits of the keys of a parent: ``words`` is one value, an array of 64-bit words."""

    words: Column
    low: int
    bits: int
    exact: bool

    def clear(self, key: Column) -> Column:
        """Whether the bit of a key is clear: such a key has no parent."""
        at = F.pmod(key - self.low, F.lit(self.bits))
        word = F.get(self.words, F.floor(at / 64).cast("int"))
        bit = F.getbit(word, F.pmod(at, F.lit(64)).cast("int"))
        outside = (key < self.low) | (key >= self.low + self.bits)
        return F.when(outside & F.lit(self.exact), True).otherwise(bit == 0)


def key_filter(parents: DataFrame, key: str, span: int = SPAN) -> KeyFilter:
    """The filter of a parent's keys; only words, never keys, leave the tasks that read it."""
    keys = parents.select(F.col(key).cast("long").alias("k")).filter("k IS NOT NULL")
    ends = keys.agg(F.min("k").alias("low"), F.max("k").alias("high")).first()
    low, high = (0, -1) if ends.low is None else ends
    bits = max(64, min(span, high - low + 1))
    at = F.pmod(F.col("k") - low, F.lit(bits))
    words = (keys.select(F.floor(at / 64).alias("word"), F.pmod(at, F.lit(64)).cast("int").alias("bit"))
             .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    every = (keys.sparkSession.range(-(-bits // 64)).withColumnRenamed("id", "word").join(words, "word", "left")
             .agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("all"))
             .select(F.col("all.bits").alias("words")))
    return KeyFilter(every.scalar(), low, bits, high - low < span)


def fk_suspects(star: Star, table: str, span: int = SPAN) -> DataFrame:
    """``check, rows_checked, violations``, a row for each key of a fact, which is read once."""
    own = [(key, parent) for child, key, parent in FOREIGN_KEYS if child == table]
    filters = {key: key_filter(star.table(parent), key, span) for key, parent in own}
    cells = []
    for key, _ in own:
        value, bits = F.col(key).cast("long"), filters[key]
        state = (F.when(value.isNull(), "null").when(bits.clear(value), "orphan")
                 .otherwise("held" if bits.exact else "suspect"))
        cells.append(F.struct(F.lit(key).alias("name"), state.alias("state"), F.when(state == "suspect", value).alias("key")))
    counts = (star.table(table).select(F.inline(F.array(*cells))).groupBy("name", "state", "key")
              .agg(F.count(F.lit(1)).alias("n")))
    shared = [(key, parent) for key, parent in own if not filters[key].exact]
    bad = F.col("state") == "orphan"
    if shared:  # keys whose bit another key may have set
        parents = reduce(DataFrame.unionByName, [
            star.table(parent).select(F.lit(key).alias("name"), F.col(key).cast("long").alias("key")).distinct()
            for key, parent in shared]).withColumn("held", F.lit(True))
        counts = counts.join(parents, ["name", "key"], "left")
        bad |= (F.col("state") == "suspect") & F.col("held").isNull()
    totals = counts.groupBy("name").agg(F.sum("n").alias("rows_checked"), F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("violations"))
    named = star.spark.createDataFrame([(key, f"{table}.{key} in {parent}") for key, parent in own], "name string, check string")
    return (named.join(totals, "name", "left")
            .select("check", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rows_checked", "violations")]))


def fk_suspects_all(star: Star, span: int = SPAN) -> DataFrame:
    return reduce(DataFrame.unionByName, [fk_suspects(star, t, span) for t in FACT_TIME])
