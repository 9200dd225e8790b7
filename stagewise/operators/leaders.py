"""Leading products of every period from summaries of days.

The summary of a day holds its ``capacity`` largest products and one number, the bound: the largest
amount it left out.  Summaries add up to any period.  A product's total lies between the sum over the
days that list it and that sum plus the bounds of the days that do not; so one that no day lists
has at most the sum of all bounds.  Every product that could be among the leaders is a candidate and
is counted exactly, from the rows of candidates alone.  Where even an unlisted product could lead, the
summaries do not decide, and the period is counted in full.  The ranks are the exact ones in both cases.

Amounts are taken to be zero or more; a day with a negative amount gets no bound, so that its
periods are counted in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.errors import MetricError
from stagewise.functions.calendar import GRAINS, period_label
from stagewise.functions.ratios import half_up
from stagewise.operators.arguments import how_many
from stagewise.plans.daily import money_sum
from stagewise.star import Star

CAPACITY = 1000
_AMOUNT = "decimal(38,4)"


def _daily(star: Star, measure: str) -> DataFrame:
    if measure not in ("orders", "revenue"):
        raise MetricError(f"measure must be orders or revenue, got {measure!r}")
    amount = F.count(F.lit(1)) if measure == "orders" else money_sum()
    return star.fact_orders.groupBy("date_key", "product_key").agg(amount.cast(_AMOUNT).alias("amount"))


def day_summaries(daily: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``date_key, product_key, amount, bound``: the largest of each day, with the day's bound on each row.

    A day whose rows all fit has bound 0; ``bound`` is null where nothing can be promised.
    """
    order = Window.partitionBy("date_key").orderBy(F.desc("amount"), "product_key")
    top = daily.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= capacity + 1)
    day = Window.partitionBy("date_key")
    lowest = daily.groupBy("date_key").agg(F.min("amount").alias("lowest"))
    bound = F.coalesce(F.max(F.when(F.col("place") == capacity + 1, F.col("amount"))).over(day), F.lit(0).cast(_AMOUNT))
    return (top.withColumn("bound", bound).filter(F.col("place") <= capacity).join(lowest, "date_key")
            .select("date_key", "product_key", "amount", F.when(F.col("lowest") >= 0, F.col("bound")).alias("bound")))


def _periods(star: Star) -> DataFrame:
    """``date_key, grain, period``: each day in its four periods."""
    cells = F.array(*[F.struct(F.lit(g).alias("grain"), period_label(g).alias("period")) for g in GRAINS])
    return star.dim_date.select("date_key", F.inline(cells))


def candidates(summaries: DataFrame, days: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """``(grain, period, product_key)`` that could lead, and the ``(grain, period)`` that summaries do not decide."""
    each = summaries.join(days, "date_key")
    by = ("grain", "period")
    bounds = (each.select(*by, "date_key", "bound").distinct().groupBy(*by)
              .agg(F.sum("bound").alias("unlisted"), F.count_if(F.col("bound").isNull()).alias("open")))
    sums = each.groupBy(*by, "product_key").agg(F.sum("amount").alias("least"), F.sum("bound").alias("own")).join(bounds, list(by))
    most = F.col("least") + F.col("unlisted") - F.col("own")
    order = Window.partitionBy(*by).orderBy(F.desc("least"), "product_key")
    kth = (sums.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).groupBy(*by)
           .agg(F.min("least").alias("kth"), F.count(F.lit(1)).alias("found")))
    sums = sums.join(kth, list(by))
    # an unlisted product could be level with the last leader, and names decide then
    undecided = (bounds.join(kth, list(by)).filter((F.col("open") > 0) | ((F.col("unlisted") > 0) & (
        (F.col("unlisted") >= F.col("kth")) | (F.col("found") < limit)))).select(*by))
    could = sums.filter((F.col("found") < limit) | (most >= F.col("kth"))).select(*by, "product_key")
    return could.join(undecided, list(by), "left_anti"), undecided


def top_product_periods(star: Star, measure: str = "revenue", limit: int = 5, capacity: int = CAPACITY) -> DataFrame:
    """``grain, period, rank, name, value``: the leading product names of every week, month, quarter and year."""
    limit = how_many("limit", limit)
    daily, days = _daily(star, measure), _periods(star)
    named = star.dim_product.select("product_key", F.col("product_name").alias("name"))
    # names are ranked, and several keys may share one: their amounts belong together before anything is cut
    daily = (daily.join(named, "product_key").groupBy("date_key", F.col("name").alias("product_key"))
             .agg(F.sum("amount").cast(_AMOUNT).alias("amount")))
    could, undecided = candidates(day_summaries(daily, capacity), days, limit)
    whole = daily.join(days, "date_key")
    by = ["grain", "period"]
    exact = (whole.join(could, [*by, "product_key"], "left_semi").unionByName(whole.join(undecided, by, "left_semi"))
             .groupBy(*by, "product_key").agg(F.sum("amount").alias("amount")))
    order = Window.partitionBy(*by).orderBy(F.desc("amount"), "product_key")
    value: Column = half_up(F.col("amount").cast("double"), 2)
    return (exact.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
            .select(*by, "rank", F.col("product_key").alias("name"), value.alias("value")))
