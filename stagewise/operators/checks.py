"""Data checks as jobs.  Each rule gives one row ``(check, rows_checked, violations)``,
so a clean table still answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.operators.funnel import funnel_yoy_all
from stagewise.operators.suspects import SPAN, KeyFilter, key_filter
from stagewise.plans.daily import WEEK
from stagewise.plans.views import vw_funnel_weekly
from stagewise.schemas import FOREIGN_KEYS, TABLES
from stagewise.star import Star


def _rule(name: str, rows: DataFrame, violated: Column) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("rows_checked"),
                    F.count_if(violated).alias("violations")).select(
        F.lit(name).alias("check"), "rows_checked", "violations")


def _stacked(summed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """One row of sums as one row per rule ``(check, rows column, violations column)``."""
    cells = ", ".join(f"'{check}', {rows}, {bad}" for check, rows, bad in rules)
    return summed.selectExpr(
        f"stack({len(rules)}, {cells}) AS (`check`, rows_checked, violations)")


def _together(rules: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def iso_week_span(star: Star) -> DataFrame:
    """No ISO week may span more than six days from its first to its last date."""
    weeks = star.dim_date.groupBy(*WEEK).agg(
        F.datediff(F.max("date"), F.min("date")).alias("span_days"))
    return _rule("iso_week_spans_at_most_6_days", weeks, F.col("span_days") > 6)


def widest_week(star: Star) -> DataFrame:
    """The week with the longest span."""
    return (star.dim_date.groupBy(*WEEK)
            .agg(F.datediff(F.max("date"), F.min("date")).alias("span_days"))
            .orderBy(F.desc("span_days"), *WEEK).limit(1))


def yoy_pair_check(star: Star) -> DataFrame:
    """Every stage and week: the prior week is one ISO year earlier, and if it holds
    nothing the change is unknown and says so."""
    rows = funnel_yoy_all(star)
    prior = F.col("prior_year_events")
    expected = F.format_string("%d-W%02d", F.col("iso_year") - 1, F.col("iso_week"))
    unknown = (F.col("yoy_pct").isNull() & (F.col("direction") == "unknown")
               & F.col("note").isNotNull())
    flags = rows.select(
        (F.col("prior_year_week") != expected).alias("mispaired"),
        (prior.isNull() & ~unknown).alias("invented"),
        (prior.isNotNull() & F.col("note").isNotNull()).alias("spurious"))
    summed = flags.selectExpr("count(1) AS n", *[f"count_if({c}) AS {c}" for c in flags.columns])
    return _stacked(summed, [("yoy_pairs_same_week", "n", "mispaired"),
                             ("yoy_missing_prior_is_unknown", "n", "invented"),
                             ("yoy_note_only_when_unknown", "n", "spurious")])


_RATES = (("visit_to_lead_pct", "leads", "visits"),
          ("lead_to_opp_pct", "opportunities", "leads"),
          ("opp_to_order_pct", "orders", "opportunities"),
          ("visit_to_order_pct", "orders", "visits"))


def rate_null_check(star: Star) -> DataFrame:
    """A rate is null exactly when its denominator is zero; a real zero stays 0."""
    rules, sums = [], []
    for rate, part, whole in _RATES:
        sums += [f"count_if(({rate} IS NULL) <> ({whole} = 0)) AS {rate}_wrong",
                 f"count_if({part} = 0 AND {whole} > 0 AND {rate} <> 0) AS {rate}_lost"]
        rules += [(f"{rate}_null_iff_no_base", "n", f"{rate}_wrong"),
                  (f"{rate}_zero_stays_zero", "n", f"{rate}_lost")]
    return _stacked(vw_funnel_weekly(star).selectExpr("count(1) AS n", *sums), rules)


def not_null_check(star: Star, table: str) -> DataFrame:
    """One rule per column, one pass over the table."""
    columns = TABLES[table].fieldNames()
    summed = star.table(table).selectExpr(
        "count(1) AS n", *[f"count_if({c} IS NULL) AS missing_{c}" for c in columns])
    return _stacked(summed, [(f"{table}.{c} not null", "n", f"missing_{c}") for c in columns])


def foreign_key_check(star: Star, table: str) -> DataFrame:
    """Rows whose key has no parent, one rule per key, one pass over the table.

    Keys are counted before they are matched, so a hot key is one row.
    """
    keys = [(key, parent) for child, key, parent in FOREIGN_KEYS if child == table]
    pairs = ", ".join(f"'{key}', CAST({key} AS BIGINT)" for key, _ in keys)
    counts = (star.table(table).selectExpr(f"stack({len(keys)}, {pairs}) AS (name, key)")
              .groupBy("name", "key").agg(F.count(F.lit(1)).alias("n")))
    parents = reduce(DataFrame.unionByName, [
        star.table(parent).selectExpr(f"'{key}' AS name", f"CAST({key} AS BIGINT) AS key")
        for key, parent in keys])
    matched = counts.join(parents.distinct().withColumn("held", F.lit(True)),
                          ["name", "key"], "left")
    summed = matched.selectExpr(*[
        f"coalesce(sum(n) FILTER (WHERE name = '{key}'{orphan}), 0L) AS {column}_{key}"
        for key, _ in keys
        for column, orphan in (("total", ""), ("orphans", " AND held IS NULL AND key IS NOT NULL"))])
    return _stacked(summed, [(f"{table}.{key} in {parent}", f"total_{key}", f"orphans_{key}")
                             for key, parent in keys])


def unique_key_check(star: Star, table: str, column: str) -> DataFrame:
    repeated = star.table(table).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return _rule(f"{table}.{column} unique", repeated, F.col("n") > 1)


def table_rules(star: Star, table: str, filters: dict[str, KeyFilter]) -> DataFrame:
    """Null rules of a table and the key rules of a fact, from one read of it."""
    keys = [(key, parent) for child, key, parent in FOREIGN_KEYS if child == table]
    columns = TABLES[table].fieldNames()
    sums = [F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns]]
    rules = [(f"{table}.{c} not null", "n", f"missing_{c}") for c in columns]
    for key, parent in keys:
        value = F.col(key).cast("long")
        sums.append(F.count_if(value.isNotNull() & filters[parent].clear(value)).alias(f"orphans_{key}"))
        rules.append((f"{table}.{key} in {parent}", "n", f"orphans_{key}"))
    return _stacked(star.table(table).agg(*sums), rules)


def contract_check(star: Star, tables: tuple[str, ...] = tuple(TABLES), span: int = SPAN) -> DataFrame:
    """Null, key and uniqueness rules of the schema.

    Keys of a parent become bits that every task of a fact looks up; where the keys of some parent
    are spread too far for that, its facts' keys are counted and joined.
    """
    wanted = {parent: key for child, key, parent in FOREIGN_KEYS if child in tables}
    filters = {parent: key_filter(star.table(parent), key, span) for parent, key in wanted.items()}
    rules = []
    for table in tables:
        wide = any(not filters[parent].exact for child, _, parent in FOREIGN_KEYS if child == table)
        rules += [not_null_check(star, table), foreign_key_check(star, table)] if wide else [table_rules(star, table, filters)]
    if "dim_date" in tables:
        rules += [unique_key_check(star, "dim_date", c) for c in ("date_key", "date")]
    return _together(rules)
