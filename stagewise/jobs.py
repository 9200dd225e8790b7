"""The whole flow as jobs for spark-submit.

    spark-submit -m stagewise.jobs load     --raw RAW --root ROOT
    spark-submit -m stagewise.jobs evolve   --raw RAW --root ROOT
    spark-submit -m stagewise.jobs report   --root ROOT --target FOLDER
    spark-submit -m stagewise.jobs serve    --root ROOT --target FOLDER
    spark-submit -m stagewise.jobs ask      --root ROOT funnel_yoy stage=lead

``python -m stagewise.jobs`` does the same on the master of the environment.
"""

from __future__ import annotations

import argparse
import json
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise import answers
from stagewise.errors import LedgerError
from stagewise.operators import checks
from stagewise.plans.catalogue import run_catalogue
from stagewise.plans.views import vw_week
from stagewise.schemas import DIMENSIONS, FACT_TIME
from stagewise.session import build_session, workspace
from stagewise.sources.checked import load_checked, reject_counts
from stagewise.sources.ledger import Ledger
from stagewise.sources.serve import serve_files, serve_jdbc

FUNNEL = "fact_funnel_event"


def _typed(spark: SparkSession, path: str, table: str, rejects: str | None = None) -> DataFrame:
    """A raw table under its types.  Rows that can not be taken stop the load; they are kept, with their reasons, in ``rejects``."""
    good, bad = load_checked(spark, path, table)
    rejects = rejects or f"{workspace(spark)}/rejects/{table}-{uuid.uuid4().hex}"
    bad.write.mode("overwrite").parquet(rejects)
    bad = spark.read.parquet(rejects)
    lost = bad.count()
    if lost:
        said = reject_counts(bad).orderBy(F.desc("rows"), "reason").limit(5).collect()
        raise LedgerError(f"{lost} rows of {path} can not be taken: " + "; ".join(f"{r.reason} ({r.rows})" for r in said)
                          + f"; all of them are in {rejects}")
    return good


def load(spark: SparkSession, raw: str, root: str) -> Ledger:
    """Dimensions replaced, facts loaded with one commit per month, laid out by day."""
    ledger = Ledger(spark, root)
    rows = lambda table: _typed(spark, f"{raw}/{table}", table, f"{root}/rejects/{table}")
    for table in DIMENSIONS:
        ledger.overwrite(table, rows(table))
    for table in FACT_TIME:
        ledger.load_by_month(table, rows(table))
    return ledger


def evolve(spark: SparkSession, raw: str, root: str) -> Ledger:
    """The funnel fact goes over to months, then the new batch of each fact is appended."""
    ledger = Ledger(spark, root)
    ledger.evolve(FUNNEL, "month")
    for table in FACT_TIME:
        ledger.append(table, _typed(spark, f"{raw}/{table}_new", table), batch="new")
    return ledger


def report(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Counts, catalogue, data checks and commits, each a table of its own."""
    ledger = Ledger(spark, root)
    star = ledger.star()
    counts = [star.table(t).agg(F.count(F.lit(1)).alias("rows"))
              .select(F.lit(t).alias("table_name"), "rows") for t in FACT_TIME]
    return {
        "rows": counts[0].unionByName(counts[1]),
        "complete weeks": vw_week(star).filter("is_complete_week").agg(
            F.count(F.lit(1)).alias("weeks")),
        "catalogue": run_catalogue(star),
        "checks": checks.contract_check(star).unionByName(checks.iso_week_span(star))
        .unionByName(checks.yoy_pair_check(star)).unionByName(checks.rate_null_check(star)),
        "commits": ledger.log(),
    }


def serve(spark: SparkSession, root: str, target: str, **properties: str) -> None:
    """A serving copy in a database if ``target`` is a JDBC address, else in a folder."""
    star = Ledger(spark, root).star()
    if target.startswith("jdbc:"):
        serve_jdbc(star, target, properties)
    else:
        serve_files(star, target)


def ask(spark: SparkSession, root: str, metric: str, **arguments) -> list[dict]:
    ledger = Ledger(spark, root)
    return answers.answer(metric, ledger.star(), ledger, **arguments)


def _pairs(texts: list[str]) -> dict[str, object]:
    """``key=value`` arguments; numbers and lists ``a,b`` are recognised."""
    out: dict[str, object] = {}
    for key, value in (t.split("=", 1) for t in texts):
        whole = value.lstrip("-").isdigit() and key not in ("current", "previous", "as_of_date")
        out[key] = int(value) if whole else value.split(",") if "," in value else value
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stagewise.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, flags in (("load", ("raw", "root")),
                        ("evolve", ("raw", "root")), ("report", ("root", "target")),
                        ("serve", ("root", "target")), ("ask", ("root",))):
        job = jobs.add_parser(name)
        for flag in flags:
            job.add_argument(f"--{flag}", required=True)
        if name == "ask":
            job.add_argument("metric")
        if name in ("ask", "serve"):
            job.add_argument("pairs", nargs="*", metavar="key=value")
    args = parser.parse_args(argv)

    spark = build_session(f"stagewise {args.job}")
    if args.job == "load":
        load(spark, args.raw, args.root)
    elif args.job == "evolve":
        evolve(spark, args.raw, args.root)
    elif args.job == "report":
        failed = False
        for name, frame in report(spark, args.root).items():
            frame.write.mode("overwrite").parquet(f"{args.target}/{name.replace(' ', '_')}")
            print(f"{name}: {args.target}/{name.replace(' ', '_')}")
            failed |= name == "catalogue" and not frame.filter("NOT ok").isEmpty()
        return int(failed)
    elif args.job == "serve":
        serve(spark, args.root, args.target, **{k: str(v) for k, v in _pairs(args.pairs).items()})
    else:
        for row in ask(spark, args.root, args.metric, **_pairs(args.pairs)):
            print(json.dumps(row, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
