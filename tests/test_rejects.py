"""Raw rows that can not be taken, and why."""

from pyspark.sql import functions as F

from stagewise.sources.checked import load_checked, read_text, reject_counts

FUNNEL, ORDERS = "fact_funnel_event", "fact_orders"
HEADER = "event_key,date_key,customer_key,channel_key,stage,event_ts\n"


def load(spark, folder, table, *lines, header=HEADER):
    folder.mkdir(exist_ok=True)
    (folder / "a.csv").write_text(header + "".join(f"{line}\n" for line in lines))
    good, bad = load_checked(spark, str(folder), table)
    return [tuple(r) for r in good.collect()], {r[0]: r.reasons for r in bad.collect()}


def test_every_row_is_good_or_has_all_its_reasons(spark, tmp_path):
    good, bad = load(spark, tmp_path / "r", FUNNEL, "1,0,5,0,visit,2022-01-03 07:05:00", "x,0,5,0,visit,2022-01-03", "3,1.5,5,,visit,07:05",
                     "4,0,5", "5,0,5,0,visit,2022-01-03,more,and more", "6,0,99999999999,0,,2022-02-30", '7,0,5,0,"a, b",2022-01-04')
    assert [(g[0], g[4]) for g in good] == [(1, "visit"), (7, "a, b")]
    assert bad == {"x": ["event_key is not a whole number"], "3": ["date_key is not a whole number", "channel_key is missing", "event_ts is not a time"],
                   "4": ["columns are missing: 3 of 6"], "5": ["columns too many: 8 for 6"],
                   "6": ["stage is missing", "event_ts is not a time"]}


def test_types_of_good_rows_are_those_of_the_table(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.csv").write_text(HEADER + "1,0,5,0,visit,2022-01-03\n")
    good, bad = load_checked(spark, str(tmp_path / "r"), FUNNEL)
    assert [t for _, t in good.dtypes] == ["bigint", "int", "bigint", "int", "string", "timestamp"]
    assert bad.columns == ["event_key", "date_key", "customer_key", "channel_key", "stage", "event_ts", "broken_record", "reasons"]


def test_infinite_and_unreal_measures_and_quoted_commas_in_broken_lines(spark, tmp_path):
    head = "order_line_key,date_key,customer_key,channel_key,product_key,revenue,quantity,order_ts\n"
    good, bad = load(spark, tmp_path / "r", ORDERS, "1,0,1,1,1,2.50,1,2022-01-01", "2,0,1,1,1,NaN,1,2022-01-01", "3,0,1,1,1,Infinity,1,2022-01-01",
                     "4,0,1,1,1,1e400,1,2022-01-01", '5,0,1,1,"1,2,3",2.0,1', header=head)
    assert [g[0] for g in good] == [1]
    assert {bad[k][0] for k in "234"} == {"revenue is not a number"} and bad["5"][0] == "columns are missing: 7 of 8"


def test_an_empty_file_and_reasons_counted(spark, tmp_path):
    good, bad = load(spark, tmp_path / "r", FUNNEL)
    assert good == [] and bad == {}
    (tmp_path / "r" / "b.csv").write_text(HEADER + "x,0,5,0,visit,n/a\ny,0,5,0,visit,2022-01-01\n")
    rejected = load_checked(spark, str(tmp_path / "r"), FUNNEL)[1]
    assert {r.reason: r.rows for r in reject_counts(rejected).collect()} == {"event_key is not a whole number": 2, "event_ts is not a time": 1}


def test_one_narrow_pass_without_python(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.csv").write_text(HEADER + "1,0,5,0,visit,2022-01-03\n")
    plan = load_checked(spark, str(tmp_path / "r"), FUNNEL)[1]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert read_text(spark, str(tmp_path / "r"), FUNNEL).select(F.count(F.lit(1))).first()[0] == 1


def test_a_load_stops_at_any_broken_field_and_says_why(spark, tmp_path):
    import pytest

    from stagewise import jobs
    from stagewise.errors import LedgerError

    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.csv").write_text(HEADER + "1,0,5,0,visit,2022-01-03\nx,0,5,0,visit,2022-01-03\n2,y,5,0,visit\n")
    with pytest.raises(LedgerError, match="2 rows .* columns are missing: 5 of 6 .1.; date_key is not a whole number .1.; event_key is not a whole number"):
        jobs._typed(spark, str(tmp_path / "r"), FUNNEL, str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 2


def test_a_stream_keeps_rejects_with_their_reasons(spark, tmp_path):
    from stagewise.sources.ledger import Ledger
    from stagewise.streaming.append import append_files

    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.csv").write_text(HEADER + "1,0,5,0,visit,2022-01-03\n2,0,five,0,visit,2022-01-03\n3,0,5,0,visit,soon\n")
    ledger = Ledger(spark, str(tmp_path / "t"))
    append_files(ledger, FUNNEL, str(tmp_path / "r"), str(tmp_path / "cp"), "raw", str(tmp_path / "bad")).awaitTermination()
    assert [r.event_key for r in ledger.read(FUNNEL).collect()] == [1]
    got = {r.event_key: (r.customer_key, r.event_ts, r.reasons) for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert got == {2: (None, "2022-01-03", ["customer_key is not a whole number"]), 3: (5, "soon", ["event_ts is not a time"])}
