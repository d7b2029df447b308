"""Report parsers on small reports of our own, layout variants, and the chunked forward fill."""

import datetime as dt
import textwrap

import pytest
from pyspark.sql import functions as F

from retailops.functions.fill import carry_forward
from retailops.operators import parsers as PR
from retailops.sources.reports import drop_noise


def L(spark, text, rid="r"):
    rows = [(rid, i, line) for i, line in enumerate(textwrap.dedent(text).split("\n"))]
    return spark.createDataFrame(rows, "report_id string, pos long, line string")


FOOT = 'REP_S_00007,"Copyright © 2024 Vendor",,,www.vendor.com,'


def test_tax_total_is_the_last_filled_field(spark):
    rows = PR.parse_tax_report(L(spark, f"""\
        Head Office,,,,
        Tax Summary,,,,
        05-Mar-24,,,,Page 1 of, 2
        Branch Name:  North,,,,,,,,,
        Total By Branch,"1,200.00",0.00,0.00,0.00,,0.00,0.00,"1,200.00",
        {FOOT}
        Branch Name:  South,,,,,,,,,
        Total By Branch,30.50,0.00,0.00,0.00,,0.00,0.00,31.75,
        """)).orderBy("branch").collect()
    assert [tuple(r) for r in rows] == [("North", 1200.0, 1200.0), ("South", 30.5, 31.75)]


def test_monthly_totals_are_dropped(spark):
    rows = PR.parse_monthly_sales(L(spark, f"""\
        Month,,Year,Total,
        Branch Name: North,,,,
        May,,2025,"7,500.00",
        June,,2025,80.25,
        ,,Total for    2025,"7,580.25",
        Branch Name: South,,,,
        May,,2024,1.00,
        ,,Grand Total:,"7,581.25",
        {FOOT}
        """)).orderBy("branch", "month_num").collect()
    assert [tuple(r) for r in rows] == [
        ("North", "May", 5, 2025, 7500.0, dt.date(2025, 5, 1)), ("North", "June", 6, 2025, 80.25, dt.date(2025, 6, 1)),
        ("South", "May", 5, 2024, 1.0, dt.date(2024, 5, 1))]


def test_average_sales_of_listed_branches(spark):
    text = """\
        Menu Name,# Cust,Sales,Avg Customer,
        North,,,,
        TABLE,20.00,4000.00,200.00,
        Total By Branch:,20.00,4000.00,200.00,
        South,,,,
        DELIVERY,4.00,50.00,12.50,
        Total :,24.00,4050.00,168.75,
        """
    rows = PR.parse_avg_sales(L(spark, text), branches=["North", "South"]).orderBy("branch").collect()
    assert [tuple(r) for r in rows] == [("North", "TABLE", 20, 4000.0, 200.0), ("South", "DELIVERY", 4, 50.0, 12.5)]
    with pytest.raises(ValueError):
        PR.parse_avg_sales(L(spark, text))


def test_attendance_over_midnight(spark):
    rows = PR.parse_attendance(L(spark, f"""\
        ,PUNCH IN,,PUNCH OUT,,Work Duration
        ,EMP ID :7.0,NAME :P7,,,
        ,North,,,,
        03-Dec-25,,08.00.00,03-Dec-25,16.30.00,08.30.00
        03-Dec-25,,22.15.00,04-Dec-25,06.00.00,07.45.00
        ,,,,Total :,16:15:00
        {FOOT}
        """)).orderBy("punch_in").collect()
    assert [(r.emp_id, r.emp_name, r.branch, r.punch_in, r.punch_out, r.work_duration_hours) for r in rows] == [
        ("7", "P7", "North", dt.datetime(2025, 12, 3, 8), dt.datetime(2025, 12, 3, 16, 30), 8.5),
        ("7", "P7", "North", dt.datetime(2025, 12, 3, 22, 15), dt.datetime(2025, 12, 4, 6), 7.75)]


def test_item_levels_stay_when_the_branch_changes(spark):
    rows = PR.parse_sales_by_item(L(spark, """\
        Description,Barcode,Qty,Total Amount,
        Branch: North,,,,
        Division: Hot,,,,
        Group: Cups,,,,
        MOCHA,,4.0,"1,000.00",
        Total by Group: Cups,,4.0,"1,000.00",
        Branch: South,,,,
        TEA,,8.0,20.00,
        """)).orderBy("branch").collect()
    assert [(r.branch, r.division, r.grp, r.description, r.qty, r.unit_price) for r in rows] == [
        ("North", "Hot", "Cups", "MOCHA", 4.0, 250.0), ("South", "Hot", "Cups", "TEA", 8.0, 2.5)]


def test_sales_by_customer(spark):
    rows = PR.parse_sales_by_customer(L(spark, """\
        Branch :North,,,,
        0 P12,,,,
        ,-1,"  CREPE, LARGE",0.00,
        Total :,-1,,0.00,
        Total Branch:,-1,,0.00,
        """)).collect()
    assert [tuple(r) for r in rows] == [("North", "P12", -1.0, "CREPE, LARGE", 0.0, True)]


def test_customer_orders_two_layouts(spark):
    rows = PR.parse_customer_orders(L(spark, """\
        North,,,,,,,,,
        Person_0003,,555,2025-08-01 10:00:,,2025-09-02 11:30:,,"2,400.00",3,
        Person_0004,,555,2025-08-01 10:00:,,2025-09-02 11:30:,,,"2,400.00",3,
        ,,Total By Branch,2025-08-01 10:00:,,2025-09-02 11:30:,,"4,800.00",6,
        """), branches=["North"]).orderBy("customer").collect()
    assert [(r.customer, r.total, r.num_orders, r.first_order) for r in rows] == [
        ("Person_0003", 2400.0, 3, dt.datetime(2025, 8, 1, 10, 0)),
        ("Person_0004", 2400.0, 3, dt.datetime(2025, 8, 1, 10, 0))]


def test_division_summary_two_layouts(spark):
    rows = PR.parse_division_summary(L(spark, """\
        ,,DELIVERY,TABLE,,TAKE AWAY,TOTAL
        North,Hot,1.00,2.00,,3.00,6.00
        ,Cold,1.00,2.00,3.00,6.00
        ,Three,1.00,2.00,3.00,,,
        ,TOTAL,2.00,4.00,6.00,12.00
        """)).orderBy("division").collect()
    assert [tuple(r) for r in rows] == [("North", "Cold", 1.0, 2.0, 3.0, 6.0), ("North", "Hot", 1.0, 2.0, 3.0, 6.0),
                                        ("North", "Three", 1.0, 2.0, 3.0, 0.0)]


@pytest.mark.parametrize("line,noise", [
    ('x,"copyright © Vendor"', True), (",,www.vendor.com,", True), ("REP_S_12,anything", True), ("", True), (" \t", True),
    ("North,Cups,,0.00,12.50", False)])
def test_noise(spark, line, noise):
    kept = drop_noise(spark.createDataFrame([("r", 0, line)], "report_id string, pos long, line string")).count()
    assert kept == (0 if noise else 1)


def test_carry_forward_across_chunks(spark):
    # headers every 7 lines, chunks of 3 lines: values must cross chunk borders
    rows = [("a", i, f"h{i}" if i % 7 == 0 else None) for i in range(50)] + [("b", 0, None), ("b", 1, "x")]
    df = spark.createDataFrame(rows, "report_id string, pos long, h string")
    got = {(r.report_id, r.pos): r.h for r in carry_forward(df, ["h"], chunk_rows=3).collect()}
    assert all(got[("a", i)] == f"h{i - i % 7}" for i in range(50))
    assert got[("b", 0)] is None and got[("b", 1)] == "x"


def test_carry_forward_along_sort_keys(spark):
    """Lines placed by their sort keys, chunks by a leading part of them: no line numbers are needed."""
    rows = [(r, (a, b), f"{a:03}", f"{r}{a}" if b == 0 and a % 3 == 0 else None) for r in "xy" for a in range(20) for b in range(4)]
    df = spark.createDataFrame(rows, "report_id string, pos struct<a:int,b:int>, chunk string, h string").repartition(7)
    got = {(r.report_id, *r.pos): r.h for r in carry_forward(df, ["h"]).collect()}
    assert got == {(r, a, b): f"{r}{a - a % 3}" for r in "xy" for a in range(20) for b in range(4)}
