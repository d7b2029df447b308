"""Render tidy tables back into point-of-sale report text (round-trip fixtures).

One report per branch.  Each line type is a DataFrame with sort keys
(s1..s4) and the text; the keys are the line's place (``pos``), and a ``chunk``
of lines shares their leading part, so no task orders a whole report.  Money
is printed with thousands separators and quoted, as in the exports.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shapes of the non-data lines of the exports.
BANNER = "Retail Group HQ"
FOOTER = 'REP_S_00001,"Copyright © 2024 Vendor",,,,www.vendor.com,'
PRINT_DATE = "30-Jan-26"
CHUNK_CHARS = 12  # of the last sort key: 100 order numbers, or ten hours of punches


def money(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit('"'), F.format_number(c, 2), F.lit('"'))


def plain(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("decimal(38,9)"), 2).cast("decimal(38,2)").cast("string")


def quoted(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def part(df: DataFrame, s1: int, line: Column, s2: Column | None = None, s3: Column | None = None,
         s4: Column | None = None) -> DataFrame:
    keys = [F.lit("") if c is None else F.coalesce(c.cast("string"), F.lit("")) for c in (s2, s3, s4)]
    return df.select("report_id", F.lit(s1).alias("s1"), *[c.alias(f"s{i}") for i, c in enumerate(keys, 2)],
                     line.alias("line"))


def static(reports: DataFrame, s1: int, text: str) -> DataFrame:
    return part(reports, s1, F.lit(text))


def assemble(parts: list[DataFrame]) -> DataFrame:
    """(report_id, pos, chunk, line): ``pos`` orders the lines of a report, ``chunk`` never disagrees with it."""
    u = reduce(DataFrame.unionByName, parts)
    chunk = F.concat_ws("\0", F.lpad(F.col("s1").cast("string"), 3, "0"), "s2", "s3", F.left("s4", F.lit(CHUNK_CHARS)))
    return u.select("report_id", F.struct("s1", "s2", "s3", "s4", "line").alias("pos"), chunk.alias("chunk"), "line")


def _reports(df: DataFrame) -> DataFrame:
    return df.select(F.col("branch").alias("report_id")).distinct()


def _frame(reports: DataFrame, title: str, header: str, last: int) -> list[DataFrame]:
    return [static(reports, 0, BANNER + ",,,,"), static(reports, 1, title),
            static(reports, 2, PRINT_DATE + ",,,,Page 1 of, 1"), static(reports, 3, header),
            static(reports, last, FOOTER), static(reports, last + 1, "")]


def tax_report(tax: DataFrame) -> DataFrame:
    t = tax.withColumn("report_id", F.col("branch"))
    r = _reports(tax)
    return assemble(_frame(r, "Tax Report,,,,,,,,,", "TAX DESCRIPTION,VAT 11 %,Tax 2,Tax 3,Tax 4,Tax 5,,Service,Total,", 9) + [
        static(r, 4, ",Year: 2025 - All Months,,,,,,,,"),
        part(t, 5, F.concat(F.lit("Branch Name:  "), F.col("branch"), F.lit(",,,,,,,,,"))),
        part(t, 6, F.concat(F.lit("Total By Branch,"), money("vat"), F.lit(",0.00,0.00,0.00,,0.00,0.00,"),
                            money("total_tax"), F.lit(",")))])


def monthly_sales(monthly: DataFrame) -> DataFrame:
    m = monthly.withColumn("report_id", F.col("branch"))
    r = _reports(monthly)
    yr = m.groupBy("report_id", "year").agg(F.sum("total").alias("t"))
    gt = m.groupBy("report_id").agg(F.sum("total").alias("t"))
    return assemble(_frame(r, "Monthly Sales,,,,", "Month,,Year,Total,", 9) + [
        static(r, 4, ",Year: 2025,,,"),
        part(r, 5, F.concat(F.lit("Branch Name: "), F.col("report_id"), F.lit(",,,,"))),
        part(m, 6, F.concat(F.col("month"), F.lit(",,"), F.col("year").cast("string"), F.lit(","), money("total"), F.lit(",")),
             F.col("year"), F.lpad(F.col("month_num").cast("string"), 2, "0")),
        part(yr, 6, F.concat(F.lit(",,Total for    "), F.col("year").cast("string"), F.lit(","), money("t"), F.lit(",")),
             F.col("year"), F.lit("99")),
        part(gt, 7, F.concat(F.lit(",,Grand Total:,"), money("t"), F.lit(",")))])


def avg_sales(avg: DataFrame) -> DataFrame:
    a = avg.withColumn("report_id", F.col("branch"))
    r = _reports(avg)
    tot = a.groupBy("report_id").agg(F.sum("num_customers").alias("c"), F.sum("sales").alias("s"))
    tline = F.concat(plain("c"), F.lit(","), plain("s"), F.lit(","), plain(F.col("s") / F.col("c")), F.lit(","))
    return assemble(_frame(r, "Average Sales By Menu,,,,", "Menu Name,# Cust,Sales,Avg Customer,", 9) + [
        static(r, 4, ",Year: 2025 - All Months,,,"),
        part(r, 5, F.concat(F.col("report_id"), F.lit(",,,,"))),
        part(a, 6, F.concat(F.col("menu_channel"), F.lit(","), plain("num_customers"), F.lit(","), plain("sales"),
                            F.lit(","), plain("avg_per_customer"), F.lit(",")), F.col("menu_channel")),
        part(tot, 7, F.concat(F.lit("Total By Branch:,"), tline)),
        part(tot, 8, F.concat(F.lit("Total :,"), tline))])


def _hms(secs: Column, sep: str) -> Column:
    s = secs.cast("bigint")
    return F.concat_ws(sep, F.lpad((s / 3600).cast("bigint").cast("string"), 2, "0"),
                       F.lpad(((s % 3600) / 60).cast("bigint").cast("string"), 2, "0"),
                       F.lpad((s % 60).cast("string"), 2, "0"))


def attendance(att: DataFrame) -> DataFrame:
    a = att.withColumn("report_id", F.col("branch"))
    r = _reports(att)
    emp = a.select("report_id", "emp_id", "emp_name", "branch").distinct()
    ek = F.lpad(F.col("emp_id").cast("string"), 12, "0")
    tot = a.groupBy("report_id", "emp_id").agg(F.sum("work_seconds").alias("t"))
    punch = F.concat(F.date_format("punch_in", "dd-MMM-yy"), F.lit(",,"), F.date_format("punch_in", "HH.mm.ss"), F.lit(","),
                     F.date_format("punch_out", "dd-MMM-yy"), F.lit(","), F.date_format("punch_out", "HH.mm.ss"),
                     F.lit(","), _hms(F.col("work_seconds"), "."))
    return assemble(_frame(r, "Time & Attendance Report,,,,,", ",PUNCH IN,,PUNCH OUT,,Work Duration", 9) + [
        static(r, 4, "," + PRINT_DATE + ",From Date: 01-Jan-2024 30-Jan-2024,,,"),
        part(emp, 5, F.concat(F.lit(",EMP ID :"), F.col("emp_id").cast("string"), F.lit(".0,NAME :"), F.col("emp_name"),
                              F.lit(",,,")), ek, F.lit("0")),
        part(emp, 5, F.concat(F.lit(","), F.col("branch"), F.lit(",,,,")), ek, F.lit("1")),
        part(a, 5, punch, ek, F.lit("2"), F.date_format("punch_in", "yyyy-MM-dd HH:mm:ss.SSSSSS")),
        part(tot, 5, F.concat(F.lit(",,,,Total :,"), _hms(F.col("t"), ":")), F.lpad(F.col("emp_id").cast("string"), 12, "0"),
             F.lit("3"))])


def sales_by_item(items: DataFrame) -> DataFrame:
    i = items.withColumn("report_id", F.col("branch"))
    r = _reports(items)
    divs = i.groupBy("report_id", "division").agg(F.sum("qty").alias("q"), F.sum("total_amount").alias("t"))
    grps = i.groupBy("report_id", "division", "grp").agg(F.sum("qty").alias("q"), F.sum("total_amount").alias("t"))
    br = i.groupBy("report_id").agg(F.sum("qty").alias("q"), F.sum("total_amount").alias("t"))

    def tot(label, name):
        return F.concat(F.lit(label), name, F.lit(",,"), plain("q"), F.lit(","), money("t"), F.lit(","))

    return assemble(_frame(r, "Sales by Items By Group,,,,", "Description,Barcode,Qty,Total Amount,", 9) + [
        static(r, 4, PRINT_DATE + ",Years:1997 Months:3,,,"),
        part(r, 5, F.concat(F.lit("Branch: "), F.col("report_id"), F.lit(",,,,"))),
        part(divs, 6, F.concat(F.lit("Division: "), F.col("division"), F.lit(",,,,")), F.col("division"), F.lit("0")),
        part(grps, 6, F.concat(F.lit("Group: "), F.col("grp"), F.lit(",,,,")), F.col("division"),
             F.concat(F.lit("1"), F.col("grp")), F.lit("0")),
        part(i, 6, F.concat(quoted("description"), F.lit(",,"), plain("qty"), F.lit(","), money("total_amount"), F.lit(",")),
             F.col("division"), F.concat(F.lit("1"), F.col("grp")), F.concat(F.lit("1"), F.col("description"))),
        part(grps, 6, tot("Total by Group: ", F.col("grp")), F.col("division"), F.concat(F.lit("1"), F.col("grp")), F.lit("2")),
        part(divs, 6, tot("Total by Division: ", F.col("division")), F.col("division"), F.lit("2")),
        part(br, 7, tot("Total by Branch: ", F.col("report_id")))])


def sales_by_customer(lines: DataFrame) -> DataFrame:
    s = lines.withColumn("report_id", F.col("branch"))
    # reports and their totals follow from the customers' totals, without further passes over the lines
    cust = s.groupBy("report_id", "customer").agg(F.sum("qty").alias("q"), F.sum("price").alias("t"))
    br = cust.groupBy("report_id").agg(F.sum("q").alias("q"), F.sum("t").alias("t"))
    r = br.select("report_id").distinct()
    item = F.concat(F.lit(","), money("qty"), F.lit(',"  '), F.replace(F.col("description"), F.lit('"'), F.lit('""')),
                    F.lit('",'), money("price"), F.lit(","))
    return assemble(_frame(r, "Sales by customer in detail,,,,", "Full Name,Qty,Description,Price,", 9) + [
        part(r, 5, F.concat(F.lit("Branch :"), F.col("report_id"), F.lit(",,,,"))),
        part(cust, 6, F.concat(F.lit("0 "), F.col("customer"), F.lit(",,,,")), F.col("customer"), F.lit("0")),
        part(s, 6, item, F.col("customer"), F.lit("1"),
             F.concat_ws("|", F.lpad(F.col("order_id").cast("string"), 14, "0"), F.col("description"))),
        part(cust, 6, F.concat(F.lit("Total :,"), money("q"), F.lit(",,"), money("t"), F.lit(",")), F.col("customer"), F.lit("2")),
        part(br, 7, F.concat(F.lit("Total Branch:,"), money("q"), F.lit(",,"), money("t"), F.lit(",")))])


def customer_orders(orders: DataFrame) -> DataFrame:
    o = orders.withColumn("report_id", F.col("branch"))
    r = _reports(orders)
    ts = "yyyy-MM-dd HH:mm:"
    gap = F.when(F.col("num_orders") % 2 == 0, F.lit(",,,")).otherwise(F.lit(",,"))  # two layouts
    row = F.concat(F.col("customer"), F.lit(",,,"), F.date_format("first_order", ts), F.lit(",,"),
                   F.date_format("last_order", ts), gap, money("total"), F.lit(","), F.col("num_orders").cast("string"),
                   F.lit(","))
    br = o.groupBy("report_id").agg(F.min("first_order").alias("f"), F.max("last_order").alias("l"),
                                    F.sum("total").alias("t"), F.sum("num_orders").alias("n"))
    return assemble(_frame(r, "Customer Orders,,,,,,,,,",
                           "Customer Name,Address,Phone Number,First Order,,Last Order,,Total,No. of Orders,", 9) + [
        part(r, 5, F.concat(F.col("report_id"), F.lit(",,,,,,,,,"))),
        part(o, 6, row, F.col("customer")),
        part(br, 7, F.concat(F.lit(",,Total By Branch,"), F.date_format("f", ts), F.lit(",,"), F.date_format("l", ts),
                             F.lit(",,"), money("t"), F.lit(","), F.col("n").cast("string"), F.lit(",")))])


def division_summary(div: DataFrame) -> DataFrame:
    d = div.withColumn("report_id", F.col("branch"))
    r = _reports(div)
    w = Window.partitionBy("report_id").orderBy(F.col("division") == "ITEMS", "division")
    d = d.withColumn("_k", F.row_number().over(w))
    first = F.concat(F.col("branch"), F.lit(","), F.col("division"), F.lit(","), money("delivery"), F.lit(","),
                     money("dine_in"), F.lit(",,"), money("take_away"), F.lit(","), money("total"))
    other = F.concat(F.lit(","), F.col("division"), F.lit(","), money("delivery"), F.lit(","), money("dine_in"),
                     F.lit(","), money("take_away"), F.lit(","), money("total"))
    tot = d.where(F.col("division") == "ITEMS")
    return assemble(_frame(r, "Summary By Division / Menu Channel,,,,,,", ",,DELIVERY,TABLE,,TAKE AWAY,TOTAL", 9) + [
        part(d, 5, F.when(F.col("_k") == 1, first).otherwise(other), F.lpad(F.col("_k").cast("string"), 6, "0")),
        part(tot, 6, F.concat(F.lit(",TOTAL,"), money("delivery"), F.lit(","), money("dine_in"), F.lit(","),
                              money("take_away"), F.lit(","), money("total")))])
