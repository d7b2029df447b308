"""Hierarchical report parsers: report lines -> tidy tables.

Every parser has the same plan: drop noise -> split the trimmed line into CSV
fields -> mark header values with ``when`` -> carry them down the report
(``carry_forward``: bounded windows) -> keep data rows -> type the fields.
Header levels are independent and never reset by a parent header, as in the
exports.  All regexes below are fixed values of the report formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fill import carry_forward
from ..functions.scalars import (clean_text, parse_number, repair_quotes, strip_description, strip_numeric_prefix,
                                 try_ts_ntz)
from ..sources.reports import PRINT_DATE_RE, drop_noise, is_page

# A comma outside double quotes (CSV field separator).
CSV_SPLIT = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
MARK = "\x01"

# Per-report line patterns.
TAX_BRANCH_RE = r"(?i)^Branch Name:\s*(.+)"
MONTHLY_BRANCH_RE = r"(?i)^Branch Name:\s*(.+)"
ITEM_BRANCH_RE, ITEM_DIVISION_RE, ITEM_GROUP_RE = r"(?i)^Branch:\s*(.+)", r"(?i)^Division:\s*(.+)", r"(?i)^Group:\s*(.+)"
ITEM_TOTAL_RE, ITEM_HEADER_RE = r"(?i)^Total by (Group|Division|Branch)", r"(?i)^Description\s*,\s*Barcode"
CUST_BRANCH_RE, CUST_TOTAL_RE, CUST_HEADER_RE = r"(?i)^Branch\s*:\s*(.+)", r"(?i)^Total\s*(Branch)?\s*:", r"(?i)^Full Name\s*,\s*Qty"
ORDERS_HEADER_RE, ORDERS_TOTAL_RE = r"(?i)^Customer Name", r"(?i)Total By Branch"
ORDERS_CUSTOMER_RE = r"^Person_\d+"
ORDERS_TS_RE = r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:"
EMP_RE = r"EMP ID\s*:\s*([\d.]+)\s*,\s*NAME\s*:\s*([^,\s]+)"
ATT_DATE_RE, ATT_TOTAL_RE = r"^\d{2}-\w{3}-\d{2}$", r"(?i)Total\s*:"
ATT_HEADER_RE = r"(?i)PUNCH\s+IN|PUNCH\s+OUT|Work Duration"
DIVISION_HEADER_RE = r"(?i)^,*\s*(DELIVERY|TABLE|TAKE\s*AWAY|TOTAL)"
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December"]


def _unquote(f: Column) -> Column:
    inner = F.regexp_extract(f, r'^"(.*)"$', 1)
    return F.when(f.startswith('"') & f.rlike(r'^".*"$'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(f)


def csv_fields(t: Column) -> Column:
    """``t`` split at ``CSV_SPLIT``, in time linear in its length.

    A comma separates fields if the quotes after it are even in number: such commas are marked piece by piece between quotes,
    and the text is cut at the marks.  A text that holds the mark itself is split by the pattern.
    """
    pieces = F.split(t, '"', -1)
    marked = F.transform(pieces, lambda x, i: F.when((F.size(pieces) - 1 - i) % 2 == 0, F.translate(x, ",", MARK)).otherwise(x))
    return (F.when(t.contains(MARK), F.split(t, CSV_SPLIT, -1)).when(t.contains('"'), F.split(F.array_join(marked, '"'), MARK, -1))
            .otherwise(F.split(t, ",", -1)))


def prepare(lines: DataFrame, skip: list[str], csv: bool = True) -> DataFrame:
    """Noise-free, trimmed lines with their fields; ``skip`` regexes drop lines."""
    # a generated column is computed once: the many tests of a line are not pushed into what prints it
    lines = lines.withColumn("line", F.explode(F.array("line")))
    d = drop_noise(lines, pages=False).withColumn("t", F.trim("line"))
    cond = is_page(F.col("t"))
    for s in skip:
        cond = cond | F.col("t").rlike(s)
    d = d.where(~cond)
    fields = csv_fields(F.col("t")) if csv else F.split(F.col("t"), ",", -1)
    if csv:
        fields = F.transform(fields, _unquote)
    return d.withColumn("f", fields)


def fld(i: int) -> Column:
    return F.coalesce(F.get(F.col("f"), i), F.lit(""))


def col0() -> Column:
    return F.trim(fld(0))


def _branch_list(branches) -> DataFrame | list[str]:
    if branches is None:
        raise ValueError("this report names branches without a mark: give their list")
    return branches


def _known(d: DataFrame, c: Column, branches) -> DataFrame:
    """Flag ``_kb`` = c is a known branch (list literal, or a small branch table)."""
    if isinstance(branches, DataFrame):
        kb = branches.select(F.col(branches.columns[0]).alias("_kbname")).distinct()
        d = d.withColumn("_c0", c).join(kb, F.col("_c0") == F.col("_kbname"), "left")
        return d.withColumn("_kb", F.col("_kbname").isNotNull()).drop("_kbname", "_c0")
    return d.withColumn("_kb", c.isin(list(branches)))


# ---------------------------------------------------------------- ING-2
def parse_tax_report(lines: DataFrame) -> DataFrame:
    d = prepare(lines, [r"^Tax Report", PRINT_DATE_RE, r"^,Year:", r"(?i)^TAX DESCRIPTION"])
    c0 = col0()
    d = d.withColumn("branch", F.when(c0.rlike(TAX_BRANCH_RE), F.trim(F.regexp_extract(c0, TAX_BRANCH_RE, 1))))
    d = carry_forward(d, ["branch"])
    nonblank = F.filter("f", lambda x: F.trim(x) != "")
    d = d.where(col0().startswith("Total By Branch") & F.col("branch").isNotNull())
    return d.select("branch", F.coalesce(parse_number(fld(1)), F.lit(0.0)).alias("vat"),
                    F.coalesce(parse_number(F.element_at(nonblank, -1)), F.lit(0.0)).alias("total_tax"))


# ---------------------------------------------------------------- ING-7
def parse_monthly_sales(lines: DataFrame) -> DataFrame:
    d = prepare(lines, [r"Monthly Sales", PRINT_DATE_RE, r"^,Year:", r"^Month"])
    c0 = col0()
    d = d.withColumn("branch", F.when(c0.rlike(MONTHLY_BRANCH_RE), F.trim(F.regexp_extract(c0, MONTHLY_BRANCH_RE, 1))))
    d = carry_forward(d, ["branch"])
    d = d.where(~c0.rlike(MONTHLY_BRANCH_RE))
    d = d.where(~F.exists("f", lambda x: x.contains("Total") | x.contains("Grand")))
    month_num = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), c0).cast("int")
    d = d.withColumn("month_num", month_num).where(F.col("month_num") > 0)
    rest = F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(1)))
    four = F.filter(rest, lambda x: F.trim(x).rlike(r"^\d{4}$"))
    nums = F.filter(F.transform(F.filter(rest, lambda x: (~F.trim(x).rlike(r"^\d{4}$")) & (F.trim(x) != "")),
                                lambda x: parse_number(x)), lambda x: x.isNotNull())
    d = d.select("branch", c0.alias("month"), "month_num",
                 F.element_at(four, -1).cast("int").alias("year"),
                 F.coalesce(F.element_at(nums, -1), F.lit(0.0)).alias("total"))
    return d.withColumn("date", F.make_date("year", "month_num", F.lit(1)))


# ---------------------------------------------------------------- ING-8
def parse_avg_sales(lines: DataFrame, branches=None) -> DataFrame:
    d = prepare(lines, [r"Average Sales", PRINT_DATE_RE, r"^,Year:", r"^Menu Name"], csv=False)
    c0 = col0()
    d = d.where(~c0.startswith("Total"))
    d = _known(d, c0, _branch_list(branches))
    d = d.withColumn("branch", F.when(F.col("_kb"), c0))
    d = carry_forward(d, ["branch"])
    num = parse_number(fld(1))
    d = d.where(~F.col("_kb") & (c0 != "") & num.isNotNull())
    return d.select("branch", c0.alias("menu_channel"), num.cast("bigint").alias("num_customers"),
                    F.coalesce(parse_number(fld(2)), F.lit(0.0)).alias("sales"),
                    F.coalesce(parse_number(fld(3)), F.lit(0.0)).alias("avg_per_customer"))


# ---------------------------------------------------------------- ING-3
def _hms_hours(c: Column) -> Column:
    p = F.split(F.regexp_replace(F.trim(c), r"\.", ":"), ":")
    h, m, s = (F.get(p, i).try_cast("bigint") for i in range(3))
    ok = (F.size(p) == 3) & h.isNotNull() & m.isNotNull() & s.isNotNull()
    return F.when(ok, (h * 3600 + m * 60 + s) / 3600.0)


def _punch(date: Column, time: Column) -> Column:
    ok = (F.trim(date) != "") & (F.trim(time) != "")
    txt = F.concat(F.trim(date), F.lit(" "), F.regexp_replace(F.trim(time), r"\.", ":"))
    return F.when(ok, try_ts_ntz(txt, "dd-MMM-yy HH:mm:ss"))


def parse_attendance(lines: DataFrame) -> DataFrame:
    d = prepare(lines, [r"Time & Attendance"], csv=False)
    t = F.col("t")
    emp = t.rlike(EMP_RE)
    d = d.withColumn("emp_id", F.when(emp, F.regexp_replace(F.regexp_extract(t, EMP_RE, 1), r"\.0", "")))
    d = d.withColumn("emp_name", F.when(emp, F.regexp_extract(t, EMP_RE, 2)))
    f0, f1 = F.trim(fld(0)), F.trim(fld(1))
    other = ~emp & ~t.rlike(ATT_HEADER_RE) & ~t.rlike(ATT_TOTAL_RE) & ~t.rlike(r"^\d{2}-\w{3}-\d{2}\s*$")
    is_branch = (other & (F.size("f") >= 2) & (f0 == "") & (f1 != "")
                 & ~F.exists("f", lambda x: (F.trim(x) != "") & F.trim(x).rlike(ATT_DATE_RE))
                 & ~f1.rlike(r"^\d{2}\.\d{2}\.\d{2}") & ~f1.startswith("EMP") & ~f1.rlike(r"^\d{2}-\w{3}-\d{2}")
                 & ~f1.rlike(r"^\d"))
    d = d.withColumn("branch", F.when(is_branch, f1)).withColumn("_punch", other & ~is_branch & f0.rlike(ATT_DATE_RE))
    d = carry_forward(d, ["emp_id", "emp_name", "branch"])
    d = d.where(F.col("_punch"))
    return d.select("emp_id", "emp_name", "branch",
                    _punch(fld(0), fld(2)).alias("punch_in"), _punch(fld(3), fld(4)).alias("punch_out"),
                    F.coalesce(_hms_hours(F.when(F.trim(fld(5)) != "", fld(5))), F.lit(0.0)).alias("work_duration_hours"))


# ---------------------------------------------------------------- ING-6
def parse_sales_by_item(lines: DataFrame) -> DataFrame:
    d = prepare(lines, [ITEM_HEADER_RE, r"Sales by Items", PRINT_DATE_RE])
    c0 = repair_quotes(col0())
    d = d.withColumn("_c0", c0)
    c0 = F.col("_c0")
    d = (d.withColumn("branch", F.when(c0.rlike(ITEM_BRANCH_RE), F.trim(F.regexp_extract(c0, ITEM_BRANCH_RE, 1))))
         .withColumn("division", F.when(~c0.rlike(ITEM_BRANCH_RE) & c0.rlike(ITEM_DIVISION_RE),
                                        F.trim(F.regexp_extract(c0, ITEM_DIVISION_RE, 1))))
         .withColumn("grp", F.when(~c0.rlike(ITEM_BRANCH_RE) & ~c0.rlike(ITEM_DIVISION_RE) & c0.rlike(ITEM_GROUP_RE),
                                   F.trim(F.regexp_extract(c0, ITEM_GROUP_RE, 1)))))
    header = c0.rlike(ITEM_BRANCH_RE) | c0.rlike(ITEM_DIVISION_RE) | c0.rlike(ITEM_GROUP_RE)
    d = d.withColumn("_hdr", header)
    d = carry_forward(d, ["branch", "division", "grp"])
    qty = parse_number(fld(2))
    desc = strip_description(c0)
    d = d.where(~F.col("_hdr") & ~c0.rlike(ITEM_TOTAL_RE) & (F.size("f") >= 3) & (desc != "") & qty.isNotNull())
    total = F.coalesce(parse_number(fld(3)), F.lit(0.0))
    return d.select("branch", "division", "grp", desc.alias("description"), qty.alias("qty"),
                    total.alias("total_amount"), F.when(qty > 0, total / qty).otherwise(0.0).alias("unit_price"))


# ---------------------------------------------------------------- ING-4
def parse_sales_by_customer(lines: DataFrame) -> DataFrame:
    d = prepare(lines, [CUST_HEADER_RE, r"(?i)^Sales by customer", PRINT_DATE_RE])
    c0, c1 = col0(), F.trim(fld(1))
    is_branch = c0.rlike(CUST_BRANCH_RE)
    is_total = c0.rlike(CUST_TOTAL_RE) | F.concat(c0, c1).rlike(CUST_TOTAL_RE)
    is_cust = ~is_branch & ~is_total & (c0 != "") & (c1 == "")
    d = (d.withColumn("branch", F.when(is_branch, F.trim(F.regexp_extract(c0, CUST_BRANCH_RE, 1))))
         .withColumn("customer", F.when(is_cust, F.trim(strip_numeric_prefix(c0))))
         .withColumn("_data", ~is_branch & ~is_total & ~is_cust))
    d = carry_forward(d, ["branch", "customer"])
    qty = parse_number(c1)
    d = d.where(F.col("_data") & qty.isNotNull())
    return d.select("branch", "customer", qty.alias("qty"), strip_description(fld(2)).alias("description"),
                    F.coalesce(parse_number(F.trim(fld(3))), F.lit(0.0)).alias("price"),
                    (qty < 0).alias("is_cancellation"))


# ---------------------------------------------------------------- ING-5
def parse_customer_orders(lines: DataFrame, branches=None, customer_re: str = ORDERS_CUSTOMER_RE) -> DataFrame:
    d = prepare(lines, [ORDERS_HEADER_RE, r"Customer Orders", PRINT_DATE_RE])
    c0 = col0()
    d = _known(d, c0, _branch_list(branches))
    d = d.withColumn("branch", F.when(F.col("_kb"), c0))
    d = carry_forward(d, ["branch"])
    d = d.where(~F.col("_kb") & ~F.exists("f", lambda x: x.rlike(ORDERS_TOTAL_RE)) & c0.rlike(customer_re))
    idx = F.filter(F.sequence(F.lit(0), F.size("f") - 1), lambda i: F.trim(F.get(F.col("f"), i)).rlike(ORDERS_TS_RE))
    two = F.size(idx) >= 2
    second = F.get(idx, 1)
    rest = F.slice("f", second + 2, F.greatest(F.size("f"), F.lit(1)))
    nums = F.filter(F.transform(F.filter(rest, lambda x: F.trim(x) != ""), lambda x: parse_number(x)),
                    lambda x: x.isNotNull())
    ts = "yyyy-MM-dd HH:mm:"
    return d.select(
        "branch", c0.alias("customer"), F.trim(fld(2)).alias("phone"),
        F.when(two, try_ts_ntz(F.trim(F.get(F.col("f"), F.get(idx, 0))), ts)).alias("first_order"),
        F.when(two, try_ts_ntz(F.trim(F.get(F.col("f"), second)), ts)).alias("last_order"),
        F.coalesce(F.when(two, F.get(nums, 0)), F.lit(0.0)).alias("total"),
        F.coalesce(F.when(two & (F.size(nums) >= 2), F.get(nums, 1).cast("bigint")), F.lit(0)).cast("bigint")
        .alias("num_orders"))


# ---------------------------------------------------------------- ING-1
def parse_division_summary(lines: DataFrame) -> DataFrame:
    d = prepare(lines, [r"^Summary By Division", PRINT_DATE_RE, DIVISION_HEADER_RE])
    last = F.array_max(F.filter(F.transform("f", lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull()))
    d = d.withColumn("f", F.slice("f", 1, F.coalesce(last + 1, F.lit(0)))).where(F.size("f") > 0)
    c0 = repair_quotes(F.trim(fld(0)))
    c1 = repair_quotes(F.trim(fld(1)))
    d = d.withColumn("_c0", c0).withColumn("_c1", c1)
    c0, c1 = F.col("_c0"), F.col("_c1")
    d = d.withColumn("branch", F.when((c0 != "") & ~((c1 != "") & (F.upper(c1) == "TOTAL")), c0))
    d = carry_forward(d, ["branch"])
    d = d.where((c1 != "") & (F.upper(c1) != "TOTAL"))
    nums = F.transform(F.filter(F.slice("f", 3, F.greatest(F.size("f"), F.lit(1))), lambda x: F.trim(x) != ""),
                       lambda x: parse_number(x))
    n = F.size(nums)

    def at(i):
        return F.coalesce(F.when(n >= 3, F.get(nums, i)), F.lit(0.0))

    return d.select("branch", clean_text(c1).alias("division"), at(0).alias("delivery"), at(1).alias("dine_in"),
                    at(2).alias("take_away"), F.coalesce(F.when(n >= 4, F.get(nums, 3)), F.lit(0.0)).alias("total"))
