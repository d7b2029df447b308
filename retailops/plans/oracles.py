"""Independent SQL oracles (DuckDB dialect) for the registered keys.

Each oracle is self-contained: it re-derives the FIXTURES.md §2 bindings as
CTEs from the base tables and states the operator in plain SQL.  Floating
outputs go through the same decimal rounding as the Spark side.
"""

from __future__ import annotations

from . import params as P
from ..operators.category import LISTED


def rnd(x: str, n: int) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,9)), {n}) AS DOUBLE)"


def item_key(x: str) -> str:
    return rf"regexp_replace(regexp_replace(upper(trim({x})), '[.,]+$', ''), '\s+', ' ', 'g')"


def word_set_key(x: str) -> str:
    return (rf"array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(trim({x}), '\s+'), "
            rf"lambda w: w <> ''))), ' ')")


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(vals) -> str:
    return "(" + ", ".join(sq(v) for v in vals) + ")"


# ------------------------------------------------------------ binding CTEs
CTE = {
    "geo": f"""geo AS (
  SELECT n_nationkey, n_name, r_regionkey, r_name AS branch FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "sales_lines": f"""sales_lines AS (
  SELECT g.branch, c_name AS customer, l_orderkey AS order_id, o_orderdate AS order_ts,
         p_type AS division, p_brand AS grp, p_name AS item, p_brand || ' ' || p_name AS description,
         CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS qty,
         l_extendedprice AS price, l_tax AS tax_rate, l_returnflag = 'R' AS is_cancellation,
         CASE o_orderstatus WHEN 'F' THEN 'delivery' WHEN 'O' THEN 'table' ELSE 'take_away' END AS channel
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
       JOIN geo g ON g.n_nationkey = c_nationkey JOIN part ON p_partkey = l_partkey)""",
    "order_facts": f"""order_facts AS (
  SELECT g.branch, c_name AS customer, o_orderkey AS order_id, o_orderdate AS order_ts, o_totalprice AS total,
         CASE o_orderstatus WHEN 'F' THEN 'DELIVERY' WHEN 'O' THEN 'TABLE' ELSE 'TAKE AWAY' END AS menu_channel
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN geo g ON g.n_nationkey = c_nationkey)""",
    "sales_by_item": f"""sales_by_item AS (
  SELECT branch, division, grp, description, sum(qty) AS qty, {rnd("sum(price)", 2)} AS total_amount,
         {rnd("sum(price)", 2)} / sum(qty) AS unit_price
  FROM sales_lines WHERE NOT is_cancellation
  GROUP BY branch, division, grp, description)""",
    "monthly_sales": f"""monthly_sales AS (
  SELECT branch, strftime(d, '%B') AS month, CAST(month(d) AS INTEGER) AS month_num, CAST(year(d) AS INTEGER) AS year,
         total, d AS date
  FROM (SELECT branch, CAST(date_trunc('month', order_ts) AS DATE) AS d, {rnd("sum(total)", 2)} AS total
        FROM order_facts GROUP BY 1, 2))""",
    "division_summary": f"""division_summary AS (
  SELECT branch, coalesce(division, 'ITEMS') AS division,
         {rnd("sum(CASE WHEN channel = 'delivery' THEN price ELSE 0 END)", 2)} AS delivery,
         {rnd("sum(CASE WHEN channel = 'table' THEN price ELSE 0 END)", 2)} AS dine_in,
         {rnd("sum(CASE WHEN channel = 'take_away' THEN price ELSE 0 END)", 2)} AS take_away, {rnd("sum(price)", 2)} AS total
  FROM sales_lines WHERE NOT is_cancellation GROUP BY GROUPING SETS ((branch, division), (branch)))""",
    "avg_sales": f"""avg_sales AS (
  SELECT branch, menu_channel, count(DISTINCT customer) AS num_customers, {rnd("sum(total)", 2)} AS sales,
         {rnd(rnd("sum(total)", 2) + " / count(DISTINCT customer)", 2)} AS avg_per_customer
  FROM order_facts GROUP BY branch, menu_channel)""",
    "customer_orders": f"""customer_orders AS (
  SELECT branch, customer, min(order_ts) AS first_order, max(order_ts) AS last_order, {rnd("sum(total)", 2)} AS total,
         count(*) AS num_orders
  FROM order_facts GROUP BY branch, customer)""",
    "tax_report": f"""tax_report AS (
  SELECT branch, {rnd(rnd("sum(price * tax_rate)", 4), 2)} AS vat, {rnd(rnd("sum(price * tax_rate)", 4), 2)} AS total_tax
  FROM sales_lines WHERE NOT is_cancellation GROUP BY branch)""",
    "attendance": f"""attendance AS (
  SELECT user_id AS emp_id, 'P' || CAST(user_id AS VARCHAR) AS emp_name, r_name AS branch, ts AS punch_in,
         ts + to_seconds(CAST(floor(value * 360) AS BIGINT)) AS punch_out,
         CAST(floor(value * 360) AS BIGINT) AS work_seconds,
         floor(value * 360) / 3600 AS work_duration_hours
  FROM events JOIN region ON r_regionkey = user_id % 5)""",
}
DEPS = {
    "sales_lines": ["geo"], "order_facts": ["geo"], "sales_by_item": ["sales_lines"],
    "monthly_sales": ["order_facts"], "division_summary": ["sales_lines"], "avg_sales": ["order_facts"],
    "customer_orders": ["order_facts"], "tax_report": ["sales_lines"],
}


def with_(*names: str, extra: list[str] | None = None) -> str:
    """WITH clause holding the named bindings (dependencies first) plus extra CTEs."""
    order: list[str] = []

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [CTE[n] for n in order] + list(extra or [])
    return "WITH " + ",\n".join(parts) + "\n"


# ------------------------------------------------------------ baskets
def basket_ctes(keys, item_col: str, prefix: str = "b") -> list[str]:
    k = ", ".join(keys)
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    pat = "|".join(f"(?:{p})" for p in P.MOD_PATTERNS)
    return [
        f"""{prefix}_mods AS (SELECT DISTINCT upper(trim(description)) AS k FROM sales_by_item
  WHERE grp IN {in_list(P.MOD_GROUPS)})""",
        f"""{prefix}_kept AS (SELECT DISTINCT {k}, {item_key(item_col)} AS item FROM sales_lines
  WHERE NOT is_cancellation AND upper(trim(description)) NOT IN (SELECT k FROM {prefix}_mods)
    AND NOT coalesce(regexp_matches(description, {sq(pat)}), false) AND {notnull})""",
        f"""{prefix}_all AS (SELECT {k}, list_sort(list(item)) AS items, count(*) AS basket_size
  FROM {prefix}_kept WHERE item IS NOT NULL AND item <> '' GROUP BY {k})""",
        f"""{prefix} AS (SELECT * FROM {prefix}_all WHERE basket_size >= 2)""",
        f"""{prefix}_items AS (SELECT {k}, unnest(items) AS item, basket_size FROM {prefix})""",
        f"""{prefix}_pairs AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS co_purchase_count
  FROM {prefix}_items x JOIN {prefix}_items y ON {" AND ".join(f"x.{c} = y.{c}" for c in keys)} AND x.item < y.item
  GROUP BY 1, 2)""",
        f"""{prefix}_n AS (SELECT count(*) AS n_baskets FROM {prefix})""",
        f"""{prefix}_ic AS (SELECT item, count(*) AS item_count FROM {prefix}_items GROUP BY item)""",
    ]


def rules_ctes(prefix: str = "b") -> list[str]:
    return [f"""rules AS (
  SELECT d.a AS antecedent, d.c AS consequent,
         {rnd('p.co_purchase_count / n.n_baskets', 4)} AS support,
         {rnd('p.co_purchase_count / ia.item_count', 4)} AS confidence,
         {rnd('CASE WHEN ic.item_count / n.n_baskets > 0 THEN (p.co_purchase_count / ia.item_count) / (ic.item_count / n.n_baskets) ELSE 0.0 END', 4)} AS lift,
         p.co_purchase_count AS pair_count, ia.item_count AS antecedent_count, ic.item_count AS consequent_count
  FROM {prefix}_pairs p CROSS JOIN {prefix}_n n
       CROSS JOIN LATERAL (VALUES (p.item_a, p.item_b), (p.item_b, p.item_a)) d(a, c)
       JOIN {prefix}_ic ia ON ia.item = d.a JOIN {prefix}_ic ic ON ic.item = d.c
  WHERE p.co_purchase_count / n.n_baskets >= {P.MIN_SUPPORT}
    AND p.co_purchase_count / ia.item_count >= {P.MIN_CONFIDENCE})"""]


def price_ctes(items_name_col: str, prefix: str = "pr") -> list[str]:
    return [
        f"""{prefix}_exact AS (SELECT {item_key(items_name_col)} AS pkey, avg(unit_price) AS price
  FROM sales_by_item WHERE unit_price > 0 GROUP BY 1)""",
        f"""{prefix}_ws AS (SELECT {word_set_key('pkey')} AS ws, max_by(price, pkey) AS price
  FROM {prefix}_exact GROUP BY 1)""",
    ]


def price_of(col: str, prefix: str = "pr") -> str:
    return (f"coalesce((SELECT price FROM {prefix}_exact WHERE pkey = {col}), "
            f"(SELECT price FROM {prefix}_ws WHERE ws = {word_set_key(col)}), 0.0)")


def rank_pairs_ctes() -> list[str]:
    bk = basket_ctes(P.BASKET_KEYS, P.BASKET_ITEM)
    return bk + rules_ctes() + price_ctes(P.BASKET_ITEM) + [
        """dedup AS (SELECT * FROM rules QUALIFY row_number() OVER (
  PARTITION BY least(antecedent, consequent), greatest(antecedent, consequent)
  ORDER BY confidence DESC, antecedent) = 1)""",
        f"""priced AS (SELECT *, {price_of('antecedent')} + {price_of('consequent')} AS cp FROM dedup)""",
        """pair_mm AS (SELECT min(lift) a0, max(lift) a1, min(support) s0, max(support) s1,
  min(confidence) c0, max(confidence) c1 FROM priced)""",
        f"""pair_scored AS (SELECT p.*, {rnd('''0.45 * (CASE WHEN a1 - a0 > 0 THEN (lift - a0) / (a1 - a0) ELSE 0.0 END)
  + 0.3 * (CASE WHEN c1 - c0 > 0 THEN (confidence - c0) / (c1 - c0) ELSE 0.0 END)
  + 0.25 * (CASE WHEN s1 - s0 > 0 THEN (support - s0) / (s1 - s0) ELSE 0.0 END)''', 4)} AS combo_score
  FROM priced p CROSS JOIN pair_mm)""",
        f"""two_item AS (SELECT antecedent || ' + ' || consequent AS combo_name, antecedent, consequent, support,
  confidence, lift, pair_count, {rnd('cp', 6)} AS combo_price, combo_score,
  {rnd('cp * pair_count', 2)} AS estimated_revenue,
  CAST(CASE WHEN lift > 10 THEN 5 WHEN lift > 5 THEN 10 WHEN lift > 2 THEN 15 ELSE 20 END AS INTEGER) AS suggested_discount_pct,
  CAST(row_number() OVER (ORDER BY combo_score DESC, antecedent, consequent) AS INTEGER) AS rank
  FROM pair_scored)""",
    ]


def triples_ctes() -> list[str]:
    return basket_ctes(P.BASKET_KEYS, P.BASKET_ITEM) + price_ctes(P.BASKET_ITEM) + [
        f"""tri AS (SELECT x.item AS item_1, y.item AS item_2, z.item AS item_3, count(*) AS co_occurrence
  FROM b_items x JOIN b_items y ON x.branch = y.branch AND x.order_id = y.order_id AND x.item < y.item
  JOIN b_items z ON z.branch = x.branch AND z.order_id = x.order_id AND y.item < z.item
  GROUP BY 1, 2, 3 HAVING count(*) >= {P.TRIPLE_MIN_COUNT})""",
        f"""tri_p AS (SELECT *, {price_of('item_1')} + {price_of('item_2')} + {price_of('item_3')} AS cp FROM tri)""",
        f"""three_item AS (SELECT item_1, item_2, item_3, item_1 || ' + ' || item_2 || ' + ' || item_3 AS combo_name,
  co_occurrence, {rnd('co_occurrence / n_baskets', 4)} AS support, {rnd('cp', 2)} AS combo_price,
  {rnd('cp * co_occurrence', 2)} AS estimated_revenue,
  CAST(CASE WHEN co_occurrence >= 5 THEN 10 ELSE 15 END AS INTEGER) AS suggested_discount_pct,
  CAST(row_number() OVER (ORDER BY co_occurrence DESC, item_1, item_2, item_3) AS INTEGER) AS rank
  FROM tri_p CROSS JOIN b_n)""",
    ]


def branch_pairs_ctes() -> list[str]:
    return basket_ctes(P.BASKET_KEYS, P.BASKET_ITEM) + price_ctes(P.BASKET_ITEM) + [
        """bp AS (SELECT x.branch, x.item AS item_a, y.item AS item_b, count(*) AS co_purchase_count
  FROM b_items x JOIN b_items y ON x.branch = y.branch AND x.order_id = y.order_id AND x.item < y.item GROUP BY 1, 2, 3)""",
        """bn AS (SELECT branch, count(*) AS nb FROM b GROUP BY branch)""",
        f"""by_branch AS (SELECT bp.branch, CAST(row_number() OVER (PARTITION BY bp.branch
    ORDER BY co_purchase_count DESC, item_a, item_b) AS INTEGER) AS branch_rank,
  item_a, item_b, item_a || ' + ' || item_b AS combo_name, co_purchase_count,
  {rnd('co_purchase_count / nb', 4)} AS branch_support,
  {rnd(price_of('item_a') + ' + ' + price_of('item_b'), 2)} AS combo_price,
  {rnd('(' + price_of('item_a') + ' + ' + price_of('item_b') + ') * co_purchase_count', 2)} AS estimated_revenue
  FROM bp JOIN bn ON bp.branch = bn.branch QUALIFY branch_rank <= {P.BRANCH_TOP_K})""",
    ]


def _sql_baskets() -> str:
    return with_("sales_lines", "sales_by_item", extra=basket_ctes(P.LIFETIME_KEYS, P.LIFETIME_ITEM)) + """
SELECT branch, customer, array_to_string(items, '; ') AS items, basket_size FROM b"""


def _sql_copurchase() -> str:
    return with_("sales_lines", "sales_by_item", extra=basket_ctes(P.LIFETIME_KEYS, P.LIFETIME_ITEM)) + """
SELECT item_a, item_b, co_purchase_count, co_purchase_count / n_baskets AS support FROM b_pairs CROSS JOIN b_n"""


def _sql_rules() -> str:
    return with_("sales_lines", "sales_by_item",
                 extra=basket_ctes(P.BASKET_KEYS, P.BASKET_ITEM) + rules_ctes()) + "SELECT * FROM rules"


def _sql_itemset_rules() -> str:
    k = P.BASKET_KEYS

    def joined(size: int) -> str:
        names = [f"t{i}" for i in range(size)]
        joins = " ".join(f"JOIN b_items {t} ON " + " AND ".join(f"{t}.{c} = {p}.{c}" for c in k) + f" AND {p}.item < {t}.item"
                         for p, t in zip(names, names[1:]))
        items = ", ".join(f"{t}.item" for t in names)
        return f"SELECT [{items}] AS items, {size} AS size, count(*) AS n FROM b_items t0 {joins} GROUP BY 1"

    sets = "\n  UNION ALL ".join(joined(size) for size in range(1, 5))
    return with_("sales_lines", "sales_by_item", extra=basket_ctes(k, P.BASKET_ITEM) + [
        f"sets AS MATERIALIZED (SELECT s.* FROM ({sets}) s CROSS JOIN b_n WHERE s.n / n_baskets >= {P.ITEMSET_MIN_SUPPORT})",
        """r AS (SELECT list_filter(items, lambda x: x <> consequent) AS a, consequent, n
  FROM (SELECT items, n, unnest(items) AS consequent FROM sets WHERE size >= 2))"""]) + f"""
SELECT array_to_string(r.a, ' + ') AS antecedent, r.consequent, CAST(len(r.a) AS INTEGER) AS antecedent_size,
  {rnd('r.n / n_baskets', 4)} AS support, {rnd('r.n / x.n', 4)} AS confidence,
  {rnd('(r.n / x.n) / (y.n / n_baskets)', 4)} AS lift,
  r.n AS itemset_count, x.n AS antecedent_count, y.n AS consequent_count
FROM r JOIN sets x ON x.items = r.a JOIN sets y ON y.items = [r.consequent] CROSS JOIN b_n
WHERE r.n / x.n >= {P.ITEMSET_MIN_CONFIDENCE}"""


def _sql_affinity() -> str:
    return with_("sales_lines", "sales_by_item", extra=basket_ctes(P.BASKET_KEYS, P.BASKET_ITEM) + [
        "st AS (SELECT item, count(*) AS basket_appearances, " + rnd("avg(basket_size)", 2)
        + " AS avg_basket_size FROM b_items GROUP BY item)",
        """dir AS (SELECT item_a AS item, item_b AS partner, co_purchase_count AS n FROM b_pairs
  UNION ALL SELECT item_b, item_a, co_purchase_count FROM b_pairs)""",
        """rk AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, partner) AS rn FROM dir)""",
        """wide AS (SELECT item, count(*) AS unique_partners,
  max(CASE WHEN rn = 1 THEN partner END) AS top_partner_1, max(CASE WHEN rn = 1 THEN n END) AS c1,
  max(CASE WHEN rn = 2 THEN partner END) AS top_partner_2, max(CASE WHEN rn = 2 THEN n END) AS c2,
  max(CASE WHEN rn = 3 THEN partner END) AS top_partner_3, max(CASE WHEN rn = 3 THEN n END) AS c3
  FROM rk GROUP BY item)"""]) + """
SELECT st.item, basket_appearances, avg_basket_size, coalesce(unique_partners, 0) AS unique_partners,
  top_partner_1, coalesce(c1, 0) AS top_partner_1_count, top_partner_2, coalesce(c2, 0) AS top_partner_2_count,
  top_partner_3, coalesce(c3, 0) AS top_partner_3_count
FROM st LEFT JOIN wide ON st.item = wide.item"""


def _sql_cancellation() -> str:
    return with_("sales_lines") + f"""
SELECT branch, qty < 0 AS is_cancellation, count(*) AS lines, {rnd('sum(qty)', 2)} AS qty
FROM sales_lines GROUP BY 1, 2"""


def _sql_modifier() -> str:
    pat = "|".join(f"(?:{p})" for p in P.MOD_PATTERNS)
    return with_("sales_lines", "sales_by_item") + f"""
SELECT branch, grp, count(*) AS lines FROM sales_lines
WHERE upper(trim(description)) NOT IN (SELECT DISTINCT upper(trim(description)) FROM sales_by_item
                                       WHERE grp IN {in_list(P.MOD_GROUPS)})
  AND NOT coalesce(regexp_matches(description, {sq(pat)}), false)
GROUP BY 1, 2"""


def _sql_price_lookup() -> str:
    return with_("sales_lines", "sales_by_item", extra=price_ctes("description") + [
        """names AS (SELECT DISTINCT name FROM (
  SELECT upper(p_brand || ' ' || p_name) AS name FROM part UNION ALL
  SELECT upper(p_name || ' ' || p_brand) FROM part UNION ALL
  SELECT upper('NO SUCH ' || p_name) FROM part))"""]) + f"""
SELECT name, {rnd(price_of('name'), 6)} AS price FROM names"""


ORACLES: dict[str, str] = {
    "baskets": _sql_baskets(),
    "copurchase_pairs": _sql_copurchase(),
    "association_rules": _sql_rules(),
    "itemset_rules": _sql_itemset_rules(),
    "item_affinity": _sql_affinity(),
    "cancellation_split": _sql_cancellation(),
    "modifier_antijoin": _sql_modifier(),
    "price_lookup": _sql_price_lookup(),
    "rank_pairs": with_("sales_lines", "sales_by_item", extra=rank_pairs_ctes()) + "SELECT * FROM two_item",
    "triples": with_("sales_lines", "sales_by_item", extra=triples_ctes()) + "SELECT * FROM three_item",
    "branch_pairs": with_("sales_lines", "sales_by_item", extra=branch_pairs_ctes()) + "SELECT * FROM by_branch",
}


# ------------------------------------------------------------ demand
def clip0(x: str) -> str:
    return f"(CASE WHEN ({x}) < 0 THEN 0.0 ELSE ({x}) END)"


FEATURES_CTE = f"""features AS (
  SELECT branch, month, month_num, year, total, date,
    lag(total, 1) OVER w AS lag_1, lag(total, 2) OVER w AS lag_2,
    {rnd('CASE WHEN lag(total, 1) OVER w <> 0 THEN total / lag(total, 1) OVER w - 1 END', 6)} AS mom_growth,
    {rnd('avg(total) OVER (PARTITION BY branch ORDER BY date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)', 4)} AS rolling_avg_2,
    {rnd('avg(total) OVER (PARTITION BY branch ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 4)} AS rolling_avg_3,
    {rnd('sum(total) OVER (PARTITION BY branch ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 2)} AS cumulative_total,
    {rnd('CASE WHEN sum(total) OVER (PARTITION BY branch) > 0 THEN total / sum(total) OVER (PARTITION BY branch) ELSE 0.0 END', 6)} AS month_share,
    CAST(row_number() OVER w - 1 AS INTEGER) AS trend_idx, CAST(month(date) AS INTEGER) AS month_of_year
  FROM monthly_sales WINDOW w AS (PARTITION BY branch ORDER BY date))"""

PROFILE_CTE = f"""profile AS (
  WITH m AS (SELECT *, CASE WHEN lag(total) OVER w <> 0 THEN total / lag(total) OVER w - 1 END AS pct
             FROM monthly_sales WINDOW w AS (PARTITION BY branch ORDER BY date)),
  g AS (SELECT branch, sum(total) AS tot, count(*) AS n, arg_min(total, date) AS fv, arg_max(total, date) AS lv,
               avg(pct) AS mom, stddev_samp(total) AS sd, avg(total) AS mean,
               first(month ORDER BY total DESC, date) AS peak_month FROM m GROUP BY branch),
  ch AS (SELECT branch,
           CASE WHEN delivery + dine_in + take_away > 0 THEN delivery / (delivery + dine_in + take_away) ELSE 0.0 END AS ds,
           CASE WHEN delivery + dine_in + take_away > 0 THEN dine_in / (delivery + dine_in + take_away) ELSE 0.0 END AS ts,
           CASE WHEN delivery + dine_in + take_away > 0 THEN take_away / (delivery + dine_in + take_away) ELSE 0.0 END AS tas
         FROM division_summary WHERE division = 'ITEMS'),
  cu AS (SELECT branch, sum(num_customers) AS c, sum(sales) AS s FROM avg_sales GROUP BY branch),
  dl AS (SELECT branch, count(DISTINCT customer) AS dc, sum(num_orders) AS do_ FROM customer_orders GROUP BY branch),
  ad AS (SELECT branch, count(*) AS a FROM division_summary WHERE total > 0 GROUP BY branch)
  SELECT g.branch, {rnd('tot', 2)} AS total_revenue, n AS num_months,
    {rnd('CASE WHEN n > 0 THEN tot / n ELSE 0.0 END', 2)} AS avg_monthly_revenue,
    {rnd('CASE WHEN n >= 2 THEN (CASE WHEN fv > 0 THEN (lv - fv) / fv ELSE 0.0 END) ELSE 0.0 END', 4)} AS overall_growth,
    {rnd('CASE WHEN n >= 2 THEN mom ELSE 0.0 END', 4)} AS avg_mom_growth,
    {rnd('CASE WHEN mean > 0 THEN sd / mean ELSE 0.0 END', 4)} AS revenue_cv, peak_month,
    {rnd('coalesce(ds, 0.0)', 4)} AS delivery_share, {rnd('coalesce(ts, 0.0)', 4)} AS table_share,
    {rnd('coalesce(tas, 0.0)', 4)} AS takeaway_share,
    CAST(coalesce(c, 0) AS BIGINT) AS total_customers,
    {rnd('coalesce(CASE WHEN c > 0 THEN s / c ELSE 0.0 END, 0.0)', 2)} AS avg_ticket_size,
    CAST(coalesce(dc, 0) AS BIGINT) AS delivery_customers, CAST(coalesce(do_, 0) AS BIGINT) AS delivery_orders,
    {rnd('coalesce(CASE WHEN dc > 0 THEN do_ / dc ELSE 0.0 END, 0.0)', 2)} AS avg_orders_per_delivery_customer,
    CAST(coalesce(a, 0) AS BIGINT) AS active_divisions
  FROM g LEFT JOIN ch ON ch.branch = g.branch LEFT JOIN cu ON cu.branch = g.branch
       LEFT JOIN dl ON dl.branch = g.branch LEFT JOIN ad ON ad.branch = g.branch)"""

FIT_CTE = """fit AS (
  WITH m AS (SELECT branch, date, trend_idx, total,
               CASE WHEN lag(total) OVER w > 0 THEN (total - lag(total) OVER w) / lag(total) OVER w END AS rate,
               row_number() OVER (PARTITION BY branch ORDER BY date DESC) AS rd,
               count(*) OVER (PARTITION BY branch) AS n
             FROM features WINDOW w AS (PARTITION BY branch ORDER BY date)),
  f AS (SELECT branch, count(*) AS n_points, regr_slope(total, trend_idx) AS slope,
          regr_intercept(total, trend_idx) AS intercept, max(trend_idx) AS last_idx,
          arg_max(total, trend_idx) AS last_value, max(date) AS last_date,
          sum(CASE WHEN rd <= least(n, 3) THEN least(n, 3) - rd + 1 END * total)
            / sum(CASE WHEN rd <= least(n, 3) THEN least(n, 3) - rd + 1 END) AS wma,
          min(least(n, 3)) AS wma_window, count(rate) AS n_rates, median(rate) AS med
        FROM m GROUP BY branch),
  f2 AS (SELECT *, CASE WHEN n_rates > 0 THEN least(greatest(med, -0.3), 0.5) ELSE 0.0 END AS growth_rate FROM f),
  rs AS (SELECT x.branch, stddev_pop(x.total - CASE WHEN f2.n_points >= 2 THEN f2.intercept + f2.slope * x.trend_idx
                                                 ELSE x.total END) AS s
         FROM features x JOIN f2 ON f2.branch = x.branch GROUP BY x.branch)
  SELECT f2.*, coalesce(rs.s, 0.0) AS residual_std FROM f2 LEFT JOIN rs ON rs.branch = f2.branch)"""


def trend_at(idx: str) -> str:
    return f"(CASE WHEN n_points >= 2 THEN intercept + slope * ({idx}) ELSE last_value END)"


FORECAST_CTE = f"""fc AS (
  WITH s AS (SELECT fit.*, h AS steps_ahead, CAST(last_date + to_months(h) AS DATE) AS d,
               {clip0(trend_at('last_idx + h'))} AS ft, {clip0('wma * (1 + 0.02 * h)')} AS fw,
               {clip0('last_value * pow(1 + growth_rate, h)')} AS fg
             FROM fit CROSS JOIN generate_series(1, 3) t(h)),
  e AS (SELECT *, 0.35 * ft + 0.4 * fw + 0.25 * fg AS f, 1.96 * sqrt(CAST(steps_ahead AS DOUBLE)) * residual_std AS ci FROM s)
  SELECT branch, CAST(year(d) AS INTEGER) AS year, strftime(d, '%B') AS month, CAST(month(d) AS INTEGER) AS month_num,
    d AS date, {rnd('f', 2)} AS forecast, {rnd(clip0('f - ci'), 2)} AS ci_lower, {rnd('f + ci', 2)} AS ci_upper,
    {rnd('ft', 2)} AS forecast_trend, {rnd('fw', 2)} AS forecast_wma, {rnd('fg', 2)} AS forecast_growth,
    {rnd('residual_std', 2)} AS residual_std, CAST(steps_ahead AS INTEGER) AS steps_ahead FROM e
  UNION ALL
  SELECT branch, year, month, month_num, date, {rnd('total', 2)}, {rnd('total', 2)}, {rnd('total', 2)},
    NULL, NULL, NULL, NULL, 0 FROM features)"""

FC_SUMMARY_CTE = f"""fc_summary AS (
  WITH fut AS (SELECT * FROM fc WHERE steps_ahead > 0),
  per AS (SELECT fut.branch,
            max(CASE WHEN steps_ahead = 1 THEN forecast END) AS first_forecast,
            max(CASE WHEN steps_ahead = 1 THEN ci_lower END) AS first_ci_lower,
            max(CASE WHEN steps_ahead = 1 THEN ci_upper END) AS first_ci_upper,
            sum(forecast) AS tot, avg(forecast) AS av FROM fut GROUP BY fut.branch),
  p2 AS (SELECT per.*, coalesce(p.avg_monthly_revenue, 0.0) AS hist FROM per LEFT JOIN profile p ON p.branch = per.branch),
  p3 AS (SELECT branch, first_forecast, first_ci_lower, first_ci_upper, {rnd('tot', 2)} AS horizon_total_forecast,
            {rnd('av', 2)} AS avg_monthly_forecast, {rnd('hist', 2)} AS historical_avg_monthly,
            {rnd('CASE WHEN hist > 0 THEN (av - hist) / hist END', 4)} AS forecast_vs_historical FROM p2),
  bm AS (SELECT steps_ahead, sum(forecast) AS m FROM fut GROUP BY steps_ahead),
  net AS (SELECT {rnd('sum(m)', 2)} AS network_horizon_total, {rnd('avg(m)', 2)} AS network_monthly_avg FROM bm),
  best AS (SELECT first(branch ORDER BY coalesce(forecast_vs_historical, 0.0) DESC, branch) AS fastest_growing_branch,
             max(coalesce(forecast_vs_historical, 0.0)) AS fastest_growth_rate FROM p3)
  SELECT * FROM p3 CROSS JOIN net CROSS JOIN best)"""

DEMAND_BASE = ("monthly_sales", "division_summary", "avg_sales", "customer_orders")


def demand_with(*extra: str, bindings: tuple[str, ...] = (), more: list[str] | None = None) -> str:
    ctes = {"features": FEATURES_CTE, "profile": PROFILE_CTE, "fit": FIT_CTE, "fc": FORECAST_CTE,
            "fc_summary": FC_SUMMARY_CTE}
    order = ["features", "profile", "fit", "fc", "fc_summary"]
    need = set(extra)
    deps = {"fit": {"features"}, "fc": {"fit"}, "fc_summary": {"fc", "profile"}}
    changed = True
    while changed:
        changed = False
        for n in list(need):
            for d in deps.get(n, ()):
                if d not in need:
                    need.add(d)
                    changed = True
    return with_(*DEMAND_BASE, *bindings, extra=[ctes[n] for n in order if n in need] + list(more or []))


ORACLES.update({
    "monthly_features": demand_with("features") + "SELECT * FROM features",
    "branch_profile": demand_with("profile") + "SELECT * FROM profile",
    "forecast_dataset": demand_with("features", "profile") + f"""
SELECT f.branch, month, month_num, year, total, date, lag_1, lag_2, mom_growth, rolling_avg_2, rolling_avg_3,
  month_share, trend_idx, month_of_year, total_revenue, num_months, avg_monthly_revenue, overall_growth,
  avg_mom_growth, revenue_cv, delivery_share, table_share, takeaway_share, total_customers, avg_ticket_size,
  delivery_customers, delivery_orders, avg_orders_per_delivery_customer, active_divisions,
  (SELECT CAST(count(*) + 1 AS INTEGER) FROM profile q
   WHERE q.total_revenue > p.total_revenue OR (q.total_revenue = p.total_revenue AND q.branch < p.branch))
    AS branch_revenue_rank,
  {rnd('CASE WHEN avg_monthly_revenue <> 0 THEN total / avg_monthly_revenue END', 6)} AS revenue_ratio
FROM features f LEFT JOIN profile p ON p.branch = f.branch""",
    "trend_fit": demand_with("fit") + f"""
SELECT branch, n_points, {rnd('slope', 4)} AS slope, {rnd('intercept', 2)} AS intercept,
  {rnd(clip0(trend_at('last_idx + 1')), 2)} AS next_trend FROM fit""",
    "wma": demand_with("fit") + f"""
SELECT branch, CAST(wma_window AS INTEGER) AS wma_window, {rnd('wma', 2)} AS wma,
  {rnd(clip0('wma * 1.02'), 2)} AS next_wma FROM fit""",
    "growth_rate": demand_with("fit") + f"""
SELECT branch, n_rates, {rnd('growth_rate', 6)} AS growth_rate, last_value,
  {rnd(clip0('last_value * (1 + growth_rate)'), 2)} AS next_growth FROM fit""",
    "forecast": demand_with("fc") + "SELECT * FROM fc",
    "forecast_summary": demand_with("fc_summary") + "SELECT * FROM fc_summary",
})


# ------------------------------------------------------------ staffing
def shift_sql(h: str) -> str:
    return (f"(CASE WHEN {h} >= 0 AND {h} < 6 THEN 'overnight' WHEN {h} >= 6 AND {h} < 12 THEN 'morning' "
            f"WHEN {h} >= 12 AND {h} < 17 THEN 'afternoon' WHEN {h} >= 17 AND {h} < 22 THEN 'evening' "
            f"WHEN {h} >= 22 AND {h} < 24 THEN 'late_night' END)")


def ceil9_sql(x: str) -> str:
    return f"CAST(ceil({rnd(x, 9)}) AS BIGINT)"


SHIFTS_CTE = f"""shifts AS (
  SELECT emp_id, emp_name, branch, CAST(punch_in AS DATE) AS date, strftime(punch_in, '%A') AS day_of_week,
    CAST(isodow(punch_in) - 1 AS INTEGER) AS day_num, CAST(hour(punch_in) AS INTEGER) AS hour_in,
    CAST(hour(punch_out) AS INTEGER) AS hour_out, {shift_sql('hour(punch_in)')} AS shift_type,
    CAST(isodow(punch_in) IN (6, 7) AS INTEGER) AS is_weekend,
    CAST(CAST(punch_out AS DATE) > CAST(punch_in AS DATE) AS INTEGER) AS crosses_midnight, work_duration_hours
  FROM attendance)"""

_LABS = ("morning", "afternoon", "evening", "overnight")
STAFF_PROFILE_CTE = f"""staff_profile AS (
  WITH a AS (SELECT *, {shift_sql('hour(punch_in)')} AS st, isodow(punch_in) - 1 AS dn,
               work_duration_hours AS h FROM attendance WHERE branch IS NOT NULL),
  g AS (SELECT branch, count(DISTINCT emp_id) AS ne, count(*) AS ts, sum(h) AS th, avg(h) AS ah, median(h) AS mh,
          stddev_samp(h) AS sh, count(st) AS nst,
          {", ".join(f"count(CASE WHEN st = '{x}' THEN 1 END) AS n_{x}" for x in _LABS)},
          avg(CASE WHEN dn IN (5, 6) THEN 1.0 ELSE 0.0 END) AS we, count(DISTINCT CAST(punch_in AS DATE)) AS wd
        FROM a GROUP BY branch),
  pe AS (SELECT branch, avg(k) AS ak, min(k) AS mink, max(k) AS maxk
         FROM (SELECT branch, emp_id, count(*) AS k FROM a GROUP BY 1, 2) GROUP BY branch),
  rv AS (SELECT branch, sum(total) AS rev FROM monthly_sales WHERE month(date) = {P.ATTENDANCE_MONTH} GROUP BY branch),
  j AS (SELECT g.*, pe.ak, pe.mink, pe.maxk, coalesce(rv.rev, 0.0) AS r FROM g JOIN pe ON pe.branch = g.branch
        LEFT JOIN rv ON rv.branch = g.branch)
  SELECT branch, CAST(ne AS BIGINT) AS num_employees, CAST(ts AS BIGINT) AS total_shifts,
    {rnd('th', 2)} AS total_hours, {rnd('ah', 2)} AS avg_shift_hours, {rnd('mh', 2)} AS median_shift_hours,
    {rnd('sh', 2)} AS std_shift_hours, {rnd('ak', 2)} AS avg_shifts_per_employee,
    CAST(mink AS BIGINT) AS min_shifts_per_employee, CAST(maxk AS BIGINT) AS max_shifts_per_employee,
    CAST(wd AS BIGINT) AS working_days, {rnd('CASE WHEN wd > 0 THEN ts / wd ELSE 0.0 END', 2)} AS avg_employees_per_day,
    {rnd('we', 4)} AS weekend_share,
    {", ".join(rnd(f"coalesce(CASE WHEN nst > 0 THEN n_{x} / nst ELSE 0.0 END, 0.0)", 4) + f" AS {x}_share" for x in _LABS)},
    {rnd('r', 2)} AS month_revenue, {rnd('CASE WHEN th > 0 THEN r / th ELSE 0.0 END', 2)} AS revenue_per_hour,
    {rnd('CASE WHEN ts > 0 THEN r / ts ELSE 0.0 END', 2)} AS revenue_per_shift,
    {rnd('CASE WHEN ne > 0 THEN r / ne ELSE 0.0 END', 2)} AS revenue_per_employee
  FROM j)"""

DAILY_CTE = f"""daily AS (
  SELECT branch, CAST(punch_in AS DATE) AS date, CAST(count(DISTINCT emp_id) AS BIGINT) AS employees_on_duty,
    CAST(count(emp_id) AS BIGINT) AS total_shifts, {rnd('sum(work_duration_hours)', 2)} AS total_hours,
    {rnd('avg(work_duration_hours)', 2)} AS avg_shift_hours, strftime(CAST(punch_in AS DATE), '%A') AS day_of_week,
    CAST(isodow(CAST(punch_in AS DATE)) - 1 AS INTEGER) AS day_num,
    CAST(isodow(CAST(punch_in AS DATE)) IN (6, 7) AS INTEGER) AS is_weekend,
    {rnd("(epoch_us(max(punch_out)) - epoch_us(min(punch_in))) / 3.6e9", 2)} AS coverage_span_hours
  FROM attendance WHERE branch IS NOT NULL GROUP BY branch, CAST(punch_in AS DATE))"""

GROWTH_CTE = """growth AS (SELECT branch, coalesce(forecast_vs_historical, 0.0) AS growth FROM fc_summary)"""

RECS_CTE = f"""recs AS (
  WITH s AS (SELECT * FROM shifts WHERE branch IS NOT NULL),
  tot AS (SELECT branch, count(*) AS t FROM s GROUP BY branch),
  g AS (SELECT branch, shift_type, count(*) AS c, count(DISTINCT emp_id) AS e, avg(work_duration_hours) AS ah,
          median(work_duration_hours) AS mh, count(DISTINCT date) AS days,
          count(CASE WHEN is_weekend = 1 THEN 1 END) AS nwe, count(DISTINCT CASE WHEN is_weekend = 1 THEN date END) AS dwe,
          count(CASE WHEN is_weekend = 0 THEN 1 END) AS nwd, count(DISTINCT CASE WHEN is_weekend = 0 THEN date END) AS dwd
        FROM s WHERE shift_type IN ('morning', 'afternoon', 'evening', 'overnight') GROUP BY 1, 2),
  j AS (SELECT g.*, tot.t, greatest(1 + coalesce(gr.growth, 0.0), 0.5) AS mult,
          CASE WHEN days > 0 THEN c / days ELSE 0.0 END AS pd
        FROM g JOIN tot ON tot.branch = g.branch LEFT JOIN growth gr ON gr.branch = g.branch)
  SELECT branch, shift_type, CAST(c AS BIGINT) AS current_shift_count, {rnd('c / t', 4)} AS shift_share,
    CAST(e AS BIGINT) AS employees_available, {rnd('ah', 2)} AS avg_hours_per_shift, {rnd('mh', 2)} AS median_hours_per_shift,
    {rnd('pd', 2)} AS avg_staff_per_day, {rnd('nwd / greatest(dwd, 1)', 2)} AS weekday_avg_staff,
    {rnd('nwe / greatest(dwe, 1)', 2)} AS weekend_avg_staff, {rnd('mult', 4)} AS demand_multiplier,
    CAST(least({ceil9_sql('pd * mult')}, e + 3) AS BIGINT) AS recommended_staff_per_day,
    {rnd('mh', 1)} AS recommended_shift_hours
  FROM j)"""

SCHED_CTE = f"""sched AS (
  WITH d AS (SELECT branch, day_num, min(day_of_week) AS day_of_week, avg(employees_on_duty) AS ae,
               avg(total_hours) AS ahrs, avg(coverage_span_hours) AS acov FROM daily GROUP BY 1, 2),
  c AS (SELECT branch, day_num, shift_type, count(*) AS k FROM shifts WHERE shift_type IS NOT NULL GROUP BY 1, 2, 3),
  pk AS (SELECT branch, day_num, first(shift_type ORDER BY k DESC, shift_type) AS peak FROM c GROUP BY 1, 2),
  j AS (SELECT d.*, pk.peak, CASE WHEN d.day_num IN (5, 6)
          THEN greatest({ceil9_sql('ae')}, {ceil9_sql('ae + 0.5')}) ELSE {ceil9_sql('ae')} END AS rec
        FROM d LEFT JOIN pk ON pk.branch = d.branch AND pk.day_num = d.day_num)
  SELECT branch, day_of_week, day_num, CAST(day_num IN (5, 6) AS INTEGER) AS is_weekend,
    {rnd('ae', 2)} AS observed_avg_employees, {rnd('ahrs', 2)} AS observed_avg_total_hours,
    {rnd('acov', 2)} AS observed_avg_coverage_span, coalesce(peak, 'afternoon') AS peak_shift_type,
    CAST(rec AS BIGINT) AS recommended_employees,
    CASE WHEN rec > 0 THEN {rnd('ahrs / rec', 1)} ELSE 8.0 END AS recommended_hours_per_employee
  FROM j)"""

HIRING_CTE = f"""hiring AS (
  SELECT p.branch, p.num_employees, {rnd('coalesce(g.growth, 0.0)', 4)} AS growth,
    CASE WHEN coalesce(g.growth, 0.0) > 0.3 THEN 'HIRE' WHEN coalesce(g.growth, 0.0) < -0.2 THEN 'OPTIMIZE'
         ELSE 'MAINTAIN' END AS action,
    CAST(CASE WHEN coalesce(g.growth, 0.0) > 0.3 THEN greatest(1, {ceil9_sql('p.num_employees * coalesce(g.growth, 0.0) * 0.5')})
         ELSE 0 END AS BIGINT) AS suggested_additional,
    CASE WHEN coalesce(g.growth, 0.0) > 0.3 THEN 'The forecast is '
           || CAST(CAST({rnd('coalesce(g.growth, 0.0) * 100', 0)} AS BIGINT) AS VARCHAR) || '% over the average month: more hands are needed.'
         WHEN coalesce(g.growth, 0.0) < -0.2 THEN 'The forecast is '
           || CAST(CAST({rnd('abs(coalesce(g.growth, 0.0)) * 100', 0)} AS BIGINT) AS VARCHAR) || '% under the average month: cut extra hours, keep the staff.'
         ELSE 'The forecast is near the average month: no change.' END AS reason
  FROM staff_profile p LEFT JOIN growth g ON g.branch = p.branch)"""

STAFF_SUMMARY_SQL = f"""
, dom AS (SELECT branch, first(shift_type ORDER BY shift_share DESC,
            CASE shift_type WHEN 'morning' THEN 0 WHEN 'afternoon' THEN 1 WHEN 'evening' THEN 2 WHEN 'overnight' THEN 3 ELSE 4 END) AS ds,
            first(shift_share ORDER BY shift_share DESC,
            CASE shift_type WHEN 'morning' THEN 0 WHEN 'afternoon' THEN 1 WHEN 'evening' THEN 2 WHEN 'overnight' THEN 3 ELSE 4 END) AS dss
          FROM recs GROUP BY branch),
rec_text AS (SELECT branch, string_agg(shift_type || ': ' || recommended_staff_per_day || ' staff of '
              || CAST(recommended_shift_hours AS DECIMAL(12, 1)) || ' h, demand x ' || CAST(demand_multiplier AS DECIMAL(12, 4)), '; '
              ORDER BY CASE shift_type WHEN 'morning' THEN 0 WHEN 'afternoon' THEN 1 WHEN 'evening' THEN 2 ELSE 3 END) AS rt
             FROM recs GROUP BY branch),
wkm AS (SELECT branch, is_weekend, recommended_employees AS v, count(*) AS k FROM sched GROUP BY 1, 2, 3),
wk AS (SELECT branch, first(v ORDER BY k DESC, v) FILTER (WHERE is_weekend = 0) AS wd,
         first(v ORDER BY k DESC, v) FILTER (WHERE is_weekend = 1) AS we FROM wkm GROUP BY branch),
pkd AS (SELECT branch, first(day_of_week ORDER BY observed_avg_total_hours DESC, day_num) AS peak_day FROM sched GROUP BY branch),
net AS (SELECT CAST(sum(num_employees) AS BIGINT) AS network_total_employees,
          {rnd('avg(revenue_per_employee)', 2)} AS network_avg_revenue_per_employee,
          first(branch ORDER BY revenue_per_employee DESC, branch) AS most_efficient_branch FROM staff_profile)
SELECT p.branch, p.num_employees, {rnd(rnd('p.avg_shift_hours', 2), 1)} AS avg_shift_hours,
  {rnd(rnd('p.avg_employees_per_day', 2), 1)} AS avg_employees_per_day, p.revenue_per_hour, p.revenue_per_employee,
  dom.ds AS dominant_shift, dom.dss AS dominant_shift_share, coalesce(rec_text.rt, '') AS shift_recommendations,
  CAST(coalesce(wk.wd, 0) AS BIGINT) AS weekday_recommended_employees,
  CAST(coalesce(wk.we, 0) AS BIGINT) AS weekend_recommended_employees, pkd.peak_day,
  h.action AS hiring_action, h.suggested_additional, h.reason AS hiring_reason, net.*,
  net.most_efficient_branch || ' earns the most per employee: compare its shifts with the others''.' AS key_finding
FROM staff_profile p LEFT JOIN dom ON dom.branch = p.branch LEFT JOIN rec_text ON rec_text.branch = p.branch LEFT JOIN wk ON wk.branch = p.branch
  LEFT JOIN pkd ON pkd.branch = p.branch LEFT JOIN hiring h ON h.branch = p.branch CROSS JOIN net"""


def staffing_with(*ctes: str) -> str:
    return demand_with("fc_summary", bindings=("attendance",), more=list(ctes))


ORACLES.update({
    "shift_patterns": with_("attendance", extra=[SHIFTS_CTE]) + "SELECT * FROM shifts",
    "staffing_profile": with_("monthly_sales", "attendance", extra=[STAFF_PROFILE_CTE]) + "SELECT * FROM staff_profile",
    "daily_coverage": with_("attendance", extra=[DAILY_CTE]) + "SELECT * FROM daily",
    "shift_recommendations": staffing_with(SHIFTS_CTE, GROWTH_CTE, RECS_CTE) + "SELECT * FROM recs",
    "schedule_guidelines": with_("attendance", extra=[SHIFTS_CTE, DAILY_CTE, SCHED_CTE]) + "SELECT * FROM sched",
    "hiring_action": staffing_with(STAFF_PROFILE_CTE, GROWTH_CTE, HIRING_CTE) + "SELECT * FROM hiring",
    "staffing_summary": staffing_with(SHIFTS_CTE, DAILY_CTE, STAFF_PROFILE_CTE, GROWTH_CTE, RECS_CTE, SCHED_CTE,
                                      HIRING_CTE) + STAFF_SUMMARY_SQL,
})


# ------------------------------------------------------------ expansion
def num_text_sql(x: str, d: int = 2) -> str:
    return f"CAST(CAST({rnd(x, d)} AS DECIMAL(38,{d})) AS VARCHAR)"


def _shares(prefix: str = "") -> str:
    tot = "(delivery + dine_in + take_away)"
    return (f"CASE WHEN {tot} > 0 THEN delivery / {tot} ELSE 0.0 END AS ds, "
            f"CASE WHEN {tot} > 0 THEN dine_in / {tot} ELSE 0.0 END AS tbs, "
            f"CASE WHEN {tot} > 0 THEN take_away / {tot} ELSE 0.0 END AS tas")


SCORECARD_CTE = f"""sc AS (
  WITH m AS (SELECT branch, total, row_number() OVER (PARTITION BY branch ORDER BY date) AS ra,
               row_number() OVER (PARTITION BY branch ORDER BY date DESC) AS rd FROM monthly_sales),
  rv AS (SELECT branch, sum(total) AS tot, count(*) AS n, avg(CASE WHEN ra <= 2 THEN total END) AS e2,
           avg(CASE WHEN rd <= 2 THEN total END) AS l2, max(CASE WHEN ra = 1 THEN total END) AS e1,
           max(CASE WHEN rd = 1 THEN total END) AS l1, stddev_samp(total) AS sd, avg(total) AS mean FROM m GROUP BY branch),
  rv2 AS (SELECT *, CASE WHEN n > 0 THEN tot / n ELSE 0.0 END AS av FROM rv),
  rv3 AS (SELECT *, CASE WHEN n >= 4 THEN e2 WHEN n >= 2 THEN e1 ELSE av END AS early,
            CASE WHEN n >= 4 THEN l2 WHEN n >= 2 THEN l1 ELSE av END AS late FROM rv2),
  rv4 AS (SELECT branch, tot, av, CASE WHEN early > 0 THEN (late - early) / early ELSE 0.0 END AS mom,
            CASE WHEN mean > 0 THEN sd / mean ELSE 1.0 END AS cv FROM rv3),
  vt AS (SELECT branch, sum(vat) AS v FROM tax_report GROUP BY branch),
  cu AS (SELECT branch, sum(num_customers) AS c, sum(sales) AS s, count(CASE WHEN num_customers > 0 THEN 1 END) AS chn
         FROM avg_sales GROUP BY branch),
  dl AS (SELECT branch, count(DISTINCT customer) AS dc, sum(num_orders) AS do_,
           avg(CASE WHEN num_orders > 1 THEN 1.0 ELSE 0.0 END) AS rr FROM customer_orders GROUP BY branch),
  st AS (SELECT branch, count(DISTINCT emp_id) AS ne, count(*) AS ts, avg(work_duration_hours) AS ash
         FROM attendance GROUP BY branch),
  ch AS (SELECT branch, {_shares()}, total AS items_total FROM division_summary WHERE division = 'ITEMS'),
  bv AS (SELECT branch, sum(total) AS bev FROM division_summary WHERE division IN {in_list(P.CATEGORY_DIVISIONS)}
         GROUP BY branch),
  j AS (SELECT rv4.*, vt.v, coalesce(cu.c, 0) AS c, cu.s, cu.chn, dl.dc, dl.do_, dl.rr, coalesce(st.ne, 0) AS ne, st.ts,
          st.ash, ch.ds, ch.tbs, ch.tas, ch.items_total, bv.bev
        FROM rv4 LEFT JOIN vt ON vt.branch = rv4.branch LEFT JOIN cu ON cu.branch = rv4.branch
        LEFT JOIN dl ON dl.branch = rv4.branch LEFT JOIN st ON st.branch = rv4.branch
        LEFT JOIN ch ON ch.branch = rv4.branch LEFT JOIN bv ON bv.branch = rv4.branch)
  SELECT branch, {rnd('tot', 2)} AS total_revenue, {rnd('av', 2)} AS avg_monthly_revenue, {rnd('mom', 4)} AS momentum,
    {rnd('cv', 4)} AS revenue_cv, {rnd('coalesce(v, 0.0)', 2)} AS vat_contribution, CAST(c AS BIGINT) AS total_customers,
    {rnd('coalesce(CASE WHEN c > 0 THEN s / c ELSE 0.0 END, 0.0)', 2)} AS avg_ticket_size,
    {rnd('CASE WHEN c > 0 THEN tot / c ELSE 0.0 END', 2)} AS revenue_per_customer,
    CAST(coalesce(chn, 0) AS BIGINT) AS channels_active, CAST(coalesce(dc, 0) AS BIGINT) AS delivery_customers,
    CAST(coalesce(do_, 0) AS BIGINT) AS delivery_orders, {rnd('coalesce(rr, 0.0)', 4)} AS repeat_rate,
    CAST(ne AS BIGINT) AS num_employees, CAST(coalesce(ts, 0) AS BIGINT) AS total_shifts,
    {rnd('coalesce(ash, 0.0)', 2)} AS avg_shift_hours, {rnd('CASE WHEN ne > 0 THEN tot / ne ELSE 0.0 END', 2)} AS revenue_per_employee,
    {rnd('coalesce(ds, 0.0)', 4)} AS delivery_share, {rnd('coalesce(tbs, 0.0)', 4)} AS table_share,
    {rnd('coalesce(tas, 0.0)', 4)} AS takeaway_share,
    {rnd('coalesce(CASE WHEN items_total > 0 THEN coalesce(bev, 0.0) / items_total ELSE 0.0 END, 0.0)', 4)} AS beverage_ratio
  FROM j)"""

_SC = {"score_revenue": ("avg_monthly_revenue", False), "score_growth": ("momentum", False),
       "score_stability": ("revenue_cv", True), "score_customers": ("total_customers", False),
       "score_ticket": ("avg_ticket_size", False), "score_efficiency": ("revenue_per_employee", False)}
_W = {"score_revenue": 0.2, "score_growth": 0.25, "score_stability": 0.15, "score_customers": 0.15,
      "score_ticket": 0.1, "score_efficiency": 0.15}


def _mm(src: str) -> str:
    return f"(CASE WHEN mx_{src} - mn_{src} > 0 THEN ({src} - mn_{src}) / (mx_{src} - mn_{src}) ELSE 0.0 END)"


_srcs = sorted({v[0] for v in _SC.values()})
SCORED_CTE = f"""scored AS (
  WITH mm AS (SELECT {", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in _srcs)} FROM sc),
  s AS (SELECT sc.*, {", ".join(("(1 - " + _mm(src) + ")" if inv else _mm(src)) + f" AS {k}" for k, (src, inv) in _SC.items())}
        FROM sc CROSS JOIN mm)
  SELECT * EXCLUDE ({", ".join(_SC)}), {", ".join(rnd(k, 6) + f" AS {k}" for k in _SC)},
    {rnd(" + ".join(f"{k} * {w}" for k, w in _W.items()), 4)} AS composite_score FROM s)"""

_BENCH_COLS = ["total_revenue", "avg_monthly_revenue", "momentum", "revenue_cv", "vat_contribution", "total_customers",
               "avg_ticket_size", "revenue_per_customer", "channels_active", "delivery_customers", "delivery_orders",
               "repeat_rate", "num_employees", "total_shifts", "avg_shift_hours", "revenue_per_employee",
               "delivery_share", "table_share", "takeaway_share", "beverage_ratio", *_SC, "composite_score"]
BENCH_CTE = f"""bench AS (
  WITH l AS ({" UNION ALL ".join(f"SELECT branch, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM scored" for c in _BENCH_COLS)})
  SELECT metric, {rnd('avg(value)', 4)} AS mean, {rnd('median(value)', 4)} AS median, {rnd('min(value)', 4)} AS min,
    {rnd('max(value)', 4)} AS max, {rnd('stddev_samp(value)', 4)} AS std,
    first(branch ORDER BY value DESC, branch) FILTER (WHERE value IS NOT NULL) AS best_branch,
    first(branch ORDER BY value ASC, branch) FILTER (WHERE value IS NOT NULL) AS worst_branch
  FROM l GROUP BY metric)"""

_ord = "ORDER BY composite_score DESC, branch"
HEALTH_CTE = f"""health AS (
  WITH h AS (SELECT count(CASE WHEN composite_score >= 0.5 THEN 1 END) AS strong_branches,
               count(CASE WHEN composite_score < 0.5 THEN 1 END) AS weak_branches,
               coalesce(string_agg(CASE WHEN composite_score >= 0.5 THEN branch END, ', ' {_ord}), '') AS strong_branch_names,
               coalesce(string_agg(CASE WHEN composite_score < 0.5 THEN branch END, ', ' {_ord}), '') AS weak_branch_names,
               {rnd('avg(composite_score)', 4)} AS avg_composite,
               {rnd('max(total_revenue) / sum(total_revenue)', 4)} AS max_revenue_share, count(*) AS n FROM scored),
  f AS (SELECT count(CASE WHEN coalesce(forecast_vs_historical, 0.0) > 0 THEN 1 END) AS branches_growing,
               count(CASE WHEN coalesce(forecast_vs_historical, 0.0) < 0 THEN 1 END) AS branches_declining FROM fc_summary)
  SELECT CAST(strong_branches AS BIGINT) AS strong_branches, CAST(weak_branches AS BIGINT) AS weak_branches,
    strong_branch_names, weak_branch_names, avg_composite, max_revenue_share, max_revenue_share > 0.35 AS revenue_concentrated,
    CAST(branches_growing AS BIGINT) AS branches_growing, CAST(branches_declining AS BIGINT) AS branches_declining,
    {rnd('(strong_branches / n + (1 - weak_branches / n) + least(avg_composite / 0.7, 1.0) + branches_growing / greatest(n, 1)) / 4', 4)}
      AS network_health_score
  FROM h CROSS JOIN f)"""

_IDEAL = [("avg_monthly_revenue", "Target monthly revenue (first year)"), ("total_customers", "Target customer base"),
          ("avg_ticket_size", "Target average ticket size"), ("num_employees", "Recommended starting staff"),
          ("avg_shift_hours", "Average shift length (hours)"), ("beverage_ratio", "Target beverage revenue share"),
          ("repeat_rate", "Target customer repeat rate")]
IDEAL_CTE = f"""ideal AS (
  WITH r AS (SELECT *, row_number() OVER ({_ord}) AS rk FROM scored),
  l AS ({" UNION ALL ".join(f"SELECT branch, rk, '{m}' AS metric, '{lab}' AS label, {i} AS metric_order, CAST({m} AS DOUBLE) AS value FROM r" for i, (m, lab) in enumerate(_IDEAL))}),
  a AS (SELECT metric, label, metric_order, avg(value) FILTER (WHERE rk <= 2) AS top, avg(value) AS net FROM l GROUP BY 1, 2, 3),
  c AS (SELECT avg(table_share) AS t, avg(takeaway_share) AS ta, avg(delivery_share) AS d,
          string_agg(branch, ', ' ORDER BY rk) AS based_on FROM r WHERE rk <= 2)
  SELECT a.metric, label, CAST(metric_order AS INTEGER) AS metric_order, {rnd('top', 2)} AS top_performer_avg,
    {rnd('net', 2)} AS network_average, {rnd('coalesce(b.median, net)', 2)} AS benchmark_median,
    {rnd('(top + coalesce(b.median, net)) / 2', 2)} AS recommended_target, based_on,
    CASE WHEN t > 0.7 THEN 'TABLE (dine-in)' WHEN ta > 0.7 THEN 'TAKE AWAY' ELSE 'MIXED (table + takeaway)' END
      AS recommended_channel_focus,
    {rnd('t', 4)} AS channel_table, {rnd('ta', 4)} AS channel_takeaway, {rnd('d', 4)} AS channel_delivery
  FROM a LEFT JOIN bench b ON b.metric = a.metric CROSS JOIN c)"""

RISKS_CTE = f"""risks AS (
  SELECT 1 AS risk_order, 'Underperforming existing branch' AS risk, 'HIGH' AS severity,
    string_agg(branch, ', ' {_ord}) || ' scores under 0.4 overall.' AS detail,
    'First bring to 0.4: ' || string_agg(branch, ', ' {_ord}) AS mitigation
  FROM scored WHERE composite_score < 0.4 HAVING count(*) > 0
  UNION ALL
  SELECT 2, 'High revenue volatility', 'MEDIUM',
    'A month''s revenue is off its branch''s mean by a share of ' || {num_text_sql('cv', 2)} || ' on average.',
    'Plan with the lower ends of the forecast intervals.'
  FROM (SELECT avg(revenue_cv) AS cv FROM scored) WHERE cv > 0.7
  UNION ALL
  SELECT 3, 'Short data history', 'MEDIUM',
    'The shortest branch history has ' || CAST(n AS VARCHAR)
      || ' months of sales. Seasons and long-term trends cannot be told apart.',
    'Gather 12 months of sales before committing major capital.'
  FROM (SELECT min(k) AS n FROM (SELECT count(*) AS k FROM monthly_sales GROUP BY branch)) WHERE n < 12
  UNION ALL
  SELECT 4, 'Missing operational data', 'LOW',
    'The punch table has no rows for [' || string_agg('''' || branch || '''', ', ' {_ord}) || '].',
    'Leave these out of staffing figures until punches are recorded.'
  FROM scored WHERE num_employees = 0 HAVING count(*) > 0
  UNION ALL
  SELECT 5, 'Declining branch revenue', 'HIGH',
    'The forecast is over 10% under the average month of ' || string_agg(branch, ', ' ORDER BY branch) || '.',
    'Find out what these branches lost.'
  FROM fc_summary WHERE coalesce(forecast_vs_historical, 0.0) < -0.1 HAVING count(*) > 0)"""

VERDICT_CTE = """verdict AS (
  WITH x AS (SELECT network_health_score AS s, (SELECT count(*) FROM risks WHERE severity = 'HIGH') AS n FROM health),
  y AS (SELECT *, CASE WHEN s >= 0.7 AND n = 0 THEN 'GO' WHEN s >= 0.5 AND n <= 1 THEN 'CONDITIONAL GO'
                  ELSE 'NOT RECOMMENDED' END AS verdict FROM x)
  SELECT verdict, CASE verdict
    WHEN 'GO' THEN 'The network is healthy with strong growth across branches. No high-severity risks identified. Expansion is recommended.'
    WHEN 'CONDITIONAL GO' THEN 'The network shows moderate health with some risks. Expansion is feasible but should address identified risks first. Recommend a phased approach.'
    ELSE 'The network has significant weaknesses or multiple high-severity risks. Focus on strengthening existing operations before expanding.' END AS rationale,
    CAST(""" + rnd("s", 2) + """ AS VARCHAR) AS health_score, CAST(n AS VARCHAR) AS high_risks FROM y)"""

ASSESS_SQL = f"""
SELECT 1 AS row_order, 'Verdict' AS category, 'Expansion Recommendation' AS metric, verdict AS value, rationale AS detail FROM verdict
UNION ALL SELECT 2, 'Network Health', 'Health Score', {num_text_sql('network_health_score', 4)},
  CAST(strong_branches AS VARCHAR) || ' strong, ' || CAST(weak_branches AS VARCHAR) || ' weak branches' FROM health
UNION ALL SELECT 3, 'Network Health', 'Growing Branches', CAST(branches_growing AS VARCHAR),
  CAST(branches_declining AS VARCHAR) || ' declining' FROM health
UNION ALL SELECT 10 + metric_order, 'Ideal Profile', label, {num_text_sql('recommended_target', 2)},
  'Top performer avg: ' || {num_text_sql('top_performer_avg', 2)} || ', Network avg: ' || {num_text_sql('network_average', 2)} FROM ideal
UNION ALL SELECT 30, 'Ideal Profile', 'Recommended Channel Focus', recommended_channel_focus,
  '{{''table'': ' || {num_text_sql('channel_table', 4)} || ', ''takeaway'': ' || {num_text_sql('channel_takeaway', 4)}
  || ', ''delivery'': ' || {num_text_sql('channel_delivery', 4)} || '}}' FROM ideal WHERE metric_order = 0
UNION ALL SELECT 40 + risk_order, 'Risk', risk, severity, detail FROM risks"""

EXP_SUMMARY_SQL = f"""
, t AS (SELECT string_agg(metric || '=' || {num_text_sql('recommended_target', 2)}, '; ' ORDER BY metric_order) AS new_branch_targets,
          min(recommended_channel_focus) AS recommended_channel_focus, min(channel_table) AS channel_table,
          min(channel_takeaway) AS channel_takeaway, min(channel_delivery) AS channel_delivery FROM ideal),
tb AS (SELECT string_agg('''' || branch || '''', ', ' {_ord}) AS names FROM scored WHERE table_share > 0.9 AND takeaway_share < 0.05),
best AS (SELECT branch AS model_to_replicate, composite_score AS model_composite,
  concat_ws('; ', CASE WHEN score_growth > 0.8 THEN 'Strong growth momentum' END, CASE WHEN score_revenue > 0.8 THEN 'High revenue' END,
    CASE WHEN score_efficiency > 0.8 THEN 'High operational efficiency' END,
    CASE WHEN score_customers > 0.8 THEN 'Large customer base' END) AS model_key_strengths
  FROM scored {_ord} LIMIT 1)
SELECT v.verdict, v.rationale, h.network_health_score, h.strong_branch_names AS strong_branches,
  h.weak_branch_names AS weak_branches, h.branches_growing, h.branches_declining, t.new_branch_targets,
  t.recommended_channel_focus, t.channel_table, t.channel_takeaway, t.channel_delivery,
  (SELECT coalesce(string_agg(risk || ' [' || severity || ']: ' || mitigation, '; ' ORDER BY risk_order), '') FROM risks)
    AS risks, (SELECT CAST(count(*) AS BIGINT) FROM risks WHERE severity = 'HIGH') AS high_risk_count,
  CASE WHEN tb.names IS NOT NULL THEN 'Over 90% table sales and under 5% take-away at [' || tb.names || '].'
       ELSE 'Take-away reaches 5% or table sales stay under 90% everywhere.' END AS location_insight,
  best.*
FROM verdict v CROSS JOIN health h CROSS JOIN t CROSS JOIN tb CROSS JOIN best"""


def expansion_with(*ctes: str) -> str:
    return demand_with("fc_summary", bindings=("tax_report", "attendance"), more=list(ctes))


_EXP = [SCORECARD_CTE, SCORED_CTE]
ORACLES.update({
    "scorecard": expansion_with(SCORECARD_CTE) + "SELECT * FROM sc",
    "composite_score": expansion_with(*_EXP) + "SELECT * FROM scored",
    "benchmarks": expansion_with(*_EXP, BENCH_CTE) + "SELECT * FROM bench",
    "branch_comparison": expansion_with(*_EXP) + f"""
, r AS (SELECT *, row_number() OVER ({_ord}) AS rk FROM scored)
SELECT a.branch AS branch_a, b.branch AS branch_b,
  CAST({" + ".join(f"CAST(a.{s} > b.{s} AS INTEGER)" for s in _SC)} AS INTEGER) AS dimension_wins_a,
  CAST({" + ".join(f"CAST(b.{s} > a.{s} AS INTEGER)" for s in _SC)} AS INTEGER) AS dimension_wins_b,
  {rnd('a.composite_score', 4)} AS composite_a, {rnd('b.composite_score', 4)} AS composite_b,
  {rnd('abs(a.composite_score - b.composite_score)', 4)} AS composite_gap,
  CASE WHEN a.composite_score > b.composite_score THEN a.branch ELSE b.branch END AS stronger_branch
FROM r a JOIN r b ON a.rk < b.rk""",
    "network_health": expansion_with(*_EXP, HEALTH_CTE) + "SELECT * FROM health",
    "ideal_profile": expansion_with(*_EXP, BENCH_CTE, IDEAL_CTE) + "SELECT * FROM ideal",
    "risk_register": expansion_with(*_EXP, RISKS_CTE) + "SELECT * FROM risks",
    "verdict": expansion_with(*_EXP, HEALTH_CTE, RISKS_CTE, VERDICT_CTE) + "SELECT * FROM verdict",
    "assessment_table": expansion_with(*_EXP, BENCH_CTE, HEALTH_CTE, IDEAL_CTE, RISKS_CTE, VERDICT_CTE) + ASSESS_SQL,
    "expansion_summary": expansion_with(*_EXP, BENCH_CTE, HEALTH_CTE, IDEAL_CTE, RISKS_CTE, VERDICT_CTE) + EXP_SUMMARY_SQL,
})


# ------------------------------------------------------------ category
def classify_sql(desc: str = "description", division: str = "division") -> str:
    parts = []
    for cat, kws in P.CATEGORY_RULES:
        cond = " OR ".join(f"contains(upper({desc}), {sq(k)})" for k in kws)
        parts.append(f"WHEN {cond} THEN '{cat}'")
    return (f"(CASE {' '.join(parts)} WHEN {division} IN {in_list(P.CATEGORY_DIVISIONS)} THEN 'other_beverage' "
            f"ELSE 'non_beverage' END)")


_FOCUS = "('coffee', 'milkshake', 'frappe')"
ITEMS_C_CTE = f"""items_c AS (SELECT *, {classify_sql()} AS bev_category FROM sales_by_item)"""
CAT_SUMMARY_CTE = f"""cat_summary AS (
  WITH t AS (SELECT branch, description, qty, total_amount, bev_category AS category FROM items_c
             UNION ALL SELECT branch, description, qty, total_amount, 'all_beverages' FROM items_c
             WHERE bev_category <> 'non_beverage'),
  a AS (SELECT branch, category, count(DISTINCT description) AS np, sum(qty) AS q, sum(total_amount) AS r FROM t
        WHERE category IN ('coffee', 'milkshake', 'frappe', 'other_beverage', 'all_beverages') GROUP BY 1, 2),
  sc AS (SELECT DISTINCT branch, c.category FROM items_c, (VALUES ('coffee'), ('milkshake'), ('frappe'),
           ('other_beverage'), ('all_beverages')) c(category)),
  isum AS (SELECT branch, sum(total_amount) AS s FROM items_c GROUP BY branch),
  it AS (SELECT branch, total AS it FROM division_summary WHERE division = 'ITEMS'),
  j AS (SELECT sc.branch, sc.category, coalesce(np, 0) AS np, coalesce(q, 0.0) AS q, coalesce(r, 0.0) AS r,
          coalesce(it.it, isum.s) AS bt
        FROM sc LEFT JOIN a ON a.branch = sc.branch AND a.category = sc.category
        LEFT JOIN isum ON isum.branch = sc.branch LEFT JOIN it ON it.branch = sc.branch)
  SELECT branch, category, CAST(np AS BIGINT) AS num_products, q AS total_qty, {rnd('r', 2)} AS total_revenue,
    {rnd('CASE WHEN q > 0 THEN r / q ELSE 0.0 END', 2)} AS avg_unit_price,
    {rnd('CASE WHEN bt > 0 THEN r / bt ELSE 0.0 END', 6)} AS revenue_share,
    {rnd('CASE WHEN np > 0 THEN q / np ELSE 0.0 END', 2)} AS qty_per_product
  FROM j)"""

PERF_CTE = f"""perf AS (
  WITH bev AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY branch ORDER BY total_amount DESC) AS INTEGER) AS branch_rank
               FROM items_c WHERE bev_category IN {_FOCUS}),
  net AS (SELECT description, sum(qty) AS network_qty, sum(total_amount) AS nr, count(DISTINCT branch) AS bs,
            avg(qty) AS aq FROM bev GROUP BY description),
  nb AS (SELECT count(DISTINCT branch) AS nb FROM items_c)
  SELECT branch, bev.description, bev_category, division, grp, qty, total_amount, {rnd('unit_price', 6)} AS unit_price,
    branch_rank, network_qty, {rnd('nr', 2)} AS network_revenue, CAST(bs AS BIGINT) AS branches_sold,
    {rnd('bs / nb', 4)} AS branch_penetration,
    {rnd('CASE WHEN aq > 0 THEN (qty - aq) / aq ELSE 0.0 END', 4)} AS qty_vs_network_avg
  FROM bev LEFT JOIN net ON net.description = bev.description CROSS JOIN nb)"""

GAP_PARTS = f"""cs AS (SELECT * FROM cat_summary WHERE category IN {_FOCUS}),
  st AS (SELECT category, avg(revenue_share) AS avs, avg(total_qty) AS avq,
           first(branch ORDER BY revenue_share DESC, branch) AS benchmark_branch, max(revenue_share) AS best
         FROM cs GROUP BY category),
  g AS (SELECT cs.*, avs, avq, benchmark_branch, best, avs - revenue_share AS sg, avq - total_qty AS qg
        FROM cs JOIN st ON st.category = cs.category WHERE avs - revenue_share > 0 OR avq - total_qty > 0),
  have AS (SELECT DISTINCT branch, bev_category AS category, description FROM items_c WHERE bev_category IN {_FOCUS}),
  bi AS (SELECT h.category, h.description FROM have h JOIN st ON st.category = h.category AND h.branch = st.benchmark_branch),
  miss AS (SELECT g.branch, g.category, bi.description, g.benchmark_branch FROM g JOIN bi ON bi.category = g.category
           WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.branch = g.branch AND h.category = g.category
                             AND h.description = bi.description))"""

GAPS_CTE = f"""gaps AS (
  WITH {GAP_PARTS},
  mc AS (SELECT branch, category, count(*) AS m, array_to_string(list(description ORDER BY description)[1:{LISTED}], '; ') AS ml
         FROM miss GROUP BY 1, 2)
  SELECT g.branch, g.category, {rnd('revenue_share', 6)} AS current_revenue_share, {rnd('avs', 6)} AS network_avg_share,
    {rnd('best', 6)} AS best_branch_share, {rnd('sg', 6)} AS share_gap_vs_avg,
    {rnd('best - revenue_share', 6)} AS share_gap_vs_best, total_qty AS current_qty, {rnd('avq', 2)} AS network_avg_qty,
    {rnd('qg', 2)} AS qty_gap, benchmark_branch, CAST(coalesce(m, 0) AS BIGINT) AS missing_products,
    coalesce(ml, '') AS missing_product_list
  FROM g LEFT JOIN mc ON mc.branch = g.branch AND mc.category = g.category)"""

_gap_units = f"CAST(CAST({rnd('qty_gap', 0)} AS BIGINT) AS VARCHAR)"
ACTIONS_CTE = f"""actions AS (
  WITH j AS (SELECT g.*, s.total_qty AS cq0, s.avg_unit_price AS ap,
               CAST(row_number() OVER (ORDER BY share_gap_vs_best DESC, g.branch, g.category) AS INTEGER) AS priority
             FROM gaps g LEFT JOIN cat_summary s ON s.branch = g.branch AND s.category = g.category)
  SELECT priority, branch, category,
    CASE WHEN missing_products > 0 AND qty_gap > 20 THEN 'INTRODUCE_AND_PROMOTE' WHEN missing_products > 0 THEN 'INTRODUCE'
         WHEN qty_gap > 20 THEN 'PROMOTE' ELSE 'OPTIMIZE' END AS action_type,
    CASE WHEN missing_products > 0 AND qty_gap > 20 THEN benchmark_branch || ' sells ' || CAST(missing_products AS VARCHAR) || ' kinds of '
           || category || ' that this branch lacks; the branch is ' || {_gap_units} || ' units under the average.'
         WHEN missing_products > 0 THEN benchmark_branch || ' sells ' || CAST(missing_products AS VARCHAR) || ' kinds of '
           || category || ' that this branch lacks.'
         WHEN qty_gap > 20 THEN 'All kinds of ' || category || ' that ' || benchmark_branch || ' sells are here; the branch is '
           || {_gap_units} || ' units under the average.'
         ELSE 'All kinds of ' || category || ' that ' || benchmark_branch || ' sells are here, near the average quantity.'
    END AS description,
    current_revenue_share, {rnd('best_branch_share * 0.75', 6)} AS target_revenue_share, share_gap_vs_best,
    coalesce(cq0, 0.0) AS current_qty, {rnd('coalesce(cq0, 0.0) + qty_gap * 0.75', 0)} AS target_qty,
    {rnd('CASE WHEN qty_gap > 0 THEN qty_gap * 0.75 * coalesce(ap, 0.0) ELSE 0.0 END', 2)} AS estimated_revenue_uplift,
    missing_products, benchmark_branch
  FROM j)"""

OPPS_CTE = f"""opps AS (
  WITH cat AS (SELECT bev_category AS category, description AS product, avg(qty) AS aq,
                 first(unit_price ORDER BY branch, division, unit_price) AS up FROM perf GROUP BY 1, 2),
  br AS (SELECT DISTINCT branch FROM perf)
  SELECT branch, bev_category AS category, description AS product, 'BOOST_EXISTING' AS opportunity_type,
    qty AS current_qty, {rnd('network_qty / branches_sold', 1)} AS network_avg_qty,
    {rnd('qty_vs_network_avg * 100', 1)} AS qty_gap_pct, {rnd('total_amount', 2)} AS current_revenue,
    {rnd('unit_price', 2)} AS unit_price
  FROM perf WHERE qty_vs_network_avg < -0.3
  UNION ALL
  SELECT br.branch, cat.category, cat.product, 'ADD_NEW', 0.0, {rnd('aq', 1)}, -100.0, 0.0, {rnd('up', 2)}
  FROM br, cat WHERE NOT EXISTS (SELECT 1 FROM perf p WHERE p.branch = br.branch AND p.bev_category = cat.category
                                 AND p.description = cat.product))"""

CAT_GROWTH_SQL = f"""
, ab AS (SELECT * FROM cat_summary WHERE category = 'all_beverages'),
net AS (SELECT first(branch ORDER BY revenue_share DESC, branch) AS best_beverage_branch,
          {rnd('max(revenue_share)', 4)} AS best_beverage_share,
          first(branch ORDER BY revenue_share ASC, branch) AS worst_beverage_branch,
          {rnd('min(revenue_share)', 4)} AS worst_beverage_share,
          {rnd('avg(revenue_share)', 4)} AS network_avg_beverage_share FROM ab),
tot AS (SELECT CAST(count(*) AS BIGINT) AS total_actions,
          {rnd('coalesce(sum(estimated_revenue_uplift), 0.0)', 2)} AS total_estimated_uplift FROM actions),
tot_o AS (SELECT CAST(count(*) AS BIGINT) AS total_product_opportunities,
            count(DISTINCT CASE WHEN opportunity_type = 'ADD_NEW' THEN product END) AS new_products FROM opps),
widest AS (SELECT max(CASE WHEN priority = 1 THEN branch || ': ' || category || ' earns '
             || CAST({rnd('current_revenue_share * 100', 1)} AS DECIMAL(9, 1)) || '% of revenue, against '
             || CAST({rnd('(current_revenue_share + share_gap_vs_best) * 100', 1)} AS DECIMAL(9, 1)) || '% at '
             || benchmark_branch || '.' END) AS gap FROM actions),
per AS (SELECT branch, CAST(count(*) AS BIGINT) AS num_actions, {rnd('sum(estimated_revenue_uplift)', 2)} AS estimated_uplift,
          arg_min(category, priority) AS top_priority_category, arg_min(action_type, priority) AS top_priority_action,
          arg_min(description, priority) AS top_priority_description
        FROM actions GROUP BY branch),
po AS (SELECT branch, count(CASE WHEN opportunity_type = 'ADD_NEW' THEN 1 END) AS pa,
          count(CASE WHEN opportunity_type = 'BOOST_EXISTING' THEN 1 END) AS pb FROM opps GROUP BY branch)
SELECT per.branch, num_actions, estimated_uplift, CAST(coalesce(pa, 0) AS BIGINT) AS products_to_add,
  CAST(coalesce(pb, 0) AS BIGINT) AS products_to_boost, top_priority_category, top_priority_action,
  top_priority_description,
  net.*, tot.total_actions, tot_o.total_product_opportunities, tot.total_estimated_uplift,
  concat_ws(' ', widest.gap, best_beverage_branch || ' leads with ' || CAST({rnd('best_beverage_share * 100', 1)} AS DECIMAL(9, 1))
    || '% of its revenue from beverages.',
    CASE WHEN new_products > 0 THEN new_products || ' products are missing from some branch''s menu.' END) AS key_insights
FROM per LEFT JOIN po ON po.branch = per.branch CROSS JOIN net CROSS JOIN tot CROSS JOIN tot_o CROSS JOIN widest"""


def category_with(*ctes: str) -> str:
    return with_("sales_lines", "sales_by_item", "division_summary", extra=[ITEMS_C_CTE, *ctes])


ORACLES.update({
    "classify_items": category_with() + "SELECT * FROM items_c",
    "category_summary": category_with(CAT_SUMMARY_CTE) + "SELECT * FROM cat_summary",
    "product_performance": category_with(PERF_CTE) + "SELECT * FROM perf",
    "growth_gaps": category_with(CAT_SUMMARY_CTE, GAPS_CTE) + "SELECT * FROM gaps",
    "missing_products": category_with(CAT_SUMMARY_CTE, GAP_PARTS) + "SELECT * FROM miss",
    "strategy_actions": category_with(CAT_SUMMARY_CTE, GAPS_CTE, ACTIONS_CTE) + "SELECT * FROM actions",
    "product_opportunities": category_with(PERF_CTE, OPPS_CTE) + "SELECT * FROM opps",
    "category_growth_summary": category_with(CAT_SUMMARY_CTE, GAPS_CTE, ACTIONS_CTE, PERF_CTE, OPPS_CTE) + CAT_GROWTH_SQL,
})


# ------------------------------------------------------------ report round trips
def clean_text_sql(x: str) -> str:
    s = f"""trim(regexp_replace(trim({x}), '^"+|"+$', '', 'g'))"""
    s = rf"regexp_replace({s}, '\s+', ' ', 'g')"
    s = f"regexp_replace({s}, '[.,]+$', '')"
    s = rf"regexp_replace({s}, '^[.,]+\s*', '')"
    return f"trim({s})"


TEXT_LINES = """WITH text_lines AS (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth
  FROM documents WHERE text IS NOT NULL)"""
ORACLES.update({
    "parse_tax_report": with_("tax_report") + "SELECT branch, vat, total_tax FROM tax_report",
    "parse_monthly_sales": with_("monthly_sales") + "SELECT * FROM monthly_sales",
    "parse_avg_sales": with_("avg_sales") + "SELECT * FROM avg_sales",
    "parse_attendance": with_("attendance") + """
SELECT CAST(emp_id AS VARCHAR) AS emp_id, emp_name, branch, date_trunc('second', punch_in) AS punch_in,
  date_trunc('second', punch_out) AS punch_out, work_seconds / 3600.0 AS work_duration_hours FROM attendance""",
    "parse_sales_by_item": with_("sales_by_item") + """
SELECT branch, division, grp, description, qty, total_amount,
  CASE WHEN qty > 0 THEN total_amount / qty ELSE 0.0 END AS unit_price FROM sales_by_item""",
    "parse_sales_by_customer": with_("sales_lines") + f"""
SELECT branch, customer, {rnd('qty', 2)} AS qty, description, {rnd('price', 2)} AS price, qty < 0 AS is_cancellation
FROM sales_lines""",
    "parse_customer_orders": with_("customer_orders") + """
SELECT branch, customer, '' AS phone, first_order, last_order, total, num_orders FROM customer_orders""",
    "parse_division_summary": with_("division_summary") + "SELECT * FROM division_summary",
    "noise_filter": with_("tax_report", "monthly_sales", "avg_sales", "attendance", "sales_by_item", "sales_lines",
                          "customer_orders", "division_summary") + """
SELECT 'tax:' || branch AS report_id, CAST(6 AS BIGINT) AS kept_lines, CAST(3 AS BIGINT) AS dropped_lines FROM tax_report
UNION ALL
SELECT 'monthly:' || branch, CAST(6 + count(*) + count(DISTINCT year) AS BIGINT), CAST(3 AS BIGINT)
FROM monthly_sales GROUP BY branch
UNION ALL SELECT 'avg:' || branch, 7 + count(*), 3 FROM avg_sales GROUP BY branch
UNION ALL SELECT 'attendance:' || branch, 4 + 3 * count(DISTINCT emp_id) + count(*), 3 FROM attendance GROUP BY branch
UNION ALL SELECT 'items:' || branch, 6 + 2 * count(DISTINCT division) + 2 * count(DISTINCT (division, grp)) + count(*), 3
FROM sales_by_item GROUP BY branch
UNION ALL SELECT 'customers:' || branch, 5 + 2 * count(DISTINCT customer) + count(*), 3 FROM sales_lines GROUP BY branch
UNION ALL SELECT 'orders:' || branch, 5 + count(*), 3 FROM customer_orders GROUP BY branch
UNION ALL SELECT 'divisions:' || branch, 4 + count(*), 3 FROM division_summary GROUP BY branch""",
    "report_lines": TEXT_LINES + """
SELECT lang AS report_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id, nth) - 1 AS pos, replace(line, chr(13), ' ') AS line
FROM text_lines""",
    "document_lines": TEXT_LINES + rf"""
, x AS (SELECT doc_id, regexp_matches(line, '(?i)Page\s+\d+\s+of') OR NOT regexp_matches(trim(line), '\S')
    OR regexp_matches(trim(line), '(?i)Copyright\s*©') OR regexp_matches(trim(line), '(?i)^REP_S_\d+')
    OR regexp_matches(trim(line), '(?i)\bwww\.[\w-]+\.com\b') AS noise,
  length({clean_text_sql("line")}) AS n, regexp_matches(line, '\d') AS number FROM text_lines)
SELECT doc_id, count(*) FILTER (WHERE NOT noise) AS kept_lines, count(*) FILTER (WHERE noise) AS dropped_lines,
  CAST(sum(n) FILTER (WHERE NOT noise) AS BIGINT) AS clean_chars, count(*) FILTER (WHERE NOT noise AND number) AS numbers
FROM x GROUP BY doc_id""",
    "dataset_catalog": with_("division_summary", "tax_report", "attendance", "sales_lines", "customer_orders",
                             "sales_by_item", "monthly_sales", "avg_sales") + " UNION ALL ".join(
        f"SELECT '{n}' AS dataset, count(*) AS rows, CAST({k} AS BIGINT) AS columns, '{cols}' AS column_names FROM {n}"
        for n, k, cols in [
            ("division_summary", 6, "branch, division, delivery, dine_in, take_away, total"),
            ("tax_report", 3, "branch, vat, total_tax"),
            ("attendance", 7, "emp_id, emp_name, branch, punch_in, punch_out, work_seconds, work_duration_hours"),
            ("sales_lines", 13, "branch, customer, order_id, order_ts, division, grp, item, description, qty, price, "
                                "tax_rate, is_cancellation, channel"),
            ("customer_orders", 6, "branch, customer, first_order, last_order, total, num_orders"),
            ("sales_by_item", 7, "branch, division, grp, description, qty, total_amount, unit_price"),
            ("monthly_sales", 6, "branch, month, month_num, year, total, date"),
            ("avg_sales", 5, "branch, menu_channel, num_customers, sales, avg_per_customer"),
        ]),
})


# ------------------------------------------------------------ scalars over table text
def strip_description_sql(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


_MESSY = """('  "., ' || replace(p_name, ' ', '   ') || '.,"  ')"""
CTE["questions"] = """questions AS (
  SELECT o_orderkey AS question_id, CASE o_orderkey % 6
    WHEN 0 THEN 'Which items should we bundle together in ' || n_name || '?'
    WHEN 1 THEN 'Forecast demand for ' || n_name || ' next month'
    WHEN 2 THEN 'Is it feasible to expand to a new location?'
    WHEN 3 THEN 'How many staff per shift in ' || n_name || '?'
    WHEN 4 THEN 'Which coffee or frappe should ' || n_name || ' add?'
    ELSE 'Give me the overall picture' END AS question
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""

_KW = [("combo", ["combo", "bundle", "pair", "cross-sell", "upsell", "together"]),
       ("demand", ["demand", "forecast", "predict", "sales projection", "next month", "q1"]),
       ("expansion", ["expand", "new branch", "new location", "feasibility", "open"]),
       ("staffing", ["staff", "employee", "shift", "schedule", "hire", "hiring", "workforce"]),
       ("beverage", ["coffee", "milkshake", "frappe", "beverage", "drink", "growth strategy"])]
ROUTE_SQL = with_("questions", extra=["""scores AS (""" + " UNION ALL ".join(
    f"SELECT question_id, {' + '.join(f'CAST(contains(lower(question), {sq(k)}) AS INTEGER)' for k in kws)} AS score, "
    f"{i} AS ord, '{t}' AS topic FROM questions" for i, (t, kws) in enumerate(_KW)) + ")"]) + """
SELECT question_id, CAST(max(score) AS INTEGER) AS score,
  CASE WHEN max(score) > 0 THEN first(topic ORDER BY score DESC, ord) ELSE 'full_summary' END AS topic
FROM scores GROUP BY question_id"""

NB_CTE = """nb AS (SELECT n_name AS branch, row_number() OVER (ORDER BY length(n_name) DESC, n_nationkey) AS list_pos
  FROM nation)"""
RB_CTE = """rb AS (SELECT r_name AS branch, row_number() OVER (ORDER BY r_name) AS list_pos FROM region)"""


def _dedupe(ctes: list[str]) -> list[str]:
    return list(dict.fromkeys(ctes))


_ALL_BINDINGS = ("sales_lines", "sales_by_item", "monthly_sales", "division_summary", "avg_sales",
                 "customer_orders", "tax_report", "attendance")
_FULL_CTES = _dedupe(rank_pairs_ctes() + triples_ctes() + [FEATURES_CTE, PROFILE_CTE, FIT_CTE, FORECAST_CTE,
                                                          FC_SUMMARY_CTE, SCORECARD_CTE, SCORED_CTE, BENCH_CTE,
                                                          HEALTH_CTE, RISKS_CTE, VERDICT_CTE, STAFF_PROFILE_CTE,
                                                          ITEMS_C_CTE, CAT_SUMMARY_CTE, GAPS_CTE, ACTIONS_CTE])
FULL_SUMMARY_SQL = with_(*_ALL_BINDINGS, extra=_FULL_CTES) + f"""
SELECT (SELECT combo_name FROM two_item WHERE rank = 1) AS top_combo,
  (SELECT count(*) FROM two_item) + (SELECT count(*) FROM three_item) AS total_combos,
  (SELECT min(network_horizon_total) FROM fc_summary) AS network_horizon_total,
  (SELECT min(fastest_growing_branch) FROM fc_summary) AS fastest_growing,
  (SELECT verdict FROM verdict) AS verdict, (SELECT network_health_score FROM health) AS health_score,
  (SELECT CAST(sum(num_employees) AS BIGINT) FROM staff_profile) AS total_employees,
  (SELECT first(branch ORDER BY revenue_per_employee DESC, branch) FROM staff_profile) AS most_efficient,
  (SELECT first(branch ORDER BY revenue_share DESC, branch) FROM cat_summary WHERE category = 'all_beverages')
    AS best_beverage_branch,
  (SELECT {rnd('coalesce(sum(estimated_revenue_uplift), 0.0)', 2)} FROM actions) AS total_uplift"""

_num1 = f"CAST(CAST({rnd('lift', 1)} AS DECIMAL(38,1)) AS VARCHAR)"
_num0 = f"CAST(CAST({rnd('lift', 0)} AS DECIMAL(38,0)) AS VARCHAR)"
COMBO_SUMMARY_SQL = with_("sales_lines", "sales_by_item", extra=_dedupe(
    rank_pairs_ctes() + triples_ctes() + branch_pairs_ctes())) + f"""
SELECT (SELECT count(*) FROM two_item) AS total_2item_combos, (SELECT count(*) FROM three_item) AS total_3item_combos,
  (SELECT coalesce(string_agg(combo_name, '; ' ORDER BY rank), '') FROM two_item WHERE rank <= 5) AS top_5_combos,
  (SELECT coalesce(string_agg(combo_name, '; ' ORDER BY rank), '') FROM three_item WHERE rank <= 3) AS top_3_triple_combos,
  (SELECT coalesce(string_agg('lift ' || {num_text_sql('lift', 4)} || ', confidence ' || {num_text_sql('confidence', 4)}
     || ', support ' || {num_text_sql('support', 4)} || coalesce(', price ' || {num_text_sql('combo_price', 2)}, '')
     || ', discount ' || CAST(suggested_discount_pct AS VARCHAR), '; ' ORDER BY rank), '')
   FROM two_item WHERE rank <= 5) AS top_5_rules,
  (SELECT coalesce(string_agg('seen ' || CAST(co_occurrence AS VARCHAR)
     || coalesce(', price ' || {num_text_sql('combo_price', 2)}, ''), '; ' ORDER BY rank), '')
   FROM three_item WHERE rank <= 3) AS top_3_triple_figures,
  (SELECT coalesce(string_agg(branch || ': ' || combo_name, '; ' ORDER BY branch || ': ' || combo_name), '')
     FROM by_branch WHERE branch_rank = 1) AS top_combo_per_branch,
  (SELECT combo_name || ' ranks first (lift ' || {_num1} || '): baskets with ' || antecedent || ' hold ' || consequent || ' '
     || {_num0} || ' times as often as all baskets do. Bundle at ' || CAST(suggested_discount_pct AS VARCHAR) || '% off.'
   FROM two_item WHERE rank = 1) AS key_insight"""

ORACLES.update({
    "parse_number": f"""SELECT l_orderkey, l_linenumber, {rnd('l_extendedprice', 2)} AS plain,
  {rnd('l_extendedprice', 2)} AS quoted, -{rnd('l_extendedprice', 2)} AS negative, CAST(NULL AS DOUBLE) AS dash,
  CAST(NULL AS DOUBLE) AS junk FROM lineitem""",
    "clean_text": f"""SELECT p_partkey, {clean_text_sql(_MESSY)} AS cleaned,
  {strip_description_sql("'  ' || " + _MESSY)} AS stripped FROM part""",
    "item_key": with_("sales_lines") + f"""SELECT description,
  {item_key("' ' || lower(description) || ' ..,'")} AS key, {item_key("description || ' .'")} AS key_blank
FROM (SELECT DISTINCT description FROM sales_lines)""",
    "word_set_key": f"""SELECT p_partkey, {word_set_key("p_brand || ' ' || p_name")} AS ws,
  {word_set_key("p_name || '  ' || p_brand || '  ' || p_name")} AS ws_swapped FROM part""",
    "route_questions": ROUTE_SQL,
    "extract_branch": with_("questions", extra=[NB_CTE]) + """
SELECT q.question_id, arg_min(nb.branch, nb.list_pos) AS branch
FROM questions q LEFT JOIN nb ON contains(lower(q.question), lower(nb.branch)) GROUP BY q.question_id""",
    "link_branch": "WITH " + RB_CTE + """,
names AS (SELECT DISTINCT name FROM (SELECT lower(r_name) AS name FROM region UNION ALL
  SELECT r_name || ' store' FROM region UNION ALL SELECT substr(r_name, 1, 3) FROM region UNION ALL
  SELECT n_name FROM nation))
SELECT name, arg_min(rb.branch, CAST(lower(trim(name)) <> lower(rb.branch) AS INTEGER) * 1000 + rb.list_pos) AS branch
FROM names LEFT JOIN rb ON lower(trim(name)) = lower(rb.branch) OR contains(lower(trim(name)), lower(rb.branch))
  OR contains(lower(rb.branch), lower(trim(name)))
GROUP BY name""",
    "branch_lookup": with_("sales_lines", "sales_by_item", extra=branch_pairs_ctes()) + """
SELECT lower(r_name) AS name, bb.* FROM region JOIN by_branch bb ON lower(bb.branch) = lower(r_name)
WHERE bb.branch_rank <= 5""",
    "full_summary": FULL_SUMMARY_SQL,
    "branch_list": demand_with("fc_summary") + """
SELECT branch, horizon_total_forecast, forecast_vs_historical FROM fc_summary""",
    "combo_summary": COMBO_SUMMARY_SQL,
})


# ------------------------------------------------------------ answers per topic
LINKED_CTE = """names AS (SELECT DISTINCT name FROM (SELECT lower(r_name) AS name FROM region UNION ALL
  SELECT r_name || ' store' FROM region UNION ALL SELECT substr(r_name, 1, 3) FROM region UNION ALL
  SELECT n_name FROM nation)),
linked AS (SELECT name, arg_min(rb.branch, CAST(lower(trim(name)) <> lower(rb.branch) AS INTEGER) * 1000 + rb.list_pos)
    AS branch
  FROM names LEFT JOIN rb ON lower(trim(name)) = lower(rb.branch) OR contains(lower(trim(name)), lower(rb.branch))
    OR contains(lower(rb.branch), lower(trim(name))) GROUP BY name)"""
_STAFF_CTES = (SHIFTS_CTE, DAILY_CTE, STAFF_PROFILE_CTE, GROWTH_CTE, RECS_CTE, SCHED_CTE, HIRING_CTE)
_GROWTH_CTES = (CAT_SUMMARY_CTE, GAPS_CTE, ACTIONS_CTE, PERF_CTE, OPPS_CTE)


def as_cte(name: str, sql: str) -> str:
    """A summary (helper CTEs after a leading comma, then its SELECT) as one CTE."""
    return f"{name} AS (WITH {sql.strip().lstrip(',').strip()})"


def lookup_sql(table: str) -> str:
    return f"SELECT l.name, l.branch IS NOT NULL AS found, l.branch, t.* EXCLUDE (branch) FROM linked l LEFT JOIN {table} t ON t.branch = l.branch"


STAFF_SUM_CTE, GROWTH_SUM_CTE = as_cte("staff_sum", STAFF_SUMMARY_SQL), as_cte("growth_sum", CAT_GROWTH_SQL)
PLACES_CTE = """places AS (SELECT q.question_id, arg_min(nb.branch, nb.list_pos) AS place
  FROM questions q LEFT JOIN nb ON contains(lower(q.question), lower(nb.branch)) GROUP BY q.question_id)"""
HEADLINES_CTE = """headlines AS (
  SELECT 'combo' AS topic, branch, combo_name AS headline, CAST(co_purchase_count AS DOUBLE) AS figure
    FROM by_branch WHERE branch_rank = 1
  UNION ALL SELECT 'combo', NULL, combo_name, lift FROM two_item WHERE rank = 1
  UNION ALL SELECT 'demand', branch, CASE WHEN forecast_vs_historical > 0 THEN 'growing'
    WHEN forecast_vs_historical < 0 THEN 'declining' ELSE 'stable' END, horizon_total_forecast FROM fc_summary
  UNION ALL SELECT 'demand', NULL, min(fastest_growing_branch), min(network_horizon_total) FROM fc_summary
  UNION ALL SELECT 'expansion', NULL, v.verdict, h.network_health_score FROM verdict v CROSS JOIN health h
  UNION ALL SELECT 'staffing', branch, hiring_action, suggested_additional FROM staff_sum
  UNION ALL SELECT 'staffing', NULL, min(most_efficient_branch), min(network_total_employees) FROM staff_sum
  UNION ALL SELECT 'beverage', branch, top_priority_action || ' ' || top_priority_category, estimated_uplift FROM growth_sum
  UNION ALL SELECT 'beverage', NULL, min(best_beverage_branch), min(total_estimated_uplift) FROM growth_sum
  UNION ALL SELECT 'full_summary', NULL, (SELECT v.verdict FROM verdict v), min(network_horizon_total) FROM fc_summary)"""
_ANSWER_CTES = _dedupe(_FULL_CTES + branch_pairs_ctes() + [*_STAFF_CTES, *_GROWTH_CTES, STAFF_SUM_CTE, GROWTH_SUM_CTE,
                                                           HEADLINES_CTE, NB_CTE, PLACES_CTE,
                                                           f"routed AS ({ROUTE_SQL})"])
ORACLES.update({
    "demand_lookup": demand_with("fc_summary", more=[RB_CTE, LINKED_CTE]) + lookup_sql("fc_summary"),
    "staffing_lookup": staffing_with(*_STAFF_CTES, STAFF_SUM_CTE, RB_CTE, LINKED_CTE) + lookup_sql("staff_sum"),
    "beverage_lookup": category_with(*_GROWTH_CTES, GROWTH_SUM_CTE, RB_CTE, LINKED_CTE) + lookup_sql("growth_sum"),
    "answer_questions": with_(*_ALL_BINDINGS, "questions", extra=_ANSWER_CTES) + """
, about AS (SELECT p.question_id, r.topic,
    CASE WHEN r.topic NOT IN ('expansion', 'full_summary') THEN g.r_name END AS branch
  FROM places p JOIN routed r ON r.question_id = p.question_id
  LEFT JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) g ON g.n_name = p.place)
SELECT a.question_id, a.topic, a.branch, h.headline, h.figure
FROM about a LEFT JOIN headlines h ON h.topic = a.topic AND h.branch IS NOT DISTINCT FROM a.branch""",
})
