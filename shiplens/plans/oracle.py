"""DuckDB SQL oracle: the same questions stated independently in SQL.

One CTE chain restates the test-table adapter and the enrichment
(``order_lines`` -> ``enriched``); each query is plain SQL on top of it.
Constants come from ``shiplens.config`` (the business rules), not from the
Spark code. Rounding follows the registry's per-query spec: amounts to 4
decimals, ratios to 6.
"""

from __future__ import annotations

import math

from shiplens.config import (
    BASE_RATE, BASELINE_TIER, CANCELLED_STATUSES, CORPORATE_SEGMENT, DEFAULT_COST,
    DEFAULT_SCENARIO, LANE_CROSS_BORDER, LANE_DOMESTIC, LEVER_A_LABEL, LEVER_B_LABEL,
    LEVER_C_LABEL, SHIPPED_STATUSES, SHIPPING_CANCELED, USCA_MARKET, ZONE_FACTOR,
)
from shiplens.functions.numeric import AMOUNT_DP, RATIO_DP
from shiplens.plans.kpis import TOPLINE_METRICS
from shiplens.plans.marts import CARD_LABELS, CROSS_BORDER_METRICS, TOTAL_LABEL
from shiplens.plans.roundtrips import BAD_DATE_LINE, BAD_QTY_LINE
from shiplens.sources.testdata import (
    MARKET_RANGES, MODE_SCHED_DAYS, NATION_REGIONS, PRIORITY_MODE, QTY_BUCKETS, SALES_DIVISOR,
    SEGMENT_MAP, TRANSIT_WEEK,
)

C = DEFAULT_COST
S = DEFAULT_SCENARIO


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def case_map(expr: str, mapping: dict, cast: str | None = None) -> str:
    whens = " ".join(
        f"WHEN {expr} = {q(k)} THEN {dbl(v) if cast == 'double' else (v if isinstance(v, int) else q(v))}"
        for k, v in mapping.items())
    return f"CASE {whens} END"


def sdiv(a: str, b: str) -> str:
    """Division giving NULL for a zero divisor (Spark ``try_divide``)."""
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def _noise(key: str, seed: int, sigma: float) -> str:
    if sigma == 0:
        return dbl(0.0)
    h = f"md5(concat_ws('|', {q(str(seed))}, {key}))"
    u = lambda start: (f"((CAST(('0x' || substr({h}, {start}, 8)) AS BIGINT) + 1) "  # noqa: E731
                       f"/ CAST(4294967297.0 AS DOUBLE))")
    return (f"({dbl(float(sigma))} * (sqrt(CAST(-2.0 AS DOUBLE) * ln({u(1)})) "
            f"* cos({dbl(2.0 * math.pi)} * {u(9)})))")


def _market_case(nk: str) -> str:
    return "CASE " + " ".join(f"WHEN {nk} BETWEEN {lo} AND {hi} THEN {q(m)}"
                              for lo, hi, m in MARKET_RANGES) + " END"


def base_ctes(sigma: float = C.noise_sigma) -> str:
    """``order_lines`` and ``enriched`` as CTEs (no leading WITH)."""
    regions = "[" + ", ".join(q(r) for r in NATION_REGIONS) + "]"
    seg = " ".join(f"WHEN c_mktsegment = {q(k)} THEN {q(v)}" for k, v in SEGMENT_MAP.items())
    return f"""
joined AS (
  SELECT l.*, o.*, c.*, n.*, p.*,
         {case_map('o.o_orderpriority', PRIORITY_MODE)} AS mode_
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
),
order_lines AS (
  SELECT
    l_orderkey AS order_id,
    concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS line_key,
    o_orderdate AS order_ts,
    l_shipdate AS ship_ts,
    CASE WHEN o_orderstatus = 'F' THEN 'COMPLETE'
         WHEN o_orderstatus = 'O' THEN 'PROCESSING'
         WHEN o_orderstatus = 'P' THEN
           CASE WHEN l_linenumber = 7 THEN 'PAYMENT_REVIEW'
                WHEN l_linenumber = 6 THEN 'SUSPECTED_FRAUD'
                WHEN l_linenumber = 5 THEN 'CANCELED'
                ELSE 'PENDING' END
    END AS order_status,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN {q(SHIPPING_CANCELED)} ELSE 'Other' END AS delivery_status,
    CAST((((date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) % {TRANSIT_WEEK}) + {TRANSIT_WEEK}) % {TRANSIT_WEEK}) AS INTEGER) AS real_days,
    CAST({case_map('mode_', MODE_SCHED_DAYS)} AS INTEGER) AS sched_days,
    mode_ AS shipping_mode,
    CASE WHEN c_nationkey BETWEEN 0 AND {len(NATION_REGIONS) - 1}
         THEN list_extract({regions}, c_nationkey + 1) ELSE n_name END AS order_region,
    {_market_case('c_nationkey')} AS market,
    CASE {seg} ELSE 'Consumer' END AS customer_segment,
    p_type AS category_name,
    CAST(((((CAST(trunc(l_quantity) AS INTEGER) - 1) % {QTY_BUCKETS}) + {QTY_BUCKETS}) % {QTY_BUCKETS}) + 1 AS INTEGER) AS qty,
    l_extendedprice * (1 - l_discount) / {dbl(SALES_DIVISOR)} AS sales
  FROM joined
),
order_lines_r AS (
  SELECT *, CAST(real_days > sched_days AS INTEGER) AS late_risk FROM order_lines
),
kept AS (
  SELECT * FROM order_lines_r WHERE order_status IN {in_list(SHIPPED_STATUSES)}
),
flags AS (
  SELECT *,
    strftime(order_ts, '%Y-%m') AS order_month,
    CAST(year(order_ts) AS INTEGER) AS order_year,
    CAST(coalesce(real_days <= sched_days, false) AS INTEGER) AS is_on_time,
    CAST(late_risk AS INTEGER) AS is_late,
    CAST(coalesce(order_status IN {in_list(CANCELLED_STATUSES)}, false)
         OR coalesce(delivery_status = {q(SHIPPING_CANCELED)}, false) AS INTEGER) AS is_cancelled,
    real_days - sched_days AS transit_variance_days,
    CAST(coalesce(real_days - sched_days <= 0, false) AS INTEGER) AS edd_met,
    {case_map('shipping_mode', BASE_RATE, 'double')} AS base_ship_rate,
    coalesce({case_map('order_region', ZONE_FACTOR, 'double')}, {dbl(C.default_zone_factor)}) AS zone_factor,
    CASE WHEN qty IS NOT NULL THEN greatest(qty - 1, 0) * {dbl(C.qty_surcharge)} END AS qty_surcharge,
    {_noise('line_key', C.noise_seed, sigma)} AS noise
  FROM kept
),
costed AS (
  SELECT *,
    1 - is_cancelled AS is_in_full,
    CAST(is_on_time = 1 AND is_cancelled = 0 AS INTEGER) AS is_otif,
    CASE WHEN base_ship_rate * zone_factor + qty_surcharge + noise IS NOT NULL
         THEN greatest(base_ship_rate * zone_factor + qty_surcharge + noise, {dbl(C.cost_floor)}) END
      AS modeled_shipping_cost,
    sales * {dbl(C.target_ratio)} AS target_ship_cost
  FROM flags
),
enriched AS (
  SELECT *,
    CASE WHEN is_cancelled = 1 THEN modeled_shipping_cost ELSE {dbl(0.0)} END AS reshipment_cost,
    modeled_shipping_cost AS cost_per_order,
    CASE WHEN modeled_shipping_cost - target_ship_cost IS NOT NULL
         THEN greatest(modeled_shipping_cost - target_ship_cost, {dbl(0.0)}) END AS margin_leakage,
    coalesce(order_region = 'Canada', false) AS is_canada,
    CASE WHEN coalesce(order_region = 'Canada', false) THEN {q(LANE_CROSS_BORDER)} ELSE {q(LANE_DOMESTIC)} END AS lane,
    real_days + CASE WHEN coalesce(order_region = 'Canada', false) THEN 1 ELSE 0 END AS border_adj_real_days,
    CAST(coalesce(real_days + CASE WHEN coalesce(order_region = 'Canada', false) THEN 1 ELSE 0 END
                  <= sched_days, false) AS INTEGER) AS border_adj_on_time
  FROM costed
)"""


def with_base(body: str, sigma: float = C.noise_sigma, extra: str = "") -> str:
    more = f",\n{extra}" if extra else ""
    return f"WITH {base_ctes(sigma)}{more}\n{body}"


# -- measure snippets -------------------------------------------------------------

def rate(flag: str, where: str | None = None) -> str:
    if where is None:
        return sdiv(f"sum({flag})", "count(*)")
    return sdiv(f"sum(CASE WHEN {where} THEN {flag} END)", f"count(CASE WHEN {where} THEN 1 END)")


def mean(col: str) -> str:
    return sdiv(f"sum({col})", f"count({col})")


def total(col: str, where: str | None = None) -> str:
    c = col if where is None else f"CASE WHEN {where} THEN {col} END"
    return f"coalesce(CAST(sum({c}) AS DOUBLE), {dbl(0.0)})"


def nn(*keys: str) -> str:
    return " AND ".join(f"{k} IS NOT NULL" for k in keys)


LINE_VIEW_SQL = """order_id, line_key, strftime(order_ts, '%Y-%m-%d') AS order_date, order_status,
  delivery_status, real_days, sched_days, late_risk, shipping_mode, order_region, market,
  customer_segment, category_name, qty, sales"""

USCA = f"market = {q(USCA_MARKET)}"
CORP = f"customer_segment = {q(CORPORATE_SEGMENT)}"
LEVER_A = f"coalesce(shipping_mode IN {in_list(S.diversifiable_modes)}, false)"
LEVER_B = f"coalesce(order_region IN {in_list(S.zone_skip_regions)}, false)"
IN_CELL = "order_region IS NOT NULL AND shipping_mode IS NOT NULL"


def _failed_by(key: str, cum: bool = True) -> str:
    agg = (f"SELECT {key}, count(order_id) AS failed_orders, {total('reshipment_cost')} AS reshipment_cost "
           f"FROM enriched WHERE is_cancelled = 1 AND {key} IS NOT NULL GROUP BY {key}")
    if not cum:
        return agg
    return (f"SELECT *, CAST(sum(failed_orders) OVER (ORDER BY failed_orders DESC, {key} ASC "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / "
            f"CAST(sum(failed_orders) OVER () AS DOUBLE) AS cum_pct FROM ({agg}) a")


K1 = f"""SELECT shipping_mode, count(order_id) AS orders,
  {rate('is_otif')} AS otif_rate, {rate('is_on_time')} AS on_time_rate,
  {rate('is_cancelled')} AS cancel_rate, {mean('transit_variance_days')} AS avg_transit_variance,
  {mean('cost_per_order')} AS avg_cost_per_order
FROM enriched WHERE shipping_mode IS NOT NULL GROUP BY shipping_mode"""

K3 = f"""SELECT order_month, count(order_id) AS orders, {rate('is_otif')} AS otif_rate,
  {rate('is_on_time')} AS on_time_rate
FROM enriched WHERE order_month IS NOT NULL GROUP BY order_month"""

K4 = f"""SELECT order_region, shipping_mode, count(order_id) AS orders,
  {mean('cost_per_order')} AS avg_cost_per_order, {total('cost_per_order')} AS total_cost,
  {mean('margin_leakage')} AS avg_margin_leakage, {total('margin_leakage')} AS total_margin_leakage
FROM enriched WHERE {nn('order_region', 'shipping_mode')} GROUP BY order_region, shipping_mode"""

REGION_CELLS = f"""SELECT order_region, count(order_id) AS orders, {total('cost_per_order')} AS total_cost,
  {total('margin_leakage')} AS total_margin_leakage
FROM enriched WHERE {nn('order_region', 'shipping_mode')} GROUP BY order_region"""

K6 = f"""SELECT shipping_mode, count(order_id) AS orders, {rate('edd_met')} AS edd_met_rate,
  {mean('sched_days')} AS avg_scheduled_days, {mean('real_days')} AS avg_real_days,
  {mean('transit_variance_days')} AS avg_variance
FROM enriched WHERE shipping_mode IS NOT NULL GROUP BY shipping_mode"""

K10 = f"""SELECT lane, count(order_id) AS orders, {rate('is_otif')} AS otif_rate,
  {rate('is_on_time')} AS on_time_rate_pre_customs_adj,
  {rate('border_adj_on_time')} AS on_time_rate_post_customs_adj,
  {rate('is_cancelled')} AS cancel_rate, {mean('cost_per_order')} AS avg_cost_per_order,
  {mean('sales')} AS avg_sales
FROM enriched WHERE {USCA} GROUP BY lane"""

K12 = f"""SELECT order_month, count(order_id) AS orders, CAST(coalesce(sum(qty), 0) AS BIGINT) AS total_units,
  {total('sales')} AS total_sales, {rate('is_otif')} AS otif_rate, {mean('cost_per_order')} AS avg_cost_per_order
FROM enriched WHERE {CORP} AND order_month IS NOT NULL GROUP BY order_month"""

K13 = f"""SELECT category_name, count(order_id) AS orders, CAST(coalesce(sum(qty), 0) AS BIGINT) AS total_units,
  {total('sales')} AS total_sales, {rate('is_otif')} AS otif_rate
FROM enriched WHERE {CORP} AND category_name IS NOT NULL GROUP BY category_name"""

LEVER_SUMS = f"""SELECT
  {total('cost_per_order', IN_CELL)} AS total_cost_cells,
  {total('cost_per_order', IN_CELL + ' AND ' + LEVER_A)} * {dbl(S.share_a)} * {dbl(S.rate_a)} AS lever_a,
  {total('cost_per_order', IN_CELL + ' AND ' + LEVER_B)} * {dbl(S.share_b)} * {dbl(S.rate_b)} AS lever_b,
  {total('qty_surcharge')} * {dbl(S.rate_c)} AS lever_c"""

H5 = f"""SELECT lever, annual_savings, {sdiv('annual_savings', 'total_cost_cells')} AS pct_of_total_cost FROM (
  SELECT {q(LEVER_A_LABEL)} AS lever, lever_a AS annual_savings, total_cost_cells, 1 AS pos FROM lv
  UNION ALL SELECT {q(LEVER_B_LABEL)}, lever_b, total_cost_cells, 2 FROM lv
  UNION ALL SELECT {q(LEVER_C_LABEL)}, lever_c, total_cost_cells, 3 FROM lv) t"""

LV_CTE = f"lv AS ({LEVER_SUMS} FROM enriched)"

TOPLINE_WIDE = f"""SELECT
  count(*) AS total_orders,
  min(order_ts) AS first_order_ts, max(order_ts) AS last_order_ts,
  {rate('is_otif')} AS otif_rate, {rate('is_on_time')} AS on_time_rate, {rate('is_cancelled')} AS cancel_rate,
  {mean('cost_per_order')} AS avg_cost_per_order,
  {total('cost_per_order')} AS total_shipping_cost,
  {total('margin_leakage')} AS total_margin_leakage,
  {total('reshipment_cost', 'is_cancelled = 1')} AS total_reshipment_cost,
  count(CASE WHEN {CORP} THEN 1 END) AS corporate_segment_orders,
  {total('sales', CORP)} AS corporate_segment_sales,
  count(CASE WHEN {USCA} AND order_region = 'Canada' THEN 1 END) AS usca_cross_border_orders,
  {total('cost_per_order', IN_CELL)} AS total_cost_cells,
  {total('cost_per_order', IN_CELL + ' AND ' + LEVER_A)} * {dbl(S.share_a)} * {dbl(S.rate_a)} AS lever_a,
  {total('cost_per_order', IN_CELL + ' AND ' + LEVER_B)} * {dbl(S.share_b)} * {dbl(S.rate_b)} AS lever_b,
  {total('qty_surcharge')} * {dbl(S.rate_c)} AS lever_c
FROM enriched"""

TW_CTE = (f"tw0 AS ({TOPLINE_WIDE}), tw AS (SELECT *, lever_a + lever_b + lever_c AS simulated_annual_savings, "
          f"{sdiv('lever_a + lever_b + lever_c', 'total_cost_cells')} AS simulated_savings_pct FROM tw0)")


def _topline_text() -> str:
    parts = []
    for name, dp in TOPLINE_METRICS:
        if name == "date_range":
            v = "strftime(first_order_ts, '%Y-%m-%d') || ' to ' || strftime(last_order_ts, '%Y-%m-%d')"
        elif dp is None:
            v = f"CAST({name} AS VARCHAR)"
        else:
            v = f"printf('%.{dp}f', round_even({name}, {dp}))"
        parts.append(f"SELECT {q(name)} AS metric, {v} AS value FROM tw")
    return "\nUNION ALL ".join(parts)


def _summary_rounded_cte() -> str:
    cols = []
    for name, dp in TOPLINE_METRICS:
        if name == "date_range":
            continue
        cols.append(name if dp is None else f"round_even({name}, {dp}) AS {name}")
    return f"sr AS (SELECT {', '.join(cols)} FROM tw)"


def _fmt_count(x: str) -> str:
    return f"format('{{:,.0f}}', CAST({x} AS DOUBLE))"


def _fmt_money(x: str) -> str:
    return f"'$' || format('{{:,.0f}}', CAST({x} AS DOUBLE))"


def _fmt_pct(x: str) -> str:
    return f"format('{{:,.1f}}', CAST({x} AS DOUBLE) * 100) || '%'"


def _fmt_k(x: str) -> str:
    return f"'$' || format('{{:,.0f}}', CAST({x} AS DOUBLE) / 1000) || 'k'"


def _cards() -> str:
    values = [
        _fmt_count("total_orders"),
        _fmt_pct("otif_rate"),
        _fmt_money("avg_cost_per_order"),
        _fmt_money("total_shipping_cost"),
        _fmt_money("total_margin_leakage"),
        _fmt_money("total_reshipment_cost"),
        f"{_fmt_money('simulated_annual_savings')} || ' (' || {_fmt_pct('simulated_savings_pct')} || ')'",
        _fmt_count("usca_cross_border_orders"),
    ]
    return "\nUNION ALL ".join(
        f"SELECT {i + 1} AS card, {q(lbl)} AS label, {v} AS value FROM sr"
        for i, (lbl, v) in enumerate(zip(CARD_LABELS, values)))


def _wb_topline() -> str:
    n = "CAST(total_orders AS DOUBLE)"
    inputs = [
        ("Total Orders Analyzed", n),
        ("OTIF Orders (derived)", f"round_even(otif_rate * {n}, 0)"),
        ("On-Time Orders (derived)", f"round_even(on_time_rate * {n}, 0)"),
        ("Cancelled Orders (derived)", f"round_even(cancel_rate * {n}, 0)"),
        ("Total Outbound Shipping Cost ($)", "total_shipping_cost"),
        ("Total Shipping Margin Leakage ($)", "total_margin_leakage"),
        ("Total Reshipment Cost ($, cancelled orders)", "total_reshipment_cost"),
        ("Simulated Annual Savings ($, 3 levers)", "simulated_annual_savings"),
        ("Corporate (B2B) Segment Orders", "CAST(corporate_segment_orders AS DOUBLE)"),
        ("Corporate (B2B) Segment Sales ($)", "corporate_segment_sales"),
        ("Cross-Border US->Canada Orders", "CAST(usca_cross_border_orders AS DOUBLE)"),
    ]
    d = {k: f"({v})" for k, v in inputs}
    derived = [
        ("OTIF Rate", sdiv(d["OTIF Orders (derived)"], d["Total Orders Analyzed"])),
        ("On-Time Rate", sdiv(d["On-Time Orders (derived)"], d["Total Orders Analyzed"])),
        ("Cancellation Rate", sdiv(d["Cancelled Orders (derived)"], d["Total Orders Analyzed"])),
        ("Avg. Cost per Order", sdiv(d["Total Outbound Shipping Cost ($)"], d["Total Orders Analyzed"])),
        ("Margin Leakage as % of Total Cost",
         sdiv(d["Total Shipping Margin Leakage ($)"], d["Total Outbound Shipping Cost ($)"])),
        ("Simulated Savings as % of Total Cost",
         sdiv(d["Simulated Annual Savings ($, 3 levers)"], d["Total Outbound Shipping Cost ($)"])),
    ]
    rows = [(k, "input", v) for k, v in inputs] + [(k, "derived", v) for k, v in derived]
    return "\nUNION ALL ".join(
        f"SELECT {i + 1} AS row_no, {q(b)} AS block, {q(k)} AS metric, round(CAST({v} AS DOUBLE), {AMOUNT_DP if b == 'input' else RATIO_DP}) AS value FROM sr"
        for i, (k, b, v) in enumerate(rows))


def _top(sql: str, n: int, order: str) -> str:
    return f"SELECT * FROM ({sql}) t ORDER BY {order} LIMIT {n}"


def _surge() -> str:
    return f"""SELECT order_month, orders, mean_orders, std_orders, surge_threshold,
  CAST(coalesce(orders > surge_threshold, false) AS INTEGER) AS is_surge
FROM (SELECT *, mean_orders + {dbl(1.0)} * std_orders AS surge_threshold FROM (
  SELECT order_month, orders, avg(orders) OVER () AS mean_orders, stddev_samp(orders) OVER () AS std_orders
  FROM (SELECT order_month, count(order_id) AS orders FROM enriched
        WHERE {CORP} AND order_month IS NOT NULL GROUP BY order_month) m) a) b"""


def _wb_otif_by_carrier() -> str:
    detail = f"""SELECT shipping_mode, count(order_id) AS orders,
  CAST(sum(is_otif) AS BIGINT) AS otif_orders, CAST(sum(is_on_time) AS BIGINT) AS on_time_orders,
  CAST(sum(is_cancelled) AS BIGINT) AS cancelled_orders,
  round_even({mean('transit_variance_days')}, 2) AS avg_transit_variance,
  round_even({mean('cost_per_order')}, 2) AS avg_cost_per_order
FROM enriched WHERE shipping_mode IS NOT NULL GROUP BY shipping_mode"""
    return f"""SELECT shipping_mode, orders, otif_orders, on_time_orders, cancelled_orders, avg_transit_variance,
  avg_cost_per_order, {sdiv('otif_orders', 'orders')} AS otif_rate, {sdiv('on_time_orders', 'orders')} AS on_time_rate,
  {sdiv('cancelled_orders', 'orders')} AS cancel_rate, false AS is_total FROM d
UNION ALL
SELECT {q(TOTAL_LABEL)}, CAST(sum(orders) AS BIGINT), CAST(sum(otif_orders) AS BIGINT), NULL, NULL, NULL, NULL,
  {sdiv('sum(otif_orders)', 'sum(orders)')}, NULL, NULL, true FROM d""", f"d AS ({detail})"


def _wb_edd() -> str:
    return f"""SELECT shipping_mode, count(order_id) AS orders, CAST(sum(edd_met) AS BIGINT) AS edd_met_orders,
  round_even({mean('sched_days')}, 2) AS avg_scheduled_days, round_even({mean('real_days')}, 2) AS avg_real_days,
  round_even({mean('transit_variance_days')}, 2) AS avg_variance,
  {sdiv('sum(edd_met)', 'count(order_id)')} AS edd_met_rate
FROM enriched WHERE shipping_mode IS NOT NULL GROUP BY shipping_mode"""


def _wb_pareto() -> str:
    blocks = []
    for label, key in (("By Region", "order_region"), ("By Category", "category_name")):
        blocks.append(f"SELECT {q(label)} AS dimension, {key} AS key, failed_orders, "
                      f"round_even(reshipment_cost, 2) AS reshipment_cost, cum_pct FROM ({_failed_by(key)}) p")
    return "\nUNION ALL ".join(blocks)


def _cross_border_long() -> str:
    return "\nUNION ALL ".join(
        f"SELECT lane, {q(m)} AS metric, {m} * {dbl(100.0)} AS value_pct, {_fmt_pct(m)} AS label FROM k10"
        for m in CROSS_BORDER_METRICS)


def _bodies() -> dict[str, tuple]:
    """name -> (body SQL, extra CTEs, noise sigma)."""
    wb_otif_body, wb_otif_cte = _wb_otif_by_carrier()
    savings_label = f"{_fmt_k('annual_savings')} || ' (' || {_fmt_pct('pct_of_total_cost')} || ')'"
    return {
        # filters
        "filter_shipped_status": (f"SELECT {LINE_VIEW_SQL} FROM kept", ""),
        "filter_failed_orders": (f"SELECT {LINE_VIEW_SQL} FROM enriched WHERE is_cancelled = 1", ""),
        "filter_market_usca": (f"SELECT {LINE_VIEW_SQL} FROM enriched WHERE {USCA}", ""),
        "filter_segment_corporate": (f"SELECT {LINE_VIEW_SQL} FROM enriched WHERE {CORP}", ""),
        "surge_months": (f"SELECT * FROM ({_surge()}) s WHERE is_surge = 1", ""),
        # lookups / row expressions
        "lookup_base_rate": ("SELECT line_key, shipping_mode, base_ship_rate FROM flags", ""),
        "lookup_zone_factor": ("SELECT line_key, order_region, zone_factor FROM flags", ""),
        "parse_order_dates": ("SELECT line_key, strftime(order_ts, '%-m/%-d/%Y %-H:%M') AS order_text, "
                              "strftime(ship_ts, '%-m/%-d/%Y %-H:%M') AS ship_text, "
                              "strftime(order_ts, '%Y-%m-%d %H:%M') AS order_parsed, "
                              "strftime(ship_ts, '%Y-%m-%d %H:%M') AS ship_parsed FROM kept", ""),
        "order_month_year": ("SELECT line_key, strftime(order_ts, '%Y-%m-%d') AS order_date, order_month, "
                             "order_year FROM flags", ""),
        "delivery_flags": ("SELECT line_key, order_status, delivery_status, real_days, sched_days, is_on_time, "
                           "is_late, is_cancelled, is_in_full, is_otif, transit_variance_days, edd_met "
                           "FROM costed", ""),
        "cost_model": ("SELECT line_key, shipping_mode, order_region, qty, is_cancelled, base_ship_rate, "
                       "zone_factor, qty_surcharge, modeled_shipping_cost, reshipment_cost, cost_per_order "
                       "FROM enriched", "", 0.0),
        "cost_model_noise": ("SELECT line_key, shipping_mode, order_region, qty, is_cancelled, base_ship_rate, "
                             "zone_factor, qty_surcharge, modeled_shipping_cost, reshipment_cost, cost_per_order "
                             "FROM enriched", ""),
        "margin_leakage": ("SELECT line_key, sales, cost_per_order, target_ship_cost, margin_leakage "
                           "FROM enriched", ""),
        "cross_border_lines": (f"SELECT line_key, order_region, real_days, sched_days, is_canada, lane, "
                               f"border_adj_real_days, border_adj_on_time FROM enriched WHERE {USCA}", ""),
        # KPI tables
        "kpi_otif_by_carrier": (K1, ""),
        "kpi_otif_by_region": (f"""SELECT order_region, count(order_id) AS orders, {rate('is_otif')} AS otif_rate,
  {rate('is_on_time')} AS on_time_rate, {rate('is_cancelled')} AS cancel_rate,
  {mean('cost_per_order')} AS avg_cost_per_order
FROM enriched WHERE order_region IS NOT NULL GROUP BY order_region""", ""),
        "kpi_otif_monthly": (K3, ""),
        "kpi_cpo_region_carrier": (K4, ""),
        "kpi_cost_monthly": (f"""SELECT order_month, count(order_id) AS orders,
  {total('cost_per_order')} AS total_shipping_cost, {mean('cost_per_order')} AS avg_cost_per_order,
  {total('margin_leakage')} AS total_margin_leakage
FROM enriched WHERE order_month IS NOT NULL GROUP BY order_month""", ""),
        "kpi_edd_by_carrier": (K6, ""),
        "kpi_failed_delivery_region": (_failed_by("order_region"), ""),
        "kpi_failed_delivery_category": (_failed_by("category_name"), ""),
        "kpi_failed_delivery_carrier": (_failed_by("shipping_mode", cum=False), ""),
        "kpi_cross_border_summary": (K10, ""),
        "kpi_cross_border_monthly": (f"SELECT order_month, lane, count(order_id) AS orders FROM enriched "
                                     f"WHERE {USCA} AND order_month IS NOT NULL GROUP BY order_month, lane", ""),
        "kpi_corporate_monthly": (K12, ""),
        "kpi_corporate_category": (K13, ""),
        "kpi_monthly_by_segment": ("SELECT order_month, customer_segment, count(order_id) AS orders FROM enriched "
                                   "WHERE order_month IS NOT NULL AND customer_segment IS NOT NULL "
                                   "GROUP BY order_month, customer_segment", ""),
        "scenario_rows": (f"""SELECT *, savings_carrier_diversification + savings_zone_skipping AS simulated_annual_savings
FROM (SELECT *,
  CASE WHEN {LEVER_A} THEN total_cost * {dbl(S.share_a)} * {dbl(S.rate_a)} ELSE {dbl(0.0)} END AS savings_carrier_diversification,
  CASE WHEN {LEVER_B} THEN total_cost * {dbl(S.share_b)} * {dbl(S.rate_b)} ELSE {dbl(0.0)} END AS savings_zone_skipping
  FROM ({K4}) k4) s""", ""),
        "kpi_savings_simulation": (f"""SELECT *, {sdiv('simulated_savings', 'current_total_cost')} AS savings_pct FROM (
  SELECT *, savings_carrier_diversification + savings_zone_skipping AS simulated_savings FROM (
    SELECT order_region, {total('cost_per_order')} AS current_total_cost,
      {total('cost_per_order', LEVER_A)} * {dbl(S.share_a)} * {dbl(S.rate_a)} AS savings_carrier_diversification,
      CASE WHEN {LEVER_B} THEN {total('cost_per_order')} * {dbl(S.share_b)} * {dbl(S.rate_b)} ELSE {dbl(0.0)} END
        AS savings_zone_skipping
    FROM enriched WHERE {IN_CELL} GROUP BY order_region) a) b""", ""),
        "kpi_savings_by_lever": (H5, LV_CTE),
        "kpi_topline_summary": (_topline_text(), TW_CTE),
        # charts / dashboard
        "chart_otif_by_carrier": (f"""SELECT shipping_mode, orders, otif_rate * {dbl(100.0)} AS otif_pct,
  avg(otif_rate) OVER () * {dbl(100.0)} AS network_avg_pct,
  max(otif_rate) OVER () * {dbl(100.0)} + 12 AS axis_max_pct, {_fmt_pct('otif_rate')} AS label
  FROM ({K1}) k1""", ""),
        "chart_otif_monthly": (f"""SELECT order_month, strftime(strptime(order_month, '%Y-%m'), '%Y-%m-%d') AS month_start,
  otif_rate * {dbl(100.0)} AS otif_pct, on_time_rate * {dbl(100.0)} AS on_time_pct FROM ({K3}) k3""", ""),
        "chart_cost_by_region": (_top(f"""SELECT order_region, orders, total_cost,
  {sdiv('total_cost', 'orders')} AS avg_cpo, total_cost / 1000 AS total_cost_k,
  {_fmt_k('total_cost')} AS label FROM ({REGION_CELLS}) r""",
                                      12, "total_cost DESC, order_region ASC"), ""),
        "chart_leakage_by_region": (_top(f"""SELECT order_region, total_margin_leakage,
  total_margin_leakage / 1000 AS total_margin_leakage_k, {_fmt_k('total_margin_leakage')} AS label
  FROM ({REGION_CELLS}) r""",
                                         10, "total_margin_leakage DESC, order_region ASC"), ""),
        "chart_edd_by_carrier": (f"SELECT shipping_mode, edd_met_rate * {dbl(100.0)} AS edd_met_pct, avg_variance, "
                                 f"{_fmt_pct('edd_met_rate')} AS label FROM ({K6}) k6", ""),
        "chart_pareto_region": (f"SELECT order_region, failed_orders, cum_pct * {dbl(100.0)} AS cum_pct_100 FROM "
                                f"({_top(_failed_by('order_region'), 10, 'failed_orders DESC, order_region ASC')}) t",
                                ""),
        "chart_pareto_category": (f"SELECT category_name, failed_orders, cum_pct * {dbl(100.0)} AS cum_pct_100 FROM "
                                  f"({_top(_failed_by('category_name'), 10, 'failed_orders DESC, category_name ASC')}) t",
                                  ""),
        "pareto_vital_few": (f"SELECT *, cum_pct <= {dbl(0.8)} AS vital_few FROM ({_failed_by('order_region')}) p", ""),
        "chart_cross_border": (_cross_border_long(), f"k10 AS ({K10})"),
        "chart_corporate_surge": (_surge(), ""),
        "chart_corporate_mix": (_top(f"SELECT category_name, orders, total_units FROM ({K13}) k", 8,
                                     "orders DESC, category_name ASC"), ""),
        "chart_savings_by_lever": (f"""SELECT lever, annual_savings, pct_of_total_cost,
  annual_savings / 1000 AS annual_savings_k, {savings_label} AS label FROM ({H5}) h""", LV_CTE),
        "dashboard_cards": (_cards(), TW_CTE + ", " + _summary_rounded_cte()),
        # workbook
        "wb_topline": (_wb_topline(), TW_CTE + ", " + _summary_rounded_cte()),
        "wb_otif_by_carrier": (wb_otif_body, wb_otif_cte),
        "wb_edd_by_carrier": (_wb_edd(), ""),
        "wb_pareto": (_wb_pareto(), ""),
        "wb_savings_by_lever": (f"""SELECT lever, annual_savings, pct_of_total_cost, false AS is_total FROM ({H5}) h
UNION ALL SELECT 'TOTAL', sum(annual_savings), NULL, true FROM ({H5}) h2""", LV_CTE),
        # report findings
        "tier_cost_ratio": (f"""SELECT shipping_mode, orders, avg_cost_per_order,
  {sdiv('avg_cost_per_order', f"max(CASE WHEN shipping_mode = {q(BASELINE_TIER)} THEN avg_cost_per_order END) OVER ()")}
    AS cost_ratio_vs_baseline FROM ({K1}) k1""", ""),
        "otif_monthly_range": (f"SELECT count(*) AS months, min(otif_rate) AS min_monthly_otif, "
                               f"max(otif_rate) AS max_monthly_otif FROM ({K3}) k3", ""),
        "pareto_top3_share": (f"""SELECT CAST(sum(CASE WHEN rk <= 3 THEN failed_orders END) AS BIGINT) AS top_failed_orders,
  CAST(sum(failed_orders) AS BIGINT) AS total_failed_orders, max(CASE WHEN rk <= 3 THEN cum_pct END) AS top_share
FROM (SELECT *, row_number() OVER (ORDER BY failed_orders DESC, order_region ASC) AS rk
      FROM ({_failed_by('order_region')}) p) r""", ""),
        "failure_vs_volume": (f"""SELECT *, {sdiv('failed_share', 'volume_share')} AS failure_to_volume FROM (
  SELECT category_name, orders, failed_orders,
    {sdiv('failed_orders', 'sum(failed_orders) OVER ()')} AS failed_share,
    {sdiv('orders', 'sum(orders) OVER ()')} AS volume_share
  FROM (SELECT category_name, count(order_id) AS orders,
          count(CASE WHEN is_cancelled = 1 THEN order_id END) AS failed_orders
        FROM enriched WHERE category_name IS NOT NULL GROUP BY category_name) a) b""", ""),
        "customs_on_time_gap": (f"""SELECT lane, orders, on_time_rate_pre_customs_adj, on_time_rate_post_customs_adj,
  on_time_rate_pre_customs_adj - on_time_rate_post_customs_adj AS on_time_drop,
  lane = {q(LANE_CROSS_BORDER)} AS is_cross_border FROM ({K10}) k10""", ""),
        "routing_guide": (f"""SELECT *, coalesce(avg_variance <= 0, false) AS meets_promise,
  CAST(row_number() OVER (ORDER BY avg_cost_per_order ASC, shipping_mode ASC) AS INTEGER) AS cost_rank FROM (
  SELECT shipping_mode, count(order_id) AS orders, {rate('is_otif')} AS otif_rate, {rate('edd_met')} AS edd_met_rate,
    {mean('transit_variance_days')} AS avg_variance, {mean('cost_per_order')} AS avg_cost_per_order
  FROM enriched WHERE shipping_mode IS NOT NULL GROUP BY shipping_mode) t""", ""),
        "failure_impact": (f"""SELECT *, {sdiv('reshipment_cost', 'failed_orders')} AS cost_per_failure FROM (
  SELECT order_region, count(order_id) AS orders, count(CASE WHEN is_cancelled = 1 THEN order_id END) AS failed_orders,
    {rate('is_cancelled')} AS failure_rate, {total('reshipment_cost', 'is_cancelled = 1')} AS reshipment_cost
  FROM enriched WHERE order_region IS NOT NULL GROUP BY order_region) a""", ""),
        "leakage_vs_cost_share": (f"""SELECT order_region, total_cost, total_margin_leakage,
  {sdiv('total_cost', 'sum(total_cost) OVER ()')} AS cost_share,
  {sdiv('total_margin_leakage', 'sum(total_margin_leakage) OVER ()')} AS leakage_share FROM ({REGION_CELLS}) r""", ""),
        "leakage_cost_corr": (f"SELECT count(*) AS regions, corr(total_cost, total_margin_leakage) AS cost_leakage_corr "
                              f"FROM ({REGION_CELLS}) r", ""),
        "otif_by_year_carrier": (f"""SELECT order_year, shipping_mode, count(order_id) AS orders, {rate('is_otif')} AS otif_rate
FROM enriched WHERE {nn('order_year', 'shipping_mode')} GROUP BY order_year, shipping_mode""", ""),
        # sources, sinks and quality: what a round trip must not change
        "csv_roundtrip_otif": (K1, ""),
        "csv_ingest_rejects": (f"""SELECT count(*) FILTER (WHERE false) AS malformed_rows, count(*) AS raw_rows,
  count(*) FILTER (WHERE line_no = {BAD_DATE_LINE}) AS rejected_order_ts,
  count(*) FILTER (WHERE line_no = {BAD_QTY_LINE}) AS rejected_qty,
  {', '.join(f'CAST(0 AS BIGINT) AS rejected_{c}' for c in ('order_id', 'ship_ts', 'real_days', 'sched_days', 'late_risk', 'sales'))}
FROM (SELECT CAST(split_part(line_key, '|', 2) AS INTEGER) AS line_no FROM order_lines_r) x""", ""),
        "csv_rejected_rows": (f"""SELECT line_key, 'sales' AS reasons FROM order_lines_r
WHERE CAST(split_part(line_key, '|', 2) AS INTEGER) = {BAD_QTY_LINE}""", ""),
        "csv_line_breaks": ("""SELECT replace(category_name, ' ', chr(10)) AS category_name, count(*) AS lines,
  CAST(sum(qty) AS BIGINT) AS units FROM order_lines_r GROUP BY 1""", ""),
        "csv_inferred_dates": ("""SELECT strftime(order_ts, '%Y-%m') AS order_month, count(*) AS lines,
  'd/M/yyyy H:mm' AS date_format FROM order_lines_r GROUP BY 1""", ""),
        "sink_late_month": (K3, ""),
        "line_quality": (f"""SELECT count(*) AS kept_lines, count(*) FILTER (WHERE order_month IS NULL) AS lines_without_month,
  count(*) FILTER (WHERE base_ship_rate IS NULL) AS lines_without_rate,
  count(*) FILTER (WHERE order_region IS NULL OR order_region NOT IN {in_list(ZONE_FACTOR)}) AS default_zone_lines
FROM enriched""", ""),
        "sink_enriched_monthly": (K3, ""),
        "stored_kpi_summary": (_topline_text(), TW_CTE),
        "stored_kpi_chart": (_top(f"""SELECT order_region, orders, total_cost,
  {sdiv('total_cost', 'orders')} AS avg_cpo, total_cost / 1000 AS total_cost_k,
  {_fmt_k('total_cost')} AS label FROM ({REGION_CELLS}) r""",
                                  12, "total_cost DESC, order_region ASC"), ""),
        "stored_kpi_cards": (_cards(), TW_CTE + ", " + _summary_rounded_cte()),
        "stored_kpi_sheet": (f"""SELECT order_region AS "Order Region", count(order_id) AS "Orders", {rate('is_otif')} AS "OTIF Rate",
  {mean('cost_per_order')} AS "Avg Cost/Order ($)"
FROM enriched WHERE order_region IS NOT NULL GROUP BY order_region""", ""),
    }


def _rounded(body: str, amounts, ratios) -> str:
    repl = [f'round("{c}", {AMOUNT_DP}) AS "{c}"' for c in amounts] + \
           [f'round("{c}", {RATIO_DP}) AS "{c}"' for c in ratios]
    if not repl:
        return body
    return f"SELECT * REPLACE ({', '.join(repl)}) FROM (\n{body}\n) oracle_out"


def oracle_sql() -> dict[str, str]:
    from shiplens.plans.registry import QUERIES
    out = {}
    for name, spec in _bodies().items():
        body, extra = spec[0], spec[1]
        sigma = spec[2] if len(spec) > 2 else C.noise_sigma
        qd = QUERIES[name]
        out[name] = with_base(_rounded(body, qd.amounts, qd.ratios), sigma, extra)
    return out
