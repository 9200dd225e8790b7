"""SQL stating what each registered query must return, for an independent engine.

The star schema is restated here from the base tables, so that a mistake in a
binding shows up as a difference and does not cancel out.
"""

from __future__ import annotations

ORDERS_STAR = """
span AS (
  SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders),
days AS (
  SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date, lo
  FROM span),
dim_date AS (
  SELECT CAST(date_diff('day', lo, date) AS INTEGER) AS date_key, date,
         CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter,
         CAST(month(date) AS INTEGER) AS month, monthname(date) AS month_name,
         CAST(isoyear(date) AS INTEGER) AS iso_year, CAST(week(date) AS INTEGER) AS iso_week,
         CAST(date - CAST(isodow(date) - 1 AS INTEGER) AS DATE) AS week_start_date,
         dayname(date) AS day_of_week
  FROM days),
staged AS (
  SELECT *, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END AS reached FROM orders),
fact_funnel_event AS (
  SELECT o_orderkey * 3 + k.pos AS event_key,
         CAST(date_diff('day', lo, CAST(o_orderdate AS DATE)) AS INTEGER) AS date_key,
         o_custkey AS customer_key, CAST(o_orderpriority[1] AS INTEGER) - 1 AS channel_key,
         k.stage, o_orderdate AS event_ts
  FROM staged CROSS JOIN span
  JOIN (VALUES (0, 'visit'), (1, 'lead'), (2, 'opportunity')) AS k(pos, stage) ON k.pos < reached),
fact_orders AS (
  SELECT CAST(date_diff('day', lo, CAST(o_orderdate AS DATE)) AS INTEGER) AS date_key,
         o_custkey AS customer_key, CAST(o_orderpriority[1] AS INTEGER) - 1 AS channel_key,
         l_partkey AS product_key, l_orderkey AS order_line_key,
         CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18,4)) AS revenue,
         CAST(l_quantity AS INTEGER) AS quantity, o_orderdate AS order_ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey CROSS JOIN span
  WHERE o_orderstatus = 'F'),
dim_customer AS (
  SELECT c_custkey AS customer_key, c_name AS customer_id, c_name AS name, c_mktsegment AS segment,
         r_name AS region, CAST(NULL AS DATE) AS signup_date
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
dim_channel AS (
  SELECT DISTINCT CAST(o_orderpriority[1] AS INTEGER) - 1 AS channel_key, o_orderpriority AS channel_name,
         CASE WHEN o_orderpriority[1:2] IN ('1-', '2-') THEN 'Paid' ELSE 'Organic' END AS channel_group
  FROM orders),
dim_product AS (
  SELECT p_partkey AS product_key, p_name AS product_name, p_type AS category, p_retailprice AS unit_price
  FROM part),
wk AS (
  SELECT iso_year, iso_week, min(week_start_date) AS week_start_date, min(date) AS first_date_observed,
         max(date) AS last_date_observed, count(*) AS days_observed, count(*) = 7 AS is_complete_week
  FROM dim_date GROUP BY ALL),
day_events AS (
  SELECT date, year, quarter, month, iso_year, iso_week, stage, count(*) AS events
  FROM fact_funnel_event JOIN dim_date USING (date_key) GROUP BY ALL),
day_orders AS (
  SELECT date, year, quarter, month, iso_year, iso_week, count(*) AS n, sum(revenue) AS amount,
         sum(quantity) AS units
  FROM fact_orders JOIN dim_date USING (date_key) GROUP BY ALL),
week_events AS (
  SELECT iso_year, iso_week, stage, CAST(sum(events) AS BIGINT) AS events FROM day_events GROUP BY ALL),
week_orders AS (
  SELECT iso_year, iso_week, CAST(sum(n) AS BIGINT) AS orders, CAST(sum(amount) AS DOUBLE) AS revenue,
         CAST(sum(units) AS BIGINT) AS units
  FROM day_orders GROUP BY ALL),
week_stages AS (
  SELECT iso_year, iso_week, CAST(coalesce(sum(events) FILTER (stage = 'visit'), 0) AS BIGINT) AS visits,
         CAST(coalesce(sum(events) FILTER (stage = 'lead'), 0) AS BIGINT) AS leads,
         CAST(coalesce(sum(events) FILTER (stage = 'opportunity'), 0) AS BIGINT) AS opportunities
  FROM week_events GROUP BY ALL)"""


def star(sql: str) -> str:
    return f"WITH {ORDERS_STAR.strip()}\n{sql.strip()}"


def star_with(ctes: str, sql: str) -> str:
    return f"WITH {ORDERS_STAR.strip()},\n{ctes.strip()}\n{sql.strip()}"


def rounded(value: str, digits: int) -> str:
    """Half-up rounding of the decimal value, not of its binary neighbour."""
    return f"CAST(round(CAST({value} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def share(part: str, whole: str) -> str:
    return rounded(f"100e0 * ({part}) / nullif(CAST({whole} AS DOUBLE), 0)", 2)


def change(now: str, base: str) -> str:
    return rounded(f"100e0 * (CAST({now} AS DOUBLE) - CAST({base} AS DOUBLE)) / nullif(CAST({base} AS DOUBLE), 0)", 1)


def direction(pct: str) -> str:
    return (f"CASE WHEN ({pct}) IS NULL THEN 'unknown' WHEN ({pct}) > 0 THEN 'up' "
            f"WHEN ({pct}) < 0 THEN 'down' ELSE 'flat' END")


FUNNEL_WEEKLY = f"""
SELECT s.iso_year, s.iso_week, w.week_start_date, w.is_complete_week, visits, leads, opportunities,
       coalesce(o.orders, 0) AS orders, coalesce(o.revenue, 0) AS revenue,
       {share('leads', 'visits')} AS visit_to_lead_pct,
       {share('opportunities', 'leads')} AS lead_to_opp_pct,
       {share('coalesce(o.orders, 0)', 'opportunities')} AS opp_to_order_pct,
       {share('coalesce(o.orders, 0)', 'visits')} AS visit_to_order_pct
FROM week_stages s JOIN wk w USING (iso_year, iso_week) LEFT JOIN week_orders o USING (iso_year, iso_week)"""


def views() -> dict[str, str]:
    return {
        "dim_date": star("SELECT * FROM dim_date"),
        "vw_week": star("SELECT * FROM wk"),
        "vw_weekly_funnel": star("""
            SELECT iso_year, iso_week, week_start_date, is_complete_week, stage, events
            FROM week_events JOIN wk USING (iso_year, iso_week)"""),
        "vw_weekly_orders": star("""
            SELECT iso_year, iso_week, week_start_date, is_complete_week, orders, revenue, units
            FROM week_orders JOIN wk USING (iso_year, iso_week)"""),
        "vw_funnel_weekly": star(FUNNEL_WEEKLY),
        "vw_funnel_stage_trend": star(f"""
            SELECT c.stage, c.iso_year, c.iso_week, w.week_start_date, w.is_complete_week, c.events,
                   lag(c.events) OVER s AS events_prior_week,
                   {change('c.events', 'lag(c.events) OVER s')} AS wow_pct,
                   p.events AS events_last_year, {change('c.events', 'p.events')} AS yoy_pct
            FROM week_events c JOIN wk w USING (iso_year, iso_week)
            LEFT JOIN week_events p ON p.stage = c.stage AND p.iso_week = c.iso_week AND p.iso_year + 1 = c.iso_year
            WINDOW s AS (PARTITION BY c.stage ORDER BY c.iso_year, c.iso_week)"""),
        "vw_orders_trend": star(f"""
            SELECT c.iso_year, c.iso_week, w.week_start_date, w.is_complete_week, c.orders, c.revenue,
                   lag(c.orders) OVER s AS orders_prior_week, lag(c.revenue) OVER s AS revenue_prior_week,
                   {change('c.orders', 'lag(c.orders) OVER s')} AS orders_wow_pct,
                   {change('c.revenue', 'lag(c.revenue) OVER s')} AS revenue_wow_pct,
                   p.orders AS orders_last_year, p.revenue AS revenue_last_year,
                   {change('c.orders', 'p.orders')} AS orders_yoy_pct,
                   {change('c.revenue', 'p.revenue')} AS revenue_yoy_pct
            FROM week_orders c JOIN wk w USING (iso_year, iso_week)
            LEFT JOIN week_orders p ON p.iso_week = c.iso_week AND p.iso_year + 1 = c.iso_year
            WINDOW s AS (ORDER BY c.iso_year, c.iso_week)"""),
    }


RESETS = {"wtd": "iso_year, iso_week", "mtd": "year, month", "ytd": "year"}


def catalogue() -> dict[str, str]:
    out = {}
    for period, reset in RESETS.items():
        out[f"orders_{period}"] = star(f"""
            SELECT date, n AS orders, CAST(sum(n) OVER (PARTITION BY {reset} ORDER BY date
                   ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_orders_{period} FROM day_orders""")
        out[f"revenue_{period}"] = star(f"""
            SELECT date, CAST(amount AS DOUBLE) AS revenue, CAST(sum(amount) OVER (PARTITION BY {reset}
                   ORDER BY date ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_revenue_{period} FROM day_orders""")
        out[f"events_{period}"] = star(f"""
            SELECT date, stage, events, CAST(sum(events) OVER (PARTITION BY stage, {reset} ORDER BY date
                   ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_events_{period} FROM day_events""")
    for measure, table, by in (("orders", "week_orders", ()), ("revenue", "week_orders", ()),
                               ("events", "week_events", ("stage",))):
        cols = "".join(f"c.{b}, " for b in by)
        part = "PARTITION BY c.stage " if by else ""
        same = " AND p.stage = c.stage" if by else ""
        before = f"lag(c.{measure}) OVER ({part}ORDER BY c.iso_year, c.iso_week)"
        out[f"{measure}_wow"] = star(f"""
            SELECT {cols}iso_year, iso_week, {measure}, {before} AS {measure}_prior_week,
                   {change(f'c.{measure}', before)} AS wow_pct FROM {table} c""")
        out[f"{measure}_yoy"] = star(f"""
            SELECT {cols}c.iso_week, c.iso_year, c.{measure}, p.{measure} AS {measure}_last_year,
                   {change(f'c.{measure}', f'p.{measure}')} AS yoy_pct
            FROM {table} c LEFT JOIN {table} p
              ON p.iso_year + 1 = c.iso_year AND p.iso_week = c.iso_week{same}""")
    return out


# --- metrics ------------------------------------------------------------------

LABEL = {
    "week": "printf('%d-W%02d', iso_year, iso_week)",
    "month": "printf('%d-%02d', year, month)",
    "quarter": "printf('%d-Q%d', year, quarter)",
    "year": "printf('%d', year)",
}
WEEK_LABEL = LABEL["week"]
LAST_WEEK = """
last_week AS (
  SELECT iso_year, iso_week, week_start_date FROM wk WHERE days_observed = 7
  ORDER BY iso_year DESC, iso_week DESC LIMIT 1)"""

FUNNEL_YOY = f"""
SELECT c.stage, c.iso_year, c.iso_week, printf('%d-W%02d', c.iso_year, c.iso_week) AS week, w.week_start_date,
       c.events AS current_events, printf('%d-W%02d', c.iso_year - 1, c.iso_week) AS prior_year_week,
       p.events AS prior_year_events, c.events - p.events AS delta,
       {change('c.events', 'p.events')} AS yoy_pct,
       {direction(change('c.events', 'p.events'))} AS direction,
       CASE WHEN p.events IS NULL THEN printf('week %d of %d holds no data, so the change over the year is unknown rather than zero', c.iso_week, c.iso_year - 1) END AS note
FROM week_events c JOIN wk w USING (iso_year, iso_week)
LEFT JOIN week_events p ON p.stage = c.stage AND p.iso_week = c.iso_week AND p.iso_year + 1 = c.iso_year"""

SNAPSHOTS = f"""
counts AS (
  SELECT s.iso_year, s.iso_week, w.week_start_date, w.is_complete_week, visits AS visit, leads AS lead,
         opportunities AS opportunity, coalesce(o.orders, 0) AS "order",
         {rounded('coalesce(o.revenue, 0)', 2)} AS revenue
  FROM week_stages s JOIN wk w USING (iso_year, iso_week) LEFT JOIN week_orders o USING (iso_year, iso_week)
  WHERE visits > 0),
rates AS (
  SELECT *, {share('lead', 'visit')} AS visit_to_lead_pct,
         {share('opportunity', 'lead')} AS lead_to_opportunity_pct,
         {share('"order"', 'opportunity')} AS opportunity_to_order_pct,
         {share('"order"', 'visit')} AS visit_to_order_pct
  FROM counts),
figures AS (
  SELECT iso_year, iso_week, week_start_date, f.* FROM rates, LATERAL (VALUES
    ('stage_volume', 'visit', 'visit volume', CAST(visit AS DOUBLE)),
    ('stage_volume', 'lead', 'lead volume', CAST(lead AS DOUBLE)),
    ('stage_volume', 'opportunity', 'opportunity volume', CAST(opportunity AS DOUBLE)),
    ('stage_volume', 'order', 'order volume', CAST("order" AS DOUBLE)),
    ('conversion_rate', 'visit_to_lead', 'visit → lead conversion', visit_to_lead_pct),
    ('conversion_rate', 'lead_to_opportunity', 'lead → opportunity conversion', lead_to_opportunity_pct),
    ('conversion_rate', 'opportunity_to_order', 'opportunity → order conversion', opportunity_to_order_pct),
    ('conversion_rate', 'visit_to_order', 'visit → order conversion', visit_to_order_pct)
  ) AS f(kind, name, label, value)),
fallen AS (
  SELECT printf('%d-W%02d', c.iso_year, c.iso_week) AS current_week,
         printf('%d-W%02d', p.iso_year, p.iso_week) AS previous_week, c.kind, c.name, c.label,
         c.value AS current, p.value AS previous, {change('c.value', 'p.value')} AS change_pct, c.iso_year, c.iso_week
  FROM figures c JOIN figures p ON p.kind = c.kind AND p.name = c.name AND p.week_start_date + 7 = c.week_start_date),
told AS (
  SELECT current_week, previous_week, kind, name, label, current, previous, change_pct,
         printf('%s: down %d%% ', label, CAST(round(abs(change_pct)) AS BIGINT)) ||
         CASE kind WHEN 'stage_volume' THEN printf('(%,d before, %,d now)', CAST(previous AS BIGINT), CAST(current AS BIGINT))
              ELSE printf('(%.1f%% before, %.1f%% now)', {rounded('previous', 1)}, {rounded('current', 1)}) END AS message,
         iso_year, iso_week
  FROM fallen WHERE change_pct <= -20)"""

SNAPSHOT_ROWS = f"""
SELECT iso_year, iso_week, {WEEK_LABEL} AS week, week_start_date, is_complete_week, visit, lead, opportunity, "order", revenue,
       visit_to_lead_pct, lead_to_opportunity_pct, opportunity_to_order_pct, visit_to_order_pct,
       {share('visit - lead', 'visit')} AS visit_to_lead_drop_pct,
       {share('lead - opportunity', 'lead')} AS lead_to_opportunity_drop_pct,
       {share('opportunity - "order"', 'opportunity')} AS opportunity_to_order_drop_pct
FROM rates"""


def day_values(measure: str) -> str:
    """A CTE ``d(date, ..., n, amount)`` of one measure."""
    if measure in ("visit", "lead", "opportunity"):
        return (f"d AS (SELECT date, year, quarter, month, iso_year, iso_week, events AS n, "
                f"CAST(NULL AS DECIMAL(38,4)) AS amount FROM day_events WHERE stage = '{measure}')")
    return "d AS (SELECT date, year, quarter, month, iso_year, iso_week, n, amount FROM day_orders)"


def value(measure: str, n: str = "sum(n)", amount: str = "sum(amount)") -> str:
    if measure == "revenue":
        return f"CAST({amount} AS DOUBLE)"
    if measure == "avg_deal_size":
        return f"CAST({amount} AS DOUBLE) / CAST({n} AS DOUBLE)"
    return f"CAST({n} AS DOUBLE)"


def weekly_trend(measure: str, weeks: int | None) -> str:
    limit = f"ORDER BY iso_year DESC, iso_week DESC LIMIT {weeks}" if weeks else ""
    return star_with(f"""
        {day_values(measure)},
        w AS (SELECT iso_year, iso_week, {value(measure)} AS value FROM d GROUP BY ALL),
        t AS (SELECT c.iso_year, c.iso_week, wk.week_start_date, wk.is_complete_week, c.value,
                lag(c.value) OVER o AS prior, p.value AS prior_year_value,
                date_diff('day', lag(wk.week_start_date) OVER o, wk.week_start_date) AS gap
              FROM w c JOIN wk USING (iso_year, iso_week)
              LEFT JOIN w p ON p.iso_week = c.iso_week AND p.iso_year + 1 = c.iso_year
              WINDOW o AS (ORDER BY c.iso_year, c.iso_week))""", f"""
        SELECT '{measure}' AS measure, iso_year, iso_week, {WEEK_LABEL} AS week, week_start_date,
               is_complete_week, value, {change('value', 'prior')} AS wow_pct,
               {change('value', 'prior_year_value')} AS yoy_pct, prior_year_value,
               CAST(gap AS INTEGER) AS prior_week_gap_days
        FROM t {limit}""")


FIVE = ("visit", "lead", "opportunity", "orders", "revenue")


def running_ctes(measures: tuple[str, ...], period: str, year: int | None) -> str:
    """CTEs ending in ``r(measure, period, date, value, running_total, newest)``."""
    parts = []
    for m in measures:
        if m in ("orders", "revenue"):
            v = "n" if m == "orders" else "amount"
            parts.append(f"SELECT '{m}' AS measure, date, year, month, iso_year, iso_week, CAST({v} AS DECIMAL(28,4)) AS v FROM day_orders")
        else:
            parts.append(f"SELECT '{m}' AS measure, date, year, month, iso_year, iso_week, CAST(events AS DECIMAL(28,4)) AS v FROM day_events WHERE stage = '{m}'")
    where = f"WHERE year = {year}" if year else ""
    return f"""
        m AS ({' UNION ALL '.join(parts)}),
        r AS (SELECT measure, '{period}' AS period, date, CAST(v AS DOUBLE) AS value,
                CAST(sum(v) OVER (PARTITION BY measure, {RESETS[period]} ORDER BY date ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total,
                row_number() OVER (PARTITION BY measure ORDER BY date DESC) AS newest
              FROM m {where})"""


def running_total(measures: tuple[str, ...], period: str, year: int | None = None, days: int | None = None) -> str:
    newest = f"WHERE newest <= {days}" if days else ""
    return star_with(running_ctes(measures, period, year), f"""
        SELECT measure, period, date, value, running_total, newest = 1 AS is_latest FROM r {newest}""")


DIMENSIONS = {"channel": ("dim_channel", "channel_key", "channel_name"),
              "product": ("dim_product", "product_key", "product_name"),
              "region": ("dim_customer", "customer_key", "region"),
              "segment": ("dim_customer", "customer_key", "segment")}


def ranked(dimension: str, measure: str) -> str:
    table, key, label = DIMENSIONS[dimension]
    exact = {"orders": "CAST(n AS DOUBLE)", "revenue": "CAST(amount AS DOUBLE)",
             "avg_deal_size": "CAST(amount AS DOUBLE) / CAST(n AS DOUBLE)"}[measure]
    return f"""{LAST_WEEK.strip()},
        g AS (SELECT iso_year, iso_week, {label} AS name, count(*) AS n, sum(revenue) AS amount
              FROM fact_orders JOIN dim_date USING (date_key) JOIN {table} USING ({key}) GROUP BY ALL),
        k AS (SELECT *, {exact} AS exact,
                row_number() OVER (PARTITION BY iso_year, iso_week ORDER BY {exact} DESC, name) AS rank FROM g),
        shown AS (SELECT {WEEK_LABEL} AS week, name, {rounded('exact', 2)} AS value, n AS orders,
                {rounded('CAST(amount AS DOUBLE)', 2)} AS revenue,
                {rounded('CAST(amount AS DOUBLE) / CAST(n AS DOUBLE)', 2)} AS avg_deal_size, rank, iso_year, iso_week FROM k)"""


def period_ctes(measure: str, grain: str, strict: bool = False) -> str:
    """CTEs ending in ``p(period, s, e, value, complete, prev)`` with the period before."""
    label = LABEL[grain]
    whole = ""
    if strict:
        whole = (" AND days = date_diff('day', CAST(date_trunc('month', s) AS DATE), "
                 "CAST(date_trunc('month', s) + INTERVAL 1 MONTH AS DATE))")
    return f"""
        {day_values(measure)},
        cal AS (SELECT {label} AS period, min(date) AS s, max(date) AS e, count(*) AS days FROM dim_date GROUP BY 1),
        agg AS (SELECT {label} AS period, {value(measure)} AS value FROM d GROUP BY 1),
        bounds AS (SELECT min(date) AS lo, max(date) AS hi FROM d),
        q AS (SELECT cal.period, s, e, agg.value AS found,
                coalesce(s >= (SELECT lo FROM bounds) AND e <= (SELECT hi FROM bounds){whole}, false) AS complete
              FROM cal LEFT JOIN agg USING (period)),
        p AS (SELECT period, s, e, CASE WHEN complete THEN coalesce(found, 0) ELSE found END AS value, complete FROM q)"""


def compared(measure: str, grain: str, pairs: str, strict: bool = False) -> str:
    """``pairs`` is SQL giving ``(c, b)``: the periods to compare."""
    return star_with(f"{period_ctes(measure, grain, strict).strip()},\n pairs AS ({pairs})", f"""
        SELECT '{measure}' AS measure, '{grain}' AS grain, x.period AS current, x.s AS current_start,
               x.e AS current_end, x.value AS current_value, x.complete AS current_complete,
               y.period AS previous, y.s AS previous_start, y.e AS previous_end, y.value AS previous_value,
               y.complete AS previous_complete, {rounded('x.value - y.value', 2)} AS delta,
               {change('x.value', 'y.value')} AS pct_change,
               {direction(change('x.value', 'y.value'))} AS direction,
               CASE WHEN NOT x.complete OR NOT y.complete THEN
                      'incomplete in the data: ' || concat_ws(', ', CASE WHEN NOT x.complete THEN x.period END, CASE WHEN NOT y.complete THEN y.period END)
                      || '; totals of such periods are partial and their change means little'
                    WHEN coalesce(y.value, 0) = 0 THEN 'no change can be given: ' || y.period || ' has nothing of this measure'
               END AS note
        FROM pairs JOIN p x ON x.period = pairs.c JOIN p y ON y.period = pairs.b""")


EVERY_PAIR = "SELECT period AS c, lag(period) OVER (ORDER BY s) AS b FROM p"
NEWEST_PAIR = """SELECT period AS c, lag(period) OVER (ORDER BY s) AS b FROM p WHERE complete
                 ORDER BY s DESC LIMIT 1"""


def metrics() -> dict[str, str]:
    out = {
        "period_labels": star(f"SELECT date, {', '.join(f'{v} AS {k}' for k, v in LABEL.items())} FROM dim_date"),
        "latest_complete_week": star_with(LAST_WEEK, f"""
            SELECT iso_year, iso_week, {WEEK_LABEL} AS week, week_start_date, week_start_date + 6 AS week_end FROM last_week"""),
        "latest_complete_week_fact": star(f"""
            SELECT iso_year, iso_week, {WEEK_LABEL} AS week, week_start_date, week_start_date + 6 AS week_end FROM wk
            WHERE days_observed = 7 AND last_date_observed <= (SELECT max(date) FROM day_events)
            ORDER BY iso_year DESC, iso_week DESC LIMIT 1"""),
        "dim_date_extend": star_with("""
            missing AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem
                        WHERE CAST(l_shipdate AS DATE) NOT IN (SELECT date FROM dim_date))""", """
            SELECT * FROM dim_date UNION ALL
            SELECT CAST((SELECT max(date_key) FROM dim_date) + row_number() OVER (ORDER BY date) AS INTEGER), date,
                   CAST(year(date) AS INTEGER), CAST(quarter(date) AS INTEGER), CAST(month(date) AS INTEGER),
                   monthname(date), CAST(isoyear(date) AS INTEGER), CAST(week(date) AS INTEGER),
                   CAST(date - CAST(isodow(date) - 1 AS INTEGER) AS DATE), dayname(date) FROM missing"""),
        "resolve_week": star_with("""
            asked AS (SELECT DISTINCT isoyear(l_shipdate) AS iso_year, week(l_shipdate) AS iso_week FROM lineitem)""", f"""
            SELECT a.iso_year, a.iso_week, w.week_start_date, w.week_start_date + 6 AS week_end,
                   printf('%d-W%02d', a.iso_year, a.iso_week) AS week,
                   CASE WHEN w.week_start_date IS NULL THEN 'outside the calendar' END AS note
            FROM asked a LEFT JOIN wk w USING (iso_year, iso_week)"""),
        "week_containing": star_with("""
            asked AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)""", f"""
            SELECT a.date, iso_year, iso_week, week_start_date,
                   CASE WHEN iso_week IS NOT NULL THEN {WEEK_LABEL} END AS week
            FROM asked a LEFT JOIN dim_date USING (date)"""),
        "normalise_period": """
            WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
            SELECT date, strftime(date, '%Y-%m') AS month_period, printf('%d-Q%d', year(date), quarter(date)) AS quarter_period,
                   printf('%d-W%02d', isoyear(date), week(date)) AS week_period, CAST(year(date) AS VARCHAR) AS year_period,
                   upper(monthname(date)) || '-' || CAST(year(date) AS VARCHAR) AS unknown_period FROM d""",
        "pct_helpers": star(f"""
            SELECT iso_year, iso_week, {share('leads', 'visits')} AS lead_share, {share('visits', 'opportunities')} AS visit_share,
                   {change('opportunities', 'leads')} AS step_change, {change('visits', 'opportunities')} AS back_change,
                   {direction(change('opportunities', 'leads'))} AS step_direction,
                   {direction(change('visits', 'opportunities'))} AS back_direction FROM week_stages"""),
        "published_views": star(f"""
            SELECT c.iso_year, c.iso_week, c.stage, c.events, {change('c.events', 'p.events')} AS yoy_pct,
                   o.revenue, {change('o.revenue', 'q.revenue')} AS revenue_yoy_pct
            FROM week_events c JOIN wk w USING (iso_year, iso_week) JOIN week_orders o USING (iso_year, iso_week)
            LEFT JOIN week_events p ON p.stage = c.stage AND p.iso_week = c.iso_week AND p.iso_year + 1 = c.iso_year
            LEFT JOIN week_orders q ON q.iso_week = c.iso_week AND q.iso_year + 1 = c.iso_year
            WHERE w.is_complete_week"""),
        "funnel_yoy": star(FUNNEL_YOY),
        "funnel_yoy_week": star_with(LAST_WEEK, f"""
            SELECT y.* FROM ({FUNNEL_YOY}) y JOIN last_week USING (iso_year, iso_week) WHERE stage = 'lead'"""),
        "funnel_snapshot": star_with(SNAPSHOTS, SNAPSHOT_ROWS),
        "funnel_snapshot_week": star_with(f"{SNAPSHOTS.strip()},{LAST_WEEK}", f"""
            SELECT z.* FROM ({SNAPSHOT_ROWS}) z JOIN last_week USING (iso_year, iso_week)"""),
        "funnel_anomalies_weeks": star_with(SNAPSHOTS, "SELECT * EXCLUDE (iso_year, iso_week) FROM told"),
        "funnel_anomalies_sensitive": star_with(f"{SNAPSHOTS.replace('change_pct <= -20', 'change_pct <= -0.1').strip()},{LAST_WEEK}", """
            SELECT told.* EXCLUDE (iso_year, iso_week) FROM told JOIN last_week USING (iso_year, iso_week)"""),
        "funnel_anomalies": star_with(f"{SNAPSHOTS.strip()},{LAST_WEEK}", """
            SELECT told.* EXCLUDE (iso_year, iso_week) FROM told JOIN last_week USING (iso_year, iso_week)"""),
        "weekly_trend_weeks": weekly_trend("revenue", None),
        "running_total_year": running_total(("lead",), "wtd", 1998),
        "running_total_multi": running_total(FIVE, "mtd"),
        "running_total_latest": star_with(running_ctes(FIVE, "ytd", None), """
            SELECT measure, period, date, value, running_total FROM r WHERE newest = 1"""),
        "running_total_days": star_with(running_ctes(FIVE, "ytd", None), """
            SELECT measure, period, date, value, running_total FROM r"""),
        "period_compare_named": compared("orders", "quarter", "SELECT '1998-Q1' AS c, '1997-Q1' AS b"),
        "period_compare_preceding": compared(
            "visit", "week", f"SELECT * FROM ({EVERY_PAIR}) WHERE c = '1999-W01'"),
        "period_changes_strict": compared("orders", "month", EVERY_PAIR, strict=True),
        "daily_trend": star_with(day_values("lead"), """
            SELECT 'lead' AS measure, date, CAST(n AS DOUBLE) AS value FROM d ORDER BY date DESC LIMIT 30"""),
        "daily_trend_dense": star_with(day_values("orders"), """
            SELECT 'orders' AS measure, date, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM dim_date LEFT JOIN d USING (date)
            WHERE date BETWEEN (SELECT min(date) FROM d) AND (SELECT max(date) FROM d) ORDER BY date DESC LIMIT 30"""),
        "daily_trend_summary": star_with(f"""{day_values("revenue")},
            t AS (SELECT date, amount FROM d ORDER BY date DESC LIMIT 30),
            u AS (SELECT count(*) AS n, min(date) AS a, max(date) AS b, CAST(sum(amount) AS DOUBLE) AS total,
                    CAST(arg_min(amount, date) AS DOUBLE) AS x, CAST(arg_max(amount, date) AS DOUBLE) AS y FROM t)""", f"""
            SELECT 'revenue' AS measure, 30 AS days_requested, n AS days_returned, a AS first_date, b AS last_date,
                   {rounded('total', 2)} AS total, {rounded('total / n', 2)} AS average_per_day,
                   x AS first_value, y AS last_value, {change('y', 'x')} AS change_pct,
                   CASE WHEN n < 30 THEN printf('up to %s there are %d days with data; %d were asked for', CAST(b AS VARCHAR), n, 30) END AS note
            FROM u"""),
    }
    out["order_line_totals"] = """
        SELECT count(*) AS lines, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18,4))) AS DOUBLE) AS revenue,
               CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS units, count(DISTINCT l_partkey) AS products
        FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""
    asked = ("SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS c, strftime(o_orderdate - INTERVAL 1 YEAR, '%Y-%m') AS b FROM orders")
    out["period_compare_requests"] = f"""
        WITH a AS ({asked}), f AS ({compared("revenue", "month", asked)}),
        known AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders)
        SELECT c AS request, 'revenue' AS measure, 'month' AS grain, c AS current, b AS previous, current_start, current_end,
               current_value, current_complete, previous_start, previous_end, previous_value, previous_complete, delta, pct_change,
               direction, CASE WHEN b NOT IN (SELECT m FROM known) THEN 'unknown previous month: ' || b ELSE note END AS note
        FROM a LEFT JOIN f ON f.current = a.c AND f.previous = a.b"""
    for d in (30, 400):
        out[f"running_total_newest_{d}"] = running_total(FIVE, "mtd", days=d)
    for m in FIVE:
        out[f"weekly_trend_{m}"] = weekly_trend(m, 12)
    for p in RESETS:
        out[f"running_total_{p}"] = running_total(("orders",), p)
    for d, m in (("channel", "orders"), ("product", "revenue"), ("region", "avg_deal_size"), ("segment", "revenue")):
        out[f"top_{d}"] = star_with(ranked(d, m), """
            SELECT shown.* EXCLUDE (rank, iso_year, iso_week) FROM shown JOIN last_week USING (iso_year, iso_week) WHERE rank <= 5""")
        out[f"top_{d}_weeks"] = star_with(ranked(d, m), "SELECT * EXCLUDE (iso_year, iso_week) FROM shown WHERE rank <= 3")
    for g in LABEL:
        out[f"period_compare_{g}"] = compared("revenue", g, NEWEST_PAIR)
        out[f"period_changes_{g}"] = compared("avg_deal_size" if g == "month" else "lead", g, EVERY_PAIR)
    return out


# --- checks -------------------------------------------------------------------

COLUMNS = {
    "dim_date": "date_key date year quarter month month_name iso_year iso_week week_start_date day_of_week",
    "dim_customer": "customer_key customer_id name segment region signup_date",
    "dim_channel": "channel_key channel_name channel_group",
    "dim_product": "product_key product_name category unit_price",
    "fact_funnel_event": "event_key date_key customer_key channel_key stage event_ts",
    "fact_orders": "order_line_key date_key customer_key channel_key product_key revenue quantity order_ts",
}
PARENTS = {"fact_funnel_event": ("date", "customer", "channel"),
           "fact_orders": ("date", "customer", "channel", "product")}


def checks() -> dict[str, str]:
    rules = [f"SELECT '{t}.{c} not null' AS \"check\", count(*) AS rows_checked, count(*) FILTER ({c} IS NULL) AS violations FROM {t}"
             for t, columns in COLUMNS.items() for c in columns.split()]
    rules += [f"SELECT '{t}.{d}_key in dim_{d}', count(*), count(*) FILTER ({d}_key NOT IN (SELECT {d}_key FROM dim_{d})) FROM {t}"
              for t, dims in PARENTS.items() for d in dims]
    rules += [f"SELECT 'dim_date.{c} unique', count(*), count(*) FILTER (n > 1) FROM (SELECT {c}, count(*) AS n FROM dim_date GROUP BY 1)"
              for c in ("date_key", "date")]
    rates = (("visit_to_lead_pct", "leads", "visits"), ("lead_to_opp_pct", "opportunities", "leads"),
             ("opp_to_order_pct", "orders", "opportunities"), ("visit_to_order_pct", "orders", "visits"))
    rate_rules = []
    for rate, part, whole in rates:
        rate_rules.append(f"SELECT '{rate}_null_iff_no_base' AS \"check\", count(*) AS rows_checked, count(*) FILTER (({rate} IS NULL) <> ({whole} = 0)) AS violations FROM f")
        rate_rules.append(f"SELECT '{rate}_zero_stays_zero', count(*), count(*) FILTER ({part} = 0 AND {whole} > 0 AND {rate} <> 0) FROM f")
    yoy = [f"SELECT '{name}' AS \"check\", count(*) AS rows_checked, count(*) FILTER ({bad}) AS violations FROM y" for name, bad in (
        ("yoy_pairs_same_week", "prior_year_week <> printf('%d-W%02d', iso_year - 1, iso_week)"),
        ("yoy_missing_prior_is_unknown", "prior_year_events IS NULL AND NOT (yoy_pct IS NULL AND direction = 'unknown' AND note IS NOT NULL)"),
        ("yoy_note_only_when_unknown", "prior_year_events IS NOT NULL AND note IS NOT NULL"))]
    union = " UNION ALL "
    return {
        "iso_week_span": star("""
            SELECT 'iso_week_spans_at_most_6_days' AS "check", count(*) AS rows_checked,
                   count(*) FILTER (date_diff('day', first_date_observed, last_date_observed) > 6) AS violations FROM wk"""),
        "contract_check": star(union.join(rules)),
        "rate_null_check": star_with(f"f AS ({FUNNEL_WEEKLY})", union.join(rate_rules)),
        "yoy_pair_check": star_with(f"y AS ({FUNNEL_YOY})", union.join(yoy)),
    }


# --- loads and versions ---------------------------------------------------------

EVENTS = """
WITH first AS (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM events),
e AS (
  SELECT event_id, event_id % 5 AS batch, ts, user_id, value, event_type,
         CAST(date_diff('day', lo, CAST(ts AS DATE)) AS INTEGER) AS date_key,
         CASE event_type WHEN 'view' THEN 'visit' WHEN 'click' THEN 'lead' WHEN 'signup' THEN 'opportunity' END AS stage
  FROM events, first),
c(snapshot_id, committed_at) AS (VALUES (1, TIMESTAMP '2024-02-01 06:00:00'), (2, TIMESTAMP '2024-02-01 18:00:00'),
  (3, TIMESTAMP '2024-02-02 06:00:00'), (4, TIMESTAMP '2024-02-03 06:00:00'), (5, TIMESTAMP '2024-02-04 06:00:00')),
log AS (
  SELECT snapshot_id, committed_at, CASE snapshot_id WHEN 1 THEN 'overwrite' ELSE 'append' END AS operation,
         count(e.event_id) AS added_records
  FROM c LEFT JOIN e ON e.batch + 1 = snapshot_id AND e.stage IS NOT NULL GROUP BY ALL)"""
EVENT_ROWS = """
SELECT event_id AS event_key, date_key, user_id AS customer_key, CAST(event_id % 5 AS INTEGER) AS channel_key, stage, ts AS event_ts
FROM e WHERE stage IS NOT NULL"""


def as_of(cutoff: str, requested: str, stage: str) -> str:
    return f"""{EVENTS},
        t AS (SELECT max(snapshot_id) AS id, max(committed_at) AS live_at FROM c WHERE committed_at <= TIMESTAMP '{cutoff}'),
        n AS (SELECT count(*) FILTER (batch < id) AS past, count(*) AS now FROM e, t WHERE stage = '{stage}')
        SELECT '{stage}' AS stage, '{requested}' AS as_of_requested, past AS historical_events, id AS historical_snapshot_id,
               live_at AS historical_committed_at, now AS current_events, 5 AS current_snapshot_id,
               TIMESTAMP '2024-02-04 06:00:00' AS current_committed_at, now - past AS events_added_since FROM n, t"""


def versions() -> dict[str, str]:
    ranges = {"one week": ("2024-01-08", "2024-01-15"), "inside days": ("2024-01-15 12:00:00", "2024-01-20 06:00:00"),
              "everything": ("2024-01-01", "2024-02-01"), "nothing": ("2023-05-01", "2023-06-01")}
    spans = ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, (a, b) in ranges.items())
    return {
        "csv_roundtrip": f"{EVENTS} {EVENT_ROWS}",
        "evolved_read": f"{EVENTS} {EVENT_ROWS}",
        "read_snapshot": f"{EVENTS} {EVENT_ROWS} AND batch < 3",
        "ts_normalise": """
            SELECT event_id AS event_key, CASE event_id % 4 WHEN 0 THEN CAST(date_trunc('second', ts) AS TIMESTAMP)
                     WHEN 1 THEN CAST(date_trunc('minute', ts) AS TIMESTAMP) WHEN 2 THEN ts END AS event_ts,
                   CASE event_id % 4 WHEN 3 THEN 'rejected' ELSE 'parsed' END AS status FROM events""",
        "dim_load": f"""{EVENTS},
            days AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date, lo FROM first)
            SELECT 'dim_date' AS table_name, date_diff('day', lo, date) AS key, CAST(date AS VARCHAR) AS label FROM days
            UNION ALL SELECT 'dim_customer', c_custkey, c_mktsegment FROM customer
            UNION ALL SELECT DISTINCT 'dim_channel', CAST(o_orderpriority[1] AS BIGINT) - 1, o_orderpriority FROM orders
            UNION ALL SELECT 'dim_product', p_partkey, p_name FROM part""",
        "fact_load_by_month": star_with("""
            months AS (SELECT strftime(order_ts, '%Y-%m') AS month, count(*) AS n FROM fact_orders GROUP BY 1)""", """
            SELECT row_number() OVER o AS snapshot_id, month, CASE row_number() OVER o WHEN 1 THEN 'overwrite' ELSE 'append' END AS operation,
                   n AS added_records, CAST(sum(n) OVER o AS BIGINT) AS total_records FROM months WINDOW o AS (ORDER BY month)"""),
        "load_counts": f"""{EVENTS}
            SELECT 'fact_funnel_event' AS table_name, count(*) FILTER (stage IS NOT NULL) AS row_count FROM e
            UNION ALL SELECT 'fact_orders', count(*) FILTER (event_type = 'purchase') FROM e""",
        "append_batch": f"""{EVENTS}
            SELECT 'fact_funnel_event' AS table_name, event_id % 5 AS channel_key, count(*) AS added FROM e WHERE batch = 4 AND stage IS NOT NULL GROUP BY ALL
            UNION ALL SELECT 'fact_orders', event_id % 5, count(*) FROM e WHERE batch = 4 AND event_type = 'purchase' GROUP BY ALL""",
        "append_stream": f"""{EVENTS}
            SELECT CASE WHEN event_id % 50 = 7 THEN 'rejected' ELSE 'stored' END AS status,
                   CASE WHEN event_id % 50 <> 7 THEN CAST(ts AS DATE) END AS day, stage, count(*) AS events
            FROM e WHERE stage IS NOT NULL GROUP BY ALL""",
        "serve_roundtrip": star(FUNNEL_WEEKLY),
        "current_snapshot": f"""{EVENTS}
            SELECT 'fact_funnel_event' AS table_name, 5 AS snapshot_id, TIMESTAMP '2024-02-04 06:00:00' AS committed_at,
                   'append' AS operation, count(*) FILTER (stage IS NOT NULL) AS total_records FROM e
            UNION ALL SELECT 'fact_orders', 2, TIMESTAMP '2024-02-04 06:00:00', 'append', count(*) FILTER (event_type = 'purchase') FROM e
            UNION ALL SELECT 'dim_customer', 1, TIMESTAMP '2024-02-01 06:00:00', 'overwrite', count(*) FROM customer
            UNION ALL SELECT 'dim_product', 1, TIMESTAMP '2024-02-01 06:00:00', 'overwrite', count(*) FROM part
            UNION ALL SELECT 'dim_channel', 1, TIMESTAMP '2024-02-01 06:00:00', 'overwrite', count(DISTINCT o_orderpriority) FROM orders
            UNION ALL SELECT 'dim_date', 1, TIMESTAMP '2024-02-01 06:00:00', 'overwrite', date_diff('day', lo, hi) + 1 FROM first""",
        "as_of_resolve": f"""{EVENTS},
            m AS (SELECT event_id, ts + INTERVAL 31 DAY AS later FROM events),
            k AS (SELECT event_id,
                    CASE event_id % 10 WHEN 9 THEN strftime(later, '%H:%M') WHEN 8 THEN '9999-12-31' WHEN 7 THEN strftime(later, '%Y-%m')
                      WHEN 6 THEN strftime(later, '%Y%m%d') WHEN 5 THEN strftime(later, '%Y-%m-%d %H:%M') || 'Z'
                      ELSE CASE WHEN event_id % 2 = 0 THEN strftime(later, '%Y-%m-%d') ELSE strftime(later, '%Y-%m-%dT%H:%M:%S') END END AS as_of,
                    CASE WHEN event_id % 10 IN (9, 7, 6) THEN NULL WHEN event_id % 10 = 8 THEN TIMESTAMP '9999-12-31 23:59:59.999999'
                         WHEN event_id % 10 = 5 THEN date_trunc('minute', later)
                         WHEN event_id % 2 = 0 THEN date_trunc('day', later) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND
                         ELSE date_trunc('second', later) END AS cutoff FROM m)
            SELECT event_id, as_of, max(snapshot_id) AS snapshot_id,
                   CASE WHEN max(cutoff) IS NULL THEN 'neither a date nor an ISO time' WHEN max(snapshot_id) IS NULL THEN 'before the first commit' END AS note
            FROM k LEFT JOIN c ON committed_at <= cutoff GROUP BY event_id, as_of""",
        "snapshot_history": f"""{EVENTS}
            SELECT snapshot_id, committed_at AS snapshot_committed_at, operation, added_records,
                   CAST(sum(added_records) OVER (ORDER BY snapshot_id) AS BIGINT) AS total_records, snapshot_id = 5 AS is_current FROM log""",
        "compare_as_of": as_of("2024-02-01 23:59:59.999999", "2024-02-01", "lead"),
        "compare_as_of_moment": as_of("2024-02-01 06:00:00", "2024-02-01T06:00:00Z", "visit"),
        "cross_spec_read": f"""{EVENTS}, spans(name, a, b) AS (VALUES {spans})
            SELECT name AS time_range, stage, count(*) AS events FROM e JOIN spans ON ts >= a AND ts < b WHERE stage IS NOT NULL GROUP BY ALL""",
    }


def stored() -> dict[str, str]:
    """The funnel over the stored click stream, now and as known earlier."""
    def weeks(events: str, orders: str) -> str:
        return f"""{EVENTS},
days AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM first),
wk AS (
  SELECT CAST(isoyear(date) AS INTEGER) AS iso_year, CAST(week(date) AS INTEGER) AS iso_week,
         CAST(min(date_trunc('week', date)) AS DATE) AS week_start_date, count(*) AS days_observed,
         count(*) = 7 AS is_complete_week
  FROM days GROUP BY 1, 2),
week_stages AS (
  SELECT isoyear(ts) AS iso_year, week(ts) AS iso_week, count(*) FILTER (stage = 'visit') AS visits,
         count(*) FILTER (stage = 'lead') AS leads, count(*) FILTER (stage = 'opportunity') AS opportunities
  FROM e WHERE stage IS NOT NULL AND batch {events} GROUP BY 1, 2),
week_orders AS (
  SELECT isoyear(ts) AS iso_year, week(ts) AS iso_week, count(*) AS orders,
         CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS revenue
  FROM e WHERE event_type = 'purchase' AND batch {orders} GROUP BY 1, 2)"""

    now, then = weeks("< 5", "< 5"), weeks("< 3", "< 4")
    return {
        "stored_funnel_weekly": now + FUNNEL_WEEKLY,
        "stored_funnel_weekly_as_of": then + FUNNEL_WEEKLY,
        "stored_funnel_snapshot": f"{now},{SNAPSHOTS},{LAST_WEEK} SELECT z.* FROM ({SNAPSHOT_ROWS}) z JOIN last_week USING (iso_year, iso_week)",
    }


def smoke() -> dict[str, str]:
    parts = []
    for name in catalogue():
        measure, shape = name.split("_")
        if shape in RESETS:
            table = "day_events" if measure == "events" else "day_orders"
        else:
            table = "week_events" if measure == "events" else "week_orders"
        parts.append(f"SELECT '{name}' AS name, count(*) AS row_count, true AS ok, CAST(NULL AS VARCHAR) AS error FROM {table}")
    return {"catalogue_smoke": star(" UNION ALL ".join(parts))}


def all_sql() -> dict[str, str]:
    return {**views(), **catalogue(), **smoke(), **metrics(), **checks(), **versions(), **stored()}
