"""Independent SQL statement of every registered query, for DuckDB.

The chain of CTEs below re-derives the raw export from the TPC-H-style tables,
cleans it, keeps the best row per delivery (window ``row_number``), classifies
it through a ``VALUES`` rules table and enriches it; each query then selects
from ``enriched`` (or ``typed`` / ``errs``).  It is written by hand in plain SQL
and shares no code with the Spark implementation.
"""
from __future__ import annotations

AS_OF = "1998-01-15"
NOW_STAMP = "Jan 15, 1998 at 8:00 AM"

_NUM_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

BASE = r"""
WITH src AS (
  SELECT o.o_orderkey AS ok, o.o_custkey AS ck, l.l_linenumber AS ln, l.l_partkey AS k3,
         l.l_suppkey AS k4, l.l_extendedprice AS k5, l.l_quantity, l.l_shipdate,
         o.o_orderstatus, o.o_totalprice, c.c_name, c.c_mktsegment, r.r_name
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
raw AS (
  SELECT ok, ln, k3, k4, k5,
    CASE WHEN ck % 97 = 0 THEN NULL WHEN ck % 11 = 0 THEN 'Mississauga  warehouse'
         WHEN ck % 11 = 1 THEN 'CALGARY WAREHOUSE' WHEN ck % 11 = 2 THEN ' Surrey Warehouse ' WHEN ck % 2 = 0 THEN r_name || ' WAREHOUSE'
         ELSE ' ' || r_name || '  Warehouse' END AS ys,
    CASE ok % 5 WHEN 0 THEN 'DSD' WHEN 1 THEN 'Independant' WHEN 2 THEN ' independent '
         ELSE 'Warehouse' END AS fac,
    CASE WHEN ok % 211 = 0 THEN 'n/k' WHEN ok % 199 = 0 THEN '150' WHEN ok % 3 = 0 THEN '0'
         WHEN (ok + ln) % 5 = 0 THEN '70.5' WHEN (ok + ln) % 5 = 1 AND ok % 2 = 0 THEN '100'
         ELSE '25' END AS pct,
    CASE WHEN ok % 53 = 0 THEN NULL
         WHEN ln % 3 = 0 THEN CAST(35810 + ok % 29 - 12 AS VARCHAR) || '.5'
         WHEN ln % 3 = 1 THEN '1998-01-' || lpad(CAST(15 + ok % 29 - 12 AS VARCHAR), 2, '0') || ' 23:00:00'
         ELSE '01/' || lpad(CAST(15 + ok % 29 - 12 AS VARCHAR), 2, '0') || '/1998' END AS planned,
    CASE WHEN (ok + ln) % 31 = 0 THEN 'not a date' WHEN ok % 37 = 0 THEN '19980120' WHEN ok % 43 = 0 THEN '1998'
         WHEN ok % 47 = 0 THEN '20-Jan-1998' WHEN ok % 59 = 0 THEN 'Jan 20, 1998 11:00 PM'
         WHEN ok % 61 = 0 THEN '1/20/98 8:30' WHEN ok % 67 = 0 THEN '20.01.1998'
         ELSE CAST(35810 + ck % 23 - 6 AS VARCHAR) END AS route,
    CASE WHEN ok % 4 = 0 THEN NULL ELSE CAST(35810 + (ok + ck) % 17 - 4 AS VARCHAR) END AS dock,
    CASE WHEN ln % 4 = 0 THEN NULL ELSE CAST(l_shipdate AS VARCHAR) END AS wtc,
    CASE WHEN ok % 301 = 0 THEN '   '
         WHEN ln % 2 = 0 THEN CAST(80000000 + ok AS VARCHAR) || '.0'
         ELSE ' ' || CAST(80000000 + ok AS VARCHAR) END AS le,
    CASE WHEN ck % 101 = 0 THEN ''
         ELSE coalesce(CASE ck % 13 WHEN 0 THEN 'Save-On ' WHEN 1 THEN 'ASSOCIATED  GROCERS ' WHEN 2 THEN 'Calgary Co-op '
               WHEN 3 THEN 'Pratt''s Wholesale ' WHEN 4 THEN 'FCL ' WHEN 5 THEN 'Canada  Safeway ' WHEN 6 THEN 'LOBLAW '
               WHEN 7 THEN 'Italian Centre ' WHEN 8 THEN 'DELUCA BROS FOODS ' WHEN 9 THEN 'GFS ' END,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Amazon  ' WHEN 'BUILDING' THEN 'sysco '
               WHEN 'FURNITURE' THEN 'A&W GFS ' WHEN 'MACHINERY' THEN 'WM ' ELSE 'WMX ' END) || c_name
    END AS ship,
    CASE WHEN ok % 41 = 0 THEN 'Loblaws  Pick up' ELSE 'CARRIER ' || CAST(ck % 7 AS VARCHAR) END AS carrier,
    CASE WHEN o_orderstatus = 'F' AND ok % 2 = 0 THEN 'COMPLETED'
         WHEN o_orderstatus = 'F' THEN ' Completed ' ELSE 'Not Started' END AS gi,
    CASE WHEN ok % 307 = 0 THEN 'TBD'
         ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS total,
    CAST(l_quantity AS VARCHAR) AS cases,
    CAST(ln AS VARCHAR) AS line_items,
    CASE WHEN ok % 6 <> 0 THEN '08:' || lpad(CAST(ok % 60 AS VARCHAR), 2, '0') END AS dock_time
  FROM src
  WHERE (ok + ln) % 499 <> 0  -- those rows are blank, and blank rows don't count
),
b AS (  -- whitespace-only cells are missing; then strip
  SELECT ok, ln, k3, k4, k5,
    CASE WHEN regexp_matches(ys, '^\s*$') THEN NULL ELSE trim(ys) END AS ys,
    CASE WHEN regexp_matches(fac, '^\s*$') THEN NULL ELSE trim(fac) END AS fac,
    CASE WHEN regexp_matches(pct, '^\s*$') THEN NULL ELSE pct END AS pct,
    CASE WHEN regexp_matches(planned, '^\s*$') THEN NULL ELSE trim(planned) END AS planned,
    CASE WHEN regexp_matches(route, '^\s*$') THEN NULL ELSE trim(route) END AS route,
    CASE WHEN regexp_matches(dock, '^\s*$') THEN NULL ELSE trim(dock) END AS dock,
    CASE WHEN regexp_matches(wtc, '^\s*$') THEN NULL ELSE trim(wtc) END AS wtc,
    CASE WHEN regexp_matches(le, '^\s*$') THEN NULL ELSE trim(le) END AS le,
    CASE WHEN regexp_matches(ship, '^\s*$') THEN NULL ELSE trim(ship) END AS ship,
    CASE WHEN regexp_matches(carrier, '^\s*$') THEN NULL ELSE trim(carrier) END AS carrier,
    CASE WHEN regexp_matches(gi, '^\s*$') THEN NULL ELSE trim(gi) END AS gi,
    CASE WHEN regexp_matches(total, '^\s*$') THEN NULL ELSE total END AS total,
    cases, line_items, dock_time
  FROM raw
),
num AS (
  SELECT *,
    CASE WHEN regexp_matches(pct, '__NUM__') THEN TRY_CAST(trim(pct) AS DOUBLE) END AS pct_n,
    CASE WHEN regexp_matches(total, '__NUM__') THEN TRY_CAST(trim(total) AS DOUBLE) END AS total_n
  FROM b
),
pf AS (
  SELECT CASE WHEN max(pct_n) <= 1 AND max(pct_n) > 0 THEN 100.0 ELSE 1.0 END AS factor FROM num
),
dt AS (
  SELECT num.*,
    CASE WHEN le IS NULL OR lower(le) IN ('', 'nan', 'none', 'nat') THEN ''
         WHEN regexp_matches(le, '^[+-]?[0-9]*\.0+$')
           THEN coalesce(CAST(TRY_CAST(le AS DECIMAL(38,0)) AS VARCHAR), le)
         ELSE le END AS le_id,
    greatest(least(coalesce(pct_n * pf.factor, 0.0), 100.0), 0.0) AS pick,
    coalesce(total_n, 0.0) AS amount,
    (total IS NOT NULL AND total_n IS NULL) AS bad_total
  FROM num, pf
),
typed AS (
  SELECT ok, ln, k3, k4, k5, le_id AS le_delivery, pick AS picking_in_pct, amount AS sales_order_total,
    bad_total,
    coalesce(ys, '') AS ys, coalesce(fac, '') AS facility_code, coalesce(ship, '') AS ship_to_name,
    coalesce(carrier, '') AS carrier_description, coalesce(gi, '') AS goods_issue,
    coalesce(CASE WHEN regexp_matches(cases, '__NUM__') THEN TRY_CAST(trim(cases) AS DOUBLE) END, 0.0) AS cases,
    coalesce(CASE WHEN regexp_matches(line_items, '__NUM__') THEN TRY_CAST(trim(line_items) AS DOUBLE) END, 0.0) AS line_items,
    __DATE_planned__ AS planned_dlv_date,
    __DATE_route__ AS route_depart_date,
    __DATE_dock__ AS customer_dock_appointment_date,
    __DATE_wtc__ AS warehouse_task_creat,
    '' AS cust_reference, '' AS sto_po_number, '' AS carrier, '' AS shipment_type,
    '' AS shpg_cond_desc, '' AS ship_to_city, '' AS ship_to_province, CAST(0 AS DOUBLE) AS pallet_quantity,
    CAST(0 AS DOUBLE) AS num_lifts_pallets, '' AS packing_status, '' AS picking, '' AS picking_plan,
    '' AS cod_paid_flag, dock_time AS customer_dock_appointment_time,
    '' AS customer_dock_reference, CAST(0 AS DOUBLE) AS gross_weight, '' AS sales_order, '' AS outb_del_ord,
    '' AS shipping_cond, '' AS consignee, '' AS purchase_order
  FROM dt
),
best AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY le_delivery
      ORDER BY (CAST(planned_dlv_date IS NOT NULL AS INT) + CAST(route_depart_date IS NOT NULL AS INT)
                + CAST(customer_dock_appointment_date IS NOT NULL AS INT)
                + CAST(warehouse_task_creat IS NOT NULL AS INT)
                + CAST(customer_dock_appointment_time IS NOT NULL AS INT)) DESC,
               picking_in_pct DESC, warehouse_task_creat DESC NULLS LAST, ok, ln, k3, k4, k5) AS rn
    FROM typed WHERE le_delivery <> '') WHERE rn = 1
),
rules(customer_group, customer_display, customer_priority, customer_consequence,
      deadline_flag, customer_report) AS (VALUES
  ('amazon', 'Amazon', 1, '3% on-time delivery chargeback, possible automatic PO cancellation and lost sales.', true, 'AMZ'),
  ('aw_via_gfs', 'A&W (via GFS)', 1, 'Customer out-of-stock risk and delayed replenishment.', false, 'GFS'),
  ('gfs', 'GFS', 1, 'Missed pickup may push the order to the next delivery window and increase customer out-of-stock risk.', false, 'GFS'),
  ('sysco', 'Sysco', 1, 'Missed pickup slot may delay delivery until the next available window.', false, 'Sysco'),
  ('calgary_coop', 'Calgary Co-op', 1, 'Missed delivery and customer out-of-stock risk.', false, 'Calgary CO-OP'),
  ('save_on', 'Save On Foods', 1, 'Chargebacks, fines and customer out-of-stock risk.', false, 'PFG WHSE'),
  ('associated_grocers', 'Associated Grocers', 1, 'Late-delivery fines and lost sales.', false, 'PFG WHSE'),
  ('federated_coop', 'Federated Co-op', 1, 'Fines, delayed replenishment and lost sales.', false, ''),
  ('sobeys_group', 'Sobeys/Safeway/FreshCo', 1, 'Empty shelves, customer out-of-stock risk and lost sales.', false, ''),
  ('pratts', 'Pratts', 1, 'Missed delivery or pickup window and delayed customer replenishment.', false, 'Pratts'),
  ('walmart', 'Walmart', 3, 'Missed pickup or delivery window, customer out-of-stock risk, potential chargebacks and lost sales.', false, ''),
  ('loblaws', 'Loblaws', 3, 'Missed pickup or delivery window, potential chargebacks, customer out-of-stock risk and lost sales.', false, ''),
  ('other', 'Other / Unclassified', 3, 'Delivery delay, customer out-of-stock risk and lost sales.', false, '')
),
keys AS (
  SELECT best.*,
    CASE WHEN upper(trim(ship_to_name)) IN ('', 'NAN', 'NAT', 'NONE', '<NA>') THEN ''
         ELSE upper(trim(regexp_replace(ship_to_name, '\s+', ' ', 'g'))) END AS sk,
    CASE WHEN upper(trim(carrier_description)) IN ('', 'NAN', 'NAT', 'NONE', '<NA>') THEN ''
         ELSE upper(trim(regexp_replace(carrier_description, '\s+', ' ', 'g'))) END AS cark,
    CASE WHEN upper(trim(ys)) IN ('', 'NAN', 'NAT', 'NONE', '<NA>') THEN ''
         ELSE upper(trim(regexp_replace(ys, '\s+', ' ', 'g'))) END AS yk
  FROM best
),
grp AS (
  SELECT keys.*,
    CASE
      WHEN contains(sk, 'AMAZON') OR starts_with(sk, 'AMZ') OR contains(cark, 'AMAZON PICKUP') THEN 'amazon'
      WHEN contains(sk, 'A&W') THEN 'aw_via_gfs'
      WHEN contains(sk, 'GFS') OR contains(cark, 'GFS CAPSTONE PICKUP') THEN 'gfs'
      WHEN contains(sk, 'SYSCO') THEN 'sysco'
      WHEN contains(sk, 'CALGARY CO-OP') OR contains(sk, 'CALGARY CO OP') THEN 'calgary_coop'
      WHEN contains(sk, 'SAVE ON') OR contains(sk, 'SAVE-ON') OR contains(sk, 'SAVEON') THEN 'save_on'
      WHEN contains(sk, 'ASSOCIATED GROCERS') THEN 'associated_grocers'
      WHEN starts_with(sk, 'FCL') OR contains(sk, 'FEDERATED CO-OP') OR contains(sk, 'FEDERATED CO OP') THEN 'federated_coop'
      WHEN contains(sk, 'SOBEYS') OR contains(sk, 'CANADA SAFEWAY') OR contains(sk, 'FRESHCO') THEN 'sobeys_group'
      WHEN contains(sk, 'PRATT') THEN 'pratts'
      WHEN contains(sk, 'WALMART') OR starts_with(sk, 'WM ') OR contains(cark, 'WALMART PICKUP')
           OR contains(cark, 'WALMART PICK UP') THEN 'walmart'
      WHEN contains(sk, 'LOBLAW') OR contains(sk, 'LOBLAWS') OR contains(cark, 'LOBLAWS PICK UP')
           OR contains(cark, 'LOBLAW PICK UP') OR contains(cark, 'LOBLAWS PICKUP')
           OR contains(cark, 'LOBLAW PICKUP') THEN 'loblaws'
      ELSE 'other' END AS customer_group,
    CASE WHEN yk = '' THEN 'Unknown'
         WHEN yk = 'MISSISSAUGA WAREHOUSE' THEN 'Mississauga'
         WHEN yk = 'CALGARY WAREHOUSE' THEN 'Calgary'
         WHEN yk = 'SURREY WAREHOUSE' THEN 'Surrey'
         ELSE regexp_extract(ys, '^(\S+)', 1) END AS site,
    CASE WHEN sk = '' THEN NULL
         WHEN contains(sk, 'ITALIAN CENTRE') OR contains(sk, 'BRITISH FOOD CO')
              OR contains(sk, 'MANITOBA LIQUOR AND LOTTERIES') OR contains(sk, 'PRATT''S WHOLESALE')
              OR contains(sk, 'CONNECT LOGISTICS') THEN 'Priority 1'
         WHEN contains(sk, 'K & K FOODLINER') OR contains(sk, 'BEN''S MEATS')
              OR contains(sk, 'BRIDGELAND MARKET') OR contains(sk, 'CALABRIA MARKET')
              OR contains(sk, 'CANADA SAFEWAY') OR contains(sk, 'DELUCA BROS FOODS')
              OR contains(sk, 'EDELWEISS IMPORTS') THEN 'Priority 2' END AS dsd_priority
  FROM keys
),
cls AS (
  SELECT grp.*, r.customer_display, r.customer_priority, r.customer_consequence, r.deadline_flag,
         r.customer_report, 'Unassigned' AS customer_owner
  FROM grp JOIN rules r USING (customer_group)
),
d AS (
  SELECT cls.*,
    upper(goods_issue) = 'COMPLETED' AS gi_done,
    date_diff('day', DATE '__AS_OF__', CAST(planned_dlv_date AS DATE)) AS days_to_planned_delivery,
    date_diff('day', DATE '__AS_OF__', CAST(route_depart_date AS DATE)) AS days_to_route_departure,
    date_diff('day', DATE '__AS_OF__', CAST(customer_dock_appointment_date AS DATE)) AS ddock
  FROM cls
),
f AS (
  SELECT d.*,
    NOT gi_done AS is_open,
    picking_in_pct = 0 AND NOT gi_done AS is_not_started,
    picking_in_pct > 0 AND picking_in_pct < 100 AS is_picking_in_progress,
    picking_in_pct >= 100 AS is_picking_complete,
    coalesce(planned_dlv_date < TIMESTAMP '__AS_OF__', false) AND NOT gi_done AS is_late,
    coalesce(route_depart_date < TIMESTAMP '__AS_OF__', false) AND picking_in_pct < 100 AS is_route_departure_missed,
    deadline_flag AND coalesce(customer_dock_appointment_date < TIMESTAMP '__AS_OF__', false) AS dl_passed,
    deadline_flag AND coalesce(ddock BETWEEN 0 AND 2, false) AS dl_crit,
    deadline_flag AND coalesce(ddock BETWEEN 0 AND 5, false) AS dl_risk,
    least(days_to_planned_delivery, days_to_route_departure, ddock) AS earliest_due_days,
    CASE WHEN deadline_flag THEN ddock END AS days_to_customer_deadline
  FROM d
),
enriched AS (
  SELECT f.*,
    CASE WHEN gi_done THEN 'Resolved'
         WHEN is_late OR is_route_departure_missed OR dl_passed OR (dl_crit AND picking_in_pct < 100) THEN 'Critical'
         WHEN (coalesce(days_to_planned_delivery BETWEEN 0 AND 2, false) AND picking_in_pct = 0)
           OR (coalesce(days_to_route_departure BETWEEN 0 AND 2, false) AND picking_in_pct < 100)
           OR dl_risk
           OR (customer_priority = 1 AND coalesce(days_to_planned_delivery BETWEEN 0 AND 2, false) AND is_open)
           THEN 'At Risk'
         WHEN is_picking_complete THEN 'Ready / Awaiting GI'
         WHEN is_picking_in_progress THEN 'In Progress'
         ELSE 'Not Started' END AS risk_status,
    CASE WHEN gi_done THEN 'Resolved'
         WHEN dl_passed THEN 'Cancellation Deadline Passed'
         WHEN is_late THEN 'Late Delivery'
         WHEN is_route_departure_missed THEN 'Route Departure Missed'
         WHEN dl_crit OR dl_risk THEN 'Cancellation Deadline Approaching'
         WHEN is_not_started THEN 'Not Started'
         WHEN is_picking_in_progress THEN 'Picking Behind Schedule'
         WHEN is_picking_complete THEN 'Awaiting Goods Issue'
         ELSE 'Other' END AS issue_type,
    CASE WHEN is_late OR is_route_departure_missed OR dl_passed OR dl_crit THEN 'Critical'
         WHEN earliest_due_days <= 2 THEN 'High'
         WHEN earliest_due_days <= 5 THEN 'Medium'
         ELSE 'Low' END AS priority,
    least(planned_dlv_date, route_depart_date,
          CASE WHEN deadline_flag THEN customer_dock_appointment_date END) AS due_date
  FROM f
)
"""


def _date_sql(c: str) -> str:
    return (f"(CASE WHEN regexp_matches({c}, '^[0-9]{{8}}$') THEN try_strptime({c}, '%Y%m%d') "
            f"WHEN regexp_matches({c}, '^[0-9]{{4}}$') AND CAST({c} AS INT) BETWEEN 1678 AND 2261 "
            f"THEN make_timestamp(CAST({c} AS INT), 1, 1, 0, 0, 0) "
            f"WHEN regexp_matches({c}, '^[0-9]+(\\.[0-9]+)?$') THEN "
            f"(CASE WHEN CAST({c} AS DOUBLE) < 106752 THEN TIMESTAMP '1899-12-30' + "
            f"to_microseconds(CAST(round(CAST({c} AS DOUBLE) * 86400000000) AS BIGINT)) END) "
            f"ELSE try_strptime({c}, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M', "
            f"'%Y-%m-%d', '%m/%d/%Y %H:%M:%S', '%m/%d/%Y', '%d/%m/%Y', '%b %d, %Y', '%d-%b-%Y', "
            f"'%b %d, %Y %I:%M %p', '%m/%d/%y %H:%M', '%d.%m.%Y']) END)")


def base() -> str:
    s = BASE.replace("__NUM__", _NUM_RE).replace("__AS_OF__", AS_OF)
    for c in ("planned", "route", "dock", "wtc"):
        s = s.replace(f"__DATE_{c}__", _date_sql(c))
    return s


def _money(expr: str) -> str:
    return f"CAST(coalesce(sum(CAST({expr} AS DECIMAL(38,4))), 0) AS DOUBLE)"


def _money_if(cond: str) -> str:
    return _money(f"CASE WHEN {cond} THEN sales_order_total END")


C35 = """ys, facility_code, warehouse_task_creat, picking_in_pct, route_depart_date,
  planned_dlv_date, le_delivery, cust_reference, sto_po_number, carrier, carrier_description,
  shipment_type, shpg_cond_desc, ship_to_name, ship_to_city, ship_to_province, cases, line_items,
  goods_issue, pallet_quantity, num_lifts_pallets, packing_status, picking, picking_plan,
  cod_paid_flag, customer_dock_appointment_date, customer_dock_appointment_time,
  customer_dock_reference, gross_weight, sales_order, outb_del_ord, shipping_cond,
  sales_order_total, consignee, purchase_order"""

ESCALATED = "risk_status IN ('Critical', 'At Risk')"
LATE_WH = ("facility_code = 'Warehouse' AND coalesce(planned_dlv_date < TIMESTAMP '__AS_OF__', false) "
           "AND picking_in_pct < 100")
LATE_DSD = ("upper(facility_code) IN ('DSD', 'INDEPENDENT', 'INDEPENDANT') "
            "AND coalesce(planned_dlv_date < TIMESTAMP '__AS_OF__', false) "
            "AND upper(goods_issue) <> 'COMPLETED'")
AMZ_NOTE = ("CASE WHEN customer_dock_appointment_date IS NOT NULL THEN 'Cancellation deadline ' "
            "|| strftime(customer_dock_appointment_date, '%m/%d') ELSE '' END")
LATE_COLS = ("picking_in_pct, planned_dlv_date, le_delivery, ship_to_name, ship_to_city, "
             "ship_to_province, cases, line_items, sales_order_total")


def _fmt(x: str) -> str:
    return f"coalesce(strftime({x}, '%b %d, %Y'), 'N/A')"


def tracker_sql(where: str, first_status: bool = False) -> str:
    """Issue tracker over ``enriched`` rows matching ``where``."""
    other = ("first(risk_status ORDER BY ok, ln, k3, k4, k5)" if first_status else "NULL")
    cnt = "CAST(order_count AS VARCHAR) || ' ' || customer"
    return f"""
, w AS (SELECT * FROM enriched WHERE {where}),
g AS (
  SELECT site, customer_group, issue_type,
    min(customer_display) AS customer, min(customer_consequence) AS cons,
    min(customer_report) AS rep, count(*) AS order_count,
    count(*) FILTER (WHERE is_not_started) AS n_ns, count(*) FILTER (WHERE is_late) AS n_late,
    count(*) FILTER (WHERE is_picking_in_progress) AS n_ip,
    count(*) FILTER (WHERE picking_in_pct < 100) AS n_unpicked,
    min(planned_dlv_date) AS ep, min(customer_dock_appointment_date) AS nd,
    coalesce(min(picking_in_pct), 0.0) AS lp, min(due_date) AS due,
    bool_or(risk_status = 'Critical') AS has_crit, bool_or(risk_status = 'At Risk') AS has_risk,
    {other} AS first_status,
    {_money('sales_order_total')} AS total_price,
    CASE WHEN count(*) <= 5 THEN string_agg(le_delivery, ', ' ORDER BY le_delivery) END AS ids
  FROM w GROUP BY site, customer_group, issue_type
)
SELECT site, customer, issue_type,
  CASE issue_type
    WHEN 'Cancellation Deadline Passed' THEN {cnt} || ' order(s) are past the customer cancellation deadline (earliest ' || {_fmt('nd')} || ').'
    WHEN 'Late Delivery' THEN {cnt} || ' order(s) are past the planned delivery date (earliest ' || {_fmt('ep')} || ') with Goods Issue still open.'
    WHEN 'Route Departure Missed' THEN {cnt} || ' order(s) missed the route departure window and are not fully picked (lowest ' || printf('%.0f', lp) || '% picked).'
    WHEN 'Cancellation Deadline Approaching' THEN {cnt} || ' order(s) face a cancellation deadline on or before ' || {_fmt('nd')} || ' and ' || CAST(n_unpicked AS VARCHAR) || ' are not fully picked.'
    WHEN 'Not Started' THEN {cnt} || ' order(s) are still at 0% picked. Earliest planned delivery ' || {_fmt('ep')} || '.'
    WHEN 'Picking Behind Schedule' THEN {cnt} || ' order(s) are only partially picked (lowest ' || printf('%.0f', lp) || '%) with a deadline approaching. Earliest planned delivery ' || {_fmt('ep')} || '.'
    WHEN 'Awaiting Goods Issue' THEN {cnt} || ' order(s) are fully picked and awaiting Goods Issue. Earliest planned delivery ' || {_fmt('ep')} || '.'
    ELSE {cnt} || ' order(s) require attention: ' || CAST(n_ns AS VARCHAR) || ' not started, ' || CAST(n_late AS VARCHAR) || ' late, ' || CAST(n_ip AS VARCHAR) || ' in progress. Earliest planned delivery: ' || {_fmt('ep')} || '.'
  END || coalesce(' Affected LE Deliveries: ' || ids || '.', '') AS issue,
  CASE WHEN cons <> '' THEN cons ELSE 'Delivery delay, customer out-of-stock risk and lost sales.' END AS consequence,
  'Unassigned' AS owner,
  due AS due_date,
  CASE WHEN has_crit THEN 'Critical' WHEN has_risk THEN 'At Risk' ELSE first_status END AS status,
  total_price, order_count,
  'As of {NOW_STAMP}: ' || CAST(n_late AS VARCHAR) || ' orders are late, ' || CAST(n_ns AS VARCHAR)
    || ' are not started and the current value at risk is $' || format('{{:,.0f}}', total_price)
    || '. The nearest due date is ' || {_fmt('due')} || '.' AS latest_update,
  rep AS detail_report
FROM g
"""


#: Reports: name, workbook position, comments, which orders are in it.
LONG_PARTS = [
    ("SAPUI5 Export", 0, "CAST(NULL AS VARCHAR)", "true"),
    ("DSD Priorities", 1, "CAST(NULL AS VARCHAR)", "dsd_priority IS NOT NULL"),
    ("AMZ", 2, AMZ_NOTE, "customer_group IN ('amazon')"),
    ("Andrew Tab", 3, "CAST(NULL AS VARCHAR)", LATE_WH),
    ("Andrew Tab 2", 4, "CAST(NULL AS VARCHAR)", LATE_DSD),
    ("PFG WHSE", 5, "CAST(NULL AS VARCHAR)",
     "customer_group IN ('save_on', 'associated_grocers') AND upper(facility_code) IN ('WAREHOUSE')"),
    ("Calgary CO-OP", 6, "''", "customer_group IN ('calgary_coop')"),
    ("Sysco", 7, "CAST(NULL AS VARCHAR)", "customer_group IN ('sysco')"),
    ("GFS", 8, "CAST(NULL AS VARCHAR)", "customer_group IN ('gfs', 'aw_via_gfs')"),
    ("Pratts", 9, "CAST(NULL AS VARCHAR)", "customer_group IN ('pratts')"),
]


def long_sql() -> str:
    """Every (order, report) pair with the report's workbook position."""
    sel = [f"SELECT '{n}' AS report, {seq} AS report_seq, {note} AS comments, "
           f"dsd_priority AS priority, site, {C35} FROM enriched WHERE {cond}"
           for n, seq, note, cond in LONG_PARTS]
    return "\nUNION ALL\n".join(sel)


SUMMARY = f"""
SELECT CASE WHEN grouping(site) = 1 THEN 'All Plants' ELSE site END AS site,
       count(*) AS total_orders, {_money('sales_order_total')} AS total_price,
       count(*) FILTER (WHERE is_late) AS late_orders, {_money_if('is_late')} AS late_value,
       count(*) FILTER (WHERE is_late AND is_picking_complete) AS completed,
       {_money_if('is_late AND is_picking_complete')} AS completed_value,
       count(*) FILTER (WHERE is_late AND is_picking_in_progress) AS partial,
       {_money_if('is_late AND is_picking_in_progress')} AS partial_value,
       count(*) FILTER (WHERE is_late AND is_not_started) AS not_started,
       {_money_if('is_late AND is_not_started')} AS not_started_value
FROM enriched GROUP BY GROUPING SETS ((site), ())
"""


def _q(body: str) -> str:
    return base() + body.replace("__AS_OF__", AS_OF)


def export_base(number: int, as_of: str) -> str:
    """``base()`` for one of three exports, by itself; the last has fractions."""
    s = base().replace(AS_OF, as_of).replace("% 499 <> 0", f"% 499 <> 0 AND ok % 3 = {number}")
    if number == 2:
        s = s.replace("ELSE '25' END AS pct,", "ELSE '25' END AS pct0, CASE pct0 WHEN 'n/k' THEN pct0 WHEN '150' THEN '1' "
                      "ELSE CAST(CAST(pct0 AS DOUBLE) / 100 AS VARCHAR) END AS pct,")
    return s


def each_export(body: str) -> str:
    """``body`` over each export, run on its own, one below the other."""
    days = ["1998-01-13", "1998-01-15", "1998-01-18"]
    return "\nUNION ALL\n".join(
        f"SELECT 'export-{k}' AS export_id, * FROM (\n{export_base(k, day)}{body.replace('__AS_OF__', day)}\n)"
        for k, day in enumerate(days))


NOT_STARTED = """
SELECT priority, site, customer_display AS customer_group, facility_code, warehouse_task_creat,
  route_depart_date, planned_dlv_date, le_delivery, cust_reference, carrier_description,
  ship_to_name, ship_to_city, ship_to_province, cases, line_items, picking_in_pct,
  picking AS picking_status, goods_issue, sales_order, sales_order_total,
  days_to_route_departure, days_to_planned_delivery
FROM enriched WHERE is_not_started"""
ISSUE_RANK = """CASE issue_type WHEN 'Cancellation Deadline Passed' THEN 0 WHEN 'Late Delivery' THEN 1 WHEN 'Route Departure Missed' THEN 2
  WHEN 'Cancellation Deadline Approaching' THEN 3 WHEN 'Not Started' THEN 4 WHEN 'Picking Behind Schedule' THEN 5
  WHEN 'Awaiting Goods Issue' THEN 6 WHEN 'Resolved' THEN 7 ELSE 8 END"""


PRIORITY_RANK = """CASE priority WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 9 END"""


def sections_sql() -> str:
    """All sites' sections, each part as a query of its own, then numbered."""
    late, dsd = ("Andrew Tab", "Andrew Tab 2"), "DSD Priorities"
    shown = ("le_delivery, ship_to_name, facility_code, goods_issue, picking_in_pct, planned_dlv_date, sales_order_total")
    no_tracker = ("NULL AS customer, NULL AS issue_type, NULL AS issue, NULL AS status, NULL AS total_price, "
                  "NULL AS order_count, NULL AS due_date")
    row = "ok, ln, k3, k4, k5"
    parts = [f"""SELECT site, 0 AS part, 'Issue Tracker' AS report, customer, issue_type, issue, status, total_price,
  order_count, due_date, NULL AS priority, NULL AS customer_group, NULL AS picking_status,
  NULL AS days_to_planned_delivery, NULL AS comments,
  NULL AS le_delivery, NULL AS ship_to_name, NULL AS facility_code, NULL AS goods_issue, NULL AS picking_in_pct,
  NULL AS planned_dlv_date, NULL AS sales_order_total,
  (status <> 'Critical')::INT AS o1, {ISSUE_RANK} AS o2, NULL::TIMESTAMP AS o3, -total_price AS o4, NULL::DOUBLE AS o5,
  NULL AS ok, NULL AS ln, NULL AS k3, NULL AS k4, NULL AS k5 FROM tr""",
             f"""SELECT site, 1, 'Not Started', {no_tracker}, priority, customer_display, picking, days_to_planned_delivery,
  NULL, {shown}, {PRIORITY_RANK}, (planned_dlv_date IS NULL)::INT, planned_dlv_date, -sales_order_total, NULL, {row}
  FROM enriched WHERE is_not_started"""]
    for name, seq, note, cond in LONG_PARTS:
        report, part = ("Orders", 2) if seq == 0 else (name, seq + 3)
        cells, o = shown, "NULL, NULL, NULL, NULL, NULL"
        if name in late:
            cells = cells.replace("facility_code, goods_issue", "NULL, NULL")
            o = "NULL, NULL, planned_dlv_date, picking_in_pct, -sales_order_total"
        if name == dsd:
            o = ("CASE WHEN dsd_priority = 'Priority 1' THEN 1 ELSE 2 END, (planned_dlv_date IS NULL)::INT, "
                 "planned_dlv_date, NULL, NULL")
        parts.append(f"SELECT site, {part}, '{report}', {no_tracker}, {'dsd_priority' if name == dsd else 'NULL'}, NULL, NULL, "
                     f"NULL, {note}, {cells}, {o}, {row} FROM enriched WHERE {cond}")
    return f"""
, tr AS ({base()}{tracker_sql(ESCALATED)}),
sites AS (
  SELECT site, row_number() OVER (ORDER BY CASE lower(site) WHEN 'mississauga' THEN 0 WHEN 'calgary' THEN 1
         WHEN 'surrey' THEN 2 ELSE 3 END, lower(site), site) AS site_seq
  FROM (SELECT DISTINCT site FROM enriched WHERE trim(site) <> '')),
parts AS ({" UNION ALL ".join(parts)})
SELECT * EXCLUDE (o1, o2, o3, o4, o5, ok, ln, k3, k4, k5),
  row_number() OVER (ORDER BY site_seq, part, o1, o2, o3, o4, o5, customer, issue_type, ok, ln, k3, k4, k5) AS rank
FROM parts JOIN sites USING (site)"""


def oracle_queries() -> dict[str, str]:
    m = _money("sales_order_total")
    errors = (f"SELECT 'Missing LE Delivery — excluded from order calculations' AS validation_issue, {C35} FROM typed WHERE le_delivery = ''\n"
              f"UNION ALL SELECT 'Blank Ship-to Name — classified as Other', {C35} FROM typed WHERE le_delivery <> '' AND ship_to_name = ''\n"
              f"UNION ALL SELECT 'Sales Order Total was not numeric — treated as $0', {C35} FROM typed WHERE le_delivery <> '' AND bad_total")
    # The sheet plan as published: a tracker, a not-started list and the orders of
    # every site, also when empty; reports of a site only with rows; totals on the
    # orders and on customer reports only; colours by status, priority or detail.
    customer_reports = "('AMZ', 'PFG WHSE', 'Calgary CO-OP', 'Sysco', 'GFS', 'Pratts')"
    catalog = f"""
, tg AS (SELECT site, customer_group, issue_type FROM enriched WHERE {ESCALATED} GROUP BY ALL),
L AS ({long_sql()}),
sites AS (
  SELECT site, row_number() OVER (ORDER BY CASE lower(site) WHEN 'mississauga' THEN 0 WHEN 'calgary' THEN 1
         WHEN 'surrey' THEN 2 ELSE 3 END, lower(site), site) AS site_seq
  FROM (SELECT DISTINCT site FROM enriched WHERE trim(site) <> '')),
parts AS (
  SELECT site, 'Issue Tracker' AS report, 0 AS part, (SELECT count(*) FROM tg WHERE tg.site = s.site) AS rows,
         CAST(NULL AS DOUBLE) AS total, 'status' AS shading FROM sites s
  UNION ALL SELECT site, 'Not Started', 1, (SELECT count(*) FROM enriched e WHERE e.site = s.site AND is_not_started),
         NULL, 'priority' FROM sites s
  UNION ALL SELECT site, 'Orders', 2, count(*), {m}, 'detail' FROM enriched GROUP BY site
  UNION ALL SELECT site, report, report_seq + 3, count(*), CASE WHEN report IN {customer_reports} THEN {m} END,
         CASE WHEN report IN {customer_reports} THEN 'detail' END
  FROM L WHERE report <> 'SAPUI5 Export' GROUP BY site, report, report_seq
),
plan AS (
  SELECT 0 AS seq, 'All Plants Summary' AS sheet, CAST(NULL AS VARCHAR) AS site, 'All Plants Summary' AS report,
         (SELECT count(DISTINCT site) + 1 FROM enriched) AS rows, CAST(NULL AS DOUBLE) AS total, CAST(NULL AS VARCHAR) AS shading
  UNION ALL SELECT 1, 'All Plants Issue Tracker', NULL, 'All Plants Issue Tracker', (SELECT count(*) FROM tg), NULL, 'status'
  UNION ALL SELECT 2, 'All Plants Not Started', NULL, 'All Plants Not Started',
         (SELECT count(*) FROM enriched WHERE is_not_started), NULL, 'priority'
  UNION ALL SELECT 1000000000000000 + site_seq * 1000 + part, site || CASE WHEN part < 3 THEN ' ' ELSE ' - ' END || report,
         site, report, rows, total, shading FROM parts JOIN sites USING (site)
  UNION ALL SELECT 2000000000000000, 'SAPUI5 Export', NULL, 'SAPUI5 Export', (SELECT count(*) FROM enriched), NULL, NULL
  UNION ALL SELECT 3000000000000000, 'Validation Warnings', NULL, 'Validation Warnings', n, NULL, NULL
    FROM (SELECT ((SELECT count(*) FROM typed WHERE le_delivery = '')
                 + (SELECT count(*) FROM typed WHERE le_delivery <> '' AND ship_to_name = '')
                 + (SELECT count(*) FROM typed WHERE le_delivery <> '' AND bad_total)) AS n) WHERE n > 0
)
SELECT CAST(seq AS BIGINT) AS seq, sheet, site, report, rows, total, shading,
       CASE WHEN report = 'AMZ' THEN 'HIGHLIGHTED ORDERS ARE CURRENTLY LATE AND MAY BE SUBJECT TO THE CONFIGURED ON-TIME DELIVERY CHARGEBACK' END AS note
FROM plan
"""
    return {
        "typed_export": _q(f"SELECT {C35}, bad_total, ok AS k1, ln AS k2, k3, k4, k5 FROM typed"),
        "messy_header_export": _q(f"SELECT {C35}, bad_total, ok AS k1, ln AS k2, k3, k4, k5 FROM typed"),
        "scan_export": _q(f"SELECT {C35}, bad_total FROM typed"),
        "clean_orders": _q(f"SELECT {C35} FROM best"),
        "validation_errors": _q(errors),
        "run_summary": _q("""
SELECT 'row_count' AS metric, count(*) AS value FROM enriched
UNION ALL SELECT 'sites', count(DISTINCT site) FROM enriched
UNION ALL SELECT 'only_unknown_site', CAST(count(*) > 0 AND count(*) FILTER (WHERE site <> 'Unknown') = 0 AS BIGINT) FROM enriched
UNION ALL SELECT 'duplicates_removed', count(*) - count(DISTINCT le_delivery) FROM typed WHERE le_delivery <> ''
UNION ALL SELECT 'validation_records', (SELECT count(*) FROM typed WHERE le_delivery = '')
  + (SELECT count(*) FROM typed WHERE le_delivery <> '' AND ship_to_name = '')
  + (SELECT count(*) FROM typed WHERE le_delivery <> '' AND bad_total)"""),
        "enriched_orders": _q(f"""
SELECT le_delivery, site, customer_group, customer_display, customer_priority, picking_in_pct,
  sales_order_total, planned_dlv_date, route_depart_date, customer_dock_appointment_date, is_open,
  is_not_started, is_late, is_route_departure_missed, days_to_planned_delivery,
  days_to_route_departure, days_to_customer_deadline, earliest_due_days, risk_status, issue_type,
  priority, CASE priority WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2
  WHEN 'Low' THEN 3 ELSE 9 END AS priority_rank, due_date, customer_report,
  {ISSUE_RANK} AS issue_type_rank
FROM enriched"""),
        # every account rule against every pair of keys; the default rules come after them
        "classified_by_rule_table": _q("""
, account AS (SELECT k, 'account_' || lpad(k::VARCHAR, 5, '0') AS key, k % 4 AS kind,
    CASE k % 4 WHEN 0 THEN '#' || lpad(k::VARCHAR, 9, '0') WHEN 1 THEN 'WMX CUSTOMER#' || lpad(k::VARCHAR, 9, '0')
               WHEN 2 THEN lpad((k * 7 % 10000)::VARCHAR, 4, '0') ELSE 'CARRIER ' || k END AS text
  FROM range(10000) t(k)),
pairs AS (SELECT DISTINCT sk, cark FROM enriched),
hit AS (SELECT sk, cark, min(k) AS k FROM pairs JOIN account ON
    CASE kind WHEN 1 THEN starts_with(sk, text) WHEN 3 THEN contains(cark, text) ELSE contains(sk, text) END
  GROUP BY ALL)
SELECT le_delivery, coalesce(account.key, customer_group) AS customer_group,
  coalesce(account.key, customer_display) AS customer_display, coalesce(k % 3 + 1, customer_priority) AS customer_priority,
  CASE WHEN k IS NULL THEN customer_report ELSE '' END AS customer_report, site
FROM enriched LEFT JOIN hit USING (sk, cark) LEFT JOIN account USING (k)"""),
        "ordered_sites": _q("""
SELECT site, CAST(row_number() OVER (ORDER BY CASE lower(site) WHEN 'mississauga' THEN 0
  WHEN 'calgary' THEN 1 WHEN 'surrey' THEN 2 ELSE 3 END, lower(site), site) AS BIGINT) AS site_seq
FROM (SELECT DISTINCT site FROM enriched WHERE trim(site) <> '')"""),
        "all_plants_summary": _q(SUMMARY),
        "many_exports_summary": each_export(SUMMARY),
        "many_exports_tracker": each_export(tracker_sql(ESCALATED)),
        "processed_and_filtered": _q(tracker_sql(
            f"{ESCALATED} AND site IN ('EUROPE') AND customer_display IN ('Amazon', 'Walmart')")),
        "issue_tracker": _q(tracker_sql(ESCALATED)),
        "tracker_all_open": _q(tracker_sql("is_open", first_status=True)),
        "not_started": _q(NOT_STARTED),
        "not_started_ranked": _q(NOT_STARTED.replace("FROM enriched", """,
  row_number() OVER (ORDER BY CASE priority WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3
    ELSE 9 END, planned_dlv_date IS NULL, planned_dlv_date, -sales_order_total, ok, ln, k3, k4, k5) AS rank
FROM enriched""")),
        "tracker_ranked": f"""SELECT *, row_number() OVER (
  ORDER BY status <> 'Critical', {ISSUE_RANK}, -total_price, site, customer, issue_type) AS rank
FROM ({_q(tracker_sql(ESCALATED))})""",
        "full_export": _q(f"SELECT {C35} FROM enriched"),
        "report_amz": _q(f"SELECT {AMZ_NOTE} AS comments, {C35} FROM enriched WHERE customer_group IN ('amazon')"),
        "report_pfg_whse": _q(f"SELECT {C35} FROM enriched WHERE customer_group IN ('save_on', 'associated_grocers') AND upper(facility_code) IN ('WAREHOUSE')"),
        "report_calgary_coop": _q(f"SELECT '' AS comments, {C35} FROM enriched WHERE customer_group IN ('calgary_coop')"),
        "report_pratts": _q(f"SELECT {C35} FROM enriched WHERE customer_group IN ('pratts')"),
        "report_gfs": _q(f"SELECT {C35} FROM enriched WHERE customer_group IN ('gfs', 'aw_via_gfs')"),
        "late_warehouse": _q(f"SELECT {LATE_COLS} FROM enriched WHERE {LATE_WH}"),
        "late_lists": _q(f"SELECT 'Andrew Tab' AS report, site, {LATE_COLS} FROM enriched WHERE {LATE_WH}\n"
                         f"UNION ALL SELECT 'Andrew Tab 2', site, {LATE_COLS} FROM enriched WHERE {LATE_DSD}"),
        "late_dsd_independent": _q(f"SELECT {LATE_COLS} FROM enriched WHERE {LATE_DSD}"),
        "dsd_priorities": _q(f"SELECT dsd_priority AS priority, {C35} FROM enriched WHERE dsd_priority IS NOT NULL"),
        "detail_reports_long": _q(f"SELECT report, comments, priority, site, {C35} FROM ({long_sql()})"),
        # all plants lists every report, also without rows; never the full export
        "report_totals": _q(f"""
, L AS (SELECT * FROM ({long_sql()}) WHERE report <> 'SAPUI5 Export'),
names(report, report_seq) AS (VALUES ('DSD Priorities', 1), ('AMZ', 2), ('Andrew Tab', 3), ('Andrew Tab 2', 4),
  ('PFG WHSE', 5), ('Calgary CO-OP', 6), ('Sysco', 7), ('GFS', 8), ('Pratts', 9))
SELECT 'All Plants' AS scope, n.report, n.report_seq, count(L.report) AS rows, {m} AS total
FROM names n LEFT JOIN L ON L.report = n.report GROUP BY n.report, n.report_seq
UNION ALL SELECT site, report, report_seq, count(*), {m} FROM L GROUP BY site, report, report_seq"""),
        "site_sections": _q(sections_sql()),
        "report_catalog": _q(catalog),
        "filter_options": _q("""
SELECT DISTINCT facet, value FROM (
  SELECT 'site' AS facet, trim(site) AS value FROM enriched
  UNION ALL SELECT 'customer', trim(customer_display) FROM enriched
  UNION ALL SELECT 'status', risk_status FROM enriched
  UNION ALL SELECT 'priority', priority FROM enriched
  UNION ALL SELECT 'facility', trim(facility_code) FROM enriched
  UNION ALL SELECT 'province', trim(ship_to_province) FROM enriched)
WHERE value IS NOT NULL AND value <> ''"""),
        "facet_filter": _q("""
SELECT le_delivery, site, customer_display, risk_status, priority, sales_order_total FROM enriched
WHERE site IN ('AMERICA', 'ASIA') AND priority IN ('Critical', 'High')"""),
        "exec_kpis": _q(f"""
SELECT count(*) FILTER (WHERE risk_status = 'Critical') AS critical_issues,
  count(*) FILTER (WHERE risk_status = 'At Risk') AS at_risk_issues,
  count(*) FILTER (WHERE {ESCALATED}) AS orders_requiring_attention,
  count(*) FILTER (WHERE is_not_started) AS not_started_orders,
  {_money_if(ESCALATED)} AS price_at_risk, {_money_if('is_not_started')} AS price_not_started
FROM enriched"""),
        "risk_value_by_customer": _q(f"SELECT customer_display, {m} AS price_at_risk FROM enriched WHERE {ESCALATED} GROUP BY customer_display"),
        "not_started_by_customer": _q("SELECT customer_display, count(DISTINCT le_delivery) AS not_started_orders FROM enriched WHERE is_not_started GROUP BY customer_display"),
        "status_distribution": _q(f"SELECT risk_status AS status, count(*) AS orders FROM enriched WHERE {ESCALATED} GROUP BY risk_status"),
        "risk_value_by_planned_day": _q(f"SELECT CAST(planned_dlv_date AS DATE) AS planned_day, {m} AS price_at_risk FROM enriched WHERE {ESCALATED} AND planned_dlv_date IS NOT NULL GROUP BY 1"),
        "tracker_drilldown": _q(f"""
SELECT site, customer_display AS customer, issue_type, le_delivery, ship_to_name, facility_code,
  picking_in_pct, risk_status, priority, planned_dlv_date, route_depart_date, sales_order_total
FROM enriched WHERE {ESCALATED}"""),
        "not_started_kpis": _q(f"""
SELECT count(*) AS not_started_orders, {m} AS price_not_started,
  count(*) FILTER (WHERE days_to_planned_delivery < 0) AS overdue_not_started,
  count(*) FILTER (WHERE days_to_planned_delivery BETWEEN 0 AND 2) AS due_within_2_days
FROM enriched WHERE is_not_started"""),
        "facet_cube": _q(f"""
SELECT site, customer_display, risk_status, priority, facility_code, ship_to_province,
  CAST(planned_dlv_date AS DATE) AS planned_day, issue_type, count(*) AS orders, {m} AS value,
  count(*) FILTER (WHERE is_not_started) AS not_started_orders, {_money_if('is_not_started')} AS not_started_value,
  count(*) FILTER (WHERE is_not_started AND days_to_planned_delivery < 0) AS overdue_not_started,
  count(*) FILTER (WHERE is_not_started AND days_to_planned_delivery BETWEEN 0 AND 2) AS due_within_2_days
FROM enriched GROUP BY ALL"""),
        "filtered_kpis": _q(f"""
SELECT count(*) FILTER (WHERE risk_status = 'Critical') AS critical_issues,
  count(*) FILTER (WHERE risk_status = 'At Risk') AS at_risk_issues,
  count(*) FILTER (WHERE {ESCALATED}) AS orders_requiring_attention,
  count(*) FILTER (WHERE is_not_started) AS not_started_orders,
  {_money_if(ESCALATED)} AS price_at_risk, {_money_if('is_not_started')} AS price_not_started,
  count(*) FILTER (WHERE is_not_started AND days_to_planned_delivery < 0) AS overdue_not_started,
  count(*) FILTER (WHERE is_not_started AND days_to_planned_delivery BETWEEN 0 AND 2) AS due_within_2_days
FROM enriched WHERE site IN ('AMERICA', 'ASIA') AND priority IN ('Critical', 'High')"""),
        "tracker_row_orders": f"""WITH t AS (
  SELECT site, customer, issue_type FROM ({_q(tracker_sql(ESCALATED))})
  ORDER BY status <> 'Critical', {ISSUE_RANK}, -total_price, site, customer, issue_type LIMIT 1)
SELECT d.* EXCLUDE (customer) FROM ({_q(f"""
SELECT site, customer_display AS customer, issue_type, le_delivery, ship_to_name, facility_code,
  picking_in_pct, risk_status, priority, planned_dlv_date, route_depart_date, sales_order_total
FROM enriched WHERE {ESCALATED}""")}) d SEMI JOIN t USING (site, customer, issue_type)""",
        "filtered_tracker": _q(tracker_sql(f"{ESCALATED} AND site IN ('EUROPE') AND customer_display IN ('Amazon', 'Walmart')")),
        "row_severity": _q("""
SELECT le_delivery, site,
  CASE WHEN (coalesce(planned_dlv_date < TIMESTAMP '__AS_OF__', false) AND upper(goods_issue) <> 'COMPLETED')
         OR (coalesce(route_depart_date < TIMESTAMP '__AS_OF__', false) AND picking_in_pct < 100) THEN 'red'
       WHEN picking_in_pct = 0 AND upper(goods_issue) <> 'COMPLETED' THEN 'yellow' END AS severity,
  CASE risk_status WHEN 'Critical' THEN 'red' WHEN 'At Risk' THEN 'orange'
       WHEN 'Not Started' THEN 'yellow' WHEN 'Ready / Awaiting GI' THEN 'green' END AS status_severity,
  CASE priority WHEN 'Critical' THEN 'red' WHEN 'High' THEN 'orange'
       WHEN 'Medium' THEN 'yellow' END AS priority_severity
FROM enriched"""),
        "report_with_total": _q(f"""
SELECT le_delivery, ship_to_name, sales_order_total, false AS is_total
FROM enriched WHERE customer_group IN ('gfs', 'aw_via_gfs')
UNION ALL
SELECT 'TOTAL', NULL, {_money_if("customer_group IN ('gfs', 'aw_via_gfs')")}, true FROM enriched"""),
    }
