"""D1-D13 + E2: order-level flags, day counts, status, issue type, priority.

One ``select`` of null-safe Catalyst expressions relative to an as-of date
(midnight).  Every comparison on a nullable date is wrapped in
``coalesce(..., false)`` so a missing date reads as "not true", never null.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (AT_RISK, CRITICAL, IN_PROGRESS, ISSUE_TYPES, NOT_STARTED, PRIORITIES,
                      READY, RESOLVED, Rules)
from ..functions.dates import as_of_midnight, days_between
from .classify import lookup


def _t(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def within(days: Column, n: int) -> Column:
    """0 <= days <= n; null -> false."""
    return _t(days.between(0, n))


def issue_type_rank(c: Column) -> Column:
    return lookup(c, {v: i for i, v in enumerate(ISSUE_TYPES)}, 9)


def priority_rank(c: Column) -> Column:
    return lookup(c, {v: i for i, v in enumerate(PRIORITIES)}, 9)


def due_date(planned: Column, route: Column, dock: Column, deadline_flag: Column) -> Column:
    """Earliest of planned, route and (for deadline customers only) dock."""
    return F.least(planned, route, F.when(deadline_flag, dock))


def enrich(df: DataFrame, as_of: dt.date | Column, rules: Rules) -> DataFrame:
    """D1-D13; ``as_of``: one day, or a column with the day of each row's export."""
    midnight = as_of_midnight(as_of)
    days = rules.windows
    at_risk_days = days["at_risk_days"]
    crit_days, risk_days = days["amazon_cancel_critical_days"], days["amazon_cancel_at_risk_days"]
    high_days, medium_days = days["not_started_high_days"], days["not_started_medium_days"]

    pick = F.col("picking_in_pct")
    planned, route = F.col("planned_dlv_date"), F.col("route_depart_date")
    dock = F.col("customer_dock_appointment_date")
    flag = F.col("deadline_flag")

    step1 = df.withColumns({
        "picking_pct": pick,
        "is_goods_issue_complete": F.upper(F.col("goods_issue")) == "COMPLETED",
    }).withColumns({
        "is_open": ~F.col("is_goods_issue_complete"),
        "is_not_started": (pick == 0) & ~F.col("is_goods_issue_complete"),
        "is_picking_in_progress": (pick > 0) & (pick < 100),
        "is_picking_complete": pick >= 100,
        "days_to_planned_delivery": days_between(planned, as_of),
        "days_to_route_departure": days_between(route, as_of),
        "days_to_dock": days_between(dock, as_of),
    })
    d_plan, d_route, d_dock = (F.col("days_to_planned_delivery"),
                               F.col("days_to_route_departure"), F.col("days_to_dock"))
    step2 = step1.withColumns({
        "is_late": _t(planned < midnight) & F.col("is_open"),
        "is_route_departure_missed": _t(route < midnight) & (pick < 100),
        "days_to_customer_deadline": F.when(flag, d_dock),
        "deadline_passed": flag & _t(dock < midnight),
        "deadline_within_critical": flag & within(d_dock, crit_days),
        "deadline_within_at_risk": flag & within(d_dock, risk_days),
        "earliest_due_days": F.least(d_plan, d_route, d_dock),
    })
    late, missed = F.col("is_late"), F.col("is_route_departure_missed")
    passed = F.col("deadline_passed")
    w_crit, w_risk = F.col("deadline_within_critical"), F.col("deadline_within_at_risk")
    critical = late | missed | passed | (w_crit & (pick < 100))
    at_risk = ((within(d_plan, at_risk_days) & (pick == 0))
               | (within(d_route, at_risk_days) & (pick < 100))
               | w_risk
               | ((F.col("customer_priority") == 1) & within(d_plan, at_risk_days)
                  & F.col("is_open")))
    gi_done = F.col("is_goods_issue_complete")
    status = (F.when(gi_done, RESOLVED).when(critical, CRITICAL).when(at_risk, AT_RISK)
              .when(F.col("is_picking_complete"), READY)
              .when(F.col("is_picking_in_progress"), IN_PROGRESS)
              .otherwise(NOT_STARTED))
    it = ISSUE_TYPES
    issue = (F.when(gi_done, it[7]).when(passed, it[0]).when(late, it[1]).when(missed, it[2])
             .when(w_crit | w_risk, it[3]).when(F.col("is_not_started"), it[4])
             .when(F.col("is_picking_in_progress"), it[5])
             .when(F.col("is_picking_complete"), it[6])
             .otherwise(it[8]))
    e = F.col("earliest_due_days")
    priority = (F.when(late | missed | passed | w_crit, PRIORITIES[0])
                .when(_t(e <= high_days), PRIORITIES[1])
                .when(_t(e <= medium_days), PRIORITIES[2])
                .otherwise(PRIORITIES[3]))
    step3 = step2.withColumns({
        "risk_status": status,
        "issue_type": issue,
        "priority": priority,
        "due_date": due_date(planned, route, dock, flag),
    })
    return step3.withColumns({
        "priority_rank": priority_rank(F.col("priority")),
        "issue_type_rank": issue_type_rank(F.col("issue_type")),
    })
