from helpers import day, order, processed, records


def outcome(spark, **cells):
    return records(processed(spark, [order(1, **cells)]).orders)[0]


CASES = [
    (dict(), ("Not Started", "Not Started", "Low")),
    (dict(planned_dlv_date=day(4)), ("Not Started", "Not Started", "Medium")),
    (dict(planned_dlv_date=day(0)), ("At Risk", "Not Started", "High")),
    (dict(planned_dlv_date=day(-1)), ("Critical", "Late Delivery", "Critical")),
    (dict(planned_dlv_date=day(-1), goods_issue=" COMPLETED"), ("Resolved", "Resolved", None)),
    (dict(route_depart_date=day(-1), picking_in_pct="99"), ("Critical", "Route Departure Missed", "Critical")),
    (dict(route_depart_date=day(-1), picking_in_pct="100"), ("Ready / Awaiting GI", "Awaiting Goods Issue", None)),
    (dict(planned_dlv_date=day(2), picking_in_pct="1"), ("In Progress", "Picking Behind Schedule", None)),
    (dict(ship_to_name="amz 1", customer_dock_appointment_date=day(-1)),
     ("Critical", "Cancellation Deadline Passed", "Critical")),
    (dict(ship_to_name="amz 1", customer_dock_appointment_date=day(2), picking_in_pct="50"),
     ("Critical", "Cancellation Deadline Approaching", "Critical")),
    (dict(ship_to_name="amz 1", customer_dock_appointment_date=day(5)),
     ("At Risk", "Cancellation Deadline Approaching", None)),
    (dict(ship_to_name="sysco", customer_dock_appointment_date=day(-1)), ("Not Started", "Not Started", "High")),
]


def test_status_issue_and_priority(spark):
    rows = records(processed(spark, [order(i, **c) for i, (c, _) in enumerate(CASES)]).orders)
    for (cells, (status, issue, priority)), r in zip(CASES, rows):
        assert (r["risk_status"], r["issue_type"]) == (status, issue), cells
        assert priority in (None, r["priority"]), (cells, r["priority"])


def test_days_and_due_dates(spark):
    r = outcome(spark, planned_dlv_date=day(-3, "23:59:59"), route_depart_date=day(1, "00:00:01"))
    assert (r["days_to_planned_delivery"], r["days_to_route_departure"]) == (-3, 1) and r["is_late"]
    assert r["days_to_customer_deadline"] is None and r["due_date"] == r["planned_dlv_date"]
    same_day = outcome(spark, planned_dlv_date=day(0, "00:00:01"))
    assert not same_day["is_late"] and same_day["days_to_planned_delivery"] == 0
    missed = outcome(spark, route_depart_date=day(-1), picking_in_pct="5", goods_issue="Completed")
    assert missed["is_route_departure_missed"] and missed["risk_status"] == "Resolved"
