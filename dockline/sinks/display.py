"""Output headers: internal snake_case names -> the published column headers.

Renaming happens only at the sink edge (names with dots or spaces need
backticks everywhere else).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.headers import DISPLAY_OF

# Display headers of the derived outputs.
TRACKER_HEADERS = {
    "site": "Site", "customer": "Customer", "issue_type": "Issue Type", "issue": "Issue",
    "consequence": "Consequence / Risk", "owner": "Owner", "due_date": "Due Date",
    "status": "Status", "total_price": "Total Price", "order_count": "Order Count",
    "latest_update": "Latest Update", "detail_report": "Detail Report",
}
SUMMARY_HEADERS = {
    "site": "Site", "total_orders": "Total Orders", "total_price": "Total Price $",
    "late_orders": "Late Orders", "late_value": "Late Value", "completed": "Completed",
    "completed_value": "Completed $", "partial": "Partial", "partial_value": "Partial $",
    "not_started": "Not Started", "not_started_value": "Not Started $",
}
NOT_STARTED_HEADERS = {
    **DISPLAY_OF,
    "priority": "Priority", "site": "Site", "customer_group": "Customer Group",
    "picking_status": "Picking Status", "days_to_route_departure": "Days to Route Departure",
    "days_to_planned_delivery": "Days to Planned Delivery",
}
REPORT_HEADERS = {**DISPLAY_OF, "comments": "Comments", "priority": "Priority",
                  "validation_issue": "Validation Issue"}


def with_display_names(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename the columns present in ``mapping``; keep the others."""
    return df.select(*[F.col(c).alias(mapping.get(c, c)) for c in df.columns])
