"""Sentence templates rendered from aggregate columns with ``concat`` (no UDF).

A template is plain text with ``{slot}`` placeholders; ``render`` turns it into
a ``concat`` of literals and the slot columns.
"""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Tracker issue sentences per issue type, the general fallback,
# the affected-delivery suffix and the latest-update sentence.
# ---------------------------------------------------------------------------
ISSUE_TEMPLATES = {
    "Cancellation Deadline Passed":
        "{count} {customer} order(s) are past the customer cancellation deadline "
        "(earliest {nearest_deadline}).",
    "Late Delivery":
        "{count} {customer} order(s) are past the planned delivery date "
        "(earliest {earliest_planned}) with Goods Issue still open.",
    "Route Departure Missed":
        "{count} {customer} order(s) missed the route departure window and are not "
        "fully picked (lowest {lowest_picked}% picked).",
    "Cancellation Deadline Approaching":
        "{count} {customer} order(s) face a cancellation deadline on or before "
        "{nearest_deadline} and {unpicked} are not fully picked.",
    "Not Started":
        "{count} {customer} order(s) are still at 0% picked. "
        "Earliest planned delivery {earliest_planned}.",
    "Picking Behind Schedule":
        "{count} {customer} order(s) are only partially picked (lowest {lowest_picked}%) "
        "with a deadline approaching. Earliest planned delivery {earliest_planned}.",
    "Awaiting Goods Issue":
        "{count} {customer} order(s) are fully picked and awaiting Goods Issue. "
        "Earliest planned delivery {earliest_planned}.",
}
GENERAL_TEMPLATE = (
    "{count} {customer} order(s) require attention: {not_started} not started, {late} late, "
    "{in_progress} in progress. Earliest planned delivery: {earliest_planned}.")
AFFECTED_TEMPLATE = " Affected LE Deliveries: {ids}."
AFFECTED_LIMIT = 5
LATEST_UPDATE_TEMPLATE = (
    "As of {stamp}: {late} orders are late, {not_started} are not started and the current "
    "value at risk is ${value}. The nearest due date is {nearest_due}.")

_SLOT = re.compile(r"\{(\w+)\}")


def render(template: str, slots: dict[str, Column]) -> Column:
    parts: list[Column] = []
    pos = 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(slots[m.group(1)].cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)
