"""dockline: order-fulfilment risk analytics on Spark DataFrames.

Entry point: :func:`dockline.process_export` (raw export -> lazy reports).
"""
from .config import Rules, load_rules  # noqa: F401
from .plans.pipeline import ProcessResult, process_export  # noqa: F401
