"""Property checks: Spark expressions against plain-Python statements of the
same rules, over generated text (one Spark job per property)."""
import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dockline.functions.text import clean_identifier, match_key, to_number, ustrip

CELLS = st.one_of(
    st.none(),
    st.text(alphabet=" \t 　0123456789.+-eE,$xAbnN", max_size=12),
    st.from_regex(r"\s?[+-]?\d{0,25}\.0{1,3}\s?", fullmatch=True),
    st.from_regex(r"[A-Za-z& ]{0,20}", fullmatch=True),
)


def py_number(v):
    # ASCII digits and blanks only (the number rule, like a C-level parser)
    if v is None or not re.fullmatch(r"[ \t\n\r\f\v]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)"
                                     r"([eE][+-]?[0-9]+)?[ \t\n\r\f\v]*", v):
        return None
    x = float(v)
    return None if math.isinf(x) else x


def py_identifier(v):
    if v is None:
        return ""
    s = v.strip()
    if s.lower() in {"", "nan", "none", "nat"}:
        return ""
    if re.fullmatch(r"[+-]?[0-9]*\.0+", s):
        sign = "-" if s.startswith("-") else ""
        digits = s.lstrip("+-").split(".")[0].lstrip("0") or "0"
        if len(digits) > 38:
            return s
        return "0" if digits == "0" else sign + digits
    return s


def py_key(v):
    if v is None:
        return ""
    s = " ".join(v.split()).upper()
    return "" if v.strip().upper() in {"", "NAN", "NAT", "NONE", "<NA>"} else s


def _run(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", expr(F.col("v"))).orderBy("i").collect()]


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(CELLS, min_size=50, max_size=200))
def test_cleaning_matches_python_rules(spark, values):
    assert _run(spark, values, to_number) == [py_number(v) for v in values]
    assert _run(spark, values, clean_identifier) == [py_identifier(v) for v in values]
    assert _run(spark, values, match_key) == [py_key(v) for v in values]
    assert _run(spark, values, ustrip) == [None if v is None else v.strip() for v in values]
