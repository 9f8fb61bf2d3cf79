"""Classification: cases are made from the rules themselves, one per pattern row,
then precedence and word ends where two rules meet."""
import pytest
from pyspark.sql import functions as F

from dockline.config import RuleError, Rules, load_rules, pattern_text
from dockline.functions.text import match_key
from dockline.operators.classify import classify, dsd_priority, ordered_sites, site_label
from helpers import RULES


def groups_of(spark, pairs, rules=RULES):
    df = spark.createDataFrame([(i, s, c, "x") for i, (s, c) in enumerate(pairs)],
                               "i int, ship_to_name string, carrier_description string, ys string")
    return [r["customer_group"] for r in classify(df, rules).orderBy("i").collect()]


def test_every_pattern_row_finds_its_group(spark):
    def place(p):
        inside = f"  zz {p.text.lower()}  q" if p.test == "contains" else f" {p.text}yy"
        return (inside, "nobody") if p.column == "ship_to" else ("nobody", inside)
    assert groups_of(spark, [place(p) for p in RULES.patterns]) == [p.group for p in RULES.patterns]
    # a prefix doesn't count further in
    starts = [p for p in RULES.patterns if p.test == "startswith"]
    assert len(starts) == 3 and groups_of(spark, [(f"q {p.text}y", "") for p in starts]) == ["other"] * 3


PRECEDENCE = [
    ("gfs depot for A&W #12", "", "aw_via_gfs"),          # the earlier rule of the two
    ("SYSCO c/o AMZ", "amazon  pickup run", "amazon"),    # a carrier pattern of an earlier rule
    ("walmart at pratt street", "", "pratts"),
    ("LOBLAWS yard", "WALMART PICK UP", "walmart"),
    ("Sobeys / Safeway", "loblaw pickup", "sobeys_group"),
    ("SAFEWAY", "", "other"),                              # only "canada safeway" is a pattern
    ("wm", "", "other"), ("WM x", "", "walmart"), ("wmart x", "", "other"),
    ("FCLX", "", "federated_coop"), ("the FCL", "", "other"),
    (None, None, "other"), (" nan ", "None", "other"), ("<NA>", "GFS CAPSTONE PICKUP", "gfs"),
]


def test_precedence_and_word_ends(spark):
    assert groups_of(spark, [(s, c) for s, c, _ in PRECEDENCE]) == [g for *_, g in PRECEDENCE]


def test_values_by_group(spark):
    df = spark.createDataFrame([("amazon 1", "", "x"), ("nobody", "", "x"), ("a&w", "", "x")],
                               "ship_to_name string, carrier_description string, ys string")
    rows = {r["customer_group"]: r for r in classify(df, RULES).collect()}
    assert rows["amazon"]["deadline_flag"] and rows["amazon"]["customer_report"] == "AMZ"
    assert not rows["aw_via_gfs"]["deadline_flag"] and rows["aw_via_gfs"]["customer_report"] == "GFS"
    other = rows["other"]
    assert (other["customer_priority"], other["customer_owner"], other["customer_report"]) == (3, "Unassigned", "")


def test_site_labels_and_section_order(spark):
    cells = {"SURREY   warehouse": "Surrey", "surrey depot": "surrey", " Nan ": "Unknown", None: "Unknown",
             "\t ": "Unknown", "Laval DC 2": "Laval", "laval": "laval", "Calgary Warehouse ": "Calgary"}
    df = spark.createDataFrame([(v,) for v in cells], "ys string")
    got = df.select("ys", site_label(F.col("ys"), RULES).alias("site"))
    assert {r["ys"]: r["site"] for r in got.collect()} == cells
    order = [r["site"] for r in ordered_sites(got, RULES).orderBy("site_seq").collect()]
    assert order == ["Calgary", "Surrey", "surrey", "Laval", "laval", "Unknown"]


def test_dsd_labels(spark):
    names = {"the connect  logistics yard": "Priority 1", "Edelweiss Imports": "Priority 2",
             "canada safeway connect logistics": "Priority 1", "connect": None, "": None, None: None}
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = df.select("s", dsd_priority(match_key(F.col("s")), RULES).alias("p")).collect()
    assert {r["s"]: r["p"] for r in got} == names


def test_rules_from_files_and_their_checks(tmp_path):
    import json
    mine = {"customers": [{"key": "k", "match": {"ship_to_contains": ["  big   shop ", "nan"]}}],
            "detail_reports": [{"name": "R", "customers": ["k"], "facility_in": [" dsd "]}],
            "escalation": {"at_risk_days": 4}}
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(mine))
    rules = load_rules(path)
    assert [tuple(p) for p in rules.patterns] == [(0, "k", "ship_to", "contains", "BIG SHOP")]
    assert rules.reports[0].facilities == ("DSD",) and rules.report_of_group() == {"k": "R"}
    assert rules.windows["at_risk_days"] == 4 and rules.windows["not_started_high_days"] == 2
    assert rules.values("display") == {"k": "k", "other": "Other / Unclassified"}
    assert pattern_text("wm ", "startswith") == "WM " and pattern_text("wm ") == "WM"
    for bad in ({"custmers": []}, {"customers": [{"key": "a"}, {"key": "a"}]}, {"customers": [{"display": "x"}]},
                {"customers": [{"key": "a", "match": {"ship_contains": ["x"]}}]},
                {"detail_reports": [{"name": "R", "customers": ["nobody"]}]}, {"escalation": {"at_risk_days": "soon"}}):
        with pytest.raises(RuleError):
            Rules(bad)
