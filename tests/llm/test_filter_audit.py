import re
from itertools import permutations

from cases import LONG, ODD, docs_of

from dockline.llm.filter_audit import filter_audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
           "shapley"]


def failed(doc_id, text, everything):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    out = {"A"} if len(w) < 200 else set()
    out |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
    out |= {"D"} if re.search(r"[#$%&*|]", t) else set()
    same = [i for i, x in everything if (x or "") == t and i is not None]
    return out | ({"E"} if doc_id is not None and any(i < doc_id for i in same) else set())


def brute(docs, labels):
    """Rows of every part by walking every document through every order."""
    rows, share = {}, {}
    everything = [(i, t) for i, t, _ in docs]
    for i, t, lang in docs:
        f = failed(i, t, everything)
        good = i is not None and any(x == i and q == 1 for x, q, _ in labels)
        toxic = i is not None and any(x == i and z == 1 for x, _, z in labels)
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for k, letter in enumerate(order, 1):
                row = rows.setdefault((lang or "", order, k), [0] * 6)
                share.setdefault((lang or "", letter), 0)
                row[3] += f == {letter}
                if letter in f and gone:
                    row[2] += 1
                elif letter in f:
                    gone = True
                    row[1] += 1
                    row[4] += good
                    row[5] += toxic
                    share[lang or "", letter] += 1
                elif not gone:
                    row[0] += 1
    return sorted((p, o, k, *row, share[p, o[k - 1]]) for (p, o, k), row in rows.items())


def frame(spark, docs):
    """The documents, beside columns called like inner ones."""
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr(
        "*", "'x' AS n", "'x' AS part", "'x' AS mask", "'x' AS good", "'x' AS id", "'x' AS text_")


def test_against_every_document_in_every_order(spark):
    varied = " ".join(f"w{k}" for k in range(210))
    docs = [(i, t, "en") for i, t in ODD if t != LONG] + [
        (20, varied, "de"), (21, varied, None), (21, varied, None), (22, varied, "en"), (None, varied, "de"),
        (23, varied + " #", ""), (24, varied.upper(), "fr"), (25, "AB " * 400, "fr"), (26, "AB " * 400, "de"),
        (3, "AB " * 400, "fr"), (27, "a b|" * 300, "de"), (28, "e" * 33 + "EX", "fr"), (28, "e" * 33 + "EX", "es")]
    labels = [(20, 1, 0), (21, 0, 1), (21, 1, None), (22, None, None), (25, 1, 1), (26, 1, 1), (None, 1, 1), (27, 0, 1),
              (99, 1, 1), (12, 1, 0)]
    flags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit(frame(spark, docs), flags)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)


def test_empty_tables_and_long_texts(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(empty, none).count() == 0
    rows = filter_audit(odd, none).collect()
    assert len(rows) == 600 and all(r.kept + r.removed <= len(ODD) and r.good_lost == r.toxic_lost == 0 for r in rows)
    for order in {r.filter_order for r in rows}:
        steps = sorted((r for r in rows if r.filter_order == order), key=lambda r: r.step)
        assert steps[0].kept + steps[0].removed == len(ODD)
        assert all(a.kept == b.kept + b.removed for a, b in zip(steps, steps[1:]))


def test_a_hot_text_is_counted_before_it_is_grouped(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same text', concat('t', id)) AS text",
                                          "'en' AS lang")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {(r.filter_order, r.step): r for r in filter_audit(docs, none).collect()}
    assert rows["EABCD", 1].removed == len(range(0, 20_000, 3)) - 1
    assert rows["AEBCD", 2].redundant == rows["EABCD", 1].removed
