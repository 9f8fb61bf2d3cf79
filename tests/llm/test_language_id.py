import zlib

import duckdb
import pytest
from cases import ODD

from dockline.llm.language_id import SuffixAutomaton, accepted, identify, learn, parser
from dockline.llm.queries import QUERIES


def test_longest_match_parse_against_brute_force():
    text = " the cat sat on that mat "
    a = SuffixAutomaton(text)

    def phrases(s):
        n = i = 0
        while i < len(s):
            k = 1
            while i + k <= len(s) and s[i:i + k] in text:
                k += 1
            i += max(1, k - 1)
            n += 1
        return n
    for s in ["", " ", "the", " cat ", "zz", "thatz mat", "atatat", "on on on", "sat the z q cat"]:
        assert a.phrases(s) == phrases(s)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    rows = QUERIES["op5_language_id"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == lang[r.doc_id] for r in held)
    assert len(held) > 150 and right >= 0.98 * len(held)


@pytest.fixture(scope="module")
def model(small):
    return learn(small)


def test_odd_documents(odd, empty, model):
    got = {r.doc_id: r.lang_pred for r in identify(odd, model).collect()}
    assert len(identify(odd, model).collect()) == len(ODD)
    assert all(got[k] == "und" for k in (1, 2, 3, 10, 15)) and got[4] == "en" and got[9] in model
    assert identify(empty, model).count() == 0
    assert learn(empty) == {} and {r.lang_pred for r in identify(odd, {}).collect()} == {"und"}
    assert {(r.lang_pred, r.score) for r in identify(odd, {"xx": ["a"]}).collect()} == {("und", 0.0), ("xx", 1.0)}


def test_unknown_languages_go_and_columns_stay(odd, model):
    left = accepted(odd, model)
    assert left.columns == odd.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == sorted(
        i for i, t in ODD if i and i not in (1, 2, 3, 10, 15))


def test_nothing_is_learned_from_held_out_or_unlabelled_rows(spark):
    rows = [(i, f"word{'abcdefghij'[i]}", "en" if i % 2 else None) for i in range(10)]
    learned = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert learned == {"en": sorted(f"word{'abcdefghij'[i]}" for i in range(10)
                                    if i % 2 and zlib.crc32(str(i).encode()) % 5)}


def test_every_language_has_its_own_words(spark):
    # 300 labels, of which none takes words from another
    rows = [(10 * k + j, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}{chr(97 + x)}" for x in range(20)), f"l{k}")
            for k in range(300) for j in range(10)]
    learned = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    want = {}
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 5:
            want.setdefault(lang, set()).update(t.split())
    assert {k: set(v) for k, v in learned.items()} == want and len(want) == 300


def test_copies_do_not_starve_a_language(spark):
    texts = [f"word{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for k in range(100)]
    df = spark.range(20_000).selectExpr("id AS doc_id", "id % 100 AS k").join(
        spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k").selectExpr(
        "doc_id", "text", "'xx' AS lang")
    assert learn(df)["xx"] == texts


def test_automata_are_small():
    import tracemalloc
    words = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 7 % 26)}{k * 7919 % 9973:x}{k * 104729 % 99991:x}" for k in range(5000))
    tracemalloc.start()
    a = SuffixAutomaton(words)
    size, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert size < 60 * len(words) and a.phrases(words[100:200]) == 1


def test_another_model_gets_its_own_automata():
    words = [f"w{k}" for k in range(60)]
    old = {"x": words + ["zebra"], "y": words + ["crane"]}
    new = {"x": words + ["crane"], "y": words + ["zebra"]}
    assert parser(old).predict("zebra")[0] == "x" and parser(new).predict("zebra")[0] == "y"
    assert parser(new) is parser(dict(new))


def test_accepted_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the cat", None, "a", "b", "c.d"), (2, "...", "en", "a", "b", "e"), (3, None, "en", "", "", ""),
                                  (1, "the cat", None, "a", "b", "c.d")],
                                 "doc_id long, text string, lang string, arg string, told_lang string, `__score` string")
    got = accepted(docs, {"en": ["the", "cat"], "fr": ["le", "chat"]})
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "the cat", "en", "a", "b", "c.d")] * 2
    assert accepted(docs.limit(0), {"en": ["the"]}).count() == 0
