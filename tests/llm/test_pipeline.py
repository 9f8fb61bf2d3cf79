"""run() against the stages done by brute force, on the smallest table."""
import os
import sys

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
import test_decontaminate  # noqa: E402
import test_line_dedup  # noqa: E402
import test_packing  # noqa: E402
import test_simhash  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def brute():
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()
    bench = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    rows = sorted((i, t) for i, t, _ in test_line_dedup.brute(rows))
    least = test_simhash.classes([test_simhash.fingerprint(t) for _, t in rows], 2)
    rows = [rows[k] for k in sorted(set(least))]
    bad = {r[0] for r in test_decontaminate.brute(rows, bench) if r[5]}
    return [(i, t) for i, t in rows if i not in bad]


def test_run_packs_what_the_rules_leave(spark):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left = brute()
    assert 100 < len(left) < 200
    test_packing.check(corpus_pipeline.run(spark, SMALL).collect(), left, tokenizer)


def test_stages_keep_all_columns_and_survive_odd_rows(spark, odd, empty):
    docs = none = None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, none = stage(spark, docs or odd, SMALL), stage(spark, none or empty, SMALL)
        assert docs.columns == odd.columns and none.columns == odd.columns
    assert none.count() == 0 and corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() > 0
