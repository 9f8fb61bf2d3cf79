import hashlib
import random
import re

from cases import docs_of

from dockline.llm.decontaminate import contamination, decontaminate, uncontaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, bench):
    out = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for item, bt in bench:
            b = words(bt)
            n = min(13, len(b))
            for k in range(len(b) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s:s + n] == b[k:k + n]:
                        hit.update(range(s, s + n))
                        items.add(str(item)) if item is not None else None
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def tables():
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "the", "of", "é", "x1", "THE"]
    bench = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 13, 14, 40])))) for k in range(12)]
    bench += [(3, bench[3][1]), (None, "null item of five words"), (50, None), (51, ""), (9, "beta")]
    docs = [(None, "null item of five words"), (1, None), (2, ""), (3, "  ")]
    for k in range(40):
        w = rng.choices(vocabulary, k=rng.randrange(60))
        b = (bench[rng.randrange(12)][1]).split()
        at = rng.randrange(len(w) + 1)
        docs.append((k, ", ".join(w[:at] + b[:rng.randrange(len(b) + 1)] + w[at:])))
    return docs, bench + [(77, "the the the the the the the the the the the the the the")]


def test_against_brute_force_in_one_and_in_many_blocks(spark):
    docs, bench = tables()
    d, b = docs_of(spark, docs), spark.createDataFrame(bench, "item_id long, text string")
    for chars in (10_000, 60):
        got = contamination(decontaminate(d, b, block_bytes=chars)).collect()
        assert sorted(map(tuple, got), key=str) == brute(docs, bench)
        left = uncontaminated(d, b, block_bytes=chars)
        assert left.columns == d.columns
        assert sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id) == sorted(
            (i, t) for (i, t), r in zip(docs, [brute([x], bench)[0] for x in docs]) if i and not r[5])


def test_odd_documents_and_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate(odd, none).collect()
    assert len(got) == 19 and all(r.spans == [] and r["items"] == [] for r in got)
    one = spark.createDataFrame([(1, "Twice")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate(odd, one).collect() if r["items"]) == [12, 12, 13]
    assert decontaminate(empty, one).count() == 0
