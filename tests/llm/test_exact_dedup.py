import hashlib
from collections import defaultdict

from cases import ODD

from dockline.llm.exact_dedup import exact_dedup


def check(rows, source):
    groups = defaultdict(list)
    for i, t in source:
        groups[t or ""].append(i)
    assert len(rows) == len(source)
    stay = defaultdict(int)
    for r in rows:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        keep = max((i for i in groups[text] if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (keep, len(groups[text]))
        assert not r.kept or r.doc_id == keep
        stay[text] += r.kept
    assert set(stay.values()) <= {1}


def test_odd_documents_with_roomy_and_with_full_filter(odd, empty):
    check(exact_dedup(odd).collect(), ODD)
    check(exact_dedup(odd, bits_per_row=0).collect(), ODD)
    assert exact_dedup(empty).count() == 0


def test_only_possible_repeats_shuffle_and_no_python(small):
    plan = exact_dedup(small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
