import re
from collections import defaultdict

from cases import ODD, docs_of

from dockline.llm import line_dedup
from dockline.llm.line_dedup import SKETCHES, drop_recurring, signed, templates


def leaf(w):
    return signed(f"{len(w)} {' '.join(w[:4])}")


def brute(source):
    """(id, text left, lines dropped) by the rules, in Python."""
    distinct = list(dict.fromkeys(source))
    lines, others = [], {}
    for i, t in distinct:
        own = []
        for k, line in enumerate((t or "").split("\n")):
            w = tuple("<*>" if re.search(r"\d", x) else x for x in line.split())
            if len(w) >= 3:
                own.append((i, t, k, w))
        others[t] = {leaf(w) for *_, w in own}
        lines += own
    leaves = defaultdict(set)
    for *_, w in lines:
        leaves[len(w), w[:4]].add(w)
    name = {}
    for found in leaves.values():
        left = sorted(found, key=lambda w: signed(" ".join(w)))
        for _ in range(8):
            rest = []
            for w in left:
                if sum(a == b for a, b in zip(w, left[0])) >= 0.8 * len(w):
                    name[w] = left[0]
                else:
                    rest.append(w)
            left = rest
            if not left:
                break
        name.update({w: w for w in left})
    seen = defaultdict(set)
    for i, t, _, w in lines:
        rest = others[t] - {leaf(w)}
        seen[name[w]].add((t, tuple(min(rest, key=lambda x: x * f % 2**64, default=0) for f in SKETCHES)))
    drop = defaultdict(set)
    for x, texts in seen.items():
        one = dict(texts)  # by text
        most = max(len({s[k] for s in one.values()}) for k in range(len(SKETCHES)))
        if most < 3 or 2 * most < len(one):
            continue
        of = [(i, t, k) for i, t, k, w in lines if name[w] == x]
        first = min(((i is not None, i), t) for i, t, _ in of)[0]
        for i, t, k in of:
            if (i is not None, i) != first:
                drop[i, t].add(k)
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[i, t]),
             len(drop[i, t])) for i, t in source]


def run(df):
    return sorted(((r.doc_id, r.text, r.n_dropped) for r in drop_recurring(df).collect()), key=str)


def test_whole_table_against_the_rules(small, small_texts):
    want = sorted(brute(small_texts), key=str)
    assert run(small.select("doc_id", "text")) == want and any(n for *_, n in want)


def planted():
    bases = ["alpha beta gamma delta", "red green blue white", "one of these days", "rain and then snow", "up and down it goes"]
    rows = [(k, f"{b}\nPage {k} of 9 in this book\nshort line\n{b} again {b}") for k, b in enumerate(bases)]
    rows += [(20 + k, f"copied words that all of these share\nand a second line for them\nown ending {'abcdefgh'[k]} x{'y' * k}")
             for k in range(2)]
    return rows


def test_variable_fields_copies_and_first_occurrence(spark):
    rows = planted()
    got = run(docs_of(spark, rows))
    assert got == sorted(brute(rows), key=str)
    by = {i: (t, n) for i, t, n in got}
    assert by[0][1] == 0 and "Page 0 of 9" in by[0][0]  # the first keeps it
    assert all(by[k][1] == 1 and "Page" not in by[k][0] and "short line" in by[k][0] for k in range(1, 5))
    assert by[20][1] == by[21][1] == 0


def test_exact_copies_keep_their_lines(spark):
    rows = [(k, "the same text in all of them\nwith a second line in it") for k in range(50)]
    assert all(n == 0 for *_, n in run(docs_of(spark, rows)))


def test_odd_documents(odd, empty):
    out = drop_recurring(odd)
    assert out.columns == odd.columns + ["n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_dropped) for r in out.collect()), key=str) == sorted(brute(ODD), key=str)
    assert drop_recurring(empty).count() == 0


def test_a_leaf_of_many_templates(spark):
    # 12 templates of one leaf, with a variable field that has no digit
    rows = [(k, "\n".join([f"we all know that {' '.join(f'{c}{x}' for x in 'pqrst')} {name}" for c in "abcdefghijkl"]
                          + [f"own words of {name}", f"{name} ends like this"]))
            for k, name in enumerate(["ann", "bob", "cid", "dora", "eve"])]
    got = {i: (t, n) for i, t, n in run(docs_of(spark, rows))}
    assert got[0] == (rows[0][1], 0)
    assert all(n == 12 and "we all" not in t for i, (t, n) in got.items() if i)


def letters(k):
    return "".join("abcdefghij"[int(x)] for x in str(k))


def test_near_copies_count_as_one_and_veto_nobody(spark):
    passage = "this passage stands in very many documents"
    rows = [(k, f"{letters(k)} alone has this line\n{passage}\n{letters(k)} and this other one") for k in range(1000, 1040)]
    own = [f"{x} opens a line of the copied document" for x in "abcdefghijklmnop"]
    rows += [(k, "\n".join([*(f"{letters(k)} was put in here" if j == k % 16 else x for j, x in enumerate(own)), passage]))
             for k in range(2000, 2240)]
    got = run(docs_of(spark, rows))
    assert len(got) == 280 and all(n == (i != 1000) and (passage in t) == (i == 1000) for i, t, n in got)


def hot_leaf(spark, kinds, each):
    """Lines of one leaf: ``kinds`` templates of 14 tokens, each with two variable fields."""
    rows = []
    for a in range(kinds):
        fixed = [f"w{letters(a * 31 + j)}{'pqrstuvwxy'[j]}" for j in range(8)]
        for v in range(each):
            line = " ".join(["we", "all", "know", "that", *fixed, f"x{letters(v)}", f"y{letters(v * 7)}"])
            rows.append((1, signed(line), line, a))
    return spark.createDataFrame(rows, "leaf long, sig long, tokens string, kind long")


def test_a_large_leaf_is_split_and_loses_no_template(spark, monkeypatch):
    lines = hot_leaf(spark, 60, 40)
    n = lines.count()
    whole = {r.sig: r.template for r in templates(lines, 0.8, n, rounds=2).collect()}
    sizes = []
    opener = line_dedup.by_opener

    def seen(rows, similar):
        sizes.append(rows.groupBy("leaf", "part").count().agg({"count": "max"}).first()[0] or 0)
        return opener(rows, similar)

    monkeypatch.setattr(line_dedup, "by_opener", seen)
    kinds = {r.sig: r.kind for r in lines.collect()}
    for group in (100, 7):
        got = {r.sig: r.template for r in templates(lines, 0.8, n, rounds=2, group=group).collect()}
        assert got == whole and len(set(got.values())) == 60
        assert all(kinds[t] == kinds[s] for s, t in got.items())
        assert max(sizes) <= group
        sizes.clear()


def test_lines_that_agree_in_all_but_a_few_places_need_no_task(spark):
    lines = hot_leaf(spark, 1, 300).where("kind = 0")
    got = line_dedup.parts_of_leaves(lines.select("leaf", "sig", "tokens"), 0.8, 300, 10).collect()
    assert len(got) == 300 and len({r.template for r in got}) == 1


def greedy(lines):
    """Template by line: the first line, by number, that opened one and agrees in 0.8 of the tokens."""
    opened, out = [], {}
    for sig, tokens in sorted(lines):
        x = tokens.split(" ")
        out[sig] = next((o for o, y in opened if sum(a == b for a, b in zip(x, y)) >= 0.8 * len(x)), sig)
        if out[sig] == sig:
            opened.append((sig, x))
    return out


def test_templates_do_not_depend_on_the_size_of_a_part(spark):
    # chains of lines: many agree with several that don't agree with each other
    lines = []
    for k in range(300):
        x = signed(f"line {k}")
        tokens = " ".join(["we", "all", "know", "that", *("abcd"[x >> 3 * i & 3 if i % 3 else x >> 3 * i & 1] for i in range(8))])
        lines.append((signed(tokens), tokens))
    lines = list(dict.fromkeys(lines))
    want = greedy(lines)
    assert 10 < len(set(want.values())) < len(lines) - 10
    df = spark.createDataFrame([(1, *x) for x in lines], "leaf long, sig long, tokens string")
    for group in (10_000, 20):
        assert {r.sig: r.template for r in line_dedup.parts_of_leaves(df, 0.8, len(lines), group).collect()} == want
