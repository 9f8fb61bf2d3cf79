"""Line de-duplication by a log-template tree.

A line is parsed down a tree of fixed depth: by its number of tokens, then by
its leading tokens, with every token that has a digit generalised to ``<*>``.
In a leaf, lines are grouped into templates: the first line (by hash) opens one,
lines that agree with it in ``SIMILAR`` of their tokens or more join, what they
differ in is a variable field, and the rest open the next template, until no
line is left: ``TEMPLATES`` rounds over all leaves, then what is left of each leaf
in one task, where a line is held only against templates that it shares a band
of tokens with.  A leaf with more than ``GROUP`` lines left is first split by those
bands, and again, until no part is larger; rounds over its parts then find the same
templates as one task would, so that nothing depends on ``GROUP``.

A template recurs if it is found in ``LEAST`` documents or more that are
otherwise different.  Copies of one document share all their lines and would
make each of them look recurrent, so documents are told apart by sketches of
their other lines (the least of their leaves, for each of ``SKETCHES`` hash
functions, so that another recurring line can't be the least for all of them).
If for one function at least half of the documents with the template have
sketches of their own, they are otherwise different.  Else some are near copies:
documents with a sketch in common, directly or over others, count as one.  Recurring templates are dropped from all documents but
the first (by id), so that no passage is lost altogether.

Pass 1 counts leaves from 16 bytes a line.  Only leaves that two or more texts
share can hold a recurring template; their bits make a filter of a fixed size
that is broadcast, and pass 2 sends on only lines of such leaves.
"""
from __future__ import annotations

import re
from functools import reduce
from operator import eq

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from dockline.llm.common import free_name, ship, slices, stored, text_of

DEPTH = 4  # leading tokens
SIMILAR = 0.8
LEAST = 3
TEMPLATES = 8
GROUP = 5000  # lines of one task's group
#: Odd factors, each of which makes another order of 64-bit hashes.  Eight, so that
#: a near copy that differs in a few lines isn't without a sketch of its group's.
SKETCHES = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63,
            0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
LEAST_TOKENS = 3  # shorter lines are never dropped
FILTER_BITS = 1 << 26  # 8 MB
BLOCK_BITS = 32768
DIGIT = re.compile(r"\d")


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                   similar: float = SIMILAR, least: int = LEAST, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """``docs``, with all its columns, the text without lines of recurring
    templates, and (n_lines, n_dropped) as the last two columns, under other
    names if ``docs`` has columns called so.

    Rows equal in id and text count as one document and are treated alike; a
    null text stays null; a text all of whose lines go becomes empty; an empty
    text has one line; null ids come first.
    """
    gone = dropped_lines(docs, id_col, text_col, depth, similar, least, least_tokens)
    per_doc = gone.groupBy("id", "text_hash").agg(F.collect_set("line").alias("lines"))
    left = docs.withColumn(h := free_name(docs, "text_hash"), F.xxhash64(text_of(text_col)))
    right = per_doc.select(F.col("id").alias("drop_id"), F.col("text_hash").alias("drop_hash"),
                           F.col("lines").alias("drop_lines"))
    both = left.join(right, left[id_col].eqNullSafe(right["drop_id"]) & (left[h] == right["drop_hash"]), "left")
    text = F.col(f"`{text_col}`").cast("string")
    lines = F.split(text, "\n", -1)
    kept = F.when(F.col("drop_lines").isNull(), text).otherwise(F.array_join(
        F.filter(lines, lambda x, i: ~F.array_contains("drop_lines", i)), "\n"))
    return both.select(
        *(kept.alias(c) if c == text_col else left[f"`{c}`"] for c in docs.columns),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(free_name(docs, "n_lines")),
        F.coalesce(F.size("drop_lines"), F.lit(0)).cast("long").alias(free_name(docs, "n_dropped")))


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, depth: int, similar: float, least: int,
                  least_tokens: int) -> DataFrame:
    """(id, text_hash, line): the lines to drop, by number from 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"),
                       F.col(text_col).cast("string").alias("text"))
    leaves = leaf_rows(rows, depth, least_tokens).groupBy("leaf").agg(
        F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b")
    lines = stored(candidate_lines(rows, shared_leaves(leaves), depth, least_tokens))
    n = lines.count()
    named = stored(lines.join(templates(lines, similar, n), ["leaf", "sig"])
                   .select("template", "id", "text_hash", "sketches", "line"), n)
    # texts, then sketches, then templates: no group of a common line meets in one task
    texts = named.groupBy("template", "text_hash").agg(
        F.min(F.struct("id", "text_hash")).alias("first"), F.any_value("sketches").alias("sketches"))
    sketches = texts.select("template", "first", F.posexplode("sketches").alias("k", "sketch")) \
        .groupBy("template", "k", "sketch").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"))
    counts = sketches.groupBy("template", "k").agg(
        F.sum("texts").alias("texts"), F.count(F.lit(1)).alias("sketches"), F.min("first").alias("first"))
    many = stored(counts.groupBy("template").agg(
        F.max("texts").alias("texts"), F.max("sketches").alias("sketches"), F.min("sketches").alias("fewest"),
        F.min("first").alias("first")).where(F.col("sketches") >= least), n)
    apart = 2 * F.col("sketches") >= F.col("texts")
    doubtful = many.where(~apart & (F.col("fewest") >= least)).select("template")  # a group has a sketch at least
    recurring = many.where(apart).select("template", "first")
    if doubtful.limit(1).count():
        several = groups_of_copies(texts.join(doubtful, "template"), n).where(F.col("groups") >= least)
        recurring = recurring.unionAll(many.join(several, "template").select("template", "first"))
    recurring = stored(recurring, n)
    first = F.struct("id", "text_hash").eqNullSafe(F.col("first"))
    return named.join(recurring, "template").where(~first).select("id", "text_hash", "line")


def groups_of_copies(texts: DataFrame, n: int) -> DataFrame:
    """(template, groups): how many groups of texts linked by sketches hold it.

    Texts with the same sketches are one node; every node takes the least label
    of those that it shares a sketch with, until none changes."""
    nodes = stored(texts.groupBy("template", "sketches").agg(F.lit(1)).select(
        "template", "sketches", F.xxhash64("sketches").alias("node"), F.xxhash64("sketches").alias("label")), n)
    while True:
        edges = nodes.select("template", "node", "label", F.posexplode("sketches").alias("k", "sketch"))
        least = edges.groupBy("template", "k", "sketch").agg(F.min("label").alias("to"))
        told = edges.join(least, ["template", "k", "sketch"]).groupBy("template", "node").agg(
            F.any_value("label").alias("label"), F.min("to").alias("to"))
        told = stored(told, n)
        if not told.where(F.col("to") < F.col("label")).limit(1).count():
            return told.groupBy("template").agg(F.countDistinct("label").alias("groups"))
        nodes = nodes.drop("label").join(told.select("template", "node", F.col("to").alias("label")), ["template", "node"])


def leaf_rows(rows: DataFrame, depth: int, least_tokens: int) -> DataFrame:
    """(leaf, text_hash) of each line."""
    ship(rows.sparkSession)

    def run(batches):
        for b in slices(batches):
            leaves, at = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if text:
                    found = {leaf for _, leaf, _ in parsed(text, depth, least_tokens)}
                    leaves += found
                    at += [i] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaves, pa.int64()), b.column(0).take(pa.array(at, pa.int64()))], names=["leaf", "text_hash"])

    return rows.select("text_hash", "text").mapInArrow(run, "leaf long, text_hash long")


def parsed(text: str, depth: int, least_tokens: int):
    """(number, leaf, tokens as they are) of each line that is long enough."""
    digits = DIGIT.search(text) is not None
    for k, line in enumerate(text.split("\n")):
        tokens = line.split()
        if len(tokens) >= least_tokens:
            first = tokens[:depth]
            yield k, signed(f"{len(tokens)} {' '.join(generalised(first) if digits else first)}"), tokens


def generalised(tokens: list[str]) -> list[str]:
    return ["<*>" if DIGIT.search(x) else x for x in tokens]


def signed(text: str) -> int:
    x = xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >= 1 << 63 else x


def shared_leaves(leaves: DataFrame) -> dict[int, bytes]:
    """A bit for each leaf, by its low bits: blocks of 4 KB, 8 MB in all at most."""
    slot = F.col("leaf").bitwiseAND(FILTER_BITS - 1) + 1
    blocks = leaves.groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    return {r["block"] - 1: bytes(r["bits"]) for r in blocks.collect()}


def candidate_lines(rows: DataFrame, shared: dict[int, bytes], depth: int, least_tokens: int) -> DataFrame:
    """Lines of shared leaves: (id, text_hash, sketches, line, leaf, sig, tokens)."""
    spark = rows.sparkSession
    ship(spark)
    bits = spark.sparkContext.broadcast(shared)
    id_type = rows.schema["id"].dataType.simpleString()
    names = ["id", "text_hash", "sketches", "line", "leaf", "sig", "tokens"]

    def run(batches):
        blocks = bits.value
        for b in slices(batches):
            out, at = [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                if not text:
                    continue
                lines = list(parsed(text, depth, least_tokens))
                here = []
                for k, leaf, tokens in lines:
                    block, bit = divmod(leaf & FILTER_BITS - 1, BLOCK_BITS)
                    if block in blocks and blocks[block][bit >> 3] >> (bit & 7) & 1:
                        here.append((k, leaf, tokens))
                if here:
                    sketch = sketcher({leaf for _, leaf, _ in lines})
                    for k, leaf, tokens in here:
                        joined = " ".join(generalised(tokens))
                        out.append((sketch(leaf), k, leaf, signed(joined), joined))
                        at.append(i)
            if out:
                types = (pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64(), pa.string())
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), *(pa.array(c, t) for c, t in zip(zip(*out), types))],
                    names=names)

    return rows.mapInArrow(
        run, f"id {id_type}, text_hash long, sketches array<int>, line int, leaf long, sig long, tokens string")


def sketcher(leaves: set[int]):
    """Of a line's leaf, the sketches of a document with these leaves: for each
    order, the low 32 bits of the least of the others (0 if there is none)."""
    least = []
    for factor in SKETCHES:
        two = sorted(leaves, key=lambda x: x * factor & 0xFFFFFFFFFFFFFFFF)[:2]
        least.append((two[0], two[1] if len(two) > 1 else 0))
    low = [(a, (a & 0xFFFFFFFF ^ 1 << 31) - (1 << 31), (b & 0xFFFFFFFF ^ 1 << 31) - (1 << 31)) for a, b in least]
    return lambda leaf: [y if a == leaf else x for a, x, y in low]


def templates(lines: DataFrame, similar: float, n: int, rounds: int = TEMPLATES,
              group: int = GROUP) -> DataFrame:
    """(leaf, sig, template): the template of each distinct line, named by the
    line that opened it.  ``n``: a bound on their number."""
    left = stored(lines.groupBy("leaf", "sig").agg(F.any_value("tokens").alias("tokens")), n)
    done = None
    for _ in range(rounds):  # takes the templates of many lines out of the leaves
        first = left.groupBy("leaf").agg(F.min("sig").alias("template"), F.min_by("tokens", "sig").alias("opened"))
        a, b = F.split("tokens", " "), F.split("opened", " ")
        agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
        tried = stored(left.join(first, "leaf").select(
            "leaf", "sig", "template", "tokens",
            ((F.col("sig") == F.col("template")) | (agree >= similar * F.size(a))).alias("joins")), n)
        part = tried.where("joins").select("leaf", "sig", "template")
        done = part if done is None else done.unionAll(part)
        left = tried.where("not joins").select("leaf", "sig", "tokens")
        if not left.limit(1).count():
            return done
    return done.unionAll(parts_of_leaves(stored(left, n), similar, n, group))


def parts_of_leaves(left: DataFrame, similar: float, n: int, group: int) -> DataFrame:
    """(leaf, sig, template) of lines that the rounds left.  Leaves of ``group`` lines or
    fewer are one task's work each; the others get the same templates by ``first_openers``."""
    sizes = left.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines"))
    large = stored(sizes.where(F.col("lines") > group).select("leaf"), n)
    small = left.join(large, "leaf", "left_anti").withColumn("part", F.col("leaf"))
    whole = by_opener(small, similar).select("leaf", "sig", F.col("opener").alias("template"))
    if not large.limit(1).count():
        return whole
    held = stored(left.join(large, "leaf").select("leaf", "sig", "tokens"), n)
    return whole.unionAll(first_openers(held, *parts(held, similar, n, group), similar))


def parts(lines: DataFrame, similar: float, n: int, group: int) -> tuple[DataFrame, DataFrame]:
    """(leaf, part, sig, tokens) of parts of ``group`` lines or fewer, and (leaf, part, sig)
    of parts all of whose lines agree.  Two lines that agree are in one of them together.

    A part is a leaf at first.  In one that is too large, two lines that agree differ in
    ``miss`` places at most: if it has no more places with different tokens, all its lines
    agree; else it is split by each of ``miss + 1`` bands of those places, one of which is
    the same in two lines that agree.  Each split fixes a place, so this ends.
    """
    rows, members, alikes = lines.withColumn("part", F.col("leaf")), [], []
    size = F.size("t")
    miss = F.floor(size * (1 - similar) + 1e-9).cast("int")
    while True:
        sizes = stored(rows.groupBy("leaf", "part").agg(
            F.count(F.lit(1)).alias("lines"), F.min_by("tokens", "sig").alias("opened")).where("lines > 1"), n)
        small = sizes.where(F.col("lines") <= group).select("leaf", "part")
        members.append(rows.join(small, ["leaf", "part"]).select("leaf", "part", "sig", "tokens"))
        large = sizes.where(F.col("lines") > group).drop("lines")
        if not large.limit(1).count():
            break
        held = stored(rows.join(large, ["leaf", "part"]).withColumn("t", F.split("tokens", " ")))
        other = F.split("opened", " ")
        places = held.select("leaf", "part", F.explode(F.filter(
            F.sequence(F.lit(0), size - 1), lambda i: F.get("t", i) != F.get(other, i))).alias("place"))
        places = places.distinct().groupBy("leaf", "part").agg(F.sort_array(F.collect_list("place")).alias("places"))
        held = held.join(places, ["leaf", "part"])
        alike = F.size("places") <= miss
        alikes.append(held.where(alike).select("leaf", "part", "sig"))
        banded = held.where(~alike).select(
            "leaf", "part", "sig", "tokens", "t", "places", F.explode(F.sequence(F.lit(0), miss)).alias("band"))
        mine = F.transform(F.filter("places", lambda p, k: k % (miss + 1) == F.col("band")), lambda p: F.get("t", p))
        rows = stored(banded.select("leaf", "sig", "tokens", F.xxhash64("part", "band", mine).alias("part")))
    empty = lines.select("leaf", F.col("leaf").alias("part"), "sig").limit(0)
    return stored(reduce(DataFrame.unionAll, members)), stored(reduce(DataFrame.unionAll, alikes, empty))


WAITS, OPENS, JOINS = range(3)


def first_openers(lines: DataFrame, members: DataFrame, alike: DataFrame, similar: float) -> DataFrame:
    """(leaf, sig, template) as one task would find them that takes a whole leaf line by
    line: a line joins the first opener that it agrees with, or opens a template.

    It opens one if no line before it that it agrees with does.  So in every round those
    open that agree with no line before them that still waits, and those join that agree
    with an opener.  Lines are in the order of a hash, so the rounds are few (in
    proportion to the logarithm of a leaf's lines)."""
    state = stored(lines.select("leaf", "sig", F.lit(WAITS).alias("state")))
    while state.where(F.col("state") == WAITS).limit(1).count():
        told = seen_in_parts(members, alike, state, similar, False).groupBy("leaf", "sig").agg(
            F.min("opener").alias("opener"), F.max("blocked").alias("blocked"))
        now = F.when(F.col("state") != WAITS, F.col("state")).when(F.col("opener").isNotNull(), F.lit(JOINS)) \
            .when(F.coalesce("blocked", F.lit(False)), F.lit(WAITS)).otherwise(F.lit(OPENS))
        state = stored(state.join(told, ["leaf", "sig"], "left").select("leaf", "sig", now.alias("state")))
    first = seen_in_parts(members, alike, state, similar, True).groupBy("leaf", "sig").agg(F.min("opener").alias("opener"))
    return state.join(first, ["leaf", "sig"], "left").select(
        "leaf", "sig", F.when(F.col("state") == OPENS, F.col("sig")).otherwise(F.col("opener")).alias("template"))


def seen_in_parts(members: DataFrame, alike: DataFrame, state: DataFrame, similar: float, last: bool) -> DataFrame:
    """(leaf, sig, opener, blocked) of the waiting lines (``last``: the joined ones) by
    part: the first opener before each that it agrees with, and whether, without one, it
    agrees with a line before it that waits."""
    asks = JOINS if last else WAITS
    ship(members.sparkSession)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sig")
        states = part["state"].tolist()
        found = []
        if asks in states:
            found = openers_before([x.split(" ") for x in part["tokens"]], states, asks, similar)
        sigs = part["sig"].to_numpy()
        at = [k for k, _, _ in found]
        return pd.DataFrame({"leaf": part["leaf"].to_numpy()[at], "sig": sigs[at],
                             "opener": pd.array([None if o is None else sigs[o] for _, o, _ in found], dtype="Int64"),
                             "blocked": [b for *_, b in found]})

    of_interest = state.where(F.col("state").isin(asks, OPENS))
    kind = "leaf long, sig long, opener long, blocked boolean"
    in_members = members.join(of_interest, ["leaf", "sig"]).groupBy("leaf", "part").applyInPandas(run, kind)
    placed = alike.join(of_interest, ["leaf", "sig"])
    least = placed.groupBy("leaf", "part").agg(
        F.min(F.when(F.col("state") == OPENS, F.col("sig"))).alias("opens"),
        F.min(F.when(F.col("state") == WAITS, F.col("sig"))).alias("waits"))
    in_alike = placed.where(F.col("state") == asks).join(least, ["leaf", "part"]).select(
        "leaf", "sig", F.when(F.col("opens") < F.col("sig"), F.col("opens")).alias("opener"),
        F.coalesce(F.col("waits") < F.col("sig"), F.lit(False)).alias("blocked"))
    return in_members.unionAll(in_alike)


def by_opener(rows: DataFrame, similar: float) -> DataFrame:
    """(leaf, part, sig, opener): each line's template within its part."""
    ship(rows.sparkSession)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sig")
        opened = opened_by([x.split(" ") for x in part["tokens"]], similar)
        sigs = part["sig"].to_numpy()
        return pd.DataFrame({"leaf": part["leaf"].to_numpy(), "part": part["part"].to_numpy(), "sig": sigs,
                             "opener": sigs[opened]})

    return rows.groupBy("leaf", "part").applyInPandas(run, "leaf long, part long, sig long, opener long")


def bands_of(lines: list[list[str]], similar: float) -> list[list[int]]:
    """Lines of ``n`` tokens that agree differ in ``miss`` of them at most, so of
    ``miss + 1`` bands of the places in which any differ one is the same."""
    n = len(lines[0])
    miss = max(m for m in range(n + 1) if n - m >= similar * n)
    differ = [i for i in range(n) if len({x[i] for x in lines}) > 1]
    return [differ[b::miss + 1] for b in range(miss + 1)]


def openers_before(lines: list[list[str]], states: list[int], asks: int, similar: float):
    """(place, place of the first opener before it that it agrees with or None, whether
    without one it agrees with a line before it that waits) of each line that asks."""
    bands = bands_of(lines, similar)
    known: dict[int, dict[tuple, list[int]]] = {OPENS: {}, WAITS: {}}

    def first(x: list[str], keys: list[tuple], kind: int) -> int | None:
        near = sorted({o for key in keys for o in known[kind].get(key, ())})
        return next((o for o in near if sum(map(eq, x, lines[o])) >= similar * len(x)), None)

    out = []
    for k, x in enumerate(lines):
        keys = [(b, *(x[i] for i in band)) for b, band in enumerate(bands)]
        kind = states[k]
        if kind == asks:
            opener = first(x, keys, OPENS)
            blocked = opener is None and first(x, keys, WAITS) is not None
            out.append((k, opener, blocked))
            if opener is not None:
                continue
        if kind in known:
            for key in keys:
                known[kind].setdefault(key, []).append(k)
    return out


def opened_by(lines: list[list[str]], similar: float) -> list[int]:
    """The place of the line that opened each line's template: the first one that
    it agrees with of those that opened one."""
    bands = bands_of(lines, similar)
    known: dict[tuple, list[int]] = {}
    out = []
    for k, x in enumerate(lines):
        keys = [(b, *(x[i] for i in band)) for b, band in enumerate(bands)]
        near = sorted({o for key in keys for o in known.get(key, ())})
        found = next((o for o in near if sum(map(eq, x, lines[o])) >= similar * len(x)), k)
        if found == k:
            for key in keys:
                known.setdefault(key, []).append(k)
        out.append(found)
    return out
