"""Main text of web pages by union-free wrapper inference.

The pages of a host come from few templates.  From all pages of each host
a wrapper is inferred: each page becomes a tree of tags (with class and id) in
which siblings with the same tag are one, and the trees are aligned tag by tag,
one after the other with what was found so far.
Where they agree the wrapper stays; tags that recur among their siblings become
a repeated group; tags that one side lacks become optional; texts that differ
become a slot.  There are no alternatives (unions), so a slot is named by the
path of tags that leads to it.

The slots of the article are found on the wrapper: those below ``article`` or
``main``, or else below the smallest element that holds most of the host's
varying text; menus, headers, footers, sidebars, notices, adverts, forms and
comments are left out by their tags, roles, classes and ids.  A class or id of
several words that only hints at one of those leaves an element out if its text is
the same on all of the host's pages (three at least).  The marks of optional and
repeated groups aren't read.  A page is read through its host's wrapper; a page with
paths that the wrapper lacks is aligned with it first.

Wrappers add up: each task folds its pages into one wrapper a host, and what is
shuffled are those, merged in two steps so that a host with very many pages isn't one
task's work.  A host's wrapper keeps the paths that three different pages have; what
fewer pages have decides nothing (see ``common``).  Wrappers are broadcast if they
have ``BROADCAST_CHARS`` or fewer in all, else joined by host.
"""
from __future__ import annotations

import hashlib
import html as markup
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.llm.common import over_batches, ship, slices, stored

FOLD_CHARS = 32_000_000  # characters of pages that are folded before wrappers are handed on
SALTS = 256  # parts of a host's wrappers in the first step of merging
DIFFERENT = 3  # pages that a text must be on to count as the host's
BROADCAST_CHARS = 8_000_000
CACHED = 512  # wrappers a worker keeps
#: Elements nested deeper than this count as ones of that depth, as in browsers (which
#: have a depth of 512), but for an article and an aside.
DEEPEST = 300

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var ruby rb rt rp nobr".split())
#: Open elements that an opening tag closes, up to the elements that hold them.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: Tags, roles and words in class or id of what isn't the article.
ASIDE_TAGS = frozenset("nav header footer aside form script style noscript template textarea title head iframe button "
                       "select menu dialog svg object".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu "
                        "menubar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets related "
    "recommended notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup "
    "login form comment comments reply replies respond disqus share sharing social toolbar pagination pager "
    "search".split())
#: Of these, words that articles use for parts of their own too, beside other words
#: (post-header, long-form, search-engines).
HINT_WORDS = frozenset("header form search menu banner alert social login".split())
ARTICLE = frozenset({"article", "main"})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars.

    Tags may nest to any depth and pages be of any length; an empty table gives an
    empty one.  Character references are decoded, white space inside a block becomes one
    space, blocks are joined by one space in page order.  A null or empty page,
    and a page without an article, has the empty text; a page without a host is
    read with the others that lack one; repeated rows read alike.  Other columns
    of ``pages`` are not read.
    """
    rows = pages.select(F.col(html_col).cast("string").alias("html"), F.col(id_col).alias("id"),
                        F.col(url_col).alias("url"), host_of(F.col(url_col).cast("string")).alias("host"))
    learned = stored(wrappers(rows))
    size = learned.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    joined = rows.join(F.broadcast(learned) if size <= BROADCAST_CHARS else learned, "host", "left")
    args = joined.select("html", "host", "wrapper", "id", "url")
    return over_batches(args, Reader, "text string, n_chars long", 3).select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def host_of(url):
    """The lower-cased host of a URL, empty if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))


def wrappers(rows: DataFrame) -> DataFrame:
    """(host, wrapper as JSON), from all pages of each host."""
    ship(rows.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, list] = {}
        seen: set[tuple[str, int]] = set()  # copies add nothing
        folded = 0
        for b in batches:
            for part in slices(iter([b])):
                for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    folded += len(page)
                    if (known := (host, digest(page))) not in seen:
                        seen.add(known)
                        tree = parse(page)
                        trees[host] = align(trees[host], tree) if host in trees else tree
                if folded > FOLD_CHARS:
                    yield handed_on(trees)
                    trees, seen, folded = {}, set(), 0
        if trees:
            yield handed_on(trees)

    def merge(part: pd.DataFrame, last: bool) -> list:
        found = None
        for text in part.sort_values("wrapper")["wrapper"]:
            tree = json.loads(text)
            found = tree if found is None else align(found, tree)
        return [common(found) if last else found]

    def some(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": part["host"].iloc[:1], "wrapper": [json.dumps(t) for t in merge(part, False)]})

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": part["host"].iloc[:1], "wrapper": [json.dumps(t) for t in merge(part, True)]})

    folded = rows.where(F.length("html") > 0).select("host", "html").mapInArrow(
        fold, "host string, salt int, wrapper string")
    return (folded.groupBy("host", "salt").applyInPandas(some, "host string, wrapper string")
            .groupBy("host").applyInPandas(whole, "host string, wrapper string"))


def handed_on(trees: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(list(trees), pa.string()), pa.array([t[PAGES][0] % SALTS for t in trees.values()], pa.int32()),
        pa.array([json.dumps(t) for t in trees.values()], pa.string())], ["host", "salt", "wrapper"])


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest())


def common(wrapper: list) -> list:
    """The wrapper with the slots that ``DIFFERENT`` pages have.  A slot of fewer pages
    is read like one that varies, whatever it holds, and a page that has it is aligned
    with the wrapper when it is read; so a host with ever new classes has no ever
    growing wrapper."""
    out = [*wrapper[:PAGES], list(range(len(wrapper[PAGES]))), [], *wrapper[CHILDREN + 1:]]
    for c in wrapper[CHILDREN]:
        c = common(c)
        if c[CHILDREN] or c[TAG] == TEXT and len(c[PAGES]) >= DIFFERENT:
            out[CHILDREN].append(c)
    return out


# A wrapper (and a page) is a tree of lists:
# [tag, optional, repeated, pages (digests of up to DIFFERENT ones), children] and, for text, [TEXT, optional, repeated, pages, [], constant, chars, link chars]
TEXT = "#"
TAG, OPTIONAL, REPEATED, PAGES, CHILDREN, CONSTANT, CHARS, LINKED = range(8)


def tokens(page: str):
    """("open", tag, attributes), ("close", tag, "") and ("text", text, "")."""
    lower, at, end = lowered(page), 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        c = lower[lt + 1:lt + 2]
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if c in ("!", "?"):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        name = NAME.match(lower, lt + 1)
        if not name:
            yield "text", "<", ""
            at = lt + 1
            continue
        gt = tag_end(page, name.end())
        if gt < 0:
            return  # a tag that the page breaks off in
        at = gt + 1
        tag = name[2]
        if name[1]:
            yield "close", tag, ""
            continue
        yield "open", tag, page[name.end():gt]
        if tag in RAW:
            stop = lower.find(f"</{tag}", at)
            at = end if stop < 0 else stop


def lowered(page: str) -> str:
    """The page with A-Z in lower case and every character in its place."""
    return page.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def tag_end(page: str, at: int) -> int:
    """Where the tag's ``>`` is, -1 if nowhere.  One inside a quoted value, which ends
    at the next quote of its kind, isn't it; a value whose quote is never closed is
    read as unquoted."""
    while (m := VALUE_OR_END.search(page, at)) and m[1]:
        closed = page.find(m[1], m.end())
        at = closed + 1 if closed >= 0 else m.end()
    return m.start() if m else -1


VALUE_OR_END = re.compile(r"""=\s*(["'])|>""")
NAME = re.compile(r"(/?)([a-z][^\s/>]*)")
MARKS = re.compile(r"""(?<![\w:-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def signature(tag: str, attributes: str) -> str:
    """The tag with its classes, id and role, digits left out."""
    if not attributes:
        return tag
    marks = sorted(f"{k.lower()}={' '.join(sorted((a or b or c).lower().split()))}"
                   for k, a, b, c in MARKS.findall(attributes))
    return re.sub(r"\d+", "0", " ".join([tag, *marks]))


def blocks(page: str):
    """(path of open block elements, text, linked characters) of each text block."""
    path: list[str] = []  # signatures, down to DEEPEST
    tags: list[str] = []
    beyond: list[tuple[int, str]] = []  # below it: the article, the aside
    parts: list[str] = []
    linked, link = 0, 0

    def flush():
        nonlocal linked
        text = " ".join(markup.unescape("".join(parts)).split())
        parts.clear()
        n, linked = linked, 0
        return ((*path, *(x for _, x in beyond)), text, n) if text else None

    def close(k: int):
        del tags[k:], path[k:]
        while beyond and beyond[-1][0] >= k:
            beyond.pop()

    for kind, x, attributes in tokens(page):
        if kind == "text":
            if tags and tags[-1] in RAW:
                continue
            parts.append(x)
            if link:
                linked += len(x)
            continue
        if x in INLINE:
            if x == "a":
                link = 1 if kind == "open" else 0
            continue
        if x == "br":
            parts.append(" ")
            continue
        if (block := flush()) is not None:
            yield block
        if kind == "open":
            if x in VOID:
                continue
            if "p" in tags and x not in RAW:
                k = len(tags) - 1 - tags[::-1].index("p")
                if all(t == "p" for t in tags[k:]):
                    close(k)
            if x in CLOSES:
                closed, holders = CLOSES[x]
                for k in reversed(range(len(tags))):
                    if tags[k] in holders:
                        break
                    if tags[k] in closed:
                        close(k)
                        if x not in ("tr",):
                            break
            if len(path) < DEEPEST:
                path.append(signature(x, attributes))
            elif not any(map(aside, (s for _, s in beyond))):
                s = signature(x, attributes)
                if aside(s) or x in ARTICLE and not beyond:
                    beyond.append((len(tags), s))
            tags.append(x)
        elif x in tags:
            close(len(tags) - 1 - tags[::-1].index(x))
    if (block := flush()) is not None:
        yield block


def parse(page: str) -> list:
    """The page as a tree in which what recurs among siblings is one repeated group."""
    here = [digest(page)]
    root = ["", 0, 0, here, []]
    for path, text, linked in blocks(page):
        node = root
        for tag in path:
            node = child(node, tag, lambda tag=tag: [tag, 0, 0, here, []])
        known = next((c for c in node[CHILDREN] if c[TAG] == TEXT), None)
        if known is None:
            constant = text if len(text) <= 16 else digest(text)
            node[CHILDREN].append([TEXT, 0, 0, here, [], constant, len(text), linked])
        else:  # the place recurs: a repeated group, constant if all of its texts are
            known[REPEATED], known[CONSTANT] = 1, digest(f"{known[CONSTANT]}\n{text}")
            known[CHARS] += len(text)
            known[LINKED] += linked
    return root


def child(node: list, tag: str, make) -> list:
    for c in node[CHILDREN]:
        if c[TAG] == tag:
            return c
    node[CHILDREN].append(new := make())
    return new


def align(a: list, b: list) -> list:
    """Two streams with the same outer tag as one: siblings are matched by
    their tag, what only one side has becomes optional, texts
    that differ become a slot."""
    out = [a[TAG], a[OPTIONAL] | b[OPTIONAL], a[REPEATED] | b[REPEATED], a[PAGES], []]
    if a[PAGES] != b[PAGES] and len(a[PAGES]) < DIFFERENT:
        out[PAGES] = sorted({*a[PAGES], *b[PAGES]})[:DIFFERENT]
    if a[TAG] == TEXT:
        same = a[CONSTANT] == b[CONSTANT]
        return [*out, a[CONSTANT] if same else None, a[CHARS] + b[CHARS], a[LINKED] + b[LINKED]]
    x, y = a[CHILDREN], b[CHILDREN]
    right = {c[TAG]: k for k, c in enumerate(y)}
    done = 0
    for c in x:
        k = right.get(c[TAG], -1)
        if k < 0:
            out[CHILDREN].append(optional(c))
        elif k < done:  # they stand in another order: a repeated group takes both
            out[CHILDREN].append(repeated(align(c, y[k])))
        else:
            theirs = {c2[TAG] for c2 in x}
            out[CHILDREN] += [optional(d) for d in y[done:k] if d[TAG] not in theirs]
            out[CHILDREN].append(align(c, y[k]))
            done = k + 1
    ours = {c[TAG] for c in x}
    out[CHILDREN] += [optional(d) for d in y[done:] if d[TAG] not in ours]
    return out


def optional(node: list) -> list:
    return [node[TAG], 1, *node[2:]]


def repeated(node: list) -> list:
    return [*node[:2], 1, *node[3:]]


def aside(tag: str) -> int:
    """Whether a signature says that the element isn't part of an article: 2 for sure, 1
    if one of several words of a class or id hints at it, else 0."""
    if tag not in _asides:
        if len(_asides) > 100_000:
            _asides.clear()
        _asides[tag] = _aside(tag)
    return _asides[tag]


_asides: dict[str, int] = {}


def _aside(tag: str) -> int:
    name, *marks = tag.split(" ")
    if name in ASIDE_TAGS:
        return 2
    if name in ("html", "body"):
        return 0
    found, role = 0, False
    for mark in marks:
        kind, eq, value = mark.partition("=")
        if eq and kind in ("class", "id", "role"):
            role = kind == "role"
        else:
            value = mark
        words = set(re.split(r"[^a-z]+", value)) - {""}
        if role and words & ASIDE_ROLES or words & (ASIDE_WORDS - HINT_WORDS) or words and words <= ASIDE_WORDS:
            return 2
        if words & HINT_WORDS:
            found = 1
    return found


def slots(node: list, path: tuple = ()):
    for c in node[CHILDREN]:
        if c[TAG] == TEXT:
            yield path, c
        else:
            yield from slots(c, (*path, c[TAG]))


def varies(slot: list) -> bool:
    """Whether nothing says that the slot's text is the host's own."""
    return slot[CONSTANT] is None or len(slot[PAGES]) < DIFFERENT


def article_slots(wrapper: list) -> frozenset:
    """The paths whose text belongs to the article."""
    found = [(path, slot) for path, slot in slots(wrapper)]
    inside = []
    for path, slot in found:
        k = next((i for i, tag in enumerate(path)
                  if tag.split(" ")[0] in ARTICLE and not any(map(aside, path[:i]))), -1)
        if k < 0:
            continue
        doubt = max(map(aside, path[k:]))
        # a mere hint decides only where the host's pages all have the same text
        if doubt == 0 or doubt == 1 and varies(slot):
            inside.append(path)
    if inside:
        return frozenset(inside)
    # no such element: the smallest one with most of the varying, unlinked text
    text = [(path, slot[CHARS]) for path, slot in found
            if not any(map(aside, path)) and 2 * slot[LINKED] <= slot[CHARS]
            and varies(slot)]
    root: tuple = ()
    while True:
        here = [(p, n) for p, n in text if p[:len(root)] == root]
        parts: dict[tuple, int] = {}
        for p, n in here:
            if len(p) > len(root) + 1:
                parts[p[:len(root) + 1]] = parts.get(p[:len(root) + 1], 0) + n
        best = max(parts, key=parts.get, default=None)
        if best is None or parts[best] < 0.7 * sum(n for _, n in here):
            return frozenset(p for p, _ in here)
        root = best


class Reader:
    """Reads a batch of pages through their hosts' wrappers."""

    def __init__(self):
        self.known: dict[str, tuple] = {}

    def __call__(self, pages, hosts, learned):
        texts = [self.read(p, h, w) for p, h, w in zip(pages, hosts, learned)]
        return [texts, [len(t) for t in texts]]

    def wrapper(self, host: str, learned: str | None):
        if host not in self.known:
            if len(self.known) >= CACHED:
                self.known.clear()
            tree = json.loads(learned) if learned else ["", 0, 0, [], []]
            self.known[host] = tree, frozenset(p for p, _ in slots(tree)), article_slots(tree)
        return self.known[host]

    def read(self, page: str | None, host: str, learned: str | None) -> str:
        if not page:
            return ""
        tree, paths, wanted = self.wrapper(host, learned)
        found = list(blocks(page))
        if not paths.issuperset(path for path, _, _ in found):
            wanted = article_slots(align(tree, parse(page)))
        text = " ".join(t for path, t, _ in found if path in wanted)
        if not text and found:  # a page of another template than its host's
            wanted = article_slots(parse(page))
            text = " ".join(t for path, t, _ in found if path in wanted)
        return text
