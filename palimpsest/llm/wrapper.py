"""HTML extraction by wrapper induction.

A host's wrapper is a tree of template nodes. A page's tree is made small first: neighbours with the same tag and class are merged into one iterated node. Trees are then
aligned by simple tree matching (the most nodes matched in order under matched parents; of equal matchings the one that takes the left tree's nodes first) and merged: matched nodes count the pages they were seen in, others
are added as optional. Wrappers are merged within tasks first, then FAN at a time by host, so a host with a third of all pages is one small tree a task.

The aligned wrapper says what is template. A text slot that shows the same text on nearly all pages its node is on (NEARLY of them, and FEW pages of different content at least: copies of a page prove nothing) is constant, and
so template, wherever it stands; slots that vary are content. A block outside the article nearly all of whose text, over all pages of the host, is in links (LINKED) is navigation, and template too.
Tags and class words decide only what alignment cannot see, parts that vary from page to page and are not the article: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments; and where a page has an
article or main element, the rest of it is left out.

What extraction needs of a wrapper is a plan: hashes of its template slots and blocks, some bytes a slot. Plans are joined to pages by host; the wrappers themselves stay behind.

Nulls: null or empty html gives an empty text; a null url counts as the host "". Repeated rows weigh in the wrapper as often as they occur, and each gets the same text.
Broken markup (unclosed or stray tags, text cut inside a tag) is read as far as it goes; elements below the depth DEEP are read as children of the node there, as browsers do from 512 on, and their text stays. Other columns pass through `extract`.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import sys

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, cut, over_batches, over_group
from .url_filter import host_of

#: Pages of different content from which on a slot's text can be called constant; plans' bytes up to which they are broadcast; trees that are merged at once.
FEW, BROADCAST, FAN = 4, 16 << 20, 64
#: The share of its node's pages that a constant text is on at least; the share of a block's text in links that makes it navigation; texts of more characters are compared by hash.
NEARLY, LINKED, LONG = 0.9, 0.8, 200
#: The depth of trees.
DEEP = 1000
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[A-Za-z])[^>]*\Z", re.S | re.I)
ATTR = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul br".split())
#: An open <p> ends where one of these begins; an open li, dt, dd, tr, td, th or option ends where its like begins.
ENDS_P = BLOCKS - {"br", "body", "html", "head", "title", "caption", "legend", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOP = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "p": {"div", "article", "section", "main", "body", "td", "li", "blockquote", "button"}}
#: Roles that are not the article, by tag and by words in class, id or role.
AWAY_TAGS = frozenset("nav footer aside form script style noscript head title template button select iframe menu dialog header".split())
AWAY_WORDS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|comment\w*|disqus|cookie\w*|consent|notice\w*|alert|popup|modal|newsletter|subscri\w*|side-?bar|menu\w*|nav\w*|breadcrumb\w*|pag(?:er|ination)|foot(?:er)?\w*|header|masthead|related|recommend\w*|share|social|login|search|widget|complementary|contentinfo|navigation)(?:$|[\s_-])", re.I)
MAIN_TAGS = ("article", "main")


class Node:
    __slots__ = ("tag", "name", "kids", "away")

    def __init__(self, tag: str, name: str, away: bool):
        self.tag, self.name, self.kids, self.away = tag, name, [], away


def parse(html: str) -> Node:
    """The page's tree; kids are nodes and strings."""
    root = Node("#root", "", False)
    stack, at = [root], 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            stack[-1].kids.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[0][1] == "/":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        closing, stops = (LIKE.get(tag), STOP.get(tag)) if tag in LIKE else (None, None)
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in STOP["p"]:
                    break
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in stops:
                    break
                if stack[k].tag in closing:
                    del stack[k:]
                    break
        name = ""
        if m[3] and "=" in m[3]:
            name = " ".join(a[1] or a[2] or a[3] for a in ATTR.findall(m[3]) if a[0].lower() in ("class", "id", "role"))
        node = Node(tag, name, tag in AWAY_TAGS or bool(name and AWAY_WORDS.search(name)))
        stack[-1].kids.append(node)
        if tag not in VOID and not m[3].endswith("/") and len(stack) < DEEP:
            stack.append(node)
    if at < len(html):
        stack[-1].kids.append(html[at:])
    return root


# A wrapper node is [key, pages, slot, kids, chars, linked]: key is tag and class without digits; slot is None (no text), [text or its hash, pages that showed it, the FEW least hashes of those pages' texts]
# (constant so far) or True (varying); chars and linked count the characters of its own text and of those in links, over all pages.


def _key(node: Node) -> str:
    return node.tag + ("." + re.sub(r"\d+", "", node.name) if node.name else "")


def page_tree(html: str) -> list:
    """The wrapper of a page alone."""
    return small_tree(parse(html), xxhash.xxh3_64_intdigest(html.encode("utf-8", "replace")))


def small_tree(node: Node, page: int = 0, link: bool = False) -> list:
    """The wrapper of a part of a page; page: a hash of the page's content."""
    kids, texts, link = [], [], link or node.tag == "a"
    for kid in node.kids:
        if isinstance(kid, str):
            if kid.strip():
                texts.append(kid)
        else:
            tree = small_tree(kid, page, link)
            if kids and kids[-1][0] == tree[0]:
                kids[-1] = merge(kids[-1], tree, False)  # an iterated node
            else:
                kids.append(tree)
    chars = sum(len(t.strip()) for t in texts)
    return [_key(node), 1, [_held(" ".join(texts)), 1, [page]] if texts else None, kids, chars, chars if link else 0]


def match(a: list, b: list) -> int:
    """Simple tree matching: the most pairs of nodes with equal keys, in order, below matched parents."""
    if a[0] != b[0]:
        return 0
    row = [0] * (len(b[3]) + 1)
    for x in a[3]:
        last, row_before = 0, row
        row = [0]
        for j, y in enumerate(b[3]):
            last = max(last, row_before[j + 1], row_before[j] + (match(x, y) if x[0] == y[0] else 0))
            row.append(last)
    return row[-1] + 1


def merge(a: list, b: list, pages: bool = True) -> list:
    """The wrapper of both; a and b have equal keys. pages: their pages add up (else they are parts of one page)."""
    if a[2] is None or b[2] is None:
        slot = b[2] if a[2] is None else a[2]
    elif True in (a[2], b[2]) or a[2][0] != b[2][0]:
        slot = True
    else:
        slot = [a[2][0], a[2][1] + b[2][1] if pages else a[2][1], sorted({*a[2][2], *b[2][2]})[:FEW]]
    both = [a[4] + b[4], a[5] + b[5]]
    n, m = len(a[3]), len(b[3])
    if [x[0] for x in a[3]] == [y[0] for y in b[3]]:
        return [a[0], a[1] + b[1] if pages else a[1], slot, [merge(x, y, pages) for x, y in zip(a[3], b[3], strict=True)], *both]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            own = match(a[3][i], b[3][j])
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + own if own else 0)
    kids, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[3][i][0] == b[3][j][0] and best[i][j] == best[i + 1][j + 1] + match(a[3][i], b[3][j]):
            kids.append(merge(a[3][i], b[3][j], pages))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i][j] == best[i + 1][j]):
            kids.append(a[3][i])
            i += 1
        else:
            kids.append(b[3][j])
            j += 1
    return [a[0], a[1] + b[1] if pages else a[1], slot, kids, *both]


def _clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def _held(text: str) -> str:
    """A text as wrappers hold it."""
    text = _clean(text)
    return text if len(text) <= LONG else "#" + hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=12).hexdigest()


def shape(tree: list) -> tuple:
    return (tree[0], tree[2] is None, tuple(map(shape, tree[3])))


def _has_main(tree: list) -> bool:
    return tree[0].split(".")[0] in MAIN_TAGS or any(map(_has_main, tree[3]))


def _mark(path: str, what: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\0{what}".encode("utf-8", "replace"))


def _within(tree: list) -> tuple[int, int]:
    """(characters, those in links) of a node and all below."""
    below = [_within(kid) for kid in tree[3]]
    return tree[4] + sum(x for x, _ in below), tree[5] + sum(x for _, x in below)


def plan_of(tree: list) -> bytes:
    """What extraction needs of a wrapper: whether it has a main element, then the marks of constant slots and of navigation blocks."""
    marks: set[int] = set()
    blocks: dict[str, list[int]] = {}

    def walk(node: list, path: str, inside: bool) -> None:
        path = f"{path}/{node[0]}"
        tag = node[0].split(".")[0]
        inside = inside or tag in MAIN_TAGS
        if isinstance(node[2], list) and len(node[2][2]) >= FEW and node[2][1] >= NEARLY * node[1]:
            marks.add(_mark(path, "=" + node[2][0]))
        if tag in BLOCKS and tag not in ("html", "body") and not inside and not _has_main(node):
            chars, linked = _within(node)
            seen = blocks.setdefault(path, [0, 0, 0])
            seen[0], seen[1], seen[2] = seen[0] + node[1], seen[1] + chars, seen[2] + linked
        for kid in node[3]:
            walk(kid, path, inside)

    walk(tree, "", False)
    chars, linked = _within(tree)
    if linked < LINKED * chars:  # a host of nothing but links has no navigation to tell apart
        marks |= {_mark(path, "a") for path, (pages, own, links) in blocks.items() if pages >= FEW and own and links >= LINKED * own}
    return bytes([_has_main(tree)]) + b"".join(m.to_bytes(8, "little") for m in sorted(marks))


def marks_of(plan: bytes) -> tuple[bool, frozenset[int]]:
    return bool(plan[0]), frozenset(int.from_bytes(plan[i : i + 8], "little") for i in range(1, len(plan), 8))


def text_of(root: Node, plan: tuple[bool, frozenset[int]] | None) -> str:
    """The article's blocks, joined by newlines; plan: marks_of() the host's, None if it has no wrapper."""
    main, marks = plan or (False, frozenset())
    out: list[str] = []
    current: list[str] = []

    def flush() -> None:
        if current:
            if block := _clean("".join(current)):
                out.append(block)
            current.clear()

    def node_has_main(node: Node) -> bool:
        return only_main and has_main(node)

    def has_main(node: Node) -> bool:
        return any(not isinstance(k, str) and not (k.away and k.tag != "header") and (k.tag in MAIN_TAGS or has_main(k)) for k in node.kids)

    def walk(node: Node, path: str, inside: bool) -> None:
        path = f"{path}/{_key(node)}"
        inside = inside or node.tag in MAIN_TAGS
        block = node.tag in BLOCKS
        if block:
            flush()
        own = [k for k in node.kids if isinstance(k, str) and k.strip()]
        constant = bool(marks and own) and _mark(path, "=" + _held(" ".join(own))) in marks
        if block and not inside and marks and _mark(path, "a") in marks and not node_has_main(node):
            return
        for kid in node.kids:
            if isinstance(kid, str):
                if not constant and (inside or not only_main):
                    current.append(kid)
            elif not kid.away:
                walk(kid, path, inside)
        if block:
            flush()

    only_main = (main or plan is None) and has_main(root)
    walk(root, "", False)
    flush()
    return "\n".join(out)


def induce(pages: DataFrame, html: str = "html", host: str = "_host") -> DataFrame:
    """host, wrapper (JSON): one row a host."""
    import pyarrow as pa

    host_at, html_at = pages.columns.index(host), pages.columns.index(html)

    def within(batches):
        _deep()
        trees: dict[str, dict[tuple, list]] = {}
        size = 0
        for batch in batches:
            for h, text in zip(batch.column(host_at).to_pylist(), batch.column(html_at).to_pylist(), strict=True):
                tree = page_tree(text or "")
                own = trees.setdefault(h, {})
                key = shape(tree)
                size += key not in own
                own[key] = merge(own[key], tree) if key in own else tree  # same shape: no alignment to search
                if size > 20_000:
                    yield out(trees)
                    trees, size = {}, 0
        yield out(trees)

    def out(trees):
        rows = [(h, json.dumps(together(list(own.values())))) for h, own in trees.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["host", "wrapper"])

    def together(trees: list[list]) -> list:
        whole = trees[0]
        for t in trees[1:]:
            whole = merge(whole, t)
        return whole

    def merged(table: pa.Table) -> pa.Table:
        _deep()
        whole = together([json.loads(w) for w in sorted(table.column("wrapper").to_pylist())])
        return pa.table({"host": table.column("host").slice(0, 1), "wrapper": pa.array([json.dumps(whole)])})

    trees = cut(pages.mapInArrow(over_batches(within), "host string, wrapper string"))
    most = trees.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > FAN:  # a host that all tasks have is merged FAN trees at a time
        groups = -(-most // FAN)
        salted = trees.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(groups)))
        trees = cut(salted.groupBy("host", "salt").applyInArrow(over_group(merged), "host string, wrapper string"))
        most = min(groups, -(-most // 2))
    return trees.groupBy("host").applyInArrow(over_group(merged), "host string, wrapper string")


def plans(wrappers: DataFrame) -> DataFrame:
    """host, plan."""
    import pyarrow as pa

    def run(batches):
        _deep()
        for t in batches:
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array([plan_of(json.loads(w)) for w in t.column(1).to_pylist()], pa.binary())], names=["host", "plan"])

    return wrappers.select("host", "wrapper").mapInArrow(over_batches(run), "host string, plan binary")


def _deep() -> None:
    """Lets trees of DEEP levels be walked."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEP))


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages with text and n_chars."""
    import pyarrow as pa

    hosted = pages.withColumn("_host", host_of(F.col(url)))
    table = cut(plans(induce(hosted.select("_host", html), html)).withColumnsRenamed({"host": "_host", "plan": "_plan"}))
    size = int(table.agg(F.sum(F.octet_length("_plan").cast("long") + F.octet_length("_host"))).first()[0] or 0)
    # Beyond BROADCAST the join is by host, and Spark splits a host's pages (adaptive skew join); a plan is small enough to go along with each.
    joined = hosted.join(F.broadcast(table) if size <= BROADCAST else table, "_host", "left")

    def make(texts, plans_, held={}):  # noqa: B006  each plan is read once a task
        _deep()
        out = []
        for text, p in zip(texts.to_pylist(), plans_.to_pylist(), strict=True):
            if len(held) > 1000:
                held.clear()
            plan = held.get(p)
            if plan is None and p:
                plan = held[p] = marks_of(p)
            out.append(text_of(parse(text.decode("utf-8", "replace")), plan))
        return [pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())]

    return add_columns(joined, "text string, n_chars bigint", make, html, ("_plan",)).drop("_host", "_plan")


def op9_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
