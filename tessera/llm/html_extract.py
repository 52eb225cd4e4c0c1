"""Main text of web pages by wrapper induction on the pages of one host.

Every page is parsed once, into a tree of block elements in which neighbouring
equal siblings are one node (a list), and the texts at its nodes.  Pages of a
host whose text lies below the same elements share a layout.

* Trees are aligned by simple tree matching: the most nodes that two trees share
  in order below equal elements.  The distinct trees of a layout are folded into
  a wrapper, node by node: matched nodes are one, others are added as optional
  ones.  Groups of a bounded number of trees are folded first, then their
  wrappers by the same matching, until a layout has one; so all pages count, and
  a hot host is many groups.  Nodes that few pages have are dropped, which bounds
  a wrapper to ``1 / RARE`` times the nodes of a page.
* Each distinct tree is matched to its layout's wrapper, which gives every node
  of every page a slot.  A text that stands in one slot in nearly all distinct
  pages is template; what varies is content.  Copies (pages with the same story)
  count once.  Counts are exact and combined on the map side: no sample.
* The content of a layout is where most of its varying text lies.

Names of elements and classes decide only what alignment can't: inside the
content, and between places that vary, elements named as menus, adverts, forms or
comments are left out, but not where such an element holds nearly all varying
text; an article or main element is preferred where it holds a fair share.

One rule holds for hosts of all sizes.  Where template is more than half of the
content, the pages are versions of one story and keep it; so a single page, all
of whose texts stand on all pages, loses nothing.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.llm.url_reputation import url_host
from tessera.session import shared_path

#: The share of distinct pages that makes a text constant, and the share of the content's text that template may be.
CONSTANT, HALF = 0.9, 0.5
#: Nodes on a smaller share of pages leave a wrapper; trees that are folded by one task at a time.
RARE, FOLD = 0.2, 200
#: Shares of the varying text: that a content element holds, that makes a telltale name doubtful, that an article needs.
MOST, NEARLY_ALL, FAIR = 0.8, 0.9, 0.1
#: Bytes of the table of decisions up to which it goes to the pages; beyond, both are shuffled.
SMALL = 32 << 20

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul
    caption legend option""".split())
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption legend option body html".split())
UNSEEN = frozenset("script style noscript template head title iframe object embed svg math canvas audio video map".split())
FURNITURE = frozenset("form button input select textarea label fieldset dialog nav footer aside menu".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select", "datalist"})}
CONTAINERS = frozenset("body div section article main center table td".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
# Words in class or id that name what isn't the article.
ASIDE = re.compile(r"""(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|sidebar\w*|footer|masthead|site-?header|page-?header
    |cookies?\w*|consent|gdpr|notices?|newsletter|subscri\w*|signup|login|comments?|respond|replies|disqus|breadcrumbs?|share|sharing|social
    |related|recommend\w*|popup|modal|overlay|widget|toolbar|pagination|pager|skip-?link)(?:$|[-_\s])""", re.I | re.X)
_SPACE = re.compile(r"\s+")


class Node:
    """An element (or text) of a page."""

    __slots__ = ("tag", "sign", "children", "aside", "unseen", "text")

    def __init__(self, tag: str, sign: str, aside: bool = False, unseen: bool = False):
        self.tag, self.sign, self.aside, self.unseen = tag, sign, aside, unseen
        self.children: list[Node] = []
        self.text = ""  # of a text node


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", "#root")
        self.open = [self.root]

    def _until(self, names, stops) -> None:
        """Close the innermost of ``names``, if it is open inside the innermost of ``stops``."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in names:
                del self.open[i:]
                return
            if self.open[i].tag in stops:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._until({"p"}, {"table", "td", "th", "button", "object"})
        if tag in CLOSES:
            self._until(*CLOSES[tag])
        a = {k: v or "" for k, v in attrs}
        names = f"{a.get('class', '')} {a.get('id', '')}"
        style = a.get("style", "").replace(" ", "").lower()
        unseen = tag in UNSEEN or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        aside = (tag in FURNITURE or a.get("role", "").lower() in ROLES
                 or bool(tag not in ("html", "body", "article", "main") and names.strip() and ASIDE.search(names))
                 or tag == "article" and re.search(r"(?:^|[-_\s])comments?(?:$|[-_\s])", names, re.I) is not None
                 or tag == "header" and not any(x.tag in ("article", "main") for x in self.open))
        ident = "" if re.search(r"\d", a.get("id", "")) else a.get("id", "")
        sign = tag + "".join(f".{c}" for c in sorted(a.get("class", "").split()) if not re.search(r"\d", c)) + (f"#{ident}" if ident else "")
        node = Node(tag, sign, bool(aside), unseen)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        self._until({tag}, {"table", "td", "th"} if tag in ("p", "div", "span", "b", "i", "a", "li") else set())

    def handle_data(self, data):
        node = Node("#text", "#text")
        node.text = data
        self.open[-1].children.append(node)


def parse(html: str | None) -> Node:
    """The page's tree; what a broken page leaves open is closed, a tag cut off at its end is dropped."""
    html = html or ""
    cut = html.rfind("<")
    if cut >= 0 and ">" not in html[cut:] and re.match(r"</?[A-Za-z]|<!", html[cut:]):
        html = html[:cut]
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


class Part:
    """A node of a tree that is matched: an element's sign (``!`` before those named as furniture), and the pages that have it."""

    __slots__ = ("sign", "n", "children")

    def __init__(self, sign: str, n: int = 1):
        self.sign, self.n = sign, n
        self.children: list[Part] = []


def _tag(sign: str) -> str:
    return re.split(r"[.#]", sign.lstrip("!"), maxsplit=1)[0]


def page_parts(root: Node) -> tuple[list[int], list[str], list[tuple[int, str, int]]]:
    """Parents and signs of the page's tree in preorder, and its blocks: ``(node, text, linked characters)``.

    Nodes are block elements.  Neighbouring siblings that make a list are one
    node: equal signs, and for containers equal trees below.  Text outside all
    block elements is at node 0, the page.
    """
    signs, below = ["#root"], [[]]
    found: list[tuple[int, str, int]] = []
    run: list[str] = []
    linked = 0

    def flush(node):
        nonlocal linked
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            found.append((node, text, linked))
        run.clear()
        linked = 0

    # a stack of its own: pages may nest deeper than Python calls do
    stack: list[tuple] = [("in", root, 0, False)]
    while stack:
        step, node, at, link = stack.pop()
        if step == "out":
            flush(at)
            continue
        if node.tag == "#text":
            run.append(node.text)
            linked += len(node.text.strip()) * link
            continue
        is_block = node.tag in BLOCK
        if node.unseen or (node.aside and not is_block):
            if is_block:
                flush(at)
            continue
        if node.tag == "br":
            run.append(" ")
            continue
        if is_block:
            flush(at)
            signs.append("!" + node.sign if node.aside else node.sign)
            below.append([])
            below[at].append(len(signs) - 1)
            at = len(signs) - 1
            stack.append(("out", node, at, link))
        link = link or node.tag == "a"
        for child in reversed(node.children):
            stack.append(("in", child, at, link))
    flush(0)

    kinds: list = [""] * len(signs)  # what neighbours must share to be a list
    known: dict = {}
    for i in range(len(signs) - 1, -1, -1):
        shape = [signs[i]]
        for c in below[i]:
            if kinds[c] != shape[-1] or len(shape) == 1:
                shape.append(kinds[c])
        kinds[i] = known.setdefault(tuple(shape), len(known)) if _tag(signs[i]) in CONTAINERS else signs[i]
    number, parents, ordered, todo = [0] * len(signs), [], [], [([0], -1)]
    while todo:
        same, parent = todo.pop()
        me = len(ordered)
        ordered.append(signs[same[0]])
        parents.append(parent)
        runs: list[list[int]] = []
        for node in same:
            number[node] = me
            for c in below[node]:
                if runs and kinds[runs[-1][0]] == kinds[c]:
                    runs[-1].append(c)
                else:
                    runs.append([c])
        todo.extend((r, me) for r in reversed(runs))
    return parents, ordered, [(number[node], text, k) for node, text, k in found]


def tree(parents, signs, ns=None) -> list[Part]:
    """The tree's nodes in preorder, the root first."""
    parts = [Part(s, 1 if ns is None else int(ns[i])) for i, s in enumerate(signs)]
    for p, part in zip(parents, parts, strict=True):
        if p >= 0:
            parts[p].children.append(part)
    return parts


def flat(root: Part) -> tuple[list[int], list[str], list[int]]:
    """Parents, signs and counts of a tree in preorder."""
    parents, signs, ns, todo = [], [], [], [(root, -1)]
    while todo:
        part, parent = todo.pop()
        parents.append(parent), signs.append(part.sign), ns.append(part.n)
        todo.extend((c, len(signs) - 1) for c in reversed(part.children))
    return parents, signs, ns


def _shapes(root: Part, known: dict, shape: dict[int, int], size: dict[int, int]) -> None:
    """Number of every element's subtree (equal subtrees have equal numbers), and its count of elements."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(node.children)
    for node in reversed(order):
        below = node.children
        shape[id(node)] = known.setdefault((node.sign, *(shape[id(c)] for c in below)), len(known))
        size[id(node)] = 1 + sum(size[id(c)] for c in below)


def match(a: Part, b: Part, pairs: list[tuple[Part, Part]]) -> int:
    """Simple tree matching: the most nodes that two trees share in order below equal elements; adds the pairs.

    Equal subtrees at the heads and tails of two child lists are paired first,
    which costs no other pair; the middles are aligned exactly.
    """
    known: dict = {}
    shape: dict[int, int] = {}
    size: dict[int, int] = {}
    _shapes(a, known, shape, size)
    _shapes(b, known, shape, size)
    #: by shapes: the score, and the positions of the children that are paired
    done: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    stack = [(a, b)]
    while stack:
        m, n = stack[-1]
        key = shape[id(m)], shape[id(n)]
        if key in done or m.sign != n.sign:
            done.setdefault(key, (0, []))
            stack.pop()
            continue
        x, y = m.children, n.children
        u, v = [shape[id(c)] for c in x], [shape[id(c)] for c in y]
        if key[0] == key[1]:
            done[key] = size[id(m)], [(i, i) for i in range(len(x))]
            stack.pop()
            continue
        head = 0
        while head < min(len(u), len(v)) and u[head] == v[head]:
            head += 1
        tail = 0
        while tail < min(len(u), len(v)) - head and u[-1 - tail] == v[-1 - tail]:
            tail += 1
        p, q = range(head, len(u) - tail), range(head, len(v) - tail)
        first_x, first_y = {u[i]: x[i] for i in p}, {v[j]: y[j] for j in q}
        todo = [(c, d) for i, c in first_x.items() for j, d in first_y.items() if c.sign == d.sign and (i, j) not in done]
        if todo:
            stack.extend(todo)
            continue
        best = [[0] * (len(q) + 1)]
        for i in p:
            row, above = [0], best[-1]
            for k, j in enumerate(q):
                row.append(max(above[k + 1], row[k], above[k] + done.get((u[i], v[j]), (0,))[0]))
            best.append(row)
        chosen, i, j = [], len(p), len(q)
        total = 1 + best[i][j]
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                chosen.append((p[i], q[j]))
        ends = [(k, k) for k in range(head)] + [(len(u) - 1 - k, len(v) - 1 - k) for k in range(tail)]
        done[key] = total + sum(size[id(x[i])] for i, _ in ends), ends + chosen
        stack.pop()
    stack = [(a, b)] if a.sign == b.sign else []
    while stack:
        m, n = stack.pop()
        pairs.append((m, n))
        s, t = shape[id(m)], shape[id(n)]
        x, y = m.children, n.children
        stack.extend((x[i], y[j]) for i, j in (done[s, t][1] if (s, t) in done else [(i, i) for i in range(len(x))]))
    return done[shape[id(a)], shape[id(b)]][0]


def _above(parents, here: list[int], least: float) -> int:
    """The deepest node whose subtree holds ``least`` of the sum of ``here`` (its own at each node)."""
    total = subtree(parents, here)
    depth = depths(parents)
    return max((i for i, t in enumerate(total) if t >= least * total[0]), key=lambda i: (depth[i], total[i], -i))


def subtree(parents, here) -> list:
    """Sums over each node's subtree; nodes are in preorder."""
    total = list(here)
    for i in range(len(total) - 1, 0, -1):
        total[parents[i]] += total[i]
    return total


def depths(parents) -> list[int]:
    depth = [0] * len(parents)
    for i in range(1, len(parents)):
        depth[i] = depth[parents[i]] + 1
    return depth


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _plain(parents, signs) -> list[bool]:
    """Whether a node lies in no element that is named as furniture."""
    plain = [True] * len(signs)
    for i in range(1, len(signs)):
        plain[i] = plain[parents[i]] and not signs[i].startswith("!")
    return plain


def layout_of(parents, signs, found) -> tuple[str, str]:
    """The page's layout, the elements down to the one that holds most of its text, and its story, the digest of its texts.

    Texts in furniture count where there are no others.
    """
    plain = _plain(parents, signs)
    own = [b for b in found if plain[b[0]]] or found
    here = [0] * len(signs)
    for node, text, link in own:
        here[node] += max(1, len(text) - link)
    at = _above(parents, here, HALF)
    while at and _tag(signs[at]) not in CONTAINERS:
        at = parents[at]
    path = []
    while at > 0:
        path.append(signs[at])
        at = parents[at]
    return _digest("\n".join(reversed(path))), _digest("\n".join(b[1] for b in own))


# --- wrappers ---------------------------------------------------------------------

def _added(part: Part) -> Part:
    """A copy of a tree."""
    parents, signs, ns = flat(part)
    return tree(parents, signs, ns)[0]


def fold(trees: list[tuple[list[int], list[str], list[int], int]]) -> tuple[list[int], list[str], list[int], int]:
    """One wrapper of trees (parents, signs, counts, pages), the one with most pages first: the nodes of all, aligned.

    Nodes on less than ``RARE`` of the pages are left out at the end.
    """
    trees = sorted(trees, key=lambda t: (-t[3], t[1], t[0]))
    wrapper, pages = tree(*trees[0][:3])[0], trees[0][3]
    for parents, signs, ns, n in trees[1:]:
        pages += n
        pairs: list[tuple[Part, Part]] = []
        match(wrapper, tree(parents, signs, ns)[0], pairs)
        known = {id(p): w for w, p in pairs}
        for w, p in pairs:
            w.n += p.n
            before: dict[int, list[Part]] = {}  # unmatched children, by the matched sibling that they follow
            last = None
            for child in p.children:
                if id(child) in known:
                    last = known[id(child)]
                else:
                    before.setdefault(id(last), []).append(_added(child))
            if before:
                w.children = before.get(id(None), []) + [x for c in w.children for x in (c, *before.get(id(c), []))]
    todo = [wrapper]
    while todo:
        part = todo.pop()
        part.children = [c for c in part.children if c.n >= RARE * pages]
        todo.extend(part.children)
    return (*flat(wrapper), pages)


def slots(wrapper, parents, signs, alike: bool = True) -> list[int]:
    """The wrapper's node of each node of a tree, -1 where it has none; ``wrapper`` is (parents, signs).

    With ``alike``, equal siblings other than containers have one slot: which
    of two lists of paragraphs a page lacks can't be told.
    """
    parts, own = tree(*wrapper), tree(parents, signs)
    first: dict = {}
    at = {}
    for i, (part, parent) in enumerate(zip(parts, wrapper[0], strict=True)):
        at[id(part)] = first.setdefault((parent, part.sign), i) if alike and _tag(part.sign) not in CONTAINERS else i
    pairs: list[tuple[Part, Part]] = []
    match(parts[0], own[0], pairs)
    found = {id(p): at[id(w)] for w, p in pairs}
    return [found.get(id(p), -1) for p in own]


def choose(parents, signs, weight) -> tuple[int, list[int]]:
    """The content's node, from the varying text at each node (linked text counts against it), and furniture that isn't.

    A furniture element that holds ``NEARLY_ALL`` varying text while no article
    holds any outside it is no furniture.  The content is the article or main
    element with most of the other text, if it is a ``FAIR`` share, else the
    deepest container that holds ``MOST`` of it, or the article around that.
    """
    total = subtree(parents, weight)
    named = [s.startswith("!") for s in signs]
    story = [not x and _tag(s) in ("article", "main") for x, s in zip(named, signs, strict=True)]

    def inside(i, j):
        while i > j:
            i = parents[i]
        return i == j

    articles = [i for i, x in enumerate(story) if x and total[i] > 0]
    doubtful = [i for i, x in enumerate(named) if x and total[0] > 0 and total[i] >= NEARLY_ALL * total[0]
                and all(inside(a, i) for a in articles)]
    plain = [True] * len(signs)
    for i in range(1, len(signs)):
        plain[i] = plain[parents[i]] and (not named[i] or i in doubtful)
    # an article inside furniture is content when nothing outside it is
    if not any(plain[a] for a in articles) and not any(w > 0 and p for w, p in zip(weight, plain, strict=True)):
        plain = [True] * len(signs)
    left = subtree(parents, [w if p else 0 for w, p in zip(weight, plain, strict=True)])
    best = max((a for a in articles if plain[a]), key=lambda a: (left[a], -a), default=None)
    if best is not None and left[best] >= FAIR * left[0]:
        return best, doubtful
    at = _above(parents, [w if p else 0 for w, p in zip(weight, plain, strict=True)], MOST)
    while at and (_tag(signs[at]) not in CONTAINERS or named[at] and at not in doubtful):
        at = parents[at]
    up = at
    while up > 0 and not story[up]:
        up = parents[up]
    return (up if up > 0 else at), doubtful


def kept_nodes(parents, signs, slot, content: int, doubtful) -> list[bool] | None:
    """Whether texts at a page's nodes are content; None where the page has no node for ``content``."""
    if content not in slot:
        return None
    keep, doubtful = [False] * len(signs), set(doubtful)
    for i in range(len(signs)):
        if slot[i] == content:
            keep[i] = True
        elif i and keep[parents[i]]:
            keep[i] = not signs[i].startswith("!") or slot[i] in doubtful
    return keep


def _weight(text: str, linked: int) -> int:
    return max(0, len(text) - 2 * linked)


def decide(parents, signs, whole, fixed, weight, fixed_weight) -> tuple[int, list[int], bool]:
    """Content and doubtful furniture of a wrapper, and whether its constant texts are template.

    By node: the characters of all texts and of the constant ones, and their
    weights, of which linked text is taken off.
    """
    content, doubtful = choose(parents, signs, [w - f for w, f in zip(weight, fixed_weight, strict=True)])
    every, same = subtree(parents, whole)[content], subtree(parents, fixed)[content]
    if same <= HALF * every and every:
        return content, doubtful, True
    return (*choose(parents, signs, weight), False)


def own_text(parents, signs, found) -> list[bool]:
    """What a page by itself says is content, where its wrapper's content has no place on it."""
    weight = [0] * len(signs)
    for node, text, linked in found:
        weight[node] += _weight(text, linked)
    content, doubtful = choose(parents, signs, weight)
    return kept_nodes(parents, signs, list(range(len(signs))), content, doubtful)


# --- tables -----------------------------------------------------------------------

_BLOCK = pa.struct([("node", pa.int32()), ("text", pa.string()), ("weight", pa.int32()), ("new", pa.bool_()), ("own", pa.bool_())])
_BLOCK_SQL = "struct<node: int, text: string, weight: int, new: boolean, own: boolean>"
TREE = "parents array<int>, signs array<string>"


def read(pages: DataFrame) -> DataFrame:
    """``pages`` (id, url, host, html) parsed: id, url, host, layout, story, shape (the tree's digest), parents, signs, blocks.

    A block has its node, text, weight, and whether its node and text stand in
    the page for the first time; and whether the page by itself takes it for content.
    """
    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for html in batch.column("html"):
                parents, signs, found = page_parts(parse(html.as_py()))
                layout, story = layout_of(parents, signs, found)
                alone = own_text(parents, signs, found)
                seen: set = set()
                listed = []
                for node, text, linked in found:
                    listed.append({"node": node, "text": text, "weight": _weight(text, linked), "new": (node, text) not in seen, "own": alone[node]})
                    seen.add((node, text))
                shape = _digest(" ".join(map(str, parents)) + "\n" + "\n".join(signs))
                for col, value in zip(cols, (layout, story, shape, parents, signs, listed), strict=True):
                    col.append(value)
            types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(_BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), batch.column("host"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                names=["id", "url", "host", "layout", "story", "shape", "parents", "signs", "blocks"])

    return pages.select("id", "url", "host", "html").mapInArrow(
        run, f"id {dict(pages.dtypes)['id']}, url string, host string, layout string, story string, shape string, {TREE}, blocks array<{_BLOCK_SQL}>")


def wrappers(shapes: DataFrame) -> DataFrame:
    """``(host, layout, parents, signs)``: one wrapper a layout, from ``shapes`` (host, layout, shape, parents, signs, n)."""
    schema = f"host string, layout string, shape string, {TREE}, ns array<bigint>, n bigint"

    def fold_group(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parents, signs, ns, n = fold([(r["parents"], r["signs"], r["ns"], r["n"]) for r in rows])
        out = {"host": rows[0]["host"], "layout": rows[0]["layout"], "shape": _digest(min(r["shape"] for r in rows)), "parents": parents, "signs": signs, "ns": ns, "n": n}
        return pa.Table.from_pylist([out], schema=pa.schema([("host", pa.string()), ("layout", pa.string()), ("shape", pa.string()), ("parents", pa.list_(pa.int32())),
                                                             ("signs", pa.list_(pa.string())), ("ns", pa.list_(pa.int64())), ("n", pa.int64())]))

    trees = shapes.withColumn("ns", F.transform("signs", lambda _: F.col("n")))
    while True:
        groups = trees.groupBy("host", "layout").agg(F.ceil(F.count(F.lit(1)) / FOLD).cast("int").alias("groups"))
        groups = materialise(groups, "groups")
        dealt = trees.join(groups, ["host", "layout"]).withColumn("group", F.pmod(F.xxhash64("shape"), F.col("groups")))
        trees = materialise(dealt.groupBy("host", "layout", "group").applyInArrow(fold_group, schema), "wrappers")
        if (groups.agg(F.max("groups")).first()[0] or 1) == 1:
            return trees.select("host", "layout", "parents", "signs")


def _placed(shapes: DataFrame, wrapped: DataFrame) -> DataFrame:
    """``(host, layout, shape, slots)``: each distinct tree matched to its layout's wrapper."""
    def run(batches):
        for batch in batches:
            found = [slots((r["w_parents"], r["w_signs"]), r["parents"], r["signs"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("layout"), batch.column("shape"), pa.array(found, pa.list_(pa.int32()))],
                                             names=["host", "layout", "shape", "slots"])
    w = wrapped.select("host", "layout", F.col("parents").alias("w_parents"), F.col("signs").alias("w_signs"))
    d = shapes.join(w, ["host", "layout"]).select("host", "layout", "shape", "parents", "signs", "w_parents", "w_signs")
    return d.mapInArrow(run, "host string, layout string, shape string, slots array<int>")


def _decided(wrapped: DataFrame, sums: DataFrame) -> DataFrame:
    """``(host, layout, content, doubtful, template)`` from the sums of each wrapper's slots (at most the wrapper's nodes)."""
    listed = sums.groupBy("host", "layout").agg(F.collect_list(F.struct("slot", "whole", "fixed", "weight", "fixed_weight")).alias("sums"))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                by = np.zeros((4, len(r["signs"])), np.int64)
                for x in r["sums"] or []:
                    by[:, x["slot"]] = x["whole"], x["fixed"], x["weight"], x["fixed_weight"]
                out.append(decide(r["parents"], r["signs"], *by.tolist()))
            content, doubtful, template = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("layout"), pa.array(content, pa.int32()),
                                              pa.array(doubtful, pa.list_(pa.int32())), pa.array(template, pa.bool_())],
                                             names=["host", "layout", "content", "doubtful", "template"])
    d = wrapped.join(listed, ["host", "layout"], "left").select("host", "layout", "parents", "signs", "sums")
    return d.mapInArrow(run, "host string, layout string, content int, doubtful array<int>, template boolean")


def _keeping(shapes: DataFrame) -> DataFrame:
    """``shapes`` with slots, content and doubtful: host, layout, shape, slots, keep (null where the page decides itself)."""
    def run(batches):
        for batch in batches:
            keep = [kept_nodes(r["parents"], r["signs"], r["slots"], r["content"], r["doubtful"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "layout", "shape", "slots")), pa.array(keep, pa.list_(pa.bool_()))],
                                             names=["host", "layout", "shape", "slots", "keep"])
    return shapes.select("host", "layout", "shape", "parents", "signs", "slots", "content", "doubtful").mapInArrow(
        run, "host string, layout string, shape string, slots array<int>, keep array<boolean>")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id_col, url_col, text, n_chars.

    A null or empty page has an empty text.  Pages without a host are learned
    from as pages of one host.  Where the layout's content has no place on a
    page, the page is judged by itself.  Blocks are joined by a line break; white
    space inside one is one space.  Repeated rows and null ids are kept.  No
    rows give no rows.
    """
    key = ["host", "layout", "shape"]
    d = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), url_host(F.col(url_col)).alias("host"))
    parsed = read(d)  # once: the texts are written, as parsing is most of the work
    path = shared_path(pages.sparkSession, "llm", "parsed")
    parsed.write.option("compression", "zstd").parquet(path)
    parsed = pages.sparkSession.read.schema(parsed.schema).parquet(path).withColumn("row", F.monotonically_increasing_id())
    # of copies, the page with the smallest number counts
    drawn = parsed.where(F.size("blocks") > 0).groupBy("host", "layout", "story").agg(F.min(F.struct("row", "shape")).alias("first"))
    drawn = materialise(drawn.select("host", "layout", "first.row", "first.shape"), "drawn")
    # a tree per layout, with the number of distinct pages that have it (0: only copies do)
    every = parsed.groupBy(*key).agg(F.first("parents").alias("parents"), F.first("signs").alias("signs"))
    seen = drawn.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    shapes = materialise(every.join(seen, key, "left").withColumn("n", F.coalesce("n", F.lit(0))), "shapes")
    wrapped = wrappers(shapes)
    placed = materialise(_placed(shapes, wrapped), "slots")

    def counted(b):
        n = F.length(b["text"])
        return F.struct(F.get(F.col("slots"), b["node"]).alias("slot"), F.xxhash64(b["text"]).alias("key"), b["new"].cast("int").alias("held"),
                        n.alias("whole"), b["weight"].alias("weight"))

    slim = parsed.select("row", F.col("blocks").alias("blocks"), *key).join(drawn.select("row"), "row", "left_semi").join(placed, key)
    texts = slim.select("host", "layout", F.inline(F.transform("blocks", counted))).where("slot >= 0")
    texts = texts.groupBy("host", "layout", "slot", "key").agg(*[F.sum(c).alias(c) for c in ("held", "whole", "weight")])
    count = drawn.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("pages"))
    often = F.col("held") >= CONSTANT * F.col("pages")
    texts = materialise(texts.join(count, ["host", "layout"]).withColumn("often", often).drop("pages", "held"), "texts")
    sums = texts.groupBy("host", "layout", "slot").agg(
        F.sum("whole").alias("whole"), F.sum(F.when(F.col("often"), F.col("whole")).otherwise(0)).alias("fixed"),
        F.sum("weight").alias("weight"), F.sum(F.when(F.col("often"), F.col("weight")).otherwise(0)).alias("fixed_weight"))
    decided = materialise(_decided(wrapped, sums), "decided")
    # constant texts of a layout: about the blocks of one page
    template = (texts.where("often").join(decided.where("template").select("host", "layout"), ["host", "layout"])
                .groupBy("host", "layout").agg(F.collect_list(F.struct("slot", "key")).alias("template")))
    keeping = _keeping(shapes.select(*key, "parents", "signs").join(placed, key).join(decided, ["host", "layout"]))
    keeping = materialise(keeping.join(template, ["host", "layout"], "left"), "keeping")
    size = keeping.agg(F.sum(F.lit(200) + F.size("slots") * 5 + F.when(F.col("template").isNotNull(), F.size("template") * 24).otherwise(0))).first()[0]
    out = parsed.select("id", "url", "blocks", *key).join(F.broadcast(keeping) if (size or 0) <= SMALL else keeping, key)

    def kept(b):
        slot = F.get(F.col("slots"), b["node"])
        mine = F.coalesce(F.get(F.col("keep"), b["node"]), b["own"])
        return mine & ~F.coalesce(F.array_contains(F.col("template"), F.struct(slot.alias("slot"), F.xxhash64(b["text"]).alias("key"))), F.lit(False))

    text = F.array_join(F.transform(F.filter("blocks", kept), lambda b: b["text"]), "\n")
    return (out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"))
            .withColumn("n_chars", F.length("text").cast("bigint")))


def induce(pages: list[str]) -> dict:
    """The wrapper of pages of one layout on the driver, as ``extract`` makes it of tables: parents, signs, content, doubtful,
    template (slot and text)."""
    parsed = {}
    for page in map(parse, pages):
        parents, signs, found = page_parts(page)
        if found:
            parsed.setdefault(layout_of(parents, signs, found)[1], (parents, signs, found))
    if not parsed:
        return {"parents": [-1], "signs": ["#root"], "content": 0, "doubtful": [], "template": set()}
    shapes: dict = {}
    for p, s, _ in parsed.values():
        shapes[tuple(p), tuple(s)] = shapes.get((tuple(p), tuple(s)), 0) + 1
    parents, signs, _, _ = fold([(list(p), list(s), [n] * len(s), n) for (p, s), n in shapes.items()])
    held: dict = {}
    by = np.zeros((4, len(signs)), np.int64)
    for p, s, found in parsed.values():
        at = slots((parents, signs), p, s)
        for slot, text in {(at[node], text) for node, text, _ in found}:
            held[slot, text] = held.get((slot, text), 0) + 1
    often = {k for k, n in held.items() if k[0] >= 0 and n >= CONSTANT * len(parsed)}
    for p, s, found in parsed.values():
        at = slots((parents, signs), p, s)
        for node, text, linked in found:
            if at[node] >= 0:
                same = (at[node], text) in often
                by[:, at[node]] += len(text), same * len(text), _weight(text, linked), same * _weight(text, linked)
    content, doubtful, template = decide(parents, signs, *by.tolist())
    return {"parents": parents, "signs": signs, "content": content, "doubtful": doubtful, "template": often if template else set()}


def main_text(html: str | None, wrapper: dict) -> str:
    """The page's main text by a wrapper of ``induce``."""
    parents, signs, found = page_parts(parse(html))
    at = slots((wrapper["parents"], wrapper["signs"]), parents, signs)
    keep = kept_nodes(parents, signs, at, wrapper["content"], wrapper["doubtful"]) or own_text(parents, signs, found)
    return "\n".join(text for node, text, _ in found if keep[node] and (at[node], text) not in wrapper["template"])
