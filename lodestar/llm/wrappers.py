"""Main text of web pages by wrapper induction: DOM trees of a host's pages are aligned into one wrapper, whose nodes are told apart.

Pages of a host go in groups of about GROUP.  Each page's tree of blocks is laid over the group's
wrapper by simple tree matching (the largest number of pairs of nodes with equal labels that keeps
order and ancestors); what has no partner is added to the wrapper, neighbours with one label (items of a
list, paragraphs) share a node.  A wrapper's node knows then what it held on each page: a node
that says the same on most of them is template, one whose text is all links a menu, one that is
named as one a menu, header, footer, advert, form or the like, and a varying one a slot for
content.  A page's text is read through the nodes that its own blocks were laid on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_rows, written
from lodestar.session import few

#: Pages and characters of a group: what one task aligns at a time.
GROUP, GROUP_CHARS = 32, 16 << 20
#: Depth beyond which elements are siblings of their ancestors.
DEEPEST = 200
#: Pairs of children beyond which two lists are aligned row by row in arrays, with the same result.
MOST_PAIRS = 250_000
#: Distinct pages, and the share of them, that must say the same for a node to be template; share of a node's text in links that makes a menu.
LEAST_PAGES, SAME, LINKED = 3, 0.5, 0.6

# Elements of HTML by what they do to the text around them.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
UNSEEN = frozenset("audio button canvas datalist head map object select svg video".split())
SPACED = frozenset("br td th".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: An element's start ends open ones of these, up to the given ancestors.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Names of what isn't the article.
CHROME_TAGS = frozenset("aside dialog footer form menu nav search".split()) | UNSEEN
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
CHROME_NAMES = frozenset(
    """ad ads advert advertisement advertisements adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter
    notice notices overlay pager pagination popup promo recommended related respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets""".split()
)
HEADER_NAMES = frozenset(["header"])

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:"[^"]*"|'[^']*')?)*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|href)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}
_DIGITS = re.compile(r"\d+")


class Node:
    """A block of a page: its label, and its texts (text, linked or not) and blocks in order."""

    __slots__ = ("tag", "label", "kind", "parts", "laid")

    def __init__(self, tag: str, label: str, kind: str):
        self.tag, self.label, self.kind, self.parts, self.laid = tag, label, kind, [], None

    def nodes(self) -> list[Node]:
        return [p for p in self.parts if type(p) is Node]


def _named(token: str, names: frozenset) -> bool:
    words = re.split(r"[-_]+", token.lower())
    return words[0] in names or (words[-1] in names and words[0] not in ("has", "no", "with", "without", "is"))


def _start(tag: str, attributes: str) -> tuple[str, str, bool]:
    """(label, kind, whether it links) of an element; kind is '', 'chrome', 'header', 'article' or 'main'."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
    tokens, role = [*found.get("class", "").split(), *found.get("id", "").split()], found.get("role", "").lower()
    label = " ".join([tag, *sorted(_DIGITS.sub("", t) for t in tokens)]) if tokens else tag
    if tag in CHROME_TAGS or role in CHROME_ROLES or (tag not in ("html", "body", "main") and any(_named(t, CHROME_NAMES) for t in tokens)):
        kind = "chrome"
    elif tag == "header" or (tag not in ("html", "body", "main", "article") and tag not in HEADINGS and any(_named(t, HEADER_NAMES) for t in tokens)):
        kind = "header"
    else:
        kind = "article" if tag == "article" or role == "article" else "main" if tag == "main" or role == "main" else ""
    return label, kind, tag == "a" and "href" in found


def parse(html: str) -> Node:
    """A page's blocks as a tree; inline elements are part of their block's text, and elements left open end where their parents do."""
    root = Node("", "", "")
    stack, too_deep, linked, at = [root], Counter(), False, 0

    def text(raw: str) -> None:
        if raw:
            if stack[-1].tag == "head" and not raw.isspace():
                stack.pop()
            stack[-1].parts.append((unescape(raw) if "&" in raw else raw, linked))

    def close(tags: tuple, within: tuple) -> None:
        """End the innermost open element of tags, and all in it, unless one of within is nearer."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in within:
                return

    while at < len(html):
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                linked = False
            if tag in SPACED:
                stack[-1].parts.append((" ", False))
            if too_deep[tag]:
                too_deep[tag] -= 1
            elif tag in BLOCKS or tag in UNSEEN:
                close((tag,), ())
                linked = False
            else:  # an inline element that is a node of its own ends no block
                close((tag,), tuple(BLOCKS))
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            stack.pop()
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.start() if end else len(html)
            continue
        if tag in SPACED:
            stack[-1].parts.append((" ", False))
        label, kind, links = _start(tag, m[3])
        linked = links or linked
        if tag in BLOCKS:
            close(("p",), ("button", "object", "table"))
            if tag in ENDS:
                close(*ENDS[tag])
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                stack.pop()
        if tag in VOID:
            if tag in BLOCKS:
                stack[-1].parts.append(Node(tag, label, kind))
        elif tag in BLOCKS or tag in UNSEEN or (kind and not m[3].rstrip().endswith("/")):
            node = Node(tag, label, kind)
            stack[-1].parts.append(node)
            if len(stack) < DEEPEST:
                stack.append(node)
            else:
                too_deep[tag] += 1
    return root


class Wrapper:
    """A node of what a group's pages have in common, and what they held there."""

    __slots__ = ("label", "kind", "children", "said", "pages", "chars", "linked", "content")

    def __init__(self, label: str, kind: str):
        self.label, self.kind, self.children, self.said, self.pages, self.chars, self.linked, self.content = label, kind, [], Counter(), 0, 0, 0, True


Run = tuple[str, list[Node]]


def _runs(node: Node) -> list[Run]:
    """A block's blocks, neighbours of one label together."""
    out: list[Run] = []
    for child in node.nodes():
        if out and out[-1][0] == child.label:
            out[-1][1].append(child)
        else:
            out.append((child.label, [child]))
    return out


def match(children: list[Wrapper], runs: list[Run], known: dict) -> tuple[int, list[tuple[int, int]]]:
    """(weight, pairs): simple tree matching of two lists of children; the pairs of nodes below them weigh, too."""
    if not children or not runs:
        return 0, []
    if len(children) * len(runs) > MOST_PAIRS:
        return _match_long(children, runs, known)
    best = [[0] * (len(runs) + 1) for _ in range(len(children) + 1)]
    for i, w in enumerate(children):
        for j, (label, nodes) in enumerate(runs):
            most = max(best[i][j + 1], best[i + 1][j])
            if w.label == label:
                most = max(most, best[i][j] + _weight(w, nodes[0], known))
            best[i + 1][j + 1] = most
    pairs, i, j = [], len(children), len(runs)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return best[-1][-1], pairs[::-1]


def _shape(node: Wrapper | Node, shapes: dict) -> int:
    """A number for all that _weight() asks of a node: its label, and the shapes of its wrapper's children or of its runs' first blocks."""
    below = node.children if type(node) is Wrapper else [nodes[0] for _, nodes in _runs(node)]
    return shapes.setdefault((node.label, *(_shape(n, shapes) for n in below)), len(shapes))


def _match_long(children: list[Wrapper], runs: list[Run], known: dict) -> tuple[int, list[tuple[int, int]]]:
    """match() of long lists: the same table, a row at a time as an array, and the same way back through it.

    Nodes of one shape weigh the same.  Every step-th row is kept, and the rows between are made again on the way back, so that
    memory grows with the table's side to the power of 1.5; time grows with all pairs.
    """
    shapes: dict[tuple, int] = {}
    mine, theirs = [_shape(w, shapes) for w in children], [_shape(nodes[0], shapes) for _, nodes in runs]
    first = {s: nodes[0] for s, (_, nodes) in zip(reversed(theirs), reversed(runs))}
    kinds = {s: n for n, s in enumerate(first)}
    of = np.array([kinds[s] for s in theirs])
    weights: dict[int, np.ndarray | None] = {}
    for s, w in zip(mine, children):
        if s not in weights:
            row = np.array([_weight(w, node, known) if node.label == w.label else 0 for node in first.values()], np.int32)
            weights[s] = row if row.any() else None

    def next_row(i: int, above: np.ndarray) -> np.ndarray:
        if weights[mine[i]] is None:
            return above
        row = above.copy()
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + weights[mine[i]][of]), out=row[1:])
        return row

    step, kept, row = isqrt(len(children)) + 1, [], np.zeros(len(runs) + 1, np.int32)
    for i in range(len(children)):
        if i % step == 0:
            kept.append(row)
        row = next_row(i, row)
    pairs, i, j = [], len(children), len(runs)
    while i and j:
        start = (i - 1) // step * step
        best = [kept[start // step]]
        for at in range(start, i):
            best.append(next_row(at, best[-1]))
        while i > start and j:
            here, above = best[i - start], best[i - start - 1]
            if here[j] == above[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
    return int(row[-1]), pairs[::-1]


def _weight(w: Wrapper, node: Node, known: dict) -> int:
    """Pairs that the trees below w and node can form at most, with them."""
    key = id(w), id(node)
    if key not in known:
        known[key] = 1 + match(w.children, _runs(node), known)[0]
    return known[key]


def lay(w: Wrapper, nodes: list[Node], counts: bool) -> None:
    """Lay a run of a page's blocks on a wrapper's node, and what is in them on the nodes below, which grow by what has no partner.

    counts: whether the page adds to what the wrapper knows; copies of a page don't.
    """
    if counts:
        own = [(t, linked) for n in nodes for p in n.parts if type(p) is tuple for t, linked in [p]]
        said = " ".join("".join(t for t, _ in own).split())
        if said:
            w.pages += 1
            w.said[said] += 1
            w.chars += sum(len(t) for t, _ in own)
            w.linked += sum(len(t) for t, linked in own if linked)
    for node in nodes:
        node.laid = w
        runs = _runs(node)
        pairs = dict((j, i) for i, j in match(w.children, runs, {})[1])
        grown, last = [], 0
        for j, (label, below) in enumerate(runs):
            if j in pairs:
                grown += w.children[last : pairs[j] + 1]
                last = pairs[j] + 1
            else:
                grown.append(Wrapper(label, below[0].kind))
            runs[j] = grown[-1], below
        w.children = grown + w.children[last:]
        for child, below in runs:
            lay(child, below, counts)


def label(w: Wrapper, inside: bool = False) -> None:
    """Tell slots for content from template, node by node."""
    inside = inside or w.kind in ("article", "main")
    same = w.pages >= LEAST_PAGES and w.said.most_common(1)[0][1] > SAME * w.pages
    menu = w.chars and w.linked > LINKED * w.chars
    w.content = inside or not (same or menu)
    for child in w.children:
        label(child, inside)


def _all(node: Node) -> Iterator[Node]:
    waiting = [node]
    while waiting:
        now = waiting.pop()
        yield now
        waiting += now.nodes()


def _holds_article(node: Node) -> bool:
    return any(n.kind in ("article", "main") or n.tag == "h1" for n in _all(node) if n is not node)


def read(root: Node) -> str:
    """A page's content blocks: within its articles, or else its main part, if it has one, the slots of its wrapper that are content."""
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        said = " ".join("".join(now).split())
        if said:
            blocks.append(said)
        now.clear()

    def hidden(node: Node, inside: bool) -> bool:
        if node.tag == "form" and node.kind == "chrome" and _holds_article(node):
            return False
        return node.kind == "chrome" or (node.kind == "header" and not inside)

    def regions(node: Node) -> set[str]:
        found = {node.kind}
        for n in node.nodes():
            if not hidden(n, True):
                found |= regions(n)
        return found

    def walk(node: Node, wanted: str, inside: bool) -> None:
        inside = inside or (wanted != "" and node.kind == wanted)
        breaks = node.tag in BLOCKS
        if breaks:
            flush()
        shown = node.laid.content and (inside or not wanted)
        for part in node.parts:
            if type(part) is Node:
                if not hidden(part, inside or part.kind in ("article", "main")):
                    walk(part, wanted, inside)
            elif shown:
                now.append(part[0])
        if breaks:
            flush()

    there = regions(root)
    walk(root, "article" if "article" in there else "main" if "main" in there else "", False)
    flush()
    return "\n\n".join(blocks)


def extract(pages: list[str]) -> list[str]:
    """The main texts of pages of one host, aligned with each other; the longest is the first to be laid down."""
    trees = [parse(p) for p in pages]
    wrapper, seen = Wrapper("", ""), set()
    for i in sorted(range(len(pages)), key=lambda i: (-len(pages[i]), pages[i])):
        lay(wrapper, [trees[i]], pages[i] not in seen)
        seen.add(pages[i])
    label(wrapper)
    return [read(t) for t in trees]


#: A url's host: behind the scheme and a user's name, before a port.
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page: its article's blocks in order, parted by an empty line.

    Null and empty pages, and those without any content, have an empty text.  Pages
    without a url that names a host are taken as of one host.  A host's pages are dealt by
    their hashes to groups of about GROUP pages and GROUP_CHARS characters, so that a host of
    any size spreads over all tasks; in a group, copies of a page count once.  Alone on its host, a page is told by its own
    names and links.  Rows that share an id are pages each; columns of other names go.  Elements nested more than
    DEEPEST deep count as siblings, none of their text is lost.
    """
    arrow_rows(pages.sparkSession)
    given = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"))
    given = given.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", _HOST, 1)), F.lit("")))
    parts = F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum(F.length("html")) / GROUP_CHARS)).cast("long")
    large = written(given.groupBy("host").agg(parts.alias("parts")).where("parts > 1"), "hosts")
    dealt = given.join(few(large), "host", "left").withColumn("group", F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("parts", F.lit(1))))

    def run(group: pa.Table) -> pa.Table:
        texts = extract(group["html"].to_pylist())
        return pa.table({"page_id": group["page_id"], "url": group["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return dealt.select("page_id", "url", "html", "host", "group").groupBy("host", "group").applyInArrow(run, "page_id long, url string, text string, n_chars long")
