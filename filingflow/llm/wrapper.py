"""Main text of web pages by wrapper induction.

Pages of one host are aligned as trees: simple tree matching pairs the nodes of two trees in order, and a merged tree keeps for each
node on how many pages it stands and which texts stood in it on every one of these. What stays the same is template, varying slots are
content. Each task merges the pages that it reads, then Spark merges the trees of a host in three rounds by groups of tasks, so that no
task holds a host's pages. A tree keeps every node, also those of few pages, since more may follow; it grows with what is different in
a host's pages. Of each page, the blocks that are
neither template nor furniture (menus, page headers and footers, sidebars, notices, adverts, forms, comments, by tag, role or name) are
taken, in whole and in page order. Where an article or main element holds most of them, it is the content, its own header included, and
in it only whole names such as "comments" or "ad" mark furniture.

Inside an article a text is template if it stands on all of four pages or more and such texts are the smaller part (copies of one
article are no template); elsewhere three pages do. Runs of like siblings are one repeated node, which keeps trees small. A null html
is an empty page, a null or strange url a host of its own ''. A page of which nothing varies falls back on all that isn't furniture.
Elements deeper than DEPTH are aligned with their ancestor at that depth; their text is read all the same. Repeated rows each give
their own row.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingflow.llm.common import cut

# How HTML's elements behave.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}}
FURNITURE = {"nav", "header", "footer", "aside", "form", "button", "select", "input", "label", "menu", "dialog", "fieldset", "head", "search", *RAW}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebars?|side-bar|header|masthead|footer|foot|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscri\w*|comments?|disqus|replies|respond|share|sharing|social|related|recommend\w*|widgets?|login|signup|search\w*|pagination|pager|toolbar|skip\w*)(?=$|[\s_-])", re.IGNORECASE)

#: Names that mark furniture inside an article as well, where they are a whole class or id.
WHOLE_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo", "nav", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "cookies", "cookie-notice", "consent", "notice", "popup", "modal", "newsletter", "comment", "comments", "comment-list", "disqus", "replies", "share", "sharing", "social", "related", "recommended", "widget", "footer", "pagination", "pager", "toolbar"}
MARKED = ("article", "main")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"


class Node:
    """An element, or with tag '' a text. furniture: 2 if its tag, role or whole name says that it is no content anywhere, 1 if a part
    of its name says so outside articles, 0 else."""

    __slots__ = ("tag", "label", "furniture", "parent", "children", "text")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "", text: str = ""):
        self.tag, self.parent, self.children, self.text = tag, parent, [], text
        self.label, self.furniture = tag, (1 if tag == "header" else 2) if tag in FURNITURE else 0
        if attributes and "=" in attributes:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            self.label = f"{tag}.{'.'.join(sorted(found.get('class', '').split()))}" if found.get("class") else tag
            if tag not in ("html", "body", *MARKED):
                names = [x for k in ("class", "id") for x in found.get(k, "").split()]
                if found.get("role", "").lower() in ROLES or any(x.lower() in WHOLE_NAMES for x in names):
                    self.furniture = 2
                elif not self.furniture and NAMES.search(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", " ".join(names))):
                    self.furniture = 1


def parse(page: str) -> Node:
    """The page as a tree, with the end tags that HTML lets authors leave out."""
    root = top = Node("#root", None)
    at = 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            top.children.append(Node("", top, text=page[at : m.start()]))
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            node = top
            while node.parent and node.tag != tag:
                node = node.parent
            if node.parent and (tag in BLOCK or not _blocked(top, node)):
                top = node.parent
            continue
        top = _place(top, tag)
        node = Node(tag, top, attributes)
        top.children.append(node)
        if tag in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (attributes.rstrip().endswith("/") and tag not in BLOCK):
            top = node
    if at < len(page):
        top.children.append(Node("", top, text=page[at:]))
    return root


def _blocked(top: Node, node: Node) -> bool:
    while top is not node:
        if top.tag in BLOCK:
            return True
        top = top.parent
    return False


def _place(top: Node, tag: str) -> Node:
    """Where a new element goes: open paragraphs end before a block, list items and cells before the next."""
    if tag in BLOCK:
        node = top
        while node.parent and (node.tag not in BLOCK or node.tag == "p"):
            if node.tag == "p":
                top = node.parent
                break
            node = node.parent
    if tag in CLOSES:
        node = top
        while node.parent and node.tag not in SCOPES.get(tag, ()):
            if node.tag in CLOSES[tag]:
                top = node.parent
            node = node.parent
    return top


OPEN, CLOSE, BREAK, TEXT = range(4)


def events(root: Node, furniture: int) -> Iterator[tuple]:
    """(kind, node or text, whether in a link) in page order: blocks open and close, texts between. Furniture of that degree and up
    is left out; where it was, a block ends."""
    stack = [(root, False, False)]
    while stack:
        x, ended, linked = stack.pop()
        if ended:
            yield CLOSE, x, linked
        elif x.tag == "" or x.tag == "br":
            yield TEXT, x.text or " ", linked
        elif x.tag in RAW or (x is not root and x.furniture >= furniture):
            if x.tag in BLOCK:
                yield BREAK, x, linked
        else:
            linked = linked or x.tag == "a"
            if x.tag in BLOCK or x is root:
                yield OPEN, x, linked
                stack.append((x, True, linked))
            stack += [(c, False, linked) for c in reversed(x.children)]


#: How deep elements are aligned.
DEPTH = 64


def below(path: int, label: str) -> int:
    """The number of a path of labels that goes on with a label."""
    return zlib.crc32(label.encode("utf-8", "replace"), path)


def digest(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def squashed(run: list[str]) -> str:
    return " ".join(entities.unescape("".join(run)).split())


def blocks(root: Node, furniture: int, path: int = 0, depth: int = 0) -> list[tuple[int, str, bool]]:
    """(number of the path of labels, text, whether in links only) of each block below a node, white space turned into single spaces."""
    out, paths, run, plain = [], [path], [], False
    for kind, x, linked in events(root, furniture):
        if kind == TEXT:
            run.append(x)
            plain = plain or not (linked or x.isspace())
            continue
        if run and (text := squashed(run)):
            out.append((paths[-1], text, not plain))
        run, plain = [], False
        if kind == OPEN:
            paths.append(below(paths[-1], x.label) if depth + len(paths) <= DEPTH else paths[-1])
        elif kind == CLOSE:
            paths.pop()
    return out


# A template node: [label, pages, digests of the texts that it has on all of them, children].
LABEL, PAGES, COMMON, KIDS = range(4)


def skeleton(root: Node) -> list:
    """The tree of a page's blocks with the digests of their own texts; runs of like siblings are one node."""
    top = [root.label, 1, set(), []]
    path, run = [top], []
    for kind, x, _ in events(root, 3):
        if kind == TEXT:
            run.append(x)
            continue
        if run and (text := squashed(run)):
            path[-1][COMMON].add(digest(text))
        run = []
        if kind == OPEN and x is not root:
            if len(path) < DEPTH:
                path[-1][KIDS].append([x.label, 1, set(), []])
                path.append(path[-1][KIDS][-1])
            else:
                path.append(path[-1])
        elif kind == CLOSE and x is not root:
            node = path.pop()
            if node is not path[-1]:
                node[COMMON], node[KIDS] = sorted(node[COMMON]), _folded(node[KIDS])
    top[COMMON], top[KIDS] = sorted(top[COMMON]), _folded(top[KIDS])
    return top


def _folded(kids: list) -> list:
    out: list = []
    for k in kids:
        if out and out[-1][LABEL] == k[LABEL]:
            out[-1] = merged(out[-1], k, same_page=True)
        else:
            out.append(k)
    return out


def simple_tree_matching(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Size of the largest top-down order-keeping match of two trees, and the pairs of children that it uses."""
    if a[LABEL] != b[LABEL]:
        return 0, []
    m, n = len(a[KIDS]), len(b[KIDS])
    own = [[simple_tree_matching(x, y)[0] for y in b[KIDS]] for x in a[KIDS]]
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + own[i][j])
    pairs, i, j = [], m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return best[m][n] + 1, pairs[::-1]


def merged(a: list, b: list, same_page: bool = False) -> list:
    """Two aligned trees as one: of matched nodes the texts that both have (on one page: that either has) stay, others are kept in
    order."""
    _, pairs = simple_tree_matching(a, b)
    kids, i, j = [], 0, 0
    for x, y in [*pairs, (len(a[KIDS]), len(b[KIDS]))]:
        kids += a[KIDS][i:x] + b[KIDS][j:y]
        if x < len(a[KIDS]):
            kids.append(merged(a[KIDS][x], b[KIDS][y], same_page))
        i, j = x + 1, y + 1
    common = sorted(set(a[COMMON]) | set(b[COMMON])) if same_page else sorted(set(a[COMMON]) & set(b[COMMON]))
    pages = max(a[PAGES], b[PAGES]) if same_page else a[PAGES] + b[PAGES]
    return [a[LABEL], pages, common, _folded(kids) if same_page else kids]


#: Pages on which a text must stand to be template: inside an article, and elsewhere.
INSIDE_PAGES, PAGES_ELSEWHERE = 4, 3


def template_texts(tree: list) -> list[list[int]]:
    """[path, digest, pages] of the texts that stand on every page that has their node, and at least on half of the host's pages."""
    out, stack = [], [(tree, 0)]
    while stack:
        node, path = stack.pop()
        path = below(path, node[LABEL])
        if node[PAGES] >= PAGES_ELSEWHERE and node[PAGES] * 2 >= tree[PAGES]:
            out += [[path, d, node[PAGES]] for d in node[COMMON]]
        stack += [(k, path) for k in node[KIDS]]
    return sorted(out)


def marked_roots(root: Node) -> list[tuple[Node, int, int]]:
    """The outermost main elements, else the outermost articles, outside furniture; with the number of the path to each and its depth."""
    found: dict[str, list] = {"main": [], "article": []}
    stack = [(root, 0, 0)]
    while stack:
        x, path, depth = stack.pop()
        if x.tag in MARKED:
            found[x.tag].append((x, path, depth))
            if x.tag == "main":
                continue
        if x.tag == "" or (x.furniture and x is not root):
            continue
        own = below(path, x.label) if (x.tag in BLOCK or x is root) and depth < DEPTH else path
        stack += [(c, own, depth + (x.tag in BLOCK or x is root)) for c in reversed(x.children)]
    outermost = lambda nodes: [n for n in nodes if not any(_inside(n[0], m[0]) for m in nodes)]
    return found["main"] or outermost(found["article"])


def _inside(node: Node, other: Node) -> bool:
    while node.parent:
        node = node.parent
        if node is other:
            return True
    return False


def main_text(page: str | None, template: dict[tuple[int, int], int]) -> str:
    """template: how many pages each (path, digest) of the host stands on."""
    if not page:
        return ""
    root = parse(page)
    everywhere = blocks(root, 1)
    varying = [(p, t, links) for p, t, links in everywhere if (p, digest(t)) not in template and not links]
    total = sum(len(t) for _, t, _ in varying)
    inside = [b for n, path, depth in marked_roots(root) for b in blocks(n, 2, path, depth)]
    if inside and 2 * sum(len(t) for p, t, links in inside if not links and (p, digest(t)) not in template) >= total:
        constant = [template.get((p, digest(t)), 0) >= INSIDE_PAGES for p, t, _ in inside]
        few = 3 * sum(len(t) for (_, t, _), c in zip(inside, constant) if c) <= sum(len(t) for _, t, _ in inside)
        return "\n".join(t for (_, t, _), c in zip(inside, constant) if not (c and few))
    return "\n".join(t for _, t, _ in varying or everywhere)


#: Tasks whose trees of a host are merged in one group in the first round, and groups in the next.
GROUP = 64
#: Hosts that a task holds before it sends their trees off.
HELD_HOSTS = 2000


def _merge_rounds(partial: DataFrame) -> DataFrame:
    """(host, tree) from (host, task, tree): trees of a host merged by groups of tasks, groups of these, then all."""

    def merge(batch: pa.Table) -> pa.Table:
        out = None
        for t in sorted(batch.column("tree").to_pylist()):
            out = merged(out, json.loads(t)) if out else json.loads(t)
        return pa.table({"host": [batch.column("host")[0].as_py()], "task": pa.array([batch.column("task")[0].as_py()], pa.int32()), "tree": [json.dumps(out)]})

    for group in (F.expr(f"task div {GROUP}"), F.expr(f"task div {GROUP * GROUP}"), F.lit(0)):
        partial = partial.groupBy("host", group.cast("int").alias("grouped")).applyInArrow(lambda b: merge(b), "host string, task int, tree string")
    return partial


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (host, template, pages): the template texts of each host, as JSON."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = TaskContext.get().partitionId(), {}

        def flush() -> pa.RecordBatch:
            names = sorted(held)
            return pa.RecordBatch.from_pydict({"host": pa.array(names, pa.string()), "task": pa.array([task] * len(names), pa.int32()), "tree": pa.array([json.dumps(held[h]) for h in names], pa.string())})

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = skeleton(parse(page))
                held[host] = merged(held[host], own) if host in held else own
                if len(held) >= HELD_HOSTS:
                    yield flush()
                    held.clear()
        yield flush()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [json.loads(t) for t in batch.column("tree").to_pylist()]
            yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "template": pa.array([json.dumps(template_texts(t)) for t in trees], pa.string()), "pages": pa.array([t[PAGES] for t in trees], pa.int64())})

    rows = pages.where(F.col(html_col).isNotNull()).select(host_of(url_col).alias("host"), F.col(html_col).cast("string"))
    return _merge_rounds(rows.mapInArrow(partial, "host string, task int, tree string")).select("host", "tree").mapInArrow(choose, "host string, template string, pages bigint")


def host_of(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), HOST, 1), F.lit("")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = 50_000) -> DataFrame:
    """Rows (page_id, url, text, n_chars) for every page. Up to broadcast_hosts hosts, the templates are broadcast; beyond, joined."""
    own = cut(templates(pages, url_col, html_col).where("template != '[]'").select("host", "template"))
    few = own.limit(broadcast_hosts + 1).count() <= broadcast_hosts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = {}, None
        for batch in batches:
            out = []
            for page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if template != last:
                    last, known = template, {(p, d): n for p, d, n in json.loads(template or "[]")}
                out.append(main_text(page, known))
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(out, pa.string()), "n_chars": pa.array(map(len, out), pa.int64())})

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(url_col).alias("host"))
    joined = rows.join(F.broadcast(own) if few else own, "host", "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
