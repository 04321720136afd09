"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every element that holds text and every block of text is a node with a hidden label, content or boilerplate. A label emits the node's
features (its kind, by its tag or by boilerplate words among tag, class, id and role; the share of its text in links; the length of a text), and
parent-child potentials, by the kind of the parent and of the child, tie the labels of neighbours. Messages pass from the leaves up and from the root down (sum-product), which
gives the exact marginal of every node; blocks whose content marginal is above one half are the page's text.

Emissions and potentials are counted over labelled pages: at most SAMPLE pages, those with the smallest hash of their id, whose
nodes are labelled by their own markup (inside an article or main element and not inside an element with a boilerplate word);
each is also counted in two altered forms, see :func:`variants`.
The model is a table of a few hundred numbers.

Rules: null html is empty and has no text. Character references are decoded; white space inside a block becomes one space; blocks are
joined in page order by line ends; ``br`` counts as white space. Broken markup is read as browsers do where it matters here:
unclosed blocks end with the next one, a head ends with the first tag or text that cannot be in one, and what is never closed ends with
the page. Only scripts, styles, templates and titles of pages are no text; the model judges all else. Repeated rows are extracted each. Empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auxoline.llm.registry import query, table

#: Most labelled pages that the model is counted on.
SAMPLE = 2000
SMOOTH = 0.5
#: HTML's elements without content, elements whose text is not page text, what may be in a head, and elements that end a block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template title".split())
HEAD = frozenset("head script style template title noscript base basefont bgsound link meta".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td textarea tfoot th thead tr ul".split())
#: Words that name boilerplate when they appear as a tag or among class, id or role.
BOILER = frozenset("ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs button comment comments complementary contentinfo cookie cookies disqus feedback footer form header menu navbar nav navigation newsletter notice notices popup promo promoted recommended related reply replies search share sharing sidebar signup social sponsor sponsored subscribe widget".split())
MAIN = frozenset("article main articlebody".split())
#: Elements that an opening tag ends, up to the nearest element given second.
ENDS = {"p": ({"p"}, {"table", "td", "th", "button"}), "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select", "datalist"})}
_P_ENDERS = BLOCKS - {"body", "html", "button", "tr", "td", "th", "li", "dt", "dd", "caption", "tbody", "thead", "tfoot", "legend", "textarea", "option", "optgroup"}
#: Parts of a drawing whose texts are apart from each other.
APART = frozenset("desc text title".split())
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "names", "parent", "children", "chars", "links", "text", "hides")

    def __init__(self, tag: str, names: frozenset, parent: Node | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.children: list[Node] = []
        self.chars = self.links = 0
        self.hides = False
        self.text: str | None = None


class PageTree(HTMLParser):
    """The tree of a page; blocks of text are leaves with tag ``#text``, in page order in ``blocks``."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#page", frozenset(), None)
        self.blocks: list[Node] = []
        self.part: list[str] = []
        self.in_link = self.link_chars = self.hidden = self.drawn = self.heads = 0
        # The open elements from the page down, and the depths at which each tag is open: no look at a tag walks to the root.
        self.path: list[Node] = []
        self.open: defaultdict[str, list[int]] = defaultdict(list)
        self.feed(html)
        self.close()
        self.end_block()

    def end_block(self) -> None:
        text = _SPACE.sub(" ", "".join(self.part)).strip()
        if text:
            depth = max((depths[-1] for t in BLOCKS if (depths := self.open.get(t))), default=-1)
            holder = self.path[depth] if depth >= 0 else self.root
            leaf = Node("#text", holder.names, holder)
            leaf.text, leaf.chars, leaf.links = text, len(text), min(self.link_chars, len(text))
            holder.children.append(leaf)
            self.blocks.append(leaf)
        self.part.clear()
        self.link_chars = 0

    def leave(self, node: Node) -> None:
        """Close everything inside ``node`` and itself."""
        while True:
            here = self.at
            self.hidden -= here.hides
            self.drawn -= here.tag == "svg"
            self.heads -= here.tag == "head"
            self.in_link -= here.tag == "a"
            if self.drawn and here.tag in APART:
                self.part.append(" ")
            if here.tag in BLOCKS:
                self.end_block()
            if here.parent is not None:
                self.path.pop()
                self.open[here.tag].pop()
            self.at = here.parent or here
            if here is node or here.parent is None:
                return

    def up_to(self, tags: frozenset | set, stop: frozenset | set) -> Node | None:
        """The outermost open element of ``tags`` inside the innermost one of ``stop`` (or template)."""
        barrier = max((depths[-1] for t in (*stop, "template") if (depths := self.open.get(t))), default=-1)
        found = [depths[k] for t in tags if (depths := self.open.get(t)) and (k := bisect_right(depths, barrier)) < len(depths)]
        return self.path[min(found)] if found else None

    def end_head(self) -> None:
        """Close an open head, unless something hidden is open in it."""
        if self.heads and not self.hidden and (head := self.up_to({"head"}, set())) is not None:
            self.leave(head)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in HEAD:
            self.end_head()
        if tag in VOID:
            if tag == "br":
                self.part.append(" ")
            elif tag == "hr":
                self.end_block()
            return
        if tag == "body" and self.hidden:
            while self.hidden and self.at.parent is not None:
                self.leave(self.at)
        tags, stop = ENDS.get(tag, ({"p"} if tag in _P_ENDERS else set(), {"table", "td", "th", "button"}))
        if tags and (old := self.up_to(tags, stop)) is not None:
            self.leave(old)
        if tag in BLOCKS:
            self.end_block()
        names = frozenset(_WORD.findall(" ".join(v.lower() for k, v in attrs if v and k in ("class", "id", "role", "itemprop")))) if attrs else frozenset()
        node = Node(tag, names | {tag}, self.at)
        self.at.children.append(node)
        self.open[tag].append(len(self.path))
        self.path.append(node)
        self.at = node
        # The title of a drawing is not the title of the page.
        node.hides = tag in HIDDEN and not (tag == "title" and self.drawn)
        self.hidden += node.hides
        self.drawn += tag == "svg"
        self.heads += tag == "head"
        self.in_link += tag == "a"
        if self.drawn and tag in APART:
            self.part.append(" ")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and self.up_to({"p"}, set()) is None:
            self.end_block()
        if depths := self.open.get(tag):
            self.leave(self.path[depths[-1]])

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            if not data.isspace():
                self.end_head()
            self.part.append(data)
            if self.in_link:
                self.link_chars += len(data)


def kind_of(node: Node) -> str:
    tag = node.tag
    if tag != "#text" and node.names & (MAIN | BOILER):
        return "boiler" if node.names & BOILER else "main"
    if tag in ("#page", "html"):
        return "body"
    return "h" if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else tag if tag in ("#text", "p", "li", "ul", "div", "section", "table", "td", "body", "blockquote", "a", "pre") else "other"


def nodes_of(tree: PageTree) -> list[Node]:
    """The nodes that hold text, parents before children, with their text and link lengths summed."""
    order, stack = [], [tree.root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(node.children))
    for node in reversed(order):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.links += node.links
    return [n for n in order if n.chars]


def features(node: Node) -> tuple[str, ...]:
    share, kind = node.links / node.chars, kind_of(node)
    links = f"links {0 if share < 0.1 else 1 if share < 0.6 else 2}"
    if kind == "#text":
        return f"kind {kind}", links, f"length {0 if node.chars < 30 else 1 if node.chars < 200 else 2}"
    return f"kind {kind}", links


def pair_kind(parent: Node, child: Node) -> str:
    """What the potentials of a parent and its child depend on: the parent's kind, and whether the child is named as boilerplate."""
    return f"{kind_of(parent)} {kind_of(child) == 'boiler'}"


def markup_labels(nodes: list[Node]) -> list[int]:
    """1 for nodes inside a main element and outside boilerplate, by the page's own markup."""
    label: dict[int, tuple[bool, bool]] = {}
    out = []
    for node in nodes:
        main, boiler = label.get(id(node.parent), (False, False))
        main, boiler = main or bool(node.names & MAIN), boiler or (node.tag != "#text" and bool(node.names & BOILER))
        label[id(node)] = main, boiler
        out.append(int(main and not boiler))
    return out


class TreeModel:
    """Log emissions of features and log potentials of parent and child labels, from counts. Values never counted say nothing."""

    def __init__(self, counts: dict[str, float]):
        seen = Counter(counts)
        groups: dict[str, set[str]] = {}
        for key in counts:
            if key.startswith("f "):
                groups.setdefault(key.split(" ")[2], set()).add(key[4:])
        self.emit: dict[str, tuple[float, float]] = {}
        for group, names in groups.items():
            total = [sum(seen[f"f {y} {n}"] for n in names) + SMOOTH * (len(names) + 1) for y in (0, 1)]
            for n in names:
                self.emit[n] = tuple(math.log((seen[f"f {y} {n}"] + SMOOTH) / total[y]) for y in (0, 1))
        kinds = {key.split(" ", 1)[1].rsplit(" ", 2)[0] for key in counts if key.startswith("t ")}
        self.pair = {k: [[math.log((seen[f"t {k} {p} {c}"] + SMOOTH) / (seen[f"t {k} {p} 0"] + seen[f"t {k} {p} 1"] + 2 * SMOOTH)) for c in (0, 1)] for p in (0, 1)] for k in kinds}
        self.pair.setdefault("any", [[math.log(0.5)] * 2] * 2)
        self.first = [math.log((seen[f"r {y}"] + SMOOTH) / (seen["r 0"] + seen["r 1"] + 2 * SMOOTH)) for y in (0, 1)]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of content of every node (parents before children), by messages up and down the tree."""
        place = {id(n): i for i, n in enumerate(nodes)}
        parent = [place.get(id(n.parent), -1) for n in nodes]
        emit, pairs = self.emit, [self.pair.get(pair_kind(n.parent, n), self.pair["any"]) if n.parent else None for n in nodes]
        zero, one = [0.0] * len(nodes), [0.0] * len(nodes)
        for i, n in enumerate(nodes):
            for f in features(n):
                a, b = emit.get(f, (0.0, 0.0))
                zero[i] += a
                one[i] += b
        up0, up1 = zero[:], one[:]
        sent0, sent1 = [0.0] * len(nodes), [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            a, b = up0[i], up1[i]
            p0, p1 = pairs[i]
            sent0[i], sent1[i] = _log_sum(p0[0] + a, p0[1] + b), _log_sum(p1[0] + a, p1[1] + b)
            up0[parent[i]] += sent0[i]
            up1[parent[i]] += sent1[i]
        out = []
        down0, down1 = [0.0] * len(nodes), [0.0] * len(nodes)
        for i in range(len(nodes)):
            if i:
                p = parent[i]
                p0, p1 = pairs[i]
                # What the parent knows without this child.
                a, b = up0[p] + down0[p] - sent0[i], up1[p] + down1[p] - sent1[i]
                down0[i], down1[i] = _log_sum(p0[0] + a, p1[0] + b), _log_sum(p0[1] + a, p1[1] + b)
            else:
                down0[i], down1[i] = self.first
            difference = up0[i] + down0[i] - up1[i] - down1[i]
            out.append(0.0 if difference > 700 else 1 / (1 + math.exp(difference)))
        return out

    def text(self, html: str | None) -> str:
        tree = PageTree(html or "")
        if not tree.blocks:
            return ""
        nodes = nodes_of(tree)
        return "\n".join(n.text for n, p in zip(nodes, self.marginals(nodes), strict=True) if n.text is not None and p > 0.5)


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def variants(nodes: list[Node], labels: list[int]) -> list[tuple[list[Node], list[int]]]:
    """The labelled page, and two made from it, so that the model does not rest on habits of one template.

    One has boilerplate with the shape of its own paragraphs inside the main element, named by a boilerplate word, and links inside its
    paragraphs, some of which become other kinds of blocks; in the other the main element is a plain div.
    """
    out = [(nodes, labels)]
    top = next((i for i, (n, y) in enumerate(zip(nodes, labels, strict=True)) if y and n.names & MAIN), None)
    if top is None:
        return out
    words = sorted(BOILER)
    for kind in (0, 1):
        twin: dict[int, Node] = {}
        made: list[Node] = []
        for i, n in enumerate(nodes):
            plain = kind == 1 and n.names & MAIN
            new = Node("div" if plain else n.tag, frozenset({"div"}) if plain else n.names, twin.get(id(n.parent)))
            new.chars, new.links, new.text = n.chars, n.links, n.text
            if kind == 0 and labels[i] and i % 3 == 0:
                new.links = n.chars // 4
            if kind == 0 and labels[i] and n.tag == "p":
                new.tag = ("li", "ul", "td", "div", "blockquote", "pre", "section", "p")[i // 2 % 8]
            twin[id(n)] = new
            made.append(new)
        ys = list(labels)
        if kind == 0:
            inside = [n for n, y in zip(nodes, labels, strict=True) if y and n.tag == "#text"]
            if inside:
                word = words[nodes[top].chars % len(words)]
                box = Node("div", frozenset({"div", word}), made[top])
                par = Node(("p", "div", "li")[nodes[top].chars % 3], frozenset(), box)
                leaf = Node("#text", frozenset(), par)
                for x in (box, par, leaf):
                    x.chars, x.links = inside[0].chars, inside[0].chars * (nodes[top].chars % 2) // 2
                made += [box, par, leaf]
                ys += [0, 0, 0]
        out.append((made, ys))
    return out


def count_page(html: str | None) -> Counter:
    """Counts of features by label, of child labels by parent label, and of the root's label, over the page and its variants."""
    out: Counter = Counter()
    tree = PageTree(html or "")
    if not tree.blocks:
        return out
    nodes = nodes_of(tree)
    for made, labels in variants(nodes, markup_labels(nodes)):
        by_node = {id(n): y for n, y in zip(made, labels, strict=True)}
        for n, y in zip(made, labels, strict=True):
            out.update(f"f {y} {f}" for f in features(n))
            if n.parent is None:
                out[f"r {y}"] += 1
            else:
                out.update(f"t {k} {by_node[id(n.parent)]} {y}" for k in (pair_kind(n.parent, n), "any"))
    return out


def fit_model(pages: DataFrame, page_id: str = "page_id", html: str = "html", sample: int = SAMPLE) -> TreeModel:
    chosen = pages.select(F.xxhash64(F.col(page_id).cast("string")).alias("h"), F.col(page_id).cast("string").alias("i")).orderBy("h", "i").limit(sample).distinct()
    given = pages.select(F.xxhash64(F.col(page_id).cast("string")).alias("h"), F.col(html).alias("html")).join(F.broadcast(chosen.select("h").distinct()), "h", "left_semi").select("html")

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(count_page(page))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([float(v) for v in total.values()], pa.float64())], names=["name", "n"])

    # As many rows as there are feature values: a few hundred.
    return TreeModel({r["name"]: r["n"] for r in given.mapInArrow(count, "name string, n double").groupBy("name").agg(F.sum("n").alias("n")).collect()})


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", model: TreeModel | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    known = pages.sparkSession.sparkContext.broadcast(model or fit_model(pages, page_id, html))
    given = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches):
        for batch in batches:
            texts = [known.value.text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [given.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return given.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


@query("op6_html_extract")
def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
