"""Operator 5, main text of pages by a tree-structured graphical model.

Model. A page becomes a tree of block elements whose leaves are runs of text. Each node is content or not; it has a
potential from its own features (tags, class and id words, link share, length, punctuation), and each edge one from the
parent's and child's states. Sum-product messages from the leaves up and from the root down give every node's marginal;
runs of text above one half are the page's text.

Training. Labelled pages are (a) a sample of at most SAMPLE pages of the corpus, chosen by a hash of id and html, that
mark their text with one <article> and have NODES nodes at most (SAMPLE and NODES bound what is fitted, nothing else), and
(b) generated pages that show common kinds of boilerplate in and around a text, with and without an article, whole or split
over several containers. Node weights are fitted by logistic regression, edge potentials by the ratio of joint to separate
frequencies.

Scale. Pages are read once, each on its own, in time that grows with the page's length; the model has one weight for each
feature seen in the bounded sample.

Defined cases: null and empty html give an empty text; unclosed tags, raw text elements, comments and broken references
are read as browsers with scripts do, and what they don't show (scripts, styles, templates, frames, a last tag without an
end) is no text; svg, math and object are part of the text around them, with /> honoured in svg and math; <br> counts as
white space; a run of text whose two states are equally likely is left out; pages may have any length; repeated rows are
extracted row by row; empty tables work; other columns are not read, not even those named like the new one.
"""

from __future__ import annotations

import html as references
import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_sample, slices, table

SAMPLE, NODES, EPOCHS, RATE, PENALTY = 300, 2000, 6, 0.5, 1e-5

# HTML's own element classes.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
FOREIGN = {"svg", "math"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark object q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LEAVES_FOREIGN = CLOSES_P | SAME_LEVEL.keys() | set("body button embed head iframe img input label noscript object select template textarea".split())
BOILERPLATE = {"nav", "aside", "footer", "form", "head", "button", "dialog", "menu", "select"}

CONTAINERS = ("ul", "ol", "dl", "table", "select", "div", "article", "section", "template")
CHOICES = {"select", "option", "optgroup"}

_VALUE = r"\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+"
#: A comment, a tag or a declaration; nothing is read twice, however a page ends.
_TOKEN = re.compile(rf"<!--(?:>|.*?(?:-->|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{_VALUE})?+)?+)*+)>|<[!?][^>]*+(?:>|\Z)", re.S)
_BEGUN = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE})?+)?+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW}
_SPACES = re.compile(r"[\s\xa0]+")
_NAMES = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    names: list[str] = field(default_factory=list)
    keep: str | None = None
    text: list[str] = field(default_factory=list)  # of a leaf
    linked: int = 0


class _Open:
    """The stack of open elements, and for each tag the places where it stands in it."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.stack, self.places = nodes, [0], defaultdict(list)
        self.others: list[int] = [0]  # places of what isn't a list of choices

    def push(self, i: int) -> None:
        tag = self.nodes[i].tag
        self.places[tag].append(len(self.stack))
        if tag not in CHOICES:
            self.others.append(len(self.stack))
        self.stack.append(i)

    def last(self, *tags: str) -> int:
        """The innermost place of any of these tags, 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def close(self, k: int) -> None:
        for i in self.stack[k:]:
            tag = self.nodes[i].tag
            self.places[tag].pop()
            if tag not in CHOICES:
                self.others.pop()
        del self.stack[k:]


def parse(page: str) -> list[Node]:
    """The page's block elements and runs of text (tag #text), each after its parent."""
    nodes = [Node("#root", -1)]
    here = _Open(nodes)
    links, run, foreign = 0, None, 0
    unclosed: set[str] = set()  # raw text elements that no end tag follows any more
    at, seen, end = 0, 0, len(page)

    def put(raw: str) -> None:
        nonlocal run
        if not raw or here.places["template"]:
            return
        if run is None:
            if not raw.strip():
                return
            nodes.append(Node("#text", here.stack[-1]))
            run = len(nodes) - 1
        nodes[run].text.append(raw)
        if links:
            nodes[run].linked += len(raw)

    def close(k: int) -> None:
        nonlocal run
        here.close(k)
        run = None

    while at < end:
        seen = page.find("<", seen)
        m = _TOKEN.match(page, seen) if seen >= 0 else None
        if m is None:
            if seen >= 0 and not _BEGUN.match(page, seen):
                seen += 1  # a sign of its own
                continue
            put(page[at : seen if seen >= 0 else end])  # a tag that never ends isn't shown
            break
        put(page[at:seen])
        at = seen = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in FOREIGN:
                foreign = max(0, foreign - 1)
            elif tag not in INLINE and tag not in VOID:
                k = here.last(tag)
                if k and k >= here.last("template"):
                    close(k)
                    links = foreign = 0
            continue
        attributes = list(_ATTRIBUTE.finditer(m[3]))
        if tag in FOREIGN or foreign and tag not in LEAVES_FOREIGN:
            if m[3].endswith("/") and not (attributes and attributes[-1].end() == len(m[3])):
                continue
            if tag not in RAW:
                foreign += tag in FOREIGN
                continue
        else:
            foreign = 0
        if tag in RAW:
            stop = None if tag in unclosed else _RAW_END[tag].search(page, at)
            if stop is None:
                unclosed.add(tag)
            if stop or tag != "noscript":
                at = seen = stop.end() if stop else end
                run = None if not foreign else run
                continue
        if tag == "br":
            put(" ")
        if tag == "a":
            links = 1
        if tag == "hr":
            run = None
        if tag in CLOSES_P and nodes[here.stack[-1]].tag == "p":
            close(len(here.stack) - 1)
        if tag in INLINE or tag in VOID:
            continue
        if tag in CLOSES_P and here.last("select") > here.others[-1]:  # a list of choices that wasn't closed
            close(here.last("select"))
        if (k := here.last(*SAME_LEVEL.get(tag, ()))) and k > here.last(*(t for t in CONTAINERS if t not in SAME_LEVEL[tag])):
            close(k)
        names, keep = [], None
        for name, value in (x.groups() for x in attributes):
            value = (value or "").strip("\"'")
            if name.lower() in ("class", "id", "role"):
                names += _NAMES.findall(value.lower())
            elif name.lower() == "data-keep":
                keep = value
        nodes.append(Node(tag, here.stack[-1], names, keep))
        here.push(len(nodes) - 1)
        run, links = None, 0
    return nodes


def block_text(node: Node) -> str:
    return _SPACES.sub(" ", references.unescape("".join(node.text))).strip()


def _described(nodes: list[Node]) -> Iterator[tuple[list[str], tuple[str, ...]]]:
    """Each node's own features, and the names that it has or takes from its nearest ancestor with names."""
    near: list[tuple[str, tuple[str, ...]]] = []  # nearest section tag, nearest names
    for n in nodes:
        if n.parent < 0:
            near.append(("", ()))
            yield ["root"], ()
            continue
        section, names = near[n.parent]
        if n.tag in ("article", "main", "section", "header", *BOILERPLATE):
            section = n.tag
        if n.names:
            names = tuple(n.names)
        near.append((section, names))
        x = ["bias", f"tag={n.tag}", f"section={section}", f"up={nodes[n.parent].tag}"]
        if n.tag == "#text":
            text = "".join(n.text)
            size = len(text)
            x += [f"size={min(8, int(math.log2(1 + size / 8)))}", f"links={int(4 * n.linked / max(size, 1))}", f"stops={min(4, sum(map(text.count, '.!?')))}"]
            if "©" in text or "&copy" in text:
                x.append("copyright")
        yield x, names


def features(nodes: list[Node]) -> list[list[str]]:
    """Each node's features: its own, and its nearest ancestors' tags and names."""
    return [[*x, *(f"name={w}" for w in names)] for x, names in _described(nodes)]


def labels(nodes: list[Node]) -> list[int] | None:
    """Content marks of a labelled page: by data-keep where given, else what lies in its one article and not in
    boilerplate within it. None if the page isn't labelled."""
    marked = any(n.keep for n in nodes)
    if not marked and sum(n.tag == "article" for n in nodes) != 1:
        return None
    out = [0]
    for n in nodes[1:]:
        up = out[n.parent]
        if marked:
            out.append({"1": 1, "0": 0}.get(n.keep or "", up))
        else:
            out.append(1 if n.tag == "article" else 0 if n.tag in BOILERPLATE or {"comment", "comments"} & set(n.names) else up)
    return out


# Names that page templates give to boilerplate, and to content.
_AROUND = "menu navbar breadcrumb sidebar widget related recommended share social newsletter subscribe signup cookie consent notice banner alert popup modal ad ads advert advertisement sponsor sponsored promo promotion comment comments reply respond login search pagination pager tags footer header masthead topbar copyright legal".split()
_WITHIN = "content article post entry story body main text".split()
_WORDS = "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed do eiusmod tempor incididunt ut labore. Ut enim ad minim veniam, quis nostrud exercitation."


def generated() -> Iterator[str]:
    """Labelled pages: each kind of boilerplate beside and inside a text, in several kinds of container: one article, one
    container without it, or several containers one after the other, with boilerplate between them."""
    long = f"<p>{_WORDS} {_WORDS}</p><p>{_WORDS}</p>"
    for i, name in enumerate(_AROUND):
        box = ("div", "section", "aside", "ul")[i % 4]
        inner = (f"<p>{_WORDS}</p>", "<li><a href='#'>One link</a></li><li><a href='#'>Another</a></li>", _WORDS[:60])[i % 3]
        junk = f"<{box} class='{name}' data-keep='0'>{inner}</{box}>"
        ask = ("Name", "Your address", "Search", "Leave a message here")[i % 4]
        form = f"<form data-keep='0'><label>{ask}</label> <input name='n'><div>{ask} again<input></div><select><option>One</option><option>Another</option></select><button>Send it</button></form>"
        within = _WITHIN[i % len(_WITHIN)]
        host = ("article", f"div class='{within}'", f"main id='{within}'", f"section class='{within}-part'", "div", "section", "main")[i % 7]
        end = host.split()[0]
        menu = "<nav data-keep='0'><ul><li><a href='#'>Home</a></li><li><a href='#'>About us</a></li></ul></nav>"
        more = f"<{host} data-keep='1'><h2>A part</h2>{long}</{end}>{junk}" * (i % 3)
        crumbs = "<div data-keep='0'><a href='#'>Home</a> / <a href='#'>A part</a></div>"
        yield f"<body><header data-keep='0'>Site name {menu}</header>{crumbs}{junk}<div>{more}<{host} data-keep='1'><h1>A title</h1>{long}{junk}{form}<ul><li>{_WORDS[:80]}</li></ul><blockquote>{_WORDS}</blockquote></{end}></div><aside data-keep='0'><p>{_WORDS[:70]}</p></aside><footer data-keep='0'>&copy; Site &middot; {_WORDS[:40]}</footer></body>"


@dataclass
class TreeModel:
    weights: dict[str, float]
    edge: tuple[tuple[float, float], tuple[float, float]]  # log potentials by parent's and child's state

    def marginals(self, nodes: list[Node]) -> list[float]:
        weight, by_names = self.weights.get, {}  # names are summed once, however many nodes take the same ones over
        own = []
        for x, names in _described(nodes):
            if (of_names := by_names.get(id(names))) is None:
                of_names = by_names[id(names)] = sum(weight(f"name={w}", 0.0) for w in names)
            own.append(sum(map(weight, x, [0.0] * len(x))) + of_names)
        (e00, e01), (e10, e11) = self.edge
        n = len(nodes)
        up0, up1 = [0.0] * n, own[:]
        to0, to1 = [0.0] * n, [0.0] * n  # messages to the parent, by its state
        for i in range(n - 1, 0, -1):
            a, b = up0[i], up1[i]
            to0[i], to1[i] = _plus(a + e00, b + e01), _plus(a + e10, b + e11)
            p = nodes[i].parent
            up0[p] += to0[i]
            up1[p] += to1[i]
        all0, all1 = up0[:], up1[:]
        for i in range(1, n):
            p = nodes[i].parent
            rest0, rest1 = all0[p] - to0[i], all1[p] - to1[i]
            all0[i] += _plus(rest0 + e00, rest1 + e10)
            all1[i] += _plus(rest0 + e01, rest1 + e11)
            shift = max(all0[i], all1[i])
            all0[i] -= shift
            all1[i] -= shift
        return [1 / (1 + math.exp(min(700.0, a - b))) for a, b in zip(all0, all1, strict=True)]

    def extract(self, page: str | None) -> str:
        nodes = parse(page or "")
        p = self.marginals(nodes)
        return "\n".join(t for n, q in zip(nodes, p, strict=True) if n.tag == "#text" and q > 0.5 and (t := block_text(n)))


def _plus(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def fit(pages: list[tuple[list[list[str]], list[int], list[int]]]) -> TreeModel:
    """pages: each node's features, its label and its parent."""
    weights: dict[str, float] = defaultdict(float)
    scale: dict[str, float] = defaultdict(lambda: 1e-8)
    pairs: Counter = Counter()
    for x, y, up in pages:
        pairs.update((y[p], y[i]) for i, p in enumerate(up) if p >= 0)
    for _ in range(EPOCHS):
        for x, y, _up in pages:
            for fs, label in zip(x, y, strict=True):
                z = sum(weights[f] for f in fs)
                g = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label
                for f in fs:
                    step = g + PENALTY * weights[f]
                    scale[f] += step * step
                    weights[f] -= RATE * step / math.sqrt(scale[f])
    total = sum(pairs.values()) + 4
    joint = [[(pairs[a, b] + 1) / total for b in (0, 1)] for a in (0, 1)]
    rows, cols = [sum(r) for r in joint], [joint[0][b] + joint[1][b] for b in (0, 1)]
    edge = tuple(tuple(math.log(joint[a][b] / (rows[a] * cols[b])) for b in (0, 1)) for a in (0, 1))
    return TreeModel({k: round(v, 6) for k, v in weights.items()}, edge)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> TreeModel:
    rows = pages.select(F.lit("").alias("all"), F.col(id_col).alias("id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    n = rows.count()
    some = hashed_sample(rows, "all", ["id", "html"], sample, {"": n}).select("html") if n else rows.select("html")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page in batch.column("html").to_pylist():
                nodes = parse(page)
                if (y := labels(nodes)) is not None and len(nodes) <= NODES:
                    out.append(json.dumps([features(nodes), y, [x.parent for x in nodes]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["page"])

    found = sorted(r.page for r in some.mapInArrow(described, "page string").collect())  # `sample` pages at most
    own = [(features(x), labels(x), [n.parent for n in x]) for x in map(parse, generated())]
    return fit([*own, *(tuple(json.loads(p)) for p in found), *own])


def extract(pages: DataFrame, model: TreeModel, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: id, the columns of `keep`, text."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    keep = tuple(c for c in keep if c not in (id_col, "text"))
    rows = pages.select(id_col, *keep, F.coalesce(F.col(html_col), F.lit("")).alias("__html"))
    names = [id_col, *keep]
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__html", 2 << 20):
            texts = pa.array([shared.value.extract(p) for p in batch.column("__html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), texts], names=[*names, "text"])

    return rows.mapInArrow(run, f"{kinds}, text string")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages)).withColumn("n_chars", F.length("text").cast("long"))
