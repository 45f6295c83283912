"""Main text of web pages by a tree-structured graphical model over the DOM.

Every node of a page, elements and text alike, has a hidden label: content or not. Node
potentials are the likelihoods of what is seen of a node (tag, words of its class, id and role,
length of text, share of link text, whether it is an article inside an article or stands beside the article that the page marks), edge potentials the probabilities of a child's label given its
parent's. The tree has no loops, so one sum-product pass up from the leaves and one down from
the root give each node's exact content marginal; text whose marginal exceeds one half is kept.

Potentials are smoothed counts from two sets of labelled pages: those written below, and a bounded sample of
``FIT_PAGES`` pages of the corpus that mark their own content, as the text in ``<article>`` or ``<main>`` less the
navigation, asides, forms, headers and footers inside. The corpus counts as much as the written pages,
however many pages it gives, so a corpus of one template doesn't unlearn the ways of others.

Sampling reads the pages once more; apart from that pages are independent, a map over rows without any shuffle, holding one page at a time.
Parsing is linear in a page: open elements are found by name and never searched for.

Defined results: null and empty html give an empty text. Tags follow HTML's attribute states: a quote opens a
value only behind an equals sign, and one that never ends is text of its tag, which ends at the next bracket. Unclosed and misnested tags are closed
as browsers do for heads, paragraphs, list items, table parts and options, and otherwise at their
parent's end; end tags without a start are dropped. An open head ends at the body, or at the first element or text that isn't metadata. An unfinished tag at the end of a page is dropped. Nesting is followed to any
depth without recursion, and very long pages whole. Repeated rows give equal results. An empty table gives no rows. Further
columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read_table

# fixed values: element names of HTML by role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style head title noscript template iframe object canvas audio video select textarea button datalist annotation annotation-xml".split())
RAW = frozenset("script style textarea title".split())
METADATA = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mover mrow ms msqrt mstyle msub msubsup msup mtext munder q s samp semantics small span strike strong sub sup svg text time tspan tt u var wbr".split())
CLOSED_BY_BLOCK = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {k: frozenset(v.split()) for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
SCOPES = frozenset("ul ol dl table tbody thead tfoot select div section article".split())
LISTS = SCOPES - {"div", "section", "article"}
PAGE = frozenset("html body".split())
# fixed values: elements that HTML defines as the content, and as what is beside it
MARKED = frozenset("article main".split())
BESIDE = frozenset("nav aside footer form header dialog".split())
HEAD, TEMPLATE, PARAGRAPH = frozenset(["head"]), frozenset(["template"]), frozenset(["p"])
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}

# a name, which may begin with an equals sign, and perhaps a value: quoted, or up to white space or the bracket
ATTRIBUTE = r"""(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++|(?=>)))?+"""
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|</?+[!?][^>]*+>?+|</(?:>|[^A-Za-z>][^>]*+>?+)"
    rf"|</([A-Za-z][^\s/>]*+)[^>]*+>?+|<([A-Za-z][^\s/>]*+)((?:[\s/]++|{ATTRIBUTE})*+)(>?+)|((?:[^<]++|<(?![A-Za-z/!?]))++)|.",
    re.S,
)
NAMED = re.compile(ATTRIBUTE.replace("(?:=", "(=", 1).replace('"[^"]*+"', '"([^"]*+)"').replace("'[^']*+'", "'([^']*+)'").replace("[^\\s>]++", "([^\\s>]++)"))
TELLING = frozenset("class id role aria-label".split())
WORDS = re.compile(r"[a-z]+")


def telling_words(inside: str) -> tuple[str, ...]:
    """The words in a tag's class, id, role and label, each once."""
    low = inside.lower()
    if not any(name in low for name in ("class", "id", "role", "aria-label")):
        return ()
    values = (m[2] or m[3] or m[4] or "" for m in NAMED.finditer(low) if m[1] in TELLING)
    return tuple(dict.fromkeys(w for v in values for w in WORDS.findall(v)))


@dataclass
class Node:
    tag: str
    parent: int
    words: tuple[str, ...] = ()
    text: str = ""
    hidden: bool = False
    #: Text below in all, and below links.
    chars: int = 0
    linked: int = 0
    #: Whether text stands in it directly.
    own: bool = False
    #: Whether it is, or is in, an article inside another, and whether it stands beside what the page marks as its content (None: it marks nothing).
    nested: bool = False
    beside: bool | None = None
    children: list[int] = field(default_factory=list)


def parse(page: str) -> list[Node]:
    """The nodes of a page in document order; the first is the root. Text nodes have the tag #text."""
    nodes = [Node("#root", -1)]
    stack = [0]
    opened: dict[str, list[int]] = {}

    def push(tag: str) -> None:
        opened.setdefault(tag, []).append(len(stack))
        stack.append(len(nodes) - 1)

    def cut(depth: int) -> None:
        while len(stack) > depth:
            opened[nodes[stack.pop()].tag].pop()

    def innermost(names: frozenset[str]) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=0)

    def close(names: frozenset[str], stop: frozenset[str]) -> None:
        """Ends the innermost of the names, if no element of stop is open inside it."""
        depth = innermost(names)
        if depth and depth >= innermost(stop - names):
            cut(depth)

    at = 0
    while at < len(page):
        token = TOKEN.match(page, at)
        end_tag, tag, inside, ended, text = token.groups()
        at = token.end()
        if tag and not ended:
            break
        if text is not None:
            if text.strip():
                if nodes[stack[-1]].tag == "head":
                    cut(len(stack) - 1)
                nodes[stack[-1]].children.append(len(nodes))
                nodes.append(Node("#text", stack[-1], text=html.unescape(text), hidden=nodes[stack[-1]].hidden))
            elif nodes[stack[-1]].children:
                nodes[stack[-1]].children.append(len(nodes))
                nodes.append(Node("#text", stack[-1], text=" ", hidden=True))
        elif end_tag:
            depth = innermost(frozenset((end_tag.lower(),)))
            if depth:
                cut(depth)
        elif tag:
            tag = tag.lower()
            if tag == "body":
                close(HEAD, TEMPLATE)
            elif nodes[stack[-1]].tag == "head" and tag not in METADATA:
                cut(len(stack) - 1)
            if tag in CLOSED_BY_BLOCK:
                close(PARAGRAPH, SCOPES)
            if tag in SIBLINGS:
                close(SIBLINGS[tag], LISTS)
            words = telling_words(inside) if inside else ()
            nodes[stack[-1]].children.append(len(nodes))
            nodes.append(Node(tag, stack[-1], words, hidden=nodes[stack[-1]].hidden or tag in UNSEEN, nested=nodes[stack[-1]].nested or tag == "article" and bool(opened.get("article"))))
            if tag in RAW:
                end = RAW_END[tag].search(page, at)
                at = end.start() if end else len(page)
            if tag not in VOID:
                push(tag)
    for i in range(len(nodes) - 1, 0, -1):
        node, parent = nodes[i], nodes[nodes[i].parent]
        if node.tag == "#text" and not node.hidden:
            node.chars = len(node.text)
            parent.own = True
        if node.tag == "a":
            node.linked = node.chars
        parent.chars += node.chars
        parent.linked += node.linked
    marked = [n.tag in MARKED and not n.nested and n.chars > 0 for n in nodes]
    if any(marked):
        over = marked[:]
        for i in range(len(nodes) - 1, 0, -1):
            over[nodes[i].parent] |= over[i]
        inside = marked[:]
        for i, node in enumerate(nodes):
            inside[i] |= i > 0 and inside[node.parent]
            node.beside = not (inside[i] or over[i])
    return nodes


def seen(nodes: list[Node], i: int) -> list[str]:
    """What is observed of a node; nothing of those that are never shown."""
    node = nodes[i]
    if node.hidden:
        return []
    if node.tag == "#text":
        return [f"text {min(6, int(math.log2(1 + len(node.text) / 16)))}"]
    if node.tag == "a":  # a link is told by what it stands in: text, or other links
        around = nodes[node.parent]
        return ["tag a", f"around {int(4 * around.linked / around.chars) if around.chars else 0}", *(f"word {w}" for w in node.words)]
    links = int(4 * node.linked / node.chars) if node.chars else 0
    mass = [f"mass {int(4 * node.chars / nodes[0].chars)}{' own' * node.own}"] if node.chars and kind(node) and node.tag not in PAGE else []
    place = [f"beside {int(node.beside)}"] if node.beside is not None and kind(node) and node.tag not in PAGE else []
    if kind(node) and node.tag not in PAGE:
        place.append(f"nested {int(node.nested)}")
    return [f"tag {node.tag}", f"links {links}", *place, *mass, *(f"word {w}" for w in node.words)]


@dataclass(frozen=True)
class Potentials:
    root: tuple[float, float]
    #: By kind of child (text and inline elements, or blocks), label of the parent, label of the child.
    edge: tuple[tuple[tuple[float, float], ...], ...]
    node: dict[str, tuple[float, float]]


def kind(node: Node) -> int:
    return 0 if node.tag == "#text" or node.tag in INLINE or node.tag in VOID else 1


Counts = dict[tuple[str, int], float]


def count(page: list[tuple[Node, int]]) -> Counts:
    """How often each observation and each edge comes with each label, in a page whose nodes are labelled 0 or 1."""
    out: Counts = {}
    nodes = [n for n, _ in page]
    for i, (node, label) in enumerate(page):
        if i and not node.hidden:
            for f in (f"edge {kind(node)} {page[node.parent][1]}", *seen(nodes, i)):
                out[f, label] = out.get((f, label), 0.0) + 1
    return out


def summed(counts: Iterable[Counts]) -> Counts:
    out: Counts = {}
    for one in counts:
        for key, n in one.items():
            out[key] = out.get(key, 0.0) + n
    return out


def together(written: Counts, corpus: Counts) -> Counts:
    """Both counts, those of the corpus scaled down to as many nodes as the written pages have."""
    nodes = lambda c: sum(n for (f, _), n in c.items() if f.startswith("edge "))
    share = min(1.0, nodes(written) / nodes(corpus)) if corpus else 0.0
    return summed([written, {k: n * share for k, n in corpus.items()}])


def potentials(counts: Counts) -> Potentials:
    """Smoothed log potentials."""
    edge = [[[1.0 + counts.get((f"edge {k} {above}", y), 0.0) for y in (0, 1)] for above in (0, 1)] for k in (0, 1)]
    totals: dict[str, list[float]] = {}
    for (f, y), n in counts.items():
        totals.setdefault(f.split(" ")[0], [0.0, 0.0])[y] += n
    node = {}
    for f in sorted({f for f, _ in counts if not f.startswith("edge ")}):
        pair = [counts.get((f, y), 0.0) for y in (0, 1)]
        total, more = totals[f.split(" ")[0]], SMOOTHING[f.split(" ")[0]]
        share = sum(pair) / sum(total)
        node[f] = tuple(math.log((pair[y] + more * share) / (total[y] + more)) for y in (0, 1))
    rows = tuple(tuple(tuple(math.log(x / sum(row)) for x in row) for row in table) for table in edge)
    return Potentials((math.log(0.5), math.log(0.5)), rows, node)


#: Pseudo-nodes of each label, by kind of observation: words and tags say much, lengths little.
SMOOTHING = {"word": 0.2, "tag": 0.5, "beside": 2.0, "nested": 0.2, "links": 20.0, "around": 2.0, "mass": 5.0, "text": 50.0}


def _sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(nodes: list[Node], p: Potentials) -> list[float]:
    """Each node's probability of being content, by messages up and then down the tree."""
    n = len(nodes)
    flat = [(*table[0], *table[1]) for table in p.edge]
    edges = [flat[kind(node)] for node in nodes]
    belief = [[0.0, 0.0] for _ in nodes]
    up = [(0.0, 0.0)] * n
    known = p.node
    for i in range(n - 1, -1, -1):
        own = belief[i]
        e00, e01, e10, e11 = edges[i]
        if i:
            for f in seen(nodes, i):
                potential = known.get(f)
                if potential:
                    own[0] += potential[0]
                    own[1] += potential[1]
            up[i] = (0.0, 0.0) if nodes[i].hidden else (_sum(e00 + own[0], e01 + own[1]), _sum(e10 + own[0], e11 + own[1]))
            above = belief[nodes[i].parent]
            above[0] += up[i][0]
            above[1] += up[i][1]
    belief[0] = [belief[0][0] + p.root[0], belief[0][1] + p.root[1]]
    out = [0.0] * n
    for i in range(n):
        own = belief[i]
        if i:
            e00, e01, e10, e11 = edges[i]
            above = belief[nodes[i].parent]
            a0, a1 = above[0] - up[i][0], above[1] - up[i][1]
            own[0] += _sum(a0 + e00, a1 + e10)
            own[1] += _sum(a0 + e01, a1 + e11)
        top = max(own)
        own[0] -= top
        own[1] -= top
        out[i] = 1 / (1 + math.exp(min(700.0, own[0] - own[1])))
    return out


# Labelled pages. The attribute data-y labels a node and what is below it until the next label;
# text outside any label isn't content. They cover the ways in which pages commonly name their parts.
_SENTENCE = "It began early, and nobody had seen it coming; the town talked of the river. "
_PARAGRAPHS = "".join(f"<p>{_SENTENCE * n}</p>" for n in (1, 2, 3, 5, 8, 13, 20, 30))
_ARTICLE = f"<h1>A headline of the story</h1><p><b>The first witnesses</b> said, <em>on Monday</em>, that it was <a href=x>there before</a>. {_SENTENCE}</p>{_PARAGRAPHS}<p>See <a href=x>the report</a>, and <a href=y>what followed</a> from it.</p><p><a href=x>An inquiry</a> found nothing of the kind. {_SENTENCE}</p><p>More <a href=z>here</a>.</p><p><a href=u>Read what the witnesses wrote about it at the time</a></p><p><a href=t>The full report</a></p><ul><li>The <a href=v>first</a> of its kind, says <a href=w>the mayor</a>.</li></ul><h2>What came next</h2><ul><li>A first point, with some words.</li><li>A second point.</li></ul><ol><li>Step one.</li></ol><h3>In detail</h3><blockquote><p>{_SENTENCE}</p></blockquote><pre>code sample</pre><table><tr><th>Name</th><td>42</td></tr></table><dl><dt>Term</dt><dd>What it means.</dd></dl><p>Short.<br>{_SENTENCE * 4}<br>And <i>one</i> more <span>line</span>.</p><figure><img src=x><figcaption>The bridge at dawn.</figcaption></figure><div>{_SENTENCE * 6}</div>"
_LINKS = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News and views</a></li><li><a href=/c>Contact</a></li></ul>"
_NOTE = "<h2>Before you go on</h2><p>We use cookies to give you a better visit. Read our <a href=/p>policy</a>.</p><button>Fine</button><span>Or not</span>"
_ADVERT = "Buy two and get a third for free today. Sale ends soon!"
_SMALL = "&copy; 2020 Example Ltd. All rights reserved.<p>Some words about the house, and where to find it.</p><div><a href=/t>Terms</a></div>"
_FORM = "<h3>Stay in touch</h3><p>Get our letter every week, with all that has been written.</p><input name=mail><label>Mail</label><div><b>No</b> spam.</div>"
_READER = "<article class='{0}'><h4>Jo</h4><p>I was there too and saw it. Great story!</p></article><article class='{0}'><p>Not so sure about that, it was said before.</p></article>"
_COMMENT = "<div><h4>Jo</h4><p>I was there too and saw it. Great story, thanks for writing!</p></div><ul><li><b>Al</b><br>Not so sure about that. It was said before, and by others, that nothing of the kind took place.</li></ul><p>First!</p>"
# fixed values: words in class, id and role that tell parts of pages apart
_CONTENT_WORDS = "article content post entry story body main text article-body post-content entry-content".split()
_CLUTTER = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs topnav pagination pager tabs toc menubar sitemap skip".split(),
    "header": "header masthead banner topbar site-header branding logo".split(),
    "footer": "footer site-footer copyright legal bottom colophon credits contentinfo".split(),
    "aside": "sidebar aside widget related recommended popular trending teaser rail promoted complementary leftbar rightbar seealso readmore author-bio".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay banner message paywall disclaimer warning announcement privacy toast".split(),
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion adsbygoogle adslot commercial dfp offer".split(),
    "form": "form search subscribe subscription newsletter signup login register contact poll survey".split(),
    "comments": "comments comment discussion replies reply respond responses disqus feedback reactions guestbook commentlist".split(),
    "share": "share sharing social follow tools toolbar meta tags byline-tools buttons print".split(),
}
_FILL = {"nav": f"<h2>Sections</h2>{_LINKS}<a href=/d>More</a>", "header": f"<div>The Example Daily</div><h1>Example</h1><p>All that is new</p>{_LINKS}", "footer": _SMALL, "aside": f"<h3>More</h3>{_LINKS}<p>Other words that stand aside, and a few more of them.</p><div><b>Also</b> read</div>", "notice": _NOTE, "ad": f"{_ADVERT}<h3>Now cheaper</h3><p>{_ADVERT}</p><img src=x>", "form": _FORM, "comments": f"<h2>Comments</h2>{_COMMENT}<h3>Leave a reply</h3>", "share": "<a href=x>Share</a><a href=y>Post</a><span>12 times</span>"}


def labelled_pages() -> list[str]:
    pages = []
    clutter = [(part, word) for part, words in _CLUTTER.items() for word in words]
    for k, good in enumerate(_CONTENT_WORDS):
        mine = clutter[k :: len(_CONTENT_WORDS)]
        boxes = [f"<{'div' if i % 2 else 'section'} {'class' if i % 3 else 'id'}='{w}' data-y=0>{_FILL[part]}</{'div' if i % 2 else 'section'}>" for i, (part, w) in enumerate(mine)]
        own = (
            f"<nav data-y=0>{_LINKS}</nav>",
            f"<header data-y=0>{_FILL['header']}</header>",
            f"<div class='{good}' data-y=1>{_ARTICLE}{''.join(boxes[:5])}</div>" if k % 2 else f"<article data-y=1>{_ARTICLE}{''.join(boxes[:5])}</article>",
            "".join(boxes[5:]),
            f"<aside data-y=0>{_FILL['aside']}</aside><form data-y=0>{_FORM}</form><dialog data-y=0>{_NOTE}</dialog>",
            f"<footer data-y=0>{_SMALL}</footer>",
        )
        pages.append(f"<html><body data-y=0>{''.join(own)}</body></html>")
        pages.append(f"<html><body data-y=0><div class=ad data-y=0>{_ADVERT}</div><main data-y=1><article>{_ARTICLE}{boxes[0]}{boxes[1]}<aside data-y=0>{_FILL['aside']}</aside></article>{boxes[2]}</main><footer data-y=0>{_SMALL}</footer></body></html>")
        pages.append(f"<html><body data-y=0><main data-y=1><article>{_ARTICLE}{_READER.format('note')}</article></main><section class='box{k}' data-y=0>{_COMMENT}</section><div class='end{k}' data-y=0>{_SMALL}</div></body></html>".replace("<article class=", "<article data-y=0 class="))
        pages.append(f"<html><body data-y=0><div class='wrapper container row page'><div><div class='{good}' id=content data-y=1>{_ARTICLE}</div></div></div></body></html>")
        pages += [f"<html><body data-y=0><div data-y=1>{words}</div></body></html>" for words in ("Words.", "A word or two.", _SENTENCE, _SENTENCE * 3, _SENTENCE * 9)]
        pages.append(f"<div data-y=1>{_PARAGRAPHS}<div>{_SENTENCE * 3}</div><section><div><p>{_SENTENCE}</p></div></section></div>")
        pages.append(f"<html><body data-y=0><nav data-y=0>{_LINKS}</nav><main data-y=1>{_ARTICLE}{boxes[3]}<form data-y=0>{_FORM}</form>{boxes[4]}</main><section class=comments data-y=0>{_COMMENT}</section></body></html>")
    return pages


def labelled(page: str) -> list[tuple[Node, int]]:
    marks = iter(re.findall(r"<[a-z][^>]*data-y=([01])", page))
    tags = iter(bool(re.search(r"data-y=", t)) for t in re.findall(r"<[a-z][^>]*>", page))
    out: list[tuple[Node, int]] = []
    for node in parse(page):
        label = out[node.parent][1] if out else 0
        if node.tag != "#text" and node.tag != "#root" and next(tags):
            label = int(next(marks))
        out.append((node, label))
    return out


@cache
def written() -> Counts:
    return summed(count(labelled(p)) for p in labelled_pages())


@cache
def model() -> Potentials:
    """The potentials of the written pages alone."""
    return potentials(written())


#: Pages of the corpus that are fitted on, about.
FIT_PAGES = 2_000


def self_labelled(page: str | None) -> list[tuple[Node, int]]:
    """The nodes of a page that marks its content, labelled by it; nothing for other pages. An article inside an article is a reader's, as HTML says."""
    nodes = parse(page) if page else []
    if not any(n.tag in MARKED and n.chars for n in nodes):
        return []
    labels: list[int] = []
    for node in nodes:
        above = labels[node.parent] if labels else 0
        labels.append(0 if node.nested or node.tag in BESIDE else 1 if node.tag in MARKED else above)
    return list(zip(nodes, labels, strict=True))


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: Counts = {}
    for batch in batches:
        for page in batch["html"]:
            found = summed([found, count(self_labelled(page))])
    yield pd.DataFrame([(f, y, n) for (f, y), n in found.items()], columns=["f", "y", "n"])


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Potentials:
    """Potentials from the written pages and about fit_pages pages of the corpus, drawn by a hash of id and url.

    The driver gets the counts of observations: tags, and the words in classes of the sampled pages.
    """
    bounded_batches(pages.sparkSession)
    share = F.shiftrightunsigned(F.xxhash64(F.lit("page sample"), "page_id", "url"), 11) / F.lit(float(2**53))
    sample = pages.where(share * F.lit(float(pages.count())) < F.lit(float(fit_pages))).select("html")
    counts = sample.mapInPandas(_count_batches, "f string, y int, n double").groupBy("f", "y").agg(F.sum("n").alias("n"))
    return potentials(together(written(), {(r["f"], r["y"]): r["n"] for r in counts.collect()}))


def main_text(page: str | None, p: Potentials | None = None) -> str:
    """The article's text: blocks in page order, white space as single spaces."""
    if not page:
        return ""
    nodes = parse(page)
    content = marginals(nodes, p or model())
    pieces: list[str] = []
    # a walk in page order; block elements put a space before and after what they hold
    stack = [(0, True)]
    while stack:
        i, entering = stack.pop()
        node = nodes[i]
        if node.tag == "#text":
            if (not node.hidden and content[i] > 0.5) or node.text == " ":
                pieces.append(node.text)
            continue
        if node.tag not in INLINE:
            pieces.append(" ")
        if entering:
            stack.append((i, False))
            stack += [(c, True) for c in reversed(node.children)]
    return " ".join("".join(pieces).split())


def extracted(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row; Python gets nothing but the html."""
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages, fit_pages))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((main_text(h.as_py(), shared.value) for h in batch), type=pa.string(), size=len(batch))

    text = F.arrow_udf(run, "string")(F.col("html"))
    return pages.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_tree_model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read_table(spark, sf_dir, "pages"))
