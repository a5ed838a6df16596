"""HTML extraction with a site style tree.

Pages of one host are merged into a tree of style nodes, where a node is a path of block elements with their first class.
Spark counts for every node how often each content (leaf) and each sequence of child styles (branch) occurs over pages:
a leaf's importance is 1 minus the entropy of its contents' spread over pages, a branch's importance is the entropy of its
presentations (1 for a node on one page). What few pages show proves little, so a prior importance of 1 counts as PRIOR
pages. Where the importance so weighed is below LOW the node is noise of that host and goes; the paragraphs, headings and
lists of an article, which presentation calls content, go below LOWEST only. Presentation that says by itself what it is
(tags, roles and class names of menus, forms, adverts, comments and the like) has importance 0 on any page, and the article
and main elements, where there are some, bound the content. A class name counts word by word, but not with a word as `with`
before it, and inside an article only if all its words say so; what a layout's name takes away, an article or main element
inside it gets back.

A page is parsed once, into a table of its blocks; counting and choosing are column expressions over that table. A page's
text: its remaining blocks in order, character references decoded, white space inside a block one space, blocks joined by
newline. Line breaks (br) count as white space.

Defined results: null and empty html, and pages of noise alone, give the empty text; malformed markup is read as browsers
do where that matters (unclosed and stray tags, comments and tags cut off at the end); a null url is the host ''; repeated
pages count as pages; only page_id, url and html are read, so other columns can't clash. Parsing takes time in proportion to the page, however deep its elements nest.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, map_arrow, materialize, table

#: Importance below which a node is noise, and an article's content; the weight of content beside presentation; the pages
#: that the prior counts for.
LOW, LOWEST, GAMMA, PRIOR = 0.8, 0.25, 0.9, 24.0
#: So many noise nodes are broadcast at most; more are joined by a shuffle.
BROADCAST_NODES = 200_000

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element and attribute names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("script style noscript template svg math iframe object textarea select title audio video canvas noembed noframes xmp".split())
NOISE_TAG = frozenset("nav aside footer form button dialog menu head".split())
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promoted promotion banner cookie cookies consent "
    "gdpr notice notices alert alerts announcement menu nav navbar navigation sidebar rail footer masthead topbar toolbar breadcrumb breadcrumbs "
    "comment comments disqus reply replies respond discussion share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup login popup modal overlay pager pagination widget widgets copyright disclaimer skip".split()
)
NOISE_OUTSIDE = frozenset("header head side aside search foot tags legal".split())
CONTENT_NAME = frozenset("article content main post entry story".split())
#: Words beside which a noise word still names its element; before which it doesn't (a page with a sidebar is no sidebar).
NEUTRAL = frozenset(
    "area bar bars block body bottom box button buttons center col column container cta data el fixed form group head holder home icon icons id inner item items left "
    "line link links list listing lists main mini module modules outer page panel posts primary region right row section sections side site slot small sticky "
    "strip tab tabs text title top unit units wide wrap wrapper zone".split()
)
MODIFIER = frozenset("with has no is not without show hide use".split())
#: Names of parts of an article, too; and of what readers write, whatever elements that holds.
PART = frozenset("discussion notice notices alert alerts disclaimer replies reply respond".split())
READERS = frozenset("comment comments disqus reply replies respond".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SCOPE = frozenset("td th table caption html".split())
#: An opened element closes the nearest of these, unless the second set comes first.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
}
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tr td th figure figcaption".split())


class Node:
    """An open element: its path in the style tree, and what presentation says of it.

    noise: 1 by the name of a layout, which an article or main element inside isn't bound by, 2 for good.
    """

    __slots__ = ("tag", "path", "noise", "root", "inner", "styles")

    def __init__(self, tag: str, path: int, noise: int, root: int, inner: bool):
        self.tag, self.path, self.noise, self.root, self.inner, self.styles = tag, path, noise, root, inner, []


class Page:
    """A page's text blocks, by column, and its branches with the styles of their children."""

    def __init__(self):
        self.path, self.up, self.text, self.noise, self.root, self.inner = [], [], [], [], [], []
        self.branch, self.shape = [], []


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


def _open(tag: str, attrs: str, up: Node, rules: bool) -> tuple[Node, str]:
    """The node of a start tag and its style. Its path is a hash of the parent's path and the style."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)} if attrs.strip(" /") else {}
    style = tag + "".join(f".{c}" for c in found.get("class", "").split()[:1])
    path = _hash(f"{up.path}/{style}")
    if not rules:
        return Node(tag, path, 0, 0, False), style
    names = [{w.lower() for w in _WORD.findall(x)} for x in f"{found.get('class', '')} {found.get('id', '')}".split()]
    root, noise, role = up.root, up.noise, found.get("role", "").lower()
    if tag == "article" or found.get("itemprop", "").lower() == "articlebody":
        root = 3
    elif tag == "main" or role == "main":
        root = max(root, 2)
    if root > up.root and noise == 1:
        noise = 0
    if tag in NOISE_TAG or role in NOISE_ROLE or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        noise = 2
    if tag not in ("html", "body", "main"):
        bad = [w & NOISE_NAME for w in names if _names_noise(w, up.root)]
        if any(w & READERS for w in bad):
            noise = 2
        elif bad or (up.root < 2 and (tag == "header" or any(w & NOISE_OUTSIDE and not w & MODIFIER for w in names))):
            noise = max(noise, 1)
        elif not noise and tag not in TEXTUAL and any(w & CONTENT_NAME for w in names):
            root = max(root, 1)
    return Node(tag, path, noise, root, up.inner or (up.root == 3 and tag not in TEXTUAL)), style


def _names_noise(words: set[str], root: int) -> bool:
    """If a class or id says noise: inside an article all its words must, but for neutral ones and comments; elsewhere one."""
    bad = words & NOISE_NAME
    if not bad or words & MODIFIER:
        return False
    return root < 2 or bool(words & READERS - PART) or (not bad <= PART and all(w in NOISE_NAME or w in NEUTRAL or w.isdigit() for w in words))


def parse(page: str, rules: bool = True) -> Page:
    """A page's blocks and branches, in one pass whose time is in proportion to its length, however deep it nests."""
    out, top = Page(), Node("", 0, 0, 0, False)
    stack, text, opened = [top], [], defaultdict(list)  # opened: by tag its places in the stack

    def flush() -> None:
        if text:
            words = entities.unescape("".join(text)).split()
            text.clear()
            if words:
                k = len(stack) - 1
                while stack[k].tag not in BLOCK and stack[k].tag:
                    k -= 1
                node = stack[k]
                out.path.append(node.path)
                out.up.append(stack[k - 1].path if k else 0)
                out.text.append(" ".join(words))
                out.noise.append(node.noise > 0)
                out.root.append(node.root)
                out.inner.append(node.inner)

    def close(to: int) -> None:
        for node in stack[to:]:
            opened[node.tag].pop()
            if node.styles:
                out.branch.append(node.path)
                out.shape.append(_hash("|".join(node.styles)))
        del stack[to:]

    def last(tags) -> int:
        return max((opened[t][-1] for t in tags if t in opened and opened[t]), default=0)

    def shut(tags, stop) -> None:
        """Close the nearest open one of tags, unless one of stop comes first."""
        k = last(tags)
        if k > last(stop):
            close(k)

    def push(node: Node) -> None:
        opened[node.tag].append(len(stack))
        stack.append(node)

    at, lower = 0, None
    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and (not stack[-1].tag or stack[-1].tag in BLOCK):  # text of inline noise goes
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            if tag in BLOCK:
                flush()
            shut({tag}, ())
            continue
        if tag in SKIPPED:
            lower = lower or page.lower()
            end = lower.find(f"</{tag}", at) if not (m[3] or "").endswith("/") else at
            at = len(page) if end < 0 else end
            continue
        if tag in VOID and tag != "hr":
            if tag == "br":
                text.append(" ")
            continue
        if tag not in BLOCK:  # inline elements have no node, unless presentation says that they are noise
            if rules:
                node, _ = _open(tag, m[3] or m[6] or "", stack[-1], rules)
                if node.noise and not stack[-1].noise:
                    push(node)
            continue
        flush()
        if tag in CLOSES_P:
            shut({"p"}, SCOPE)
        if tag in IMPLIED:
            shut(*IMPLIED[tag])
        if tag == "hr":
            continue
        node, style = _open(tag, m[3] or m[6] or "", stack[-1], rules)
        if stack[-1].styles[-1:] != [style]:  # a run of equal children is one
            stack[-1].styles.append(style)
        push(node)
    if at < len(page) and (not stack[-1].tag or stack[-1].tag in BLOCK):
        text.append(page[at:])
    flush()
    close(1)
    return out


def extract(page: str | None, low: frozenset[int] = frozenset(), lowest: frozenset[int] = frozenset(), rules: bool = True) -> str:
    """The main text of one page, given the paths whose importance is low at its host, for content elements the lowest ones."""
    p = parse(page or "", rules)
    least = min(2, max((r for r, noise in zip(p.root, p.noise) if not noise), default=0)) // 2 * 2
    rows = zip(p.path, p.text, p.noise, p.root, p.inner)
    return "\n".join(t for path, t, noise, root, inner in rows if not noise and root >= least and path not in (lowest if root == 3 and not inner else low))


def host_of(url) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?i)^\s*https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def parsed(pages: DataFrame, rules: bool = True) -> DataFrame:
    """page_id, url, host and blocks of every page, and what it adds to the style tree: for leaves and branches each path
    with each value once, and each path once without one. Written, so that a page is parsed once."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def listed(rows: list[list[tuple]], names: str, kinds: list) -> pa.ListArray:
        off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        columns = list(zip(*(x for r in rows for x in r))) or [[]] * len(kinds)
        return pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names.split()))

    def run(batches):
        for b in batches:
            blocks, leaves, branches = [], [], []
            for page in b["html"].to_pylist():
                p = parse(page or "", rules)
                blocks.append(list(zip(p.path, p.text, p.noise, p.root, p.inner)))
                leaves.append([*dict.fromkeys(zip(p.path, p.up, map(_hash, p.text))), *dict.fromkeys(zip(p.path, p.up, [None] * len(p.path)))])
                branches.append([*dict.fromkeys(zip(p.branch, p.branch, p.shape)), *((x, x, None) for x in dict.fromkeys(p.branch))])
            long = pa.int64()
            columns = [listed(blocks, "path text noise root inner", [long, pa.string(), pa.bool_(), pa.int32(), pa.bool_()])]
            columns += [listed(x, "path up value", [long] * 3) for x in (leaves, branches)]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], b["host"], *columns], ["page_id", "url", "host", "blocks", "leaves", "branches"])

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    block, mark = "array<struct<path:bigint,text:string,noise:boolean,root:int,inner:boolean>>", "array<struct<path:bigint,up:bigint,value:bigint>>"
    return materialize(map_arrow(rows, run, f"page_id {kinds['page_id']}, url string, host string, blocks {block}, leaves {mark}, branches {mark}"), "parsed")


def importance(rows: DataFrame) -> DataFrame:
    """The merged style trees: host, path, pages (so many have the node) and importance of every leaf node of parsed pages."""

    def spread(what: str) -> DataFrame:
        """By node: the pages that have it, the pages of its values summed, that times their logarithm, and its parent."""
        found = rows.select("host", F.explode(what).alias("x")).groupBy("host", "x.path", "x.value").agg(F.count("*").alias("n"), F.max("x.up").alias("up"))
        own = F.col("value").isNotNull()
        return found.groupBy("host", "path").agg(
            F.sum(F.when(~own, F.col("n"))).alias("pages"), F.sum(F.when(own, F.col("n"))).alias("total"), F.sum(F.when(own, F.col("n") * F.log("n"))).alias("nlogn"), F.max("up").alias("up")
        )

    leaves = spread("leaves")
    alike = F.col("nlogn") / F.col("total") / F.log("pages")  # mean entropy of a content's spread over the pages
    leaves = leaves.select("host", "path", "up", "pages", F.when(F.col("pages") > 1, 1 - alike).otherwise(1.0).alias("content"))
    shapes = (F.log("total") - F.col("nlogn") / F.col("total")) / F.log("pages")  # entropy of the presentations
    branches = spread("branches")
    branches = branches.select("host", F.col("path").alias("up"), F.when(F.col("pages") > 1, F.least(F.lit(1.0), shapes)).otherwise(1.0).alias("shape"))
    both = leaves.join(branches, ["host", "up"], "left")
    return both.select("host", "path", "pages", (F.lit(GAMMA) * F.col("content") + F.lit(1 - GAMMA) * F.coalesce("shape", F.lit(1.0))).alias("importance"))


def weighed() -> Column:
    """The importance of a node by what its pages show and by a prior importance of 1 that counts as PRIOR pages."""
    seen = F.col("pages") - 1
    return (PRIOR + seen * F.col("importance")) / (PRIOR + seen)


def texts(pages: DataFrame, rules: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html). rules=False: by the style tree alone."""
    rows = parsed(pages, rules)
    nodes = importance(rows).filter(weighed() < LOW)
    sure = F.when(weighed() < LOWEST, F.col("path"))
    noise = materialize(nodes.groupBy("host").agg(F.collect_list("path").alias("low"), F.collect_list(sure).alias("lowest")), "noise")
    if (noise.agg(F.sum(F.size("low"))).first()[0] or 0) <= BROADCAST_NODES:
        rows = rows.join(F.broadcast(noise), "host", "left")
    else:
        rows = hot_join(rows, rows.select("host").distinct().join(noise, "host", "left"), "host")
    own = F.filter("blocks", lambda b: ~b["noise"])
    # in a page with an article or main element, what is outside of them isn't content
    rows = rows.withColumn("own", own).withColumn("least", F.when(F.exists("own", lambda b: b["root"] >= 2), 2).otherwise(0))
    none = F.array().cast("array<bigint>")
    low, lowest = F.coalesce("low", none), F.coalesce("lowest", none)
    kept = F.filter("own", lambda b: (b["root"] >= F.col("least")) & ~F.when((b["root"] == 3) & ~b["inner"], F.array_contains(lowest, b["path"])).otherwise(F.array_contains(low, b["path"])))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op6(spark, sf_dir: str) -> DataFrame:
    return texts(table(spark, sf_dir, "pages"))
