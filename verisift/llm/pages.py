"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree.  A node is a path of elements, each named by its tag and its
presentation (classes and id, digits made alike); inline markup makes no node.  For each node the tree counts
  styles    the sequences of child elements it is seen with,
  contents  the whole texts of its branch, and
  evidence  what its presentation says of it, on the average of its places.
With m places seen, a value seen n times has the entropy share ln(n) / ln(m).  The importance of a node's
styles is their normalised entropy, that of its contents 1 less the mean entropy share, so that what every page repeats has none.
Both make the entropy's importance c = (1 - DECAY**l) * style + DECAY**l * content with l styles (SURE where fewer than LEAST places are
seen), and the evidence moves it on the log-odds scale:
  importance = sigmoid(ln(c / (1 - c)) + evidence)
Evidence is STRONG against elements and class words of menus, headers, footers, sidebars, notices, adverts, forms and reader
comments, and against what stands beside a landmark (article, main) of its page; WEAK against words that often stand in articles too (related, share,
legal); and as strong in favour of landmarks themselves.

The importance decides for every branch: a block of text has that of the least important branch around it, and goes below
THRESHOLD.  A page that would lose all (a host of copies) keeps its most important blocks, but none below FLOOR, where strong evidence lies.

Blocks are the runs of text between block elements; character references are decoded, white space becomes
one space, empty blocks go, the rest is joined in page order by a line feed; <br> is white space.

Pages are parsed in one pass, whatever their length and depth; a page is held whole by one task.  A null html counts as empty, its text is
empty.  A null or odd url belongs to the host ''.  Rows that share a page_id are kept apart; rows that are equal have equal
texts.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, scratch, slices

THRESHOLD, FLOOR, DECAY = 0.3, 0.01, 0.9
#: Places of a node from which its entropy counts, and the entropy's importance at most (at least: 1 less it).
LEAST, SURE = 4, 0.98
#: Evidence on the log-odds scale.
STRONG, WEAK = 9.0, 2.0
#: Ends of the names of nodes that attributes besides class and id, or their place beside a landmark, tell from others.
MARKED, BESIDE = "!", "~"

# Elements of HTML by what they do to text.
RAW = {"script", "style", "template", "iframe", "textarea", "title", "select", "canvas", "audio", "video"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCK = {"html", "head", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "header", "footer", "nav", "aside", "form", "fieldset", "dialog", "menu", "hgroup", "center", "button", "label", "legend", "noscript"}
NOISE_TAGS = {"head", "nav", "footer", "aside", "form", "fieldset", "dialog", "menu", "button", "label", "legend"}
LANDMARKS = {"article", "main"}
#: Starts that end an open paragraph are all of BLOCK; an item ends an open item of its list.
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LISTS = {"ul", "ol", "dl", "table", "thead", "tbody", "tfoot"}
#: Words of classes, ids and roles that mark what is no main text, and those that often do.
NOISE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "outbrain", "taboola",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "skip", "sitemap", "toolbar",
    "header", "masthead", "topbar", "footer", "bottombar", "colophon", "copyright",
    "sidebar", "aside", "rail", "widget", "widgets", "complementary",
    "notice", "notices", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "toast", "paywall", "subscribe", "subscription", "newsletter", "signup", "signin", "login", "register", "searchbox", "form", "contentinfo",
    "comment", "comments", "commentlist", "disqus", "respond",
}
LIKELY_WORDS = {"related", "recommended", "recommendations", "trending", "popular", "teaser", "share", "sharing", "social", "hidden", "legal", "disclaimer", "imprint", "reply", "replies", "search", "alert", "toc", "tabs"}
#: Words that make a noise word a matter of layout; words whose own header is main text; elements that class words do not remove.
LAYOUT_WORDS = {"with", "without", "has", "no"}
CONTENT_WORDS = {"article", "content", "entry", "post", "story"}
WHOLE = {"html", "body", "main"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
#: An attribute's name and value; a stray quoted string is passed over whole.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?|"[^"]*"|'[^']*'""")
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[A-Za-z]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)")


@dataclass
class Node:
    #: by tag and presentation
    name: str
    parent: int
    #: hash of the path of names
    key: int = 0
    evidence: float = 0.0
    landmark: bool = False
    #: within a landmark, or one
    inside: bool = False
    children: list[str] = field(default_factory=list)


@dataclass
class Page:
    nodes: list[Node]
    #: node and text of each block, in page order
    blocks: list[tuple[int, str]]


def _hash(text: str, seed: int = 0) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"), seed & (1 << 64) - 1) - (1 << 63)


def node_key(path: str) -> int:
    """The key of a path of names, as /html/body/div.main."""
    key = 0
    for name in path.split("/")[1:]:
        key = _hash(name, key)
    return key


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def marked(token: str) -> float:
    """How strongly a class or id speaks against its part: `post-comments` does, `has-sidebar` and `entry-header` do not."""
    words = [w.lower() for w in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token))]
    found = NOISE_WORDS.intersection(words)
    if LAYOUT_WORDS.intersection(words) or (found == {"header"} and words[0] in CONTENT_WORDS):
        return 0.0
    return STRONG if found else WEAK if LIKELY_WORDS.intersection(words) else 0.0


def presentation(tag: str, attributes: str) -> tuple[str, float, bool]:
    """A node's name, how strongly its presentation speaks against it, and whether it is a landmark."""
    against = STRONG if tag in NOISE_TAGS else 0.0
    if not attributes or attributes.isspace():
        return tag, against, tag in LANDMARKS
    found: dict[str, str] = {}
    for key, *value in _ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), "".join(value))  # the first of a name counts
    name, said = tag, 0.0
    for key, sign in (("class", "."), ("id", "#")):
        if found.get(key):
            tokens = sorted(set(found[key].split()))
            name += "".join(sign + _DIGITS.sub("0", t) for t in tokens)
            said = max([said, *map(marked, tokens)])
    landmark = tag in LANDMARKS or found.get("role", "").lower() == "main" or "articlebody" in found.get("itemprop", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    role = tag not in WHOLE and set(found.get("role", "").lower().split()) & NOISE_WORDS
    if hidden or role or (landmark and tag not in LANDMARKS):  # what class and id do not tell
        name += MARKED
    against = max(against, 0.0 if tag in WHOLE else said, STRONG if hidden or role else 0.0)
    return name, against, landmark and against < STRONG


class _Open:
    """The open elements: tag and node of each, how many of a tag are open, and where paragraphs, items and lists stand."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.count: Counter = Counter()
        self.paragraphs: list[int] = []
        self.items: list[int] = []

    def push(self, tag: str, node: int) -> None:
        if tag == "p":
            self.paragraphs.append(len(self.stack))
        elif tag in ITEMS or tag in LISTS:
            self.items.append(len(self.stack))
        self.count[tag] += 1
        self.stack.append((tag, node))

    def cut(self, depth: int) -> None:
        for tag, _ in self.stack[depth:]:
            self.count[tag] -= 1
        del self.stack[depth:]
        for places in (self.paragraphs, self.items):
            while places and places[-1] >= depth:
                places.pop()

    def close(self, tag: str) -> None:
        if self.count[tag]:
            depth = len(self.stack) - 1
            while self.stack[depth][0] != tag:
                depth -= 1
            self.cut(depth)

    def make_way(self, tag: str) -> None:
        """Closes what the start of a block element ends: a paragraph, an item of the same list."""
        if self.paragraphs and tag not in ("label", "button"):
            self.cut(self.paragraphs[-1])
        ends = ITEMS.get(tag, ())
        for depth in reversed(self.items) if ends else ():
            own = self.stack[depth][0]
            if own in ends:
                if tag != "tr" or own == "tr":
                    self.cut(depth)
                    break
            elif own in LISTS and (tag != "tr" or own == "table"):
                break


def parse(html: str) -> Page:
    """The block elements of a page as a tree, and its blocks of text."""
    nodes = [Node("", -1)]
    open_ = _Open()
    blocks: list[tuple[int, str]] = []
    run: list[str] = []
    at, end = 0, len(html)

    def flush() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                blocks.append((open_.stack[-1][1], text))
            run.clear()

    while at < end:
        found = _TAG.search(html, at)
        if not found:
            run.append(html[at:])
            break
        if found.start() > at:
            run.append(html[at : found.start()])
        at = found.end()
        tag = found[3] or found[6]
        if not tag:
            if found[1] is not None:
                run.append(found[1].replace("&", "&amp;"))
            continue
        tag, closing = tag.lower(), bool(found[2] or found[5])
        if tag in RAW and not closing:
            close = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(html, at)
            at = close.end() if close else (end if tag in ("script", "style", "textarea", "title") else at)
            run.append(" ")
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in BLOCK:
            continue
        flush()
        if closing:
            open_.close(tag)
            continue
        open_.make_way(tag)
        name, against, landmark = presentation(tag, found[4] if found[3] else found[7])
        parent = nodes[open_.stack[-1][1]]
        if tag == "header" and not parent.inside:
            against, landmark = STRONG, False
        open_.push(tag, len(nodes))
        if not parent.children or parent.children[-1] != name:
            parent.children.append(name)
        nodes.append(Node(name, open_.stack[-2][1], 0, STRONG if landmark else -against, landmark, landmark or parent.inside))
    flush()
    # What stands beside the landmarks of its page, neither in one nor around one, is another node than what does not.
    around = [node.landmark for node in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        around[nodes[k].parent] |= around[k]
    for k, node in enumerate(nodes[1:], 1):
        if around[0] and not node.inside and not around[k]:
            node.evidence, node.name = node.evidence - STRONG, f"{node.name}{BESIDE}"
        node.key = _hash(node.name, nodes[node.parent].key)
    return Page(nodes, blocks)


def main_text(page: Page, importance: dict[int, float]) -> str:
    """The blocks whose branches are all important enough; importance: of the page's nodes, 1 where not named."""
    own = [importance.get(0, 1.0)]
    for node in page.nodes[1:]:
        own.append(min(own[node.parent], importance.get(node.key, 1.0)))
    enough = max(FLOOR, min(THRESHOLD, max((own[k] for k, _ in page.blocks), default=0.0)))
    return "\n".join([text for k, text in page.blocks if own[k] >= enough])


def importance_of(c: float, evidence: float) -> float:
    c = min(max(c, 1 - SURE), SURE)
    return 1 / (1 + math.exp(-(math.log(c / (1 - c)) + evidence)))


def by_evidence(page: Page) -> dict[int, float]:
    """Importance of the nodes of a page that stands alone."""
    return {node.key: importance_of(SURE, node.evidence) for node in page.nodes[1:]}


SEEN = "page long, check long, host long, node long, style long, content long, evidence double, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each page with their styles, contents and evidence; equal ones of a page counted."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
    for batch in slices(batches):
        rows: list[tuple] = []
        for page_key, check, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page, host = parse(html or ""), _hash(host_of(url))
            inner, has = [0] * len(page.nodes), [False] * len(page.nodes)
            for k, text in page.blocks:
                inner[k], has[k] = inner[k] + _hash(text), True
            for k in range(len(page.nodes) - 1, 0, -1):
                up = page.nodes[k].parent
                inner[up], has[up] = inner[up] + inner[k], has[up] or has[k]
            counts: Counter = Counter()
            for k, node in enumerate(page.nodes[1:], 1):
                content = (inner[k] + (1 << 63)) % (1 << 64) - (1 << 63) if has[k] else None
                counts[node.key, _hash("\0".join(node.children)), content, node.evidence] += 1
            rows += [(page_key, check, host, *key, n) for key, n in counts.items()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], [x.split()[0] for x in SEEN.split(", ")])


def seen(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to the nodes of all pages; a page is known by two hashes of its row."""
    keys = [F.xxhash64("page_id", "url", "html").alias("page"), F.xxhash64("html", F.lit(1), "url", "page_id").alias("check")]
    return pages.select(*keys, "url", "html").mapInArrow(_count, SEEN)


def style_tree(nodes: DataFrame) -> DataFrame:
    """The nodes of all pages to one row for each node of each host: host, node, seen, entropy (c), evidence, importance."""
    values = nodes.select("host", "node", "n", "evidence", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("style").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("value")))).alias("v")).select("host", "node", "n", "evidence", "v.*").where("value IS NOT NULL")
    counted = values.groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("evidence")).alias("said"))
    # sum of n ln n and of n give the entropy whatever the number of values: ln m - sum(n ln n) / m
    nln = F.col("n") * F.log(F.col("n").cast("double"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    both = counted.groupBy("host", "node").agg(of(0, F.col("n")).alias("seen"), of(0, nln).alias("nln0"), F.count_if(F.col("kind") == 0).alias("l"), of(1, F.col("n")).alias("m"), of(1, nln).alias("nln1"), of(0, F.col("said")).alias("said"))
    share = lambda n, x: F.when(F.col(n) > 1, 1 - F.col(x) / F.col(n) / F.log(F.col(n).cast("double"))).otherwise(1.0)
    decay = F.pow(F.lit(DECAY), F.col("l"))
    c = F.when(F.col("seen") < LEAST, F.lit(SURE)).otherwise((1 - decay) * share("seen", "nln0") + decay * share("m", "nln1"))
    judged = both.select("host", "node", "seen", F.least(F.greatest(c, F.lit(1 - SURE)), F.lit(SURE)).alias("entropy"), (F.col("said") / F.col("seen")).alias("evidence"))
    odds = F.log(F.col("entropy") / (1 - F.col("entropy"))) + F.col("evidence")
    return judged.withColumn("importance", 1 / (1 + F.exp(-odds)))


EXTRACTED = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [main_text(parse(html or ""), {x["node"]: x["importance"] for x in low or ()}) for html, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, tree: Callable[[DataFrame], DataFrame] = style_tree) -> DataFrame:
    """(page_id, url, html) to (page_id, url, text, n_chars); tree: gives the importance of the nodes of all pages."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    with scratch(pages.sparkSession):
        nodes = keep(seen(pages), "page-nodes")
        low = keep(tree(nodes).where(F.col("importance") < THRESHOLD).select("host", "node", "importance"), "low-branches")
        # Each page gets the low ones of its own nodes, so that no row grows with its host.
        own = keep(nodes.select("page", "check", "host", "node").distinct().join(low, ["host", "node"]).groupBy("page", "check").agg(F.collect_list(F.struct("node", "importance")).alias("low")), "low-nodes", for_result=True)
    keyed = pages.withColumn("page", F.xxhash64("page_id", "url", "html")).withColumn("check", F.xxhash64("html", F.lit(1), "url", "page_id"))
    return keyed.join(own, ["page", "check"], "left").select("page_id", "url", "html", "low").mapInArrow(_extract, EXTRACTED)
