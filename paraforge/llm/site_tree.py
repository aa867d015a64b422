"""Main text of web pages by a site style tree.

The DOMs of all pages of a host are merged: elements with the same path (tags, each with its first class or id, nameless
containers with their number among their like) are one node of the site's tree. For a node that m pages have

* presentation importance is the entropy, to base m, of the child sequences the pages show there;
* content importance is 1 minus the mean, over the distinct text blocks below it, of log_m of the
  number of pages that show the block (a block on every page weighs 0, one on a single page 1);
* the composite is (1 - g^l) * presentation + g^l * content, with l child sequences and g = 0.9.

A page then loses whole branches:

* what its element says is no text: navigation, header, footer, sidebar, form, script; a role or hidden state of that sense; or a
  class or id one of whose tokens consists of such words (``ad``, ``cookie-notice``; ``has-sidebar`` is none);
* everything beside the article, if the page marks one. An article element inside a branch of the first kind (a reader comment) is
  no article, unless there is no other and it holds most of the page's text; then nothing around it counts as such a branch;
* containers (``CONTAINERS``) of composite importance below ``LEAST``: anywhere on a page without an article, and inside articles, where
  paragraphs and headings stay. If a site repeats whole articles, so that nothing would be left, they stay whole.

No branch that holds most of the article's (or, without one, the page's) text goes for its name or importance.
Nodes that fewer than ``PAGES`` pages have count as important, as so few tell nothing (two copies of a page repeat all of it).

Text: character references decoded, white space of a block (``br`` included) made one space, trimmed, blocks in
page order joined by one newline. Null html gives an empty text; null urls and urls without a host form
one site; repeated rows are pages of their own; columns beside page_id, url and html are ignored; an empty table gives an empty
result. Counts are partial aggregates per (host, node, feature), so a host with a third of all pages is no hot group.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraforge.llm.common import stored, table
from paraforge.llm.urls import host_of

GAMMA = 0.9
LEAST = 0.5
PAGES = 5
# Elements by their part in the HTML standard.
RAW = "script|style|noscript|template|iframe|svg|math|textarea|title"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr"}
NOISE_TAGS = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "select", "button", "object"}
ARTICLE_TAGS = {"article", "main"}
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "details", "center", "fieldset"}
# Words of class and id names that tell the role of a branch, and words that only tell its place or shape.
NOISE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
               "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav",
               "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted", "related", "respond", "share",
               "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets"}
SHAPE_WORDS = {"area", "bar", "block", "bottom", "box", "container", "desktop", "first", "form", "global", "inner", "item", "items", "last",
               "left", "link", "links", "list", "main", "mobile", "module", "outer", "page", "panel", "primary", "right", "secondary",
               "section", "site", "slot", "sub", "text", "thread", "top", "unit", "wrap", "wrapper"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog"}

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    rf"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)"
    rf"|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
CLOSES_P = re.compile(r"(?:address|article|aside|blockquote|center|details|dialog|dir|div|dl|fieldset|figcaption|figure|footer|"
                      r"form|h[1-6]|header|hgroup|hr|main|menu|nav|ol|p|pre|section|summary|table|ul)\Z")


class Element:
    """One element: ``noise`` is "" or what tells that it is no text ("tag" or "name"), ``size`` the length of the text below it."""
    __slots__ = ("tag", "path", "noise", "parent", "children", "size", "numbers")

    def __init__(self, tag, path, noise, parent):
        self.tag, self.path, self.noise, self.parent = tag, path, noise, parent
        self.children, self.size, self.numbers = [], 0, {}

    def chain(self):
        """The element and all around it, innermost first."""
        e = self
        while e is not None:
            yield e
            e = e.parent


def _noise_name(value: str) -> bool:
    """Whether a token of a class or id consists of words for what is no text (and of its place or shape)."""
    for token in value.split():
        words = set(NAME_WORDS.findall(token))
        if not words.isdisjoint(NOISE_WORDS) and words <= NOISE_WORDS | SHAPE_WORDS:
            return True
    return False


def _element(tag: str, rest: str, parent: Element | None) -> Element:
    noise, name = "tag" if tag in NOISE_TAGS else "", ""
    if tag == "header" and parent and any(e.tag in ARTICLE_TAGS for e in parent.chain()):
        noise = ""  # the head of the article itself
    for key, a, b, c in ATTRIBUTE.findall(rest) if rest else ():
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id"):
            name = name or (value.split() or [""])[0]
            if tag not in ("body", "html") and _noise_name(value):
                noise = noise or "name"
        elif key == "role" and value in NOISE_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            noise = noise or "name"
    number = ""
    if parent and not name and tag in CONTAINERS:
        number = parent.numbers[tag] = parent.numbers.get(tag, 0) + 1
    path = xxhash.xxh64_intdigest(f"{parent.path if parent else 0}/{tag}.{name}.{number}") - (1 << 63)
    return Element(tag, path, noise, parent)


def blocks(page: str) -> tuple[list[tuple[str, Element]], list[Element]]:
    """The text blocks of a page with their innermost elements, and all elements with their children."""
    root = _element("html", "", None)
    stack, every, out, held = [root], [root], [], []

    def flush():
        if held:
            text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append((text, stack[-1]))
                for e in stack:
                    e.size += len(text)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at:m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m["raw"]:
                held.append(" ")
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
        if tag in INLINE or tag in VOID and tag != "hr" or tag == "html":
            continue
        flush()
        if tag == "body":
            del stack[1:]  # ends a head that was left open
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if CLOSES_P.match(tag):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "section", "div", "td", "body"):
                    break
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            if stack[-1].tag == tag:
                del stack[-1:]
        node = _element(tag, m["rest"] or m["rest2"] or "", stack[-1])
        if not stack[-1].children or stack[-1].children[-1] != node.path:
            stack[-1].children.append(node.path)  # runs of like children count as one
        every.append(node)
        rest = m["rest"] or ""
        if tag != "hr" and not rest.endswith("/"):
            stack.append(node)
    if at < len(page):
        held.append(page[at:])
    flush()
    return out, every


def articles(every: list[Element]) -> list[Element]:
    """The elements that mark a page's article."""
    marked = [e for e in every if e.tag in ARTICLE_TAGS and not e.noise and e.size]
    clean = [e for e in marked if not any(x.noise for x in e.chain())]
    most = max(marked, key=lambda e: e.size, default=None)
    return clean or ([most] if most and 2 * most.size > every[0].size else [])


def extract(page: str, low: frozenset) -> str:
    """The main text of a page, given the low-importance nodes of its site."""
    found, every = blocks(page)
    inside = set(map(id, articles(every)))
    whole = sum(e.size for e in every if id(e) in inside and not any(id(x) in inside for x in e.chain() if x is not e)) or every[0].size
    around = {id(x) for e in every if id(e) in inside for x in e.chain()}
    verdicts: dict[int, tuple[bool, bool]] = {}  # whether text right below stays: without, and with, regard to importance
    for e in every:
        stays, important = verdicts[id(e.parent)] if e.parent else (not inside, not inside)
        if id(e) in inside and not stays:
            stays = important = True
        small = 2 * e.size <= whole
        if e.noise and (small or e.noise == "tag" and id(e) not in around):
            stays = important = False
        elif small and e.tag in CONTAINERS and e.path in low:
            important = False
        verdicts[id(e)] = stays, important
    kept = [t for t, e in found if verdicts[id(e)][1]]
    return "\n".join(kept or ([t for t, e in found if verdicts[id(e)][0]] if inside else []))


def _features(batches):
    """mapInArrow over (host, html): (host, node, style?, feature), each once per page."""
    for batch in batches:
        hosts, nodes, styles, features = [], [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not page:
                continue
            found, every = blocks(page)
            own = {}
            for e in every:
                own.setdefault((e.path, True), xxhash.xxh64_intdigest(repr(e.children)) - (1 << 63))
            rows = {(path, True, value) for (path, _), value in own.items()}
            for text, inner in found:
                value = xxhash.xxh64_intdigest(text) - (1 << 63)
                rows.update((e.path, False, value) for e in inner.chain())
            hosts += [host] * len(rows)
            for path, style, value in rows:
                nodes.append(path)
                styles.append(style)
                features.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(nodes, pa.int64()),
                                          pa.array(styles, pa.bool_()), pa.array(features, pa.int64())],
                                         names=["host", "node", "style", "feature"])


def importance(pages: DataFrame) -> DataFrame:
    """(host, node, pages, presentation, content, importance) of the site trees of all hosts."""
    rows = pages.select("host", "html").mapInArrow(_features, "host string, node long, style boolean, feature long")
    counts = rows.groupBy("host", "node", "style", "feature").agg(F.count(F.lit(1)).alias("c"))
    c = F.col("c").cast("double")
    sums = counts.groupBy("host", "node").agg(
        F.sum(F.when(F.col("style"), F.col("c"))).alias("pages"),
        F.sum(F.when(F.col("style"), c * F.log(c))).alias("_clogc"),
        F.sum(F.when(F.col("style"), 1)).alias("variants"),
        F.coalesce(F.avg(F.when(~F.col("style"), F.log(c))), F.lit(0.0)).alias("_logc"))
    m = F.col("pages").cast("double")
    many = F.col("pages") >= PAGES
    sums = (sums.withColumn("presentation", F.when(many, (F.log(m) - F.col("_clogc") / m) / F.log(m)).otherwise(1.0))
            .withColumn("content", F.when(many, 1 - F.col("_logc") / F.log(m)).otherwise(1.0)))
    part = F.pow(F.lit(GAMMA), F.col("variants"))
    return sums.select("host", "node", "pages", "presentation", "content",
                       ((1 - part) * F.col("presentation") + part * F.col("content")).alias("importance"))


def _extract(batches):
    """mapInArrow over (host, html, low, page_id, url)."""
    held, nodes = None, frozenset()
    for batch in batches:
        texts = []
        for host, page, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if host != held:
                held, nodes = host, frozenset(low.as_py() or ())
            texts.append(extract(page, nodes) if page else "")
        yield pa.RecordBatch.from_arrays(
            [batch.column(3), batch.column(4), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))
    low = importance(rows).filter(F.col("importance") < least)
    # A host's list grows with its templates, not with its pages: only nodes of several pages can be low.
    low = stored(low.groupBy("host").agg(F.collect_list("node").alias("low")), "site-low")
    joined = rows.join(low, "host", "left").select("host", "html", "low", "page_id", "url")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return main_texts(table(spark, sf_dir, "pages", "page_id", "url", "html"))
