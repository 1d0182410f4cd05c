"""Main text of web pages with site template removal.

1. Every page is parsed into a light tree.  Menus, page headers, footers, sidebars, notices, adverts, forms, scripts,
   styles and reader comments go by tag, role or, on container elements, by class and id words that name just that.
2. The main part is chosen by how much text outside links it holds: the article or main parts if they have a good share of
   what the page has, else the whole page.  A container that is named like a menu or a sidebar is read after all if it
   holds most of the page's text; reader comments never are, and parts within them are no main parts.
3. Of the subtrees that stay, each is hashed, and Spark counts for every host and hash the different pages it appears on.
   Pages of equal kept text are copies of one page and count once, so they do not make its paragraphs a template.
4. Subtrees that recur on a share of the pages of a host are its template and are deleted from the pages that hold them.
   Within an article or main part only large containers can be template, so headings, paragraphs, cells and items that
   pages share stay.  Class and id words that may also stand in an article (related, print, notice ...) decide nothing
   alone: they make a container template from two pages on.

Counting is a grouped aggregation with map-side counts on (host, subtree), so a host with a third of all pages is spread
over its subtrees.  A page's template hashes come to it by its digest.  Scanning is one pass without recursion, so depth
and unclosed tags cost no more than their length.

A block is the text between the borders of block elements; <br> is white space.  As in browsers, a tag, comment or script
that never ends takes the rest of the page.  Defined results: a null or empty html has no blocks and gives an empty text; a
null url is a host of its own; repeated rows are extracted row by row; an empty table gives an empty result; extra columns
pass through, and columns named text or n_chars are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import cut, meet, spare, table

#: A subtree is template when it appears on so many pages of its host that are not copies and on this share of them.
MIN_PAGES = 8
MIN_SHARE = 0.2
#: Characters from which a container within a main part can be template.
LARGE = 200
#: Of a page's text outside links, what its main parts hold at least; and how many times the rest a container named like
#: a menu must hold to be read after all.
MAIN_SHARE = 0.3
NAMED_TIMES = 3
#: Pages from which a container with a doubtful name is template.
DOUBTFUL_PAGES = 2

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""[\s/]*([^\s/>=]+|=[^\s/>=]*)(?:\s*=\s*("|'|[^\s>"'][^\s>]*)?)?""")
_GAP = re.compile(r"[\s/]*")
#: Element names (fixed values).
_RAW = frozenset("script style noscript template iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul caption title option select".split()
)
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option"}
_GONE = _RAW | frozenset("head nav footer aside form button select option input textarea menu dialog object embed audio video title".split())
_GONE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_WHOLE = frozenset("html body article main".split())
_CONTAINER = frozenset("div section ul ol dl table details figure".split())
_GONE_NAME = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|masthead|footer|sidebar|cookies?|consent|gdpr|popup|modal|overlay|"
    r"ads?|advert\w*|adsense|sponsored|newsletter|comments?|replies|disqus|pagination|pager)(?:$|[\s_-])",
    re.I,
)
_COMMENTS_NAME = re.compile(r"(?:^|[\s_-])(?:comments?|replies|disqus|respond)(?:$|[\s_-])", re.I)
_ADVERT_NAME = re.compile(r"(?:^|\s)(?:ads?|advert|adverts|advertisement|adsense|sponsored)(?:$|\s)", re.I)
_DOUBTFUL_NAME = re.compile(
    r"(?:^|[\s_-])(?:header|aside|widget|notice|banner|promo\w*|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|respond|"
    r"toolbar|skip|print|copyright|sponsor)(?:$|[\s_-])",
    re.I,
)
_ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_PAIRED = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}


class Node:
    """``gone``: goes by tag or role; ``named``: by class or id; ``closed``: never read, comments and adverts by class or id."""

    __slots__ = ("tag", "children", "gone", "named", "doubtful", "main", "closed")

    def __init__(self, tag: str, gone: bool = False, named: bool = False, doubtful: bool = False, main: bool = False, closed: bool = False):
        self.tag, self.children, self.gone, self.named, self.doubtful, self.main, self.closed = tag, [], gone, named, doubtful, main, closed


def scan(page: str) -> Iterator[tuple[str, str, dict[str, str], bool]]:
    """Texts ("", text, {}, False) and tags (kind, name, attributes, self-closed) of a page; kind is "<" or "/"."""
    at, text, end = 0, 0, len(page)
    while (at := page.find("<", at)) >= 0:
        mark, low = page[at + 1 : at + 2], page[at + 1 : at + 2] == "/"
        if mark in ("!", "?") and mark:
            close, size = ("-->", 3) if page.startswith("<!--", at) else (">", 1)
            upto = page.find(close, at + 2)
        elif m := _NAME.match(page, at + 1 + low):
            name, attrs, upto = m[0].lower(), {}, -1
            i = m.end()
            while i < end:
                i = _GAP.match(page, i).end()
                if page[i : i + 1] == ">":
                    upto, size = i, 1
                    break
                if not (a := _ATTR.match(page, i)):
                    break
                key, value, i = a[1].lower(), a[2], a.end()
                if value in ("\"", "'"):
                    close = page.find(value, i)
                    if close < 0:
                        break
                    value, i = page[i:close], close + 1
                attrs.setdefault(key, value or "")
        else:
            at += 1
            continue
        if at > text:
            yield "", page[text:at], {}, False
        if upto < 0:
            return
        here, at = at, upto + size
        text = at
        if mark in ("!", "?"):
            continue
        yield "/" if low else "<", name, attrs, page[upto - 1] == "/" and upto - 1 > here
        if not low and name in _RAW:
            m = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            if not m:
                return
            text = at = m.start()
    if text < end:
        yield "", page[text:], {}, False


class _Open:
    """The open elements and where each tag, block and main part stands among them."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks, self.mains = [root], {}, [], 0

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in _BLOCK:
            self.blocks.append(len(self.nodes))
        self.mains += node.main
        self.nodes.append(node)

    def close(self, depth: int) -> None:
        while len(self.nodes) > depth:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.tag in _BLOCK:
                self.blocks.pop()
            self.mains -= node.main

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def parse(page: str) -> Node:
    """A tree of elements and texts; unclosed paragraphs, list items and cells end where HTML ends them."""
    root = Node("#root")
    stack = _Open(root)
    for kind, tag, attrs, closed in scan(page):
        if not kind:
            stack.nodes[-1].children.append(tag)
            continue
        if kind == "/":
            depth = stack.last(tag)
            if depth and (tag in _BLOCK or not stack.blocks or stack.blocks[-1] <= depth):
                stack.close(depth)
            continue
        if tag in _CLOSES_P:
            depth = stack.last("p")
            if depth and stack.blocks[-1] == depth:
                stack.close(depth)
        if tag in _ENDS:
            depth = stack.last(*_PAIRED.get(tag, (tag,)))
            if depth > stack.last(*_ENDS[tag]):
                stack.close(depth)
        role, inside = attrs.get("role", "").lower(), stack.mains > 0
        all_names = f"{attrs.get('class', '')} {attrs.get('id', '')}" if tag not in _WHOLE else ""
        names = all_names if tag in _CONTAINER else ""
        gone = tag in _GONE or role in _GONE_ROLE or (tag == "header" and not inside) or "hidden" in attrs
        doubtful = bool(_DOUBTFUL_NAME.search(names))
        shut = bool(_ADVERT_NAME.search(all_names) or _COMMENTS_NAME.search(names))
        node = Node(tag, gone, shut or bool(_GONE_NAME.search(names)), doubtful, tag in ("article", "main") or role == "main", shut)
        stack.nodes[-1].children.append(node)
        if tag not in _VOID and not closed:
            stack.push(node)
    return root


def _hidden(node: Node, through: bool) -> bool:
    """Whether a node is not read; ``through`` reads containers that are named like menus and the like."""
    return node.gone or node.closed or (node.named and not through)


def _weight(roots: list[Node], through: bool = False) -> int:
    """Characters outside links under ``roots``."""
    total, todo = 0, [r for r in roots if not _hidden(r, through)]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, str):
                total += len(child.strip())
            elif child.tag != "a" and not _hidden(child, through):
                todo.append(child)
    return total


def _mains(root: Node, through: bool) -> list[Node]:
    """The outermost article or main parts; articles inside a main part stand for it if they have its text."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str) or _hidden(node, through):
            continue
        if node.main:
            articles, below = [], node.children[::-1]
            while node.tag != "article" and below:
                n = below.pop()
                if isinstance(n, Node) and not _hidden(n, through):
                    if n.tag == "article":
                        articles.append(n)
                    else:
                        below += n.children[::-1]
            found += articles if articles and _weight(articles, through) >= MAIN_SHARE * _weight([node], through) else [node]
        else:
            todo += node.children[::-1]
    return found


def content_roots(root: Node) -> tuple[list[Node], bool]:
    """The main parts or the whole page, and whether containers named like menus are read."""
    for through in (False, True):
        mains, whole = _mains(root, through), _weight([root], through)
        roots = mains if mains and _weight(mains, through) >= MAIN_SHARE * whole else [root]
        if through or NAMED_TIMES * _weight(roots) >= _weight(_mains(root, True) or [root], True):
            break
    return roots, through


class _Frame:
    """A node on the way: its place in the output, the parts of its hash and its characters."""

    __slots__ = ("node", "children", "mark", "parts", "size")

    def __init__(self, node: Node, out: list[list[str]]):
        self.node, self.children, self.mark, self.parts, self.size = node, iter(node.children), (len(out), len(out[-1])), [node.tag], 0
        if node.tag in _BLOCK:
            out.append([])


def _may_be_template(frame: _Frame, in_main: bool) -> bool:
    node = frame.node
    if node.tag not in _BLOCK or node.tag in _WHOLE or not any(frame.parts[1:]):
        return False
    return not in_main or node.doubtful or (node.tag in _CONTAINER and frame.size >= LARGE)


def _blocks(root: Node, through: bool, cut_hashes: frozenset, out: list[list[str]], seen: dict[int, bool] | None) -> None:
    """Append the blocks under ``root``; ``seen`` collects the hashes of subtrees that may be template and whether their name is doubtful."""
    frames = [_Frame(root, out)]
    while frames:
        frame = frames[-1]
        child = next(frame.children, None)
        if isinstance(child, str):
            out[-1].append(child)
            frame.parts.append(" ".join(child.split()))
            frame.size += len(frame.parts[-1])
        elif child is not None:
            if child.tag == "br":
                out[-1].append(" ")
            elif _hidden(child, through):
                frame.parts.append("0")
            else:
                frames.append(_Frame(child, out))
        else:
            frames.pop()
            own = xxhash.xxh3_64_intdigest("\x1f".join(frame.parts))
            own -= (own >> 63) << 64
            if _may_be_template(frame, root.main):
                if seen is not None:
                    seen[own] = seen.get(own, False) or frame.node.doubtful
                if own in cut_hashes:
                    del out[frame.mark[0] :]
                    del out[-1][frame.mark[1] :]
            if frame.node.tag in _BLOCK:
                out.append([])
            if frames:
                frames[-1].parts.append(str(own))
                frames[-1].size += frame.size


def main_text(page: str, cut_hashes: frozenset = frozenset(), seen: dict[int, bool] | None = None) -> str:
    out: list[list[str]] = [[]]
    roots, through = content_roots(parse(page))
    for root in roots:
        out.append([])
        _blocks(root, through, cut_hashes, out, seen)
        out.append([])
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in out)
    return "\n".join(x for x in lines if x)


def _subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for rid, host, page in zip(batch["rid"], batch["host"], batch["html"]):
            seen: dict[int, bool] = {}
            kept = xxhash.xxh3_64_intdigest(main_text(page, seen=seen)) >> 1
            rows += [(rid, host, h, doubtful, kept) for h, doubtful in seen.items()]
        yield pd.DataFrame(rows, columns=["rid", "host", "h", "doubtful", "kept"])


@F.pandas_udf(T.StringType())
def _extract(page: pd.Series, cuts: pd.Series) -> pd.Series:
    return pd.Series([main_text(p, frozenset(c) if c is not None else frozenset()) for p, c in zip(page, cuts)])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def templates(found: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """(host, h, rows) of the template subtrees of (host, h, doubtful, kept)."""
    counts = found.groupBy("host", "h").agg(F.count_distinct("kept").alias("n"), F.max("doubtful").alias("doubtful"), F.count("*").alias("rows"))
    counts = cut(counts.filter((F.col("n") >= min_pages) | (F.col("doubtful") & (F.col("n") >= DOUBTFUL_PAGES))), "subtree-counts")
    sizes = found.select("host", "kept").distinct().groupBy("host").agg(F.count("*").alias("size"))
    shared = counts.filter(~F.col("doubtful")).join(sizes, "host").filter(F.col("n") >= min_share * F.col("size"))
    return counts.filter("doubtful").select("host", "h", "rows").unionByName(shared.select("host", "h", "rows"))


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``pages`` with the columns text and n_chars."""
    pages = pages.drop("text", "n_chars")
    own, held = spare(pages, "rid"), spare(pages, "cuts")
    page = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rid = F.xxhash64(F.col("page_id").cast("string"), "url", page)
    rows = pages.select(rid.alias("rid"), host_of(F.col("url")).alias("host"), page.alias("html"))
    found = cut(rows.mapInPandas(_subtrees, "rid long, host string, h long, doubtful boolean, kept long"), "subtrees")
    template = cut(templates(found, min_pages, min_share), "template")
    held_by = meet(found, template, ["host", "h"], "rows", "left_semi")
    cuts = cut(held_by.groupBy(F.col("rid").alias(own)).agg(F.collect_set("h").alias(held)), "template-cuts")
    out = pages.withColumn(own, rid).join(cuts, own, "left").withColumn("text", _extract(page, held))
    return out.drop(own, held).withColumn("n_chars", F.length("text").cast("long"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op9_html_text": op9_html_text}
ORACLES: dict[str, str] = {}
