"""Elements of a page in document order, with the headings above them as parents and each table as one element."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADINGS = {f"h{k}": k for k in range(1, 7)}
_BLOCKS = frozenset("address article aside blockquote body div dd dl dt figcaption figure footer form header html main nav ol p pre section ul".split())
_SKIPPED = frozenset("script style noscript template head".split())
_KINDS = {"li": "list_item", "pre": "code", "blockquote": "quote"}


class _Page(HTMLParser):
    """One pass over a page; ``rows`` are (element_type, level, parent, content) by position, the parent as a position."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, int | None, int | None, str]] = []
        self.headings: list[tuple[int, int]] = []  # (level, position) of the headings that are open at this place
        self.kinds: list[tuple[str, str]] = []  # (tag, element type) of open elements that name their text
        self.text: list[str] = []
        self.skip, self.title, self.level = 0, False, 0
        self.tables = 0
        self.cells: list[list[list[str]]] = []

    def _add(self, kind: str, content: str, level: int | None = None) -> None:
        content = "\n".join(" ".join(line.split()) for line in content.split("\n")) if kind in ("table", "code") else " ".join(content.split())
        if not content.strip() and kind != "image":
            return
        while level is not None and self.headings and self.headings[-1][0] >= level:
            self.headings.pop()
        self.rows.append((kind, level, self.headings[-1][1] if self.headings and kind != "title" else None, content))
        if level is not None:
            self.headings.append((level, len(self.rows) - 1))

    def _flush(self) -> None:
        """End the block of text that is open."""
        text, self.text = "".join(self.text), []
        if self.level:
            self._add("heading", text, self.level)
        else:
            self._add(self.kinds[-1][1] if self.kinds else "text", text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "title":
            self.title = True
        if tag in _SKIPPED:
            self.skip += 1
        if self.skip:
            return
        if tag == "table":
            if not self.tables:
                self._flush()
                self.cells = []
            self.tables += 1
        elif self.tables:
            if self.tables == 1 and tag == "tr":
                self.cells.append([])
            elif self.tables == 1 and tag in ("td", "th", "caption"):
                if not self.cells:
                    self.cells.append([])
                self.cells[-1].append([])
        elif tag in _HEADINGS:
            self._flush()
            self.level = _HEADINGS[tag]
        elif tag == "img":
            self._flush()
            self._add("image", dict(attrs).get("alt") or "")
        elif tag in _KINDS or tag in _BLOCKS:
            self._flush()
            if tag in _KINDS:
                self.kinds.append((tag, _KINDS[tag]))
        elif tag in ("br", "hr"):
            self.text.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self.title:
            self.title = False
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag == "table" and self.tables:
            self.tables -= 1
            if not self.tables:
                rows = [" | ".join(" ".join("".join(cell).split()) for cell in row) for row in self.cells]
                self._add("table", "\n".join(r for r in rows if r.strip(" |")))
        elif self.tables:
            return
        elif tag in _HEADINGS:
            self._flush()
            self.level = 0
        elif tag in _KINDS or tag in _BLOCKS:
            self._flush()
            if any(tag == t for t, _ in self.kinds):
                while self.kinds.pop()[0] != tag:
                    pass

    def handle_data(self, data: str) -> None:
        if self.title:
            self._add("title", data)
        elif self.skip:
            return
        elif self.tables:
            if self.cells and self.cells[-1]:
                self.cells[-1][-1].append(data)
        else:
            self.text.append(data)

    def finish(self) -> list[tuple[str, int | None, int | None, str]]:
        self.close()
        if self.tables:  # a table that never ends
            self.tables = 1
            self.handle_endtag("table")
        self._flush()
        return self.rows


def page_rows(html: str | None) -> list[tuple[str, int | None, int | None, str]]:
    page = _Page()
    page.feed(html or "")
    return page.finish()


def structured_elements(pages: DataFrame) -> DataFrame:
    """(page_id, position, element_id, parent_id, element_type, level, content) of (page_id, html), in document order.

    The parent of an element is the last heading above it, of a heading the last one of a higher level, else the page.  Text
    inside lists, quotes and code belongs to the innermost of these; a table is one element, a line a row and `` | `` between
    cells, nested tables' text within their cell.  Elements without text are left out, but for images.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(page, k, *r) for page, html in zip(batch["page_id"], batch["html"]) for k, r in enumerate(page_rows(html))]
            out = pd.DataFrame(rows, columns=["page_id", "position", "element_type", "level", "parent", "content"])
            yield out.astype({"level": "Int32", "parent": "Int32"})

    rows = pages.select("page_id", F.col("html").cast("string").alias("html")).mapInPandas(run, f"page_id {kind}, position int, element_type string, level int, parent int, content string")
    of = lambda c: F.concat_ws("-", F.col("page_id"), F.lit("e"), c)
    parent = F.when(F.col("parent").isNull(), F.col("page_id").cast("string")).otherwise(of("parent"))
    return rows.select("page_id", "position", of("position").alias("element_id"), parent.alias("parent_id"), "element_type", "level", "content")
