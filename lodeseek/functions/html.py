"""Readable text of a web page."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, functions as F

from lodeseek.functions.text import col_of

# Elements whose content is not page text, and void elements.
DROPPED = {"script", "style", "noscript", "header", "footer", "nav"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Where the text is taken from, best first.
REGIONS = ("article", "main", "body")


class _Page(HTMLParser):
    """Collects text of the first element of each region and of the whole page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.closed = set()
        self.parts = {name: [] for name in (*REGIONS, "page")}
        self.seen = set()

    @property
    def muted(self) -> bool:
        return not DROPPED.isdisjoint(self.open)

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.open.append(tag)
        if tag in REGIONS and tag not in self.closed and not self.muted:
            self.seen.add(tag)

    def handle_startendtag(self, tag, attrs):
        if tag not in VOID and tag not in DROPPED:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        """Closes the innermost open element of that name and all that was left open inside it."""
        if tag not in self.open:
            return
        while (inner := self.open.pop()) != tag:
            self._left(inner)
        self._left(tag)

    def _left(self, tag):
        if tag in self.seen and tag not in self.open:
            self.closed.add(tag)

    def handle_data(self, data):
        if self.muted or not data.strip():
            return
        self.parts["page"].append(data)
        for name in REGIONS:
            if name in self.open and name in self.seen and name not in self.closed:
                self.parts[name].append(data)


def page_text(html: str, limit: int | None = None) -> str:
    """Text of the first article, else main, else body, else everything; its first ``limit`` characters if a limit is given."""
    page = _Page()
    page.feed(html or "")
    page.close()
    region = next((r for r in REGIONS if r in page.seen), "page")
    return " ".join(" ".join(page.parts[region]).split())[:limit]


def extract_text(html, limit: int | None = None) -> Column:
    """:func:`page_text` of a column, the whole of it unless a limit is given. Rows go to Python a hundred at a time, since a batch of ten thousand pages can be gigabytes."""
    return F.udf(lambda h: page_text(h, limit), "string", useArrow=False)(col_of(html))
