"""HTML to text with paragraphs, in Arrow batches (parsing is no SQL expression)."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Subtrees without text, and elements that end a paragraph.
DROPPED = frozenset({"script", "style", "head", "nav", "aside", "footer", "figure", "figcaption"})
BLOCKS = frozenset({"p", "br", "div", "section", "article", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "tr"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
#: An opening tag ends an open element of these kinds.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, **{b: {"p"} for b in BLOCKS - {"p", "br", "li", "dd", "dt", "tr"}}}


class _Reader(HTMLParser):
    """Gathers the data of each block; blocks are paragraphs of their own, and
    so are stretches between blank lines inside one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.blocks: list[list[str]] = [[]]
        self.headings: list[str] = []
        self.heading: list[str] | None = None

    def _leave(self, tag: str) -> None:
        if tag in BLOCKS and not DROPPED.intersection(self.open):
            self.blocks.append([])

    def _end(self, tag: str) -> None:
        self.open.remove(tag)
        self._leave(tag)
        if tag in ("h1", "h2", "h3") and self.heading is not None:
            self.headings.append(" ".join(" ".join(self.heading).split()))
            self.heading = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.open and self.open[-1] in IMPLIED.get(tag, ()):
            self._end(self.open[-1])
        if tag in VOID:
            self._leave(tag)
            return
        self.open.append(tag)
        if tag in ("h1", "h2", "h3"):
            self.heading = []

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open[-1] != tag:
                self._end(self.open[-1])
            self._end(tag)

    def handle_data(self, data: str) -> None:
        if not DROPPED.intersection(self.open):
            self.blocks[-1].append(data)
            if self.heading is not None:
                self.heading.append(data)

    def paragraphs(self) -> list[str]:
        """White space inside lines collapses, lines are joined by a space."""
        pieces = (p for block in self.blocks for p in BLANK.split(LINE_END.sub("\n", " ".join(block))))
        lines = ([RUN.sub(" ", line).strip() for line in p.split("\n")] for p in pieces)
        return [" ".join(filter(None, own)) for own in lines if any(own)]


LINE_END, BLANK, RUN = re.compile(r"\r\n?"), re.compile(r"\n\s*\n"), re.compile(r"[ \t]+")


def read(html: str | None) -> tuple[str, str]:
    """(text, first heading)."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return "\n\n".join(reader.paragraphs()), next((h for h in reader.headings if h), "")


_PAGE = T.StructType([T.StructField("text", T.StringType()), T.StructField("heading", T.StringType())])


@F.pandas_udf(_PAGE)
def html_text(html: pd.Series) -> pd.DataFrame:
    """Struct of text and first heading (h1 to h3); null is empty."""
    return pd.DataFrame([read(h) for h in html], columns=["text", "heading"])
