"""Text of markup by the standard library's tokeniser, in Arrow batches.

Cases: null stays null; text nodes are stripped, and joined by blanks where a tag or comment parts them; every named and numeric entity is
decoded, with `closed` only those that a semicolon ends, and the text of others stays as it is; scripts, styles, templates, comments and declarations give nothing, whatever tags stand in them; quoted attributes
may hold `>`; markup that never ends gives what it has; texts of any length are read whole and then cut.
"""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import text as X

HIDDEN = ("script", "style", "template")

#: An ampersand and the entity that it begins, if a semicolon ends one.
REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


class _Text(HTMLParser):
    """Collects the text nodes of a document."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.node, self.hidden = [], [], 0

    def part(self) -> None:
        text = "".join(self.node).strip()
        if text:
            self.nodes.append(text)
        self.node = []

    def handle_starttag(self, tag: str, attrs) -> None:
        self.part()
        self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.part()

    def handle_endtag(self, tag: str) -> None:
        self.part()
        self.hidden -= tag in HIDDEN and self.hidden > 0

    def handle_comment(self, data: str) -> None:
        self.part()

    def handle_decl(self, decl: str) -> None:
        self.part()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.node.append(data)


def _closed(found: re.Match) -> str:
    name = found[1]
    return found[0] if name and (name[0] == "#" or name in html5) else f"&amp;{name or ''}"


def text_of(html: str | None, closed: bool = False) -> str | None:
    if html is None or ("<" not in html and "&" not in html):
        return html
    if closed:
        html = REFERENCE.sub(_closed, html)
    parser = _Text()
    parser.feed(html)
    parser.close()
    parser.part()
    return " ".join(parser.nodes)


def plain_text(html: Column, n: int = 300, closed: bool = False) -> Column:
    """Text nodes, white space collapsed, cut to n characters. `closed` as in `text_of`."""

    @F.arrow_udf("string")
    def texts(batch: pa.Array) -> pa.Array:
        return pa.array([text_of(x, closed) for x in batch.to_pylist()], pa.string())

    return X.cut(X.collapse(texts(html)), n)
