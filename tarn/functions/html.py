"""Text of HTML by the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that are dropped with all they hold, and those without an end.
BOILERPLATE = frozenset(("script", "style", "nav", "footer", "header", "aside", "noscript"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Text(HTMLParser):
    """Collects text nodes; a tag or a comment ends a node."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.buffer: list[str] = []
        self.open: list[str] = []
        self.hidden = 0

    def end_node(self):
        if self.buffer:
            text = "".join(self.buffer).strip()
            self.buffer.clear()
            if text:
                self.nodes.append(text)

    def handle_starttag(self, tag, attrs):
        self.end_node()
        if tag not in VOID:
            self.open.append(tag)
            self.hidden += tag in BOILERPLATE

    def handle_startendtag(self, tag, attrs):
        self.end_node()

    def handle_endtag(self, tag):
        self.end_node()
        if tag in self.open:
            while True:
                last = self.open.pop()
                self.hidden -= last in BOILERPLATE
                if last == tag:
                    break

    def handle_comment(self, data):
        self.end_node()

    def handle_decl(self, decl):
        self.end_node()

    def handle_data(self, data):
        if not self.hidden:
            self.buffer.append(data)


def html_text(source: str | None) -> str:
    """Text nodes outside boilerplate, stripped, one a line."""
    if not source:
        return ""
    parser = _Text()
    parser.feed(source)
    parser.close()
    parser.end_node()
    return "\n".join(parser.nodes)


@F.arrow_udf(T.StringType())
def extract_html(source: pa.Array) -> pa.Array:
    # One page at a time becomes a string of Python; the others stay in Arrow.
    return pa.array((html_text(page.as_py()) for page in source), pa.string())
