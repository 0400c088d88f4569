"""HTML pages as ordered blocks: leaf block elements and whole tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Element classes that decide what becomes a block.
BLOCKS = set("div p li blockquote section article h1 h2 h3 h4 h5 h6 ul ol".split())
SKIPPED = set("script style head title meta link".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes without saying so.
_CLOSES = {"li": {"li", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, **{b: {"p"} for b in BLOCKS - {"li"}}, "table": {"p"}}
_SPACE = re.compile(r"\s+")


class _Node:
    __slots__ = ("tag", "style", "children", "holds_block")

    def __init__(self, tag: str, style: str = ""):
        self.tag, self.style, self.children, self.holds_block = tag, style, [], False


class _Tree(HTMLParser):
    """A small element tree; end tags that HTML lets one leave out are implied."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        closes = _CLOSES.get(tag, ())
        while len(self.open) > 1 and self.open[-1].tag in closes:
            self.open.pop()
        node = _Node(tag, (dict(attrs).get("style") or "").replace(" ", "").lower())
        self.open[-1].children.append(node)
        if tag in BLOCKS or tag == "table":
            for up in self.open:
                up.holds_block = True
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _strings(node: _Node) -> Iterator[str]:
    todo = [node]
    while todo:
        here = todo.pop()
        if isinstance(here, str):
            if here.strip():
                yield here.strip()
        elif here.tag not in SKIPPED:
            todo.extend(reversed(here.children))


def _all(node: _Node, tags: set[str]) -> Iterator[_Node]:
    todo = list(reversed(node.children))
    while todo:
        here = todo.pop()
        if not isinstance(here, str):
            if here.tag in tags:
                yield here
            todo.extend(reversed(here.children))


def _text(node: _Node) -> str:
    return _SPACE.sub(" ", " ".join(_strings(node)).replace("\xa0", " ")).strip()


def _table_text(table: _Node) -> str:
    rows = ([c for c in map(_text, _all(row, {"td", "th"})) if c] for row in _all(table, {"tr"}))
    return "\n".join(" | ".join(cells) for cells in rows if cells)


def blocks_of(html: str | None) -> list[tuple[int, str, str, str]]:
    """``(pos, kind, tag, text)`` of the visible blocks of a page.

    A table is one block; of other block elements only those without blocks inside. Hidden elements
    and the first ``ix:header`` are left out, and so is text that stands in no block.
    """
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    header = next(_all(tree.root, {"ix:header"}), None)
    start = next(_all(tree.root, {"body"}), tree.root)
    out: list[tuple[int, str, str, str]] = []
    todo = list(reversed(start.children))
    while todo:
        node = todo.pop()
        if isinstance(node, str) or node is header or node.tag in SKIPPED or "display:none" in node.style:
            continue
        if node.tag == "table":
            kind, text = "table", _table_text(node)
        elif node.tag in BLOCKS and not node.holds_block:
            kind, text = "block", _text(node)
        else:
            todo.extend(reversed(node.children))
            continue
        if text:
            out.append((len(out), kind, node.tag, text))
    return out


BLOCK_SCHEMA = "document_id string, pos int, kind string, tag string, text string"


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = [(d, *b) for d, h in zip(part.column("document_id").to_pylist(), part.column("html").to_pylist()) for b in blocks_of(h)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.string()) for c in cols[2:])], names=["document_id", "pos", "kind", "tag", "text"])


def page_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of pages ``(document_id, html)``."""
    return pages.select("document_id", "html").mapInArrow(_block_batches, BLOCK_SCHEMA)
