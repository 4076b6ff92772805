"""Main text of HTML pages by composite text density.

A tolerant tree is built from the tags. With C characters, T tags, LC link characters and LT link tags in a node's subtree, and
those of the body as Cb and LCb, its density is
    C / T * log(C / LC * T / LT, base ln(C / (C - LC) * LC + LCb / Cb * C + e)),
a zero denominator counting as 1. A node's density sum adds up its children's densities. The threshold is the least density on the path
from the body to the node of greatest density sum; from the body down, in every subtree whose root reaches the threshold the
node of greatest density sum is content, with all it holds, if that sum is not zero (a leaf alone, such as a notice, is no subtree of text).

Defined results: null HTML has null content; HTML without text has the empty content; a page without a body element is its own
body; tags that are left open end with their parent; a quoted attribute may hold "<" and ">"; scripts, styles, templates and comments have no text, up to their
end or, without one, the page's; ties go to the node that begins first; pages of
any length and depth are taken whole; in time linear in their length; repeated rows and null ids pass through; an empty table gives an
empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lucidframe.llm.common import c, ensure_workers

# tags whose quotes are closed and hold no "<"; the others go through tag_end()
_tag = re.compile(r"<(?:(!--)|[!?][^<>]*+>|(/?)([A-Za-z][^\s/<>]*+)(?:((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>)?)")
_stop = re.compile("[<>\"']")
_space = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript textarea title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul br".split())
CLOSES = {"li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
SCOPE = frozenset("ul ol table tbody thead tfoot select dl body article section div".split())


def tag_end(page: str, at: int, last: dict[str, int]) -> tuple[int, int] | None:
    """(end of the attributes, end of the tag) of a tag whose name ends at at; None if it is no tag. last: places of the last quotes.

    A quote after "=" runs to the next of its kind, over anything; a quote elsewhere, or one that is never closed, is a character. A tag
    must end before a "<" outside quotes, unless its quotes hold a "<" too: it then ends there, so that no text is read twice.
    """
    i, over = at, False
    while m := _stop.search(page, i):
        sign, k = m[0], m.start()
        if sign == ">":
            return k, k + 1
        if sign == "<":
            return (k, k) if over else None
        i = k + 1
        if i <= last[sign] and page[max(at, k - 16) : k].rstrip().endswith("="):
            end = page.index(sign, i)
            over = over or page.find("<", i, end) >= 0
            i = end + 1
    return (len(page), len(page)) if over else None


class Tree:
    """Parallel lists by node, in order of their start; texts: (node, text)."""

    def __init__(self, page: str):
        self.tag, self.parent, self.texts = ["#root"], [-1], []
        self.body, self.title = 0, None
        stack = [0]
        opened: dict[str, list[int]] = {}  # places on the stack of the elements of each name
        blocks: list[int] = []  # and of those that are blocks
        at = start = 0  # from where to look for tags; where the text before begins
        last = {q: page.rfind(q) for q in "\"'"}

        def cut(i: int) -> None:
            for x in stack[i:]:
                opened[self.tag[x]].pop()
            while blocks and blocks[-1] >= i:
                blocks.pop()
            del stack[i:]

        def top(names: frozenset[str] | set[str]) -> int:
            return max((opened[x][-1] for x in names if opened.get(x)), default=0)

        while m := _tag.search(page, at):
            name, attributes, end = m[3], m[4] or "", m.end()
            if name is not None and m[4] is None:
                found = tag_end(page, end, last)
                if not found:
                    at = m.start() + 1
                    continue
                attributes, end = page[end : found[0]], found[1]
            if m[1]:
                end = page.find("-->", m.start() + 2) + 3
                if end < 3:
                    end = len(page)
            if m.start() > start:
                self.texts.append((stack[-1], page[start : m.start()]))
            at = start = end
            if name is None:
                continue
            name = name.lower()
            if m[2]:
                if opened.get(name):
                    cut(opened[name][-1])
                continue
            if name == "html":
                continue
            if name == "body":
                if self.body:
                    continue
                cut(1)
            elif name in BLOCK and name != "br":
                if blocks and self.tag[stack[blocks[-1]]] == "p":
                    cut(blocks[-1])
                if name in CLOSES and (i := top(CLOSES[name])) > top(SCOPE):
                    cut(i)
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            if name == "body":
                self.body = node
            if name in SILENT:
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if name == "title" and self.title is None:
                    self.title = page[at : close.start() if close else len(page)]
                at = start = close.end() if close else len(page)
            elif name not in VOID and not attributes.endswith("/"):
                opened.setdefault(name, []).append(len(stack))
                if name in BLOCK:
                    blocks.append(len(stack))
                stack.append(node)
        if start < len(page):
            self.texts.append((stack[-1], page[start:]))


def density(c: int, t: int, lc: int, lt: int, lcb: int, cb: int) -> float:
    if not c:
        return 0.0
    base = math.log(c / max(c - lc, 1) * lc + lcb / max(cb, 1) * c + math.e)
    value = c / max(lc, 1) * max(t, 1) / max(lt, 1)
    return c / max(t, 1) * math.log(value) / math.log(base) if base > 1 else c / max(t, 1) * math.log(value)


def extract(page: str) -> dict:
    """content, title, tag of the node of greatest density sum, density_sum, threshold, n_nodes."""
    tree = Tree(page)
    n = len(tree.tag)
    tag, parent = tree.tag, tree.parent
    chars, link_chars, tags, link_tags, linked = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        linked[i] = tag[i] == "a" or linked[parent[i]]
    texts = []
    for node, text in tree.texts:
        if "&" in text:
            text = entities.unescape(text)
        text = _space.sub(" ", text)
        size = len(text.strip())
        texts.append((node, text))
        chars[node] += size
        if linked[node]:
            link_chars[node] += size
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + (tag[i] == "a")
    body = tree.body
    inside = [False] * n
    for i in range(n):
        inside[i] = i == body or i > 0 and inside[parent[i]]
    d = [density(chars[i], tags[i], link_chars[i], link_tags[i], link_chars[body], chars[body]) for i in range(n)]
    total = [0.0] * n
    for i in range(1, n):
        total[parent[i]] += d[i]
    best = list(range(n))  # node of greatest density sum in each subtree
    for i in range(n - 1, 0, -1):
        p, b = parent[i], best[i]
        if total[b] > total[best[p]] or total[b] == total[best[p]] and b < best[p]:
            best[p] = b
    top = best[body]
    threshold, i = d[top], top
    while i != body:
        i = parent[i]
        threshold = min(threshold, d[i])
    content = [False] * n
    content[top] = True
    for i in range(n):
        if inside[i] and d[i] >= threshold and total[best[i]] > 0:
            content[best[i]] = True
    # what reaches the threshold below marked nodes is theirs already
    for i in range(1, n):
        content[i] = content[i] or content[parent[i]]
    parts, last = [], -1
    block = [-1] * n
    for i in range(n):
        block[i] = i if i == 0 or tag[i] in BLOCK else block[parent[i]]
    for node, text in texts:
        if content[node] and text.strip():
            parts.append("" if last < 0 else "\n" if block[node] != last else " ")
            parts.append(text.strip())
            last = block[node]
    return {
        "content": "".join(parts),
        "title": entities.unescape(_space.sub(" ", tree.title).strip()) if tree.title is not None else None,
        "top_tag": tag[top],
        "density_sum": total[top],
        "threshold": threshold,
        "n_nodes": n - 1,
    }


def html_text(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """page_id and what extract() gives."""
    ensure_workers(pages.sparkSession)
    kind = pages.select(c(id_col)).schema[0].dataType.simpleString()
    fields = [("content", pa.string()), ("title", pa.string()), ("top_tag", pa.string()), ("density_sum", pa.float64()), ("threshold", pa.float64()), ("n_nodes", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{} if t is None else extract(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0)] + [pa.array([f.get(x) for f in found], k) for x, k in fields]
            yield pa.RecordBatch.from_arrays(columns, ["page_id"] + [x for x, _ in fields])

    schema = f"page_id {kind}, content string, title string, top_tag string, density_sum double, threshold double, n_nodes int"
    return pages.select(c(id_col).alias("page_id"), c(html).cast("string").alias("html")).mapInArrow(run, schema)
