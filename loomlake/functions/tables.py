"""HTML tables: extraction innermost first, cleaning, captions, and OTSL."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that have no end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Node:
    """An element. Pages nest without bound, so all walks keep their own stack."""

    def __init__(self, tag: str, attrs=()):
        self.tag, self.attrs, self.children, self.gone = tag, dict(attrs), [], False

    def find(self, tag: str | None = None):
        """The elements below, of a tag or all, in order."""
        inside = [iter(self.children)]
        while inside:
            c = next(inside[-1], None)
            if c is None:
                inside.pop()
            elif isinstance(c, _Node) and not c.gone:
                if tag is None or c.tag == tag:
                    yield c
                inside.append(iter(c.children))

    def _parts(self, marks: bool):
        todo: list = [self]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                yield c
            elif not c.gone:
                if marks and c.tag:
                    attrs = "".join(f' {k}="{escape(v or "")}"' for k, v in c.attrs.items())
                    yield f"<{c.tag}{attrs}/>" if c.tag in VOID else f"<{c.tag}{attrs}>"
                    if c.tag in VOID:
                        continue
                    todo.append(f"</{c.tag}>")
                todo.extend(reversed(c.children))

    def html(self) -> str:
        return "".join(self._parts(True))

    def text(self) -> str:
        return "".join(self._parts(False))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = _Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(_Node(tag, attrs))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def handle_entityref(self, name):
        self.open[-1].children.append(f"&{name};")

    def handle_charref(self, name):
        self.open[-1].children.append(f"&#{name};")


def tree(html: str) -> _Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _heights(root: _Node) -> list[tuple[int, int, _Node]]:
    """(levels of tables inside, place, table) of every table."""
    out, inside = [], [(None, iter(root.children), [0])]
    place = 0
    while inside:
        node, rest, height = inside[-1]
        c = next(rest, None)
        if c is None:
            inside.pop()
            if inside:
                up = height[0]
                if node.tag == "table":
                    out.append((up, node.place, node))
                    up += 1
                inside[-1][2][0] = max(inside[-1][2][0], up)
        elif isinstance(c, _Node) and not c.gone:
            c.place, place = place, place + 1
            inside.append((c, iter(c.children), [0]))
    return sorted(out, key=lambda x: x[:2])


def extract_tables(html: str) -> list[str]:
    """Tables from the inside out, each without the ones taken before, styles, scripts, border, caption, spans of 1 and
    white space between tags; empty ones are left out."""
    root = tree(html)
    for node in root.find():
        node.gone = node.tag in ("style", "script")
    out = []
    for _, _, table in _heights(root):
        table.attrs.pop("border", None)
        for parent in [table, *(n for t in ("thead", "tbody", "tr") for n in table.find(t))]:
            if captions := [x for x in parent.children if isinstance(x, _Node) and x.tag == "caption"]:
                for x in captions:
                    x.gone = True
                break
        for cell in table.find():
            if cell.tag in ("th", "td", "tr"):
                for a in ("rowspan", "colspan"):
                    if cell.attrs.get(a) == "1":
                        del cell.attrs[a]
        text = re.sub(r">\s+<", "><", table.html())
        if text.strip() != "<table></table>":
            out.append(text)
        table.gone = True
    return out


# The bounds that HTML sets to spans.
MOST = {"rowspan": 65534, "colspan": 1000}


def _span(cell: _Node, name: str) -> int:
    digits = re.match(r"\s*([0-9]{1,9})", cell.attrs.get(name) or "")
    return min(max(int(digits[1]), 1), MOST[name]) if digits else 1


def to_otsl(html: str) -> str | None:
    """The first table as OTSL: fcel and ecel for cells with and without text, lcel, ucel and xcel for what spans cover
    to the left, above and both, nl for row ends. A table inside a cell is that cell's text."""
    table = next(tree(html).find("table"), None)
    if table is None:
        return None
    own = [x for x in table.children if isinstance(x, _Node)]
    rows = [r for x in own for r in ([x] if x.tag == "tr" else x.children if x.tag in ("thead", "tbody", "tfoot") else []) if isinstance(r, _Node) and r.tag == "tr"]
    above: dict[int, tuple[int, str]] = {}  # column -> (last row that a cell above covers, mark)
    out = []
    for r, row in enumerate(rows):
        line, c = [], 0

        def covered(c: int) -> int:
            while above.get(c, (-1, ""))[0] >= r:
                line.append(f"<{above[c][1]}>")
                c += 1
            return c

        for cell in row.children:
            if not isinstance(cell, _Node) or cell.tag not in ("td", "th"):
                continue
            c = covered(c)
            text = re.sub(r"\s+", " ", cell.text()).strip()
            wide, last = _span(cell, "colspan"), r + _span(cell, "rowspan") - 1
            line.append((f"<fcel>{text}" if text else "<ecel>") + "<lcel>" * (wide - 1))
            if last > r:
                above.update({c + j: (last, "xcel" if j else "ucel") for j in range(wide)})
            c += wide
        covered(c)
        out.append("".join(line) + "<nl>")
    return "<otsl>" + "".join(out) + "</otsl>"


def spread(df, least: int | None = None):
    """df in at least as many partitions as there are cores, where small files would put slow work on whole texts into few
    tasks. Rows are dealt anew in any case: of several splits of a file, those without a row group's middle are empty."""
    n = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(n, df.rdd.getNumPartitions()))


@F.pandas_udf(T.ArrayType(T.StringType()))
def tables_of(html: pd.Series) -> pd.Series:
    return html.map(lambda t: [] if t is None else extract_tables(t))


@F.pandas_udf(T.StringType())
def otsl_of(html: pd.Series) -> pd.Series:
    return html.map(lambda t: None if t is None else to_otsl(t))


def flat_tables(html: Column) -> Column:
    """All tables of a text without nested ones."""
    return F.regexp_extract_all(html, F.lit(r"(?s)<table.*?</table>"), F.lit(0))


def collapse(html: Column) -> Column:
    return F.regexp_replace(html, r">\s+<", "><")


def with_caption(html: Column, title: Column) -> Column:
    """A caption behind the first table tag."""
    at = F.regexp_instr(html, F.lit(r"<table[^>]*>"))
    tag = F.regexp_extract(html, r"<table[^>]*>", 0)
    end = at + F.length(tag)
    return F.when(at > 0, F.concat(F.substring(html, F.lit(1), end - 1), F.lit("<caption>"), title, F.lit("</caption>"), F.substring(html, end, F.length(html)))).otherwise(html)
