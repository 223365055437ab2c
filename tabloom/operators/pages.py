"""Dataset pages: visible text, section fields, variable tables.

HTML needs a parser, which built-in functions lack; a small event handler from the standard library
runs over Arrow batches of whole pages. Everything after it is DataFrame work.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Headings whose text follows in the next paragraph beside them.
SUMMARY_FIELDS = (
    "Dataset Characteristics", "Subject Area", "Associated Tasks", "Feature Type", "# Instances", "# Features",
)
# Headings whose text follows in the next paragraph of the given class.
SECTION_FIELDS = (
    "Dataset Information", "Additional Variable Information", "Introductory Paper", "Papers Citing this Dataset",
)
# Classes and column titles of those pages.
SECTION_CLASS = "whitespace-pre-wrap svelte-17wf9gp"
TABLE_CLASS = "w-full"
VARIABLE_COLUMNS = ("Variable Name", "Role", "Type", "Demographic", "Description", "Units", "Missing Values")

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "template"}


class _Events(HTMLParser):
    """Keeps the stack of open elements and hands text and elements to a subclass."""

    def __init__(self, *settings):
        super().__init__(convert_charrefs=True)
        self.settings = settings
        self.open: list[tuple[str, int]] = []
        self.serial = 0

    def handle_starttag(self, tag, attrs):
        self.break_text()
        self.serial += 1
        parent = self.open[-1][1] if self.open else 0
        if tag not in _VOID:
            self.open.append((tag, self.serial))
        self.start(tag, dict(attrs), self.serial, parent)

    def handle_endtag(self, tag):
        self.break_text()
        if any(t == tag for t, _ in self.open):
            while True:
                t, n = self.open.pop()
                self.end(t, n)
                if t == tag:
                    break

    def handle_data(self, data):
        if not any(t in _HIDDEN for t, _ in self.open):
            self.text(data)

    def handle_comment(self, data):
        self.break_text()

    def run(self, html):
        """Reads a page. One with a malformed declaration is read again without its declarations."""
        try:
            self.feed(html or "")
            self.close()
        except AssertionError:
            return type(self)(*self.settings).run(re.sub(r"<!\[[^>]*>?", "", html))
        self.break_text()
        while self.open:
            self.end(*self.open.pop())
        return self

    def break_text(self):
        pass

    def start(self, tag, attrs, serial, parent):
        pass

    def end(self, tag, serial):
        pass

    def text(self, data):
        pass


class _Text(_Events):
    def __init__(self):
        super().__init__()
        self.parts, self.run_of = [], []

    def text(self, data):
        self.run_of.append(data)

    def break_text(self):
        if self.run_of:
            self.parts.append("".join(self.run_of).strip())
            self.run_of = []


class _Sections(_Events):
    """Paragraph after each wanted heading: beside it, or (with a class) anywhere after it."""

    def __init__(self, beside, after, after_class):
        super().__init__(beside, after, after_class)
        self.beside, self.after, self.after_class = set(beside), set(after), after_class
        self.found: dict[str, str] = {}
        self.waiting: list[tuple[str, int | None]] = []  # field, parent of its heading
        self.heading = None  # serial, parent, text
        self.capture: list[list] = []  # serial, fields, text
        self.seen: set[str] = set()

    def start(self, tag, attrs, serial, parent):
        if tag == "h1":
            self.heading = [serial, parent, ""]
        if tag == "p":
            cls = attrs.get("class") or ""
            hit = [
                w for w in self.waiting
                if (w[1] == parent if w[1] is not None else cls == self.after_class)
            ]
            if hit:
                self.waiting = [w for w in self.waiting if w not in hit]
                self.capture.append([serial, [w[0] for w in hit], ""])

    def text(self, data):
        if self.heading:
            self.heading[2] += data
        for c in self.capture:
            c[2] += data

    def end(self, tag, serial):
        if self.heading and serial == self.heading[0]:
            name = self.heading[2]
            if name not in self.seen:
                if name in self.beside:
                    self.waiting.append((name, self.heading[1]))
                if name in self.after:
                    self.waiting.append((name, None))
                self.seen.add(name)
            self.heading = None
        self.waiting = [w for w in self.waiting if w[1] != serial]
        for c in [c for c in self.capture if c[0] == serial]:
            for f in c[1]:
                self.found[f] = c[2]
            self.capture.remove(c)


class _Table(_Events):
    """Cells of the first table of a class; the header row is left out."""

    def __init__(self, cls):
        super().__init__(cls)
        self.cls, self.inside, self.done = cls, None, False
        self.rows: list[list[str]] = []
        self.cell = None

    def start(self, tag, attrs, serial, parent):
        if tag == "table" and not self.done and self.inside is None and self.cls in (attrs.get("class") or "").split():
            self.inside = serial
        elif self.inside is not None and tag == "tr":
            self.rows.append([])
        elif self.inside is not None and tag == "td" and self.rows:
            self.cell = [serial, ""]

    def text(self, data):
        if self.cell:
            self.cell[1] += data

    def end(self, tag, serial):
        if self.cell and serial == self.cell[0]:
            self.rows[-1].append(self.cell[1].strip())
            self.cell = None
        if serial == self.inside:
            self.inside, self.done = None, True


def page_text(html: str) -> str:
    return "".join(_Text().run(html).parts)


def page_fields(html: str) -> dict[str, str]:
    return _Sections(SUMMARY_FIELDS, SECTION_FIELDS, SECTION_CLASS).run(html).found


def page_variables(html: str) -> list[list[str]]:
    return _Table(TABLE_CLASS).run(html).rows[1:]


def visible_text(html: Column) -> Column:
    """Visible text of a page: trimmed pieces without separators."""

    @F.arrow_udf(T.StringType())
    def run(a: pa.Array) -> pa.Array:
        return pa.array([page_text(h) for h in a.to_pylist()], pa.string())

    return run(html)


def section_fields(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, field, value) for every known heading of every page; a missing one has a null value."""

    @F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
    def run(a: pa.Array) -> pa.Array:
        return pa.array([list(page_fields(h).items()) for h in a.to_pylist()], pa.map_(pa.string(), pa.string()))

    names = F.array(*[F.lit(f) for f in SUMMARY_FIELDS + SECTION_FIELDS])
    found = pages.select(page, run(html).alias("__f"))
    return found.select(page, "__f", F.explode(names).alias("field")).select(page, "field", F.col("__f")[F.col("field")].alias("value"))


def variables(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, row_no, one column per variable attribute) from the variables table of each page."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def run(a: pa.Array) -> pa.Array:
        return pa.array([page_variables(h) for h in a.to_pylist()], pa.list_(pa.list_(pa.string())))

    rows = pages.select(page, F.posexplode(run(html)).alias("row_no", "cells"))
    return rows.select(page, "row_no", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(VARIABLE_COLUMNS)])
