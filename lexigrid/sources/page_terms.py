"""Terms with their definitions from web pages, and what kind of word list a page holds.

A page becomes a small tree in one pass. Each kind of list is looked at in its own way: definition lists, tables by the
names of their columns, lists, blocks named after what they hold, paragraphs, and lines between breaks. What looks like
a term and a definition is judged in one place, by the shapes that `lexigrid.functions.text` has for columns too.

Pages are handled one by one in Arrow batches; nothing is kept between them. Null and empty pages give nothing, tags that
aren't closed end with what is around them, script and style are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigrid.functions.text import CITATION, DELIMITERS, LEADING, LEAST_DEFINITION, LINE_POS, NUMBERING, POS_LEAD, TERM_LENGTH, TERM_SHAPE, TERM_TRIM

VOID = frozenset(("br", "img", "hr", "input", "meta", "link", "wbr", "col", "source"))
#: Tags that end an open one of the same kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
#: Tags beyond which no sibling is looked for.
FENCES = frozenset(("ul", "ol", "dl", "table", "div", "section", "article", "body", "html"))
BOLD, HEADS = ("strong", "b"), ("h1", "h2", "h3", "h4", "h5")
BREAKS_OF_A_LIST = 10
#: Names of blocks that hold entries, and of columns.
BLOCK_NAMES = re.compile(r"vocab|vocabulary|glossary|term|definition|word[-_ ]list", re.I)
TERM_COLUMNS, DEFINITION_COLUMNS = ("term", "word"), ("definition", "meaning", "gloss")
#: Terms of a word list, what separates them there, and lengths of terms and of definitions in lists and tables.
PLAIN_TERM, LIST_MARKS, PLAIN_LENGTH, IN_LIST, IN_TABLE = re.compile(r"^[A-Za-z\s'-]+$"), (": ", " - ", " – ", " — "), (2, 50), 5, 10
_LINE = re.compile(r"^\s*(?P<term>[A-Za-z][A-Za-z '\-]{0,60}?)\s+(?:\((?:%s)\)|(?:%s)\.)\s*[:\-–—]?\s*(?P<rest>.+)$" % (("|".join(LINE_POS),) * 2), re.I)
_SPACE, _CITED, _NUMBER, _TERM, _LEAD, _POS = (re.compile(p) for p in (r"\s+", CITATION, NUMBERING, TERM_SHAPE, LEADING, POS_LEAD))


@dataclass
class Node:
    tag: str
    names: str = ""
    parts: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """The node and all below it, in the order of the page."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [p for p in reversed(node.parts) if isinstance(p, Node)]

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n is not self and n.tag in tags]

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n is not self and n.tag in tags), None)

    def text(self, without: Node | None = None, between: str = " ") -> str:
        out, todo = [], [self]
        while todo:
            part = todo.pop()
            if isinstance(part, str):
                out.append(part.strip())
            elif part is not without:
                todo += reversed(part.parts)
        return between.join(x for x in out if x)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("page")
        self.open, self.hidden = [self.root], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
            return
        if tag in SIBLINGS:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in SIBLINGS[tag]:
                    del self.open[k:]
                    break
                if self.open[k].tag in FENCES:
                    break
        node = Node(tag, dict(attrs).get("class") or "")
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if not self.hidden and data:
            self.open[-1].parts.append(data)


def tree(html: str | None) -> Node:
    reader = _Tree()
    reader.feed(html or "")
    reader.close()
    return reader.root


Entry = tuple[str, str]


def judged(head: str, body: str) -> Entry | None:
    """The term and definition that two texts are, freed of numbers, separators and marks; None if they don't look it."""
    plain = lambda s: _CITED.sub("", _SPACE.sub(" ", s).strip()).strip()
    term, meaning = _NUMBER.sub("", plain(head)).strip(TERM_TRIM), _POS.sub("", _LEAD.sub("", plain(body)))
    good = TERM_LENGTH[0] <= len(term) <= TERM_LENGTH[1] and _TERM.match(term) and len(meaning) >= LEAST_DEFINITION and any(map(str.isalpha, meaning))
    return (term, meaning) if good else None


def from_line(line: str) -> Entry | None:
    """An entry in a line: two sides of the preferred delimiter, or a term with its part of speech."""
    mark = next((d for d in DELIMITERS if d in line), None)
    if mark and (found := judged(*line.split(mark, 1))):
        return found
    said = _LINE.match(line)
    return judged(said["term"], said["rest"]) if said else None


def _definition_lists(page: Node) -> Iterator[Entry | None]:
    for dl in page.all("dl"):
        terms, meanings = dl.all("dt"), dl.all("dd")
        if len(meanings) >= min(3, len(terms)):
            yield from (judged(t.text(), m.text()) for t, m in zip(terms, meanings, strict=False))


def _rows(table: Node) -> list[list[str]]:
    return [[c.text() for c in row.all("td", "th")] for row in table.all("tr")]


def _tables(page: Node) -> Iterator[Entry | None]:
    """By the columns that their names tell, else the first two."""
    for table in page.all("table"):
        rows = _rows(table)
        if len(rows) > 1:
            names = [c.lower() for c in rows[0]]
            column = lambda words, other: max((k for k, n in enumerate(names) if any(w in n for w in words)), default=other)  # noqa: E731, B023
            term, meaning = column(TERM_COLUMNS, 0), column(DEFINITION_COLUMNS, 1)
            yield from (judged(row[term], row[meaning]) for row in rows[1:] if max(term, meaning) < len(row))


def _lists(page: Node) -> Iterator[Entry | None]:
    for whole in page.all("ul", "ol"):
        items = whole.all("li")
        for item in items if len(items) >= 3 else ():
            head = item.first(*BOLD) or item.first("em")
            yield (head and judged(head.text(), item.text(without=head))) or from_line(item.text())


def _named_blocks(page: Node) -> Iterator[Entry | None]:
    for block in page.walk():
        if BLOCK_NAMES.search(block.names) and (head := block.first(*HEADS) or block.first(*BOLD)):
            yield judged(head.text(), block.text(without=head))


def _paragraphs(page: Node) -> Iterator[Entry | None]:
    for p in page.all("p", "section"):
        yield from map(from_line, p.text(between="\n").split("\n"))


def _broken_lines(page: Node) -> Iterator[Entry | None]:
    """Lines of blocks with many breaks of their own."""
    for block in page.all("div", "p", "td", "section", "blockquote"):
        if len(block.all("br")) >= BREAKS_OF_A_LIST:
            line: list[str] = []
            for part in [*block.parts, Node("br")]:
                if isinstance(part, str):
                    line.append(part)
                elif part.tag != "br":
                    line.append(part.text() + " ")
                elif line:
                    yield from_line(_SPACE.sub(" ", "".join(line)).strip())
                    line = []


def entries(html: str | None) -> list[Entry]:
    """The entries of a page, the first of equal terms: of its broken lines if these hold two, else of all else."""
    page = tree(html)
    found = [e for e in _broken_lines(page) if e]
    if len(found) < 2:
        found = [e for way in (_definition_lists, _tables, _lists, _named_blocks, _paragraphs) for e in way(page) if e]
    out: dict[str, Entry] = {}
    for term, meaning in found:
        out.setdefault(term.lower(), (term, meaning))
    return list(out.values())


def _plain(term: str) -> bool:
    return PLAIN_LENGTH[0] <= len(term) <= PLAIN_LENGTH[1] and bool(PLAIN_TERM.match(term))


def structure(html: str | None) -> dict[str, int]:
    """How many definition lists, tables, lists and named blocks of a page look like word lists, by their first five entries."""
    page, counts = tree(html), dict.fromkeys(("definition_lists", "tables", "lists", "blocks"), 0)
    for dl in page.all("dl"):
        terms = dl.all("dt")
        counts["definition_lists"] += len(terms) > 1 and len(dl.all("dd")) > 1 and sum(_plain(t.text()) for t in terms[:5]) >= 2
    for table in page.all("table"):
        rows = _rows(table)
        counts["tables"] += len(rows) > 3 and sum(len(r) > 1 and _plain(r[0]) and len(r[1]) >= IN_TABLE for r in rows[1:6]) >= 3
    for whole in page.all("ul", "ol"):
        items = [i.text() for i in whole.all("li")]
        sides = [i.split(mark, 1) for i in items[:5] if (mark := next((m for m in LIST_MARKS if m in i), None))]
        counts["lists"] += len(items) > 2 and sum(_plain(a.strip()) and len(b.strip()) >= IN_LIST for a, b in sides) >= 3
    counts["blocks"] = sum(bool(BLOCK_NAMES.search(n.names) and n.first(*HEADS, *BOLD)) for n in page.walk())
    return counts


def extract_terms(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, place, term, definition of all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, *e) for i, html in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, e in enumerate(entries(html))]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], [id_col, "place", "term", "definition"])

    return pages.select(F.col(id_col).cast("long"), html_col).mapInArrow(run, f"{id_col} long, place long, term string, definition string")


def page_structure(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, the counts of `structure`, and is_word_list, of all pages."""
    names = ("definition_lists", "tables", "lists", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [structure(html) for html in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([int(f[n]) for f in found], pa.int64()) for n in names)], [id_col, *names])

    counted = pages.select(F.col(id_col).cast("long"), html_col).mapInArrow(run, f"{id_col} long, " + ", ".join(f"{n} long" for n in names))
    return counted.withColumn("is_word_list", F.greatest(*names) > 0)
