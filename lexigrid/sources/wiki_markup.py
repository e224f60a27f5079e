"""Senses from pages in wiki markup: sections by their headings, templates and links by a stack.

Templates may hold templates and links, and links may hold templates, to any depth; what isn't closed is plain text.
Pages come from a dump (`lexigrid.sources.files.read_dump`) and are read one by one in Arrow batches.

Defined cases. Null and empty texts, and pages without a section of the language, have no senses. Headings of three
equals signs and more belong to the language above them. Lines of examples and of senses within senses aren't senses. Text that
is empty once it is freed of markup is no sense either. Nesting beyond DEEPEST is plain text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Headings of parts of speech, marks of old words, and templates that hold them among their arguments.
PARTS_OF_SPEECH = ("noun", "verb", "adjective", "adverb", "preposition", "conjunction", "interjection", "phrase", "expression", "determiner", "particle", "exclamation")
MARKS = ("archaic", "obsolete", "dated", "historical")
LABELS, QUALIFIER = ("label", "lb", "context", "term-label"), "qualifier"
DEEPEST, LONGEST_CONTEXT, LONGEST_ETYMOLOGY = 200, 100, 500
_HEADING = re.compile(r"^(={2,6})[ \t]*(.+?)[ \t]*\1[ \t]*$", re.M)
_TOKEN = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")
_CLOSES = {"}}": "{{", "]]": "[["}


@dataclass
class Markup:
    """A template or link: its arguments, each a list of texts and of what is nested."""

    opened: str
    args: list[list[str | Markup]] = field(default_factory=lambda: [[]])

    def plain(self) -> str:
        """The text that a reader sees: a link's last argument, nothing of a template."""
        return shown(self.args[-1]) if self.opened == "[[" else ""

    def reopened(self) -> list[str | Markup]:
        """Its pieces as text, if it is never closed; what was closed within stays markup."""
        out: list[str | Markup] = [self.opened, *self.args[0]]
        for a in self.args[1:]:
            out += ["|", *a]
        return out

    def words(self) -> list[str]:
        return [shown(a).strip().lower() for a in self.args]


def shown(parts: list[str | Markup]) -> str:
    return "".join(p if isinstance(p, str) else p.plain() for p in parts)


def parse(text: str) -> list[str | Markup]:
    """The text as plain pieces, templates and links."""
    stack, at = [Markup("")], 0
    for m in _TOKEN.finditer(text):
        token, top = m[0], stack[-1]
        top.args[-1].append(text[at : m.start()])
        at = m.end()
        if token in ("{{", "[[") and len(stack) <= DEEPEST:
            stack.append(Markup(token))
        elif token == "|" and top.opened:
            top.args.append([])
        elif token in _CLOSES and any(s.opened == _CLOSES[token] for s in stack[1:]):
            while stack[-1].opened != _CLOSES[token]:  # what was opened within and never closed is text
                lost = stack.pop()
                stack[-1].args[-1] += lost.reopened()
            done = stack.pop()
            stack[-1].args[-1].append(done)
        else:
            top.args[-1].append(token)
    stack[-1].args[-1].append(text[at:])
    while len(stack) > 1:
        lost = stack.pop()
        stack[-1].args[-1] += lost.reopened()
    return [p for p in stack[0].args[0] if p != ""]


def _nested(parts: list[str | Markup]) -> Iterator[Markup]:
    for p in parts:
        if isinstance(p, Markup):
            yield p
            for a in p.args:
                yield from _nested(a)


def marks(parts: list[str | Markup], language: str = "en") -> set[str]:
    """The marks of old words among the templates, at any depth."""
    out: set[str] = set()
    for t in _nested(parts):
        name, *args = t.words()
        if t.opened == "{{" and name in MARKS:
            out.add(name)
        labelled = name in LABELS and args[:1] == [language]
        if t.opened == "{{" and (labelled or name == QUALIFIER):
            out |= {m for m in MARKS for a in args[labelled:] if m in a}
    return out


def cleaned(parts: list[str | Markup]) -> str:
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", shown(parts))).strip()


def context(text: str) -> str | None:
    """What a sense has in italics, or in short brackets."""
    if m := re.search(r"''([^']+)''", text):
        return m[1]
    m = re.search(r"\(([^)]+)\)", text)
    return m[1] if m and len(m[1]) < LONGEST_CONTEXT else None


def sections(text: str, language: str) -> Iterator[tuple[str, str]]:
    """Heading in lower case and text of each section of a language."""
    found, inside = list(_HEADING.finditer(text)), False
    for k, m in enumerate(found):
        if len(m[1]) == 2:
            inside = m[2].lower() == language
        elif inside:
            yield m[2].lower(), text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)]


def senses(text: str | None, language: str = "english", code: str = "en", only_marked: bool = True) -> list[tuple[str, str, list[str], str | None, str | None]]:
    """(part of speech, definition, marks, context, etymology) of a page; of marked senses only, or of all.

    A section's marks hold for all its senses. The first etymology holds for the page.
    """
    out, etymology = [], None
    for heading, body in sections(text or "", language):
        if heading.startswith("etymology"):
            etymology = etymology or cleaned(parse(body))[:LONGEST_ETYMOLOGY] or None
        if heading not in PARTS_OF_SPEECH:
            continue
        whole = marks(parse(body), code)
        for line in re.findall(r"^#[ \t]*([^#:*\s].*)$", body, re.M):
            parts = parse(line)
            found, definition = sorted(whole | marks(parts, code)), cleaned(parts)
            if definition and (found or not only_marked):
                out.append((heading, definition, found, context(shown(parts)), etymology))
    return out


def wiki_senses(pages: DataFrame, *, only_marked: bool = True) -> DataFrame:
    """term, place, pos, definition, marks, context, etymology of the pages (title, text)."""
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
    names = ["term", "place", "pos", "definition", "marks", "context", "etymology"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [((title or "").lower(), k, *s) for title, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, s in enumerate(senses(text, only_marked=only_marked))]
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return pages.select(F.col("title").cast("string"), "text").mapInArrow(run, "term string, place long, pos string, definition string, marks array<string>, context string, etymology string")
