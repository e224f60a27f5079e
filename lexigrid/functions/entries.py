"""Dictionary entries as they come from pages and books: cleaning, filters, scores and suggestions, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: What is cut out of prose, and which characters stay.
CITATIONS = r"\[[0-9]+\]|\([0-9]+\)|<[^>]+>|https?://[^ \t\n\r\f]+|www\.[^ \t\n\r\f]+"
KEPT_CHARACTERS = r"[^\p{L}\p{N}_ \t\n\r\f\-']"
#: Abbreviations of parts of speech before a definition, and their names in brackets.
POS_PREFIXES = (("NOUN", "n"), ("VERB", "v"), ("ADJECTIVE", "adj"), ("ADVERB", "adv"))
#: Blocks of code points of other scripts, first and last.
OTHER_SCRIPTS = (("0370", "03FF"), ("0400", "04FF"), ("0590", "05FF"), ("0600", "06FF"), ("3040", "309F"), ("30A0", "30FF"), ("4E00", "9FFF"))
#: Letters and clusters that English words don't have.
NOT_ENGLISH = ("[ąęłńśźż]", "[àáâäèéêëìíîïòóôöùúûü]", "[şţ]", "[öäüß]", "[æøå]", "^[qxz][qxz]", "[bcdfghjklmnpqrstvwxz]{5,}", "[aeiou]{4,}")
#: Parts of speech of what isn't a word, and how words begin and end.
POS_EXCLUDED = ("PROPN", "X", "SYM", "NUM", "SPACE")
WORD_ENDINGS = ("ing", "tion", "ness", "ment", "able", "ible", "ous", "eous", "ious", "ary", "ery", "ory", "ful", "less", "ship", "ward", "like")
WORD_BEGINNINGS = ("un", "re", "pre", "dis", "over", "under", "out", "up", "in", "im", "ir", "il", "non", "anti", "de", "pro", "sub", "inter", "trans", "super", "auto", "semi", "multi", "extra", "ultra", "pseudo", "quasi", "neo", "micro", "macro", "mega", "mini")
#: Parts and ends of words that move an estimated Zipf value.
TECHNICAL_PARTS = ("ology", "ography", "itis", "osis", "ism", "tion", "micro", "macro", "neo", "proto", "pseudo", "meta", "anti", "ultra", "super", "hyper", "philia", "phobia")
COMMON_ENDS = ("ing", "ed", "er", "ly", "tion", "able")
#: Definitions by ending and part of speech (none: any); {} is the word without the ending.
SUGGESTED = (
    ("ly", "ADVERB", "In a {} manner; showing {} characteristics"),
    ("ic", "ADJECTIVE", "Having characteristics of; relating to"),
    ("ness", "NOUN", "The quality or state of being {}"),
    ("ment", "NOUN", "The act, process, or result of"),
    ("tion", None, "The action or process of"),
    ("sion", None, "The action or process of"),
)
SUGGESTED_ALWAYS = ("Related to or characterized by", "Having the quality of", "In the manner of")
#: Where an etymology stands.
ETYMOLOGY = (r"(?i)etymology:?[ \t\n\r\f]*([^.]+)", r"(?i)from[ \t\n\r\f]+(?:Latin|Greek|French|German|Old English)[ \t\n\r\f]+([^.]+)", r"(?i)derived from[ \t\n\r\f]+([^.]+)", r"(?i)origin:?[ \t\n\r\f]*([^.]+)")
#: What labels and fields of science count in the utility of an entry.
LABEL_SCORES = (("archaic", 1.5), ("dated", 1.2), ("historical", 1.0), ("obsolete", 0.3))
SCIENCES = ("chemistry", "physics", "biology", "anatomy", "botany", "medicine")
#: The lines that a book's text stands between, in order of preference.
BOOK_STARTS = ("*** START OF THE PROJECT GUTENBERG EBOOK", "*** START OF THIS PROJECT GUTENBERG EBOOK", "***START OF THE PROJECT GUTENBERG EBOOK", "START OF THE PROJECT GUTENBERG", "*** START OF")
BOOK_ENDS = tuple(m.replace("START", "END") for m in BOOK_STARTS)


@F.pandas_udf(StringType())  # a type, as its name would need a session at import
def decomposed(text: pd.Series) -> pd.Series:
    """Unicode's NFKD form, which no built-in function gives."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def decomposed_runs(text: Column) -> Column:
    """The same of any text: only its runs of characters beyond ASCII go to Python, a line each.

    ASCII characters stay as they are, and marks aren't put in order across them; no decomposition has a line feed.
    """
    runs = F.array_join(F.regexp_extract_all(text, F.lit(r"([^\x00-\x7F]+)"), F.lit(1)), "\n")
    between, turned = F.split(text, r"[^\x00-\x7F]+"), F.split(decomposed(runs), "\n")
    return F.array_join(F.zip_with(between, turned, lambda b, t: F.concat(b, F.coalesce(t, F.lit("")))), "")


def clean_prose(text: Column) -> Column:
    """Without citations, tags, links and special characters, decomposed, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, CITATIONS, ""), KEPT_CHARACTERS, " ")
    return F.trim(F.regexp_replace(decomposed_runs(bare), r"[ \t\n\r\f]+", " "))


def pos_prefix(text: Column) -> Column:
    """The part of speech that a definition begins with as an abbreviation, else one in brackets anywhere."""
    low = F.lower(text)
    out = F.upper(F.nullif(F.regexp_extract(low, r"\((noun|verb|adjective|adverb)\)", 1), F.lit("")))
    for name, short in reversed(POS_PREFIXES):
        out = F.when(low.rlike(rf"^\(?{short}\.?\)?[ \t\n\r\f,:]"), name).otherwise(out)
    return out


def foreign_script(word: Column) -> Column:
    """Whether a word has letters of other scripts, or marks and clusters that English words lack."""
    w = F.lower(F.trim(word))
    blocks = "".join(rf"\x{{{a}}}-\x{{{b}}}" for a, b in OTHER_SCRIPTS)
    return w.rlike(f"[{blocks}]") | w.rlike("|".join(NOT_ENGLISH))


def excluded_pos(term: Column, pos: Column) -> Column:
    """Whether an entry is left out by its part of speech. PUNCT is looked at again: three signs of six make it a word."""
    p, t = F.upper(F.coalesce(pos, F.lit(""))), F.regexp_replace(F.lower(term), r"[^\p{L}\p{N}_\-']", "")
    signs = (t.rlike("[aeiou]"), F.regexp_count(t, F.lit("[bcdfghjklmnpqrstvwxz]")) <= F.length(t) * 0.8, t.rlike(f"({'|'.join(WORD_ENDINGS)})$"), t.rlike(f"^({'|'.join(WORD_BEGINNINGS)})"), term.rlike(r"[\p{L}\p{N}_]"), F.length(t).between(3, 20))
    word = (F.length(term) >= 3) & (F.length(t) >= 3) & (reduce(add, (s.cast("int") for s in signs)) >= 3)
    return F.when((p == "") | p.isin(*POS_EXCLUDED), True).when(p == "PUNCT", ~F.coalesce(word, F.lit(False))).otherwise(False)


def adverb_of_manner(term: Column, definition: Column) -> Column:
    """An adverb in -ly that is defined by the manner only."""
    return term.endswith("ly") & F.lower(definition).rlike(r"^in an? [\p{L}\p{N}_]+ (manner|way|fashion|form)")


def adverb_root(term: Column) -> Column:
    """The word that an adverb in -ly comes from, by spelling; null of other words."""
    root = F.substring(term, F.lit(1), F.length(term) - 2)
    return F.when(term.endswith("ly") & (F.length(term) > 3), F.regexp_replace(root, "i$", "y"))


def estimated_zipf(word: Column) -> Column:
    """A Zipf value between 0.5 and 1.2 for a word that no corpus has."""
    w, n = F.lower(word), F.length(word)
    by_length = F.when(n <= 4, 0.3).when(n <= 8, 0.0).when(n <= 12, -0.2).otherwise(-0.4)
    technical = F.when(w.rlike("|".join(TECHNICAL_PARTS)), -0.3).otherwise(0.0)
    common = F.when(w.rlike(f"({'|'.join(COMMON_ENDS)})$"), 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.5), F.least(F.lit(1.2), F.lit(0.8) + by_length + technical + common))


def suggested_definitions(word: Column, pos: Column) -> Column:
    """Three definitions to begin with: that of the ending first, if there is one."""
    special = F.lit(None).cast("string")
    for end, kind, says in reversed(SUGGESTED):
        base, fits = F.substring(word, F.lit(1), F.length(word) - len(end)), word.endswith(end)
        special = F.when(fits & (pos == kind) if kind else fits, F.replace(F.lit(says), F.lit("{}"), base)).otherwise(special)
    return F.slice(F.array_compact(F.array(special, *(F.lit(s) for s in SUGGESTED_ALWAYS))), 1, 3)


def etymology(text: Column) -> Column:
    """What follows the first mark of an etymology, to the full stop."""
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(text, p, 1), F.lit(" \t\n\r\f")), F.lit("")) for p in ETYMOLOGY))


def examples(text: Column) -> Column:
    """Quoted texts, three at most."""
    return F.slice(F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)), 1, 3)


def _clamped(parts: list[Column], low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), reduce(add, parts)))


def quality_score(term: Column, definition: Column, has_etymology: Column, has_examples: Column) -> Column:
    """0 to 10, from 5: length and letters of the term, length and full stop of the definition, what else there is."""
    when, n = lambda c, v: F.when(c, v).otherwise(0.0), F.length(definition)
    letters = F.regexp_replace(term, "[-']", "").rlike(r"^\p{L}+$")
    return _clamped([F.lit(5.0), when(F.length(term).between(4, 15), 1.0), when(~letters, -1.0), when(n >= 30, 1.0), when(n >= 100, 1.0), when(n < 15, -2.0), when(has_etymology, 1.0), when(has_examples, 1.0), when(F.contains(definition, F.lit(".")), 0.5)], 0.0, 10.0)


def utility_score(term: Column, definition: Column, pos: Column, labels: Column, etymology_text: Column, has_context: Column, known_morphology: Column) -> Column:
    """0 to 10, from 5: how useful an entry of a dictionary dump is. labels: array of strings."""
    when, n = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0), F.length(term)
    by_length = F.when(n.between(6, 12), 1.0).when(n < 4, -2.0).when(n > 15, -1.5).otherwise(0.0)
    counted = lambda t: F.size(F.filter(labels, lambda x: x == t))
    tagged = [counted(t) * v for t, v in LABEL_SCORES]
    return _clamped([F.lit(5.0), by_length, when(F.length(etymology_text) > 50, 1.0), when(pos.isin("noun", "verb", "adjective", "adverb"), 1.0), when(has_context, 0.5), when(known_morphology, 1.0), *tagged, when(F.length(definition) > 30, 0.5), when(F.lower(definition).rlike("|".join(SCIENCES)), -0.5)], 0.0, 10.0)


def book_text(text: Column) -> Column:
    """The text between a book's start and end lines, less three more lines after the start; divisors and blanks reduced."""
    start, end = F.lit(None).cast("int"), F.lit(None).cast("int")
    for a, b in zip(reversed(BOOK_STARTS), reversed(BOOK_ENDS), strict=True):
        start = F.when(F.contains(text, F.lit(a)), F.instr(text, a)).otherwise(start)
        end = F.when(F.contains(text, F.lit(b)), F.instr(text, b)).otherwise(end)
    inner = F.substring(text, F.coalesce(start, F.lit(1)), F.greatest(F.coalesce(end, F.length(text) + 1) - F.coalesce(start, F.lit(1)), F.lit(0)))
    body = F.when(start.isNotNull(), F.regexp_replace(inner, r"^[^\n]*(\n[^\n]*){0,3}", "")).otherwise(inner)
    for pattern, new in ((r"\r\n", "\n"), (r"\n\s*\n\s*\n+", "\n\n"), (r"[ \t]+", " "), (r"_{5,}|-{5,}", ""), (r"\n\s*[0-9]+\s*\n", "\n\n")):
        body = F.regexp_replace(body, pattern, new)
    return F.trim(body, F.lit(" \t\n\r\f"))
