"""Pages and wiki markup: the layouts that hold entries, what counts as a word list, and nested markup."""

import pytest

from lexigrid.sources import files, page_terms, wiki_markup


@pytest.mark.parametrize(
    "html, found",
    [
        ("<dl><dt>1. Mole<dd>n. an animal [2] that digs<dt>Vole<dd>another one of them</dl>", [("Mole", "an animal  that digs"), ("Vole", "another one of them")]),
        ("<dl><dt>a</dt><dt>Bee</dt><dt>Cow</dt><dt>Dog</dt><dd>too few meanings</dd></dl>", []),
        ("<table><tr><th>No.<th>Gloss<th>Word<tr><td>1<td>an animal<td>Mole<tr><td>2<td>too short</table>", [("Mole", "an animal")]),
        ("<table><tr><td>Mole</td><td>an animal</td></tr></table>", []),
        ("<ol><li><b>Mole</b> an animal<li>Vole - another one<li>neither</ol>", [("Mole", "an animal"), ("Vole", "another one")]),
        ("<ul><li>Mole - an animal<li>Vole - another one</ul>", []),
        ("<div class='Word-List x'><h4>Mole</h4>an <i>animal</i></div><div class=other><h4>Vole</h4>another one</div>", [("Mole", "an animal")]),
        ("<p>Mole (n) an animal</p><p>Vole adj. another one</p><p>no entry</p>", [("Mole", "an animal"), ("Vole", "another one")]),
        ("<div>" + "".join(f"<b>Term{c}</b> — meaning number {k}<br>" for k, c in enumerate("abcdefghijk")) + "</div><p>Mole - an animal</p>", [(f"Term{c}", f"meaning number {k}") for k, c in enumerate("abcdefghijk")]),
        ("<p>Mole - an animal</p><p>MOLE - again an animal</p><script>Vole - a script</script>", [("Mole", "an animal")]),
        ("<p>&lt;Mole&gt; - an &amp; animal", [("<Mole>", None)]),
        ("", []),
        (None, []),
        ("<<<p>><", []),
    ],
)
def test_entries(html, found):
    assert page_terms.entries(html) == [e for e in found if e[1]]


@pytest.mark.parametrize(
    "html, counts",
    [
        ("<dl><dt>Mole<dd>x<dt>Vole<dd>y</dl>", (1, 0, 0, 0)),
        ("<dl><dt>Mole 7<dd>x<dt>Vole 8<dd>y</dl>", (0, 0, 0, 0)),
        ("<table>" + "<tr><td>Mole<td>an animal that digs" * 4 + "</table>", (0, 1, 0, 0)),
        ("<table>" + "<tr><td>Mole<td>an animal" * 4 + "</table>", (0, 0, 0, 0)),
        ("<ul>" + "<li>Mole – it digs" * 3 + "</ul>", (0, 0, 1, 0)),
        ("<ul><li>Mole<li>Vole<li>Cat</ul>", (0, 0, 0, 0)),
        ("<div class=glossary><b>Mole</b></div><div class=glossary>none</div>", (0, 0, 0, 1)),
        (None, (0, 0, 0, 0)),
    ],
)
def test_structure(html, counts):
    assert tuple(page_terms.structure(html).values()) == counts


def test_pages_in_batches(spark):
    pages = spark.createDataFrame([(1, "<p>Mole - an animal</p>", "x"), (2, None, "y"), (3, "<ul>" + "<li>Mole: it digs deep" * 3, "z")], "page_id long, html string, term string")
    assert sorted(map(tuple, page_terms.extract_terms(pages).collect())) == [(1, 0, "Mole", "an animal"), (3, 0, "Mole", "it digs deep")]
    assert {r["page_id"]: r["is_word_list"] for r in page_terms.page_structure(pages).collect()} == {1: False, 2: False, 3: True}
    assert page_terms.extract_terms(pages.where("false")).count() == 0


PAGE = """==English==
===Etymology 1===
From {{inh|en|enm|{{l|x}}}} [[mole|Old [[mole]]]].
===Noun===
{{en-noun}}
# {{lb|en|dated or {{q|x}}|zoology}} An [[animal]] (small) <br/>that ''digs''.
#: {{archaic}} an example
## a sense within
# {{x}}
====Synonyms====
* vole
===Verb===
# {{lb|fr|archaic}} To [[dig {{gloss|in}}|dig]] {{qualifier|now historical}} (deep [[hole]]s)
===Adjective===
# Plain sense
==French==
===Noun===
# {{archaic}} Not English
"""


def test_senses():
    found = wiki_markup.senses(PAGE)
    etymology = "From Old mole."
    assert found == [
        ("noun", "An animal (small) that ''digs''.", ["archaic", "dated"], "digs", etymology),
        ("verb", "To dig (deep holes)", ["historical"], "deep holes", etymology),
    ]
    assert [s[1] for s in wiki_markup.senses(PAGE, only_marked=False)] == [*(s[1] for s in found), "Plain sense"]
    assert [s[1] for s in wiki_markup.senses(PAGE, "french")] == ["Not English"]


@pytest.mark.parametrize(
    "text, plain",
    [("a {{b|{{c}} d", "a {{b| d"), ("a ]] b }}", "a ]] b }}"), ("[[a|b {{c]] d}} e", "b {{c d}} e"), ("{{a|[[b}} c", " c"), ("[[a|[[b|c]]|d]]", "d"), ("a | b", "a | b"), ("", ""), ("{{" * 3, "{{" * 3)],
)
def test_markup_that_is_not_closed(text, plain):
    assert wiki_markup.shown(wiki_markup.parse(text)) == plain


def test_deep_nesting_ends():
    assert wiki_markup.shown(wiki_markup.parse("{{a|" * 5_000 + "b" + "}}" * 5_000)) is not None


def test_dump(spark, tmp_path):
    pages = "".join(f"<page><title>{t}</title><revision><text>{x.replace('<', '&lt;')}</text></revision></page>" for t, x in (("Mole", PAGE), ("Empty", ""), ("None", "no markup")))
    (tmp_path / "dump.xml").write_text(f"<mediawiki>{pages}</mediawiki>")
    found = wiki_markup.wiki_senses(files.read_dump(spark, f"file://{tmp_path}/dump.xml"))
    assert [(r["term"], r["place"], r["pos"], r["marks"]) for r in found.orderBy("place").collect()] == [("mole", 0, "noun", ["archaic", "dated"]), ("mole", 1, "verb", ["historical"])]


def test_dump_is_written_and_read(spark, tmp_path):
    pages = [(f"T<{k}>", f"a & b\n== {k} ==") for k in range(30)] + [("none", None), (None, "x")]
    files.write_dump(spark.createDataFrame(pages, "title string, text string").repartition(3), f"file://{tmp_path}/dump")
    got = {(r["title"], r["text"]) for r in files.read_dump(spark, f"file://{tmp_path}/dump").collect()}
    assert {x for x in got if x[0] and x[1]} == set(pages[:30]) and len(got) == 32
