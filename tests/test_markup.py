"""Trees of blocks and the tables made of them."""

import json

import pytest

from quirewise.operators import compare, scope, search
from quirewise.sources import artefacts, markup

TEXT = lambda s: {"type": "plainText", "content": s}
WRAP = lambda kind, *x, **more: {"type": kind, "content": [TEXT(i) if isinstance(i, str) else i for i in x], **more}
PAR = lambda *x: WRAP("paragraph", *x)
BLOCK = lambda i, *x: {"id": i, "content": list(x)}

LISTED = {"type": "list", "items": [{"content": [TEXT("one")], "nestedList": {"type": "list", "items": [{"content": [TEXT("two")]}, {"content": []}]}}]}
TABLE = {"type": "table", "rows": [{"cells": [{"content": [TEXT("a")]}, {"content": [TEXT("b")]}]}, {"cells": [{"content": [TEXT("c")]}]}]}
RICH = BLOCK("x.1", {"type": "heading", "content": [{"content": [TEXT("TOP")]}]}, WRAP("blockquote", PAR("quoted")), LISTED, TABLE)


def test_texts():
    assert markup.extract_text(RICH)[0] == "TOP\nquoted\none\ntwo\n\na | b\nc"
    b = BLOCK("x.2", PAR("The ", WRAP("deletion", "corrcted"), WRAP("insertion", "corrected"), " ", WRAP("emphasis", WRAP("insertion", "new "), "text")))
    assert markup.extract_text(b)[0] == "The corrected new text" and markup.extract_text(b, "original")[0] == "The corrcted text"
    assert markup.has_editorial(b) and not markup.has_editorial(RICH) and markup.resolve_block(b, "both") is b
    assert not markup.has_editorial(markup.resolve_block(b, "edited"))


def test_marking_wraps_all_of_it_once():
    m = markup.mark_block(RICH, "insertion")
    assert markup.has_editorial(m) and markup.extract_text(m, "original")[0].replace(" | ", "").strip("\n") == ""
    assert markup.extract_text(m)[0] == markup.extract_text(RICH)[0]
    assert [h["content"] for h in markup.holders(m)].count([]) == 1 and not markup.has_editorial(RICH)


def test_tokens_know_what_is_around_them():
    b = BLOCK("x.3", PAR("He ", WRAP("word", "lay", value="=lie"), " by ", WRAP("emphasis", WRAP("person", "Lay Humane")), " end"))
    got = {(t["text"], t["exempt"], t["word"]) for t in markup.tokens_of(b)}
    assert got == {("He", False, None), ("lay", False, "=lie"), ("by", False, None), ("Lay", True, None), ("Humane", True, None), ("end", False, None)}


@pytest.mark.parametrize("child, parent, slug", [("a.w.1750.Sect1", "a.w.1750", "sect1"), ("b.Other.1760", "a.w.1750", "other"), ("a.w.1750.1/2", "A.w.1750", "2")])
def test_slugs(child, parent, slug):
    assert markup.child_slug(child, parent) == slug


CATALOGUE = [
    {"slug": "bell", "forename": "Ann", "surname": "Bell", "works": [{"slug": "solo", "title": "Solo", "editions": [{"slug": "1740", "id": "bell.solo.1740"}, {"slug": "1750", "id": "bell.solo.1750"}]}, {"slug": "corr", "title": "Letters", "authors": ["bell", "dee"], "editions": [{"slug": "1760", "id": "bell.corr.1760"}]}]},
    {"slug": "dee", "forename": "Bo", "surname": "Dee", "works": [{"slug": "corr", "title": "Letters", "authors": ["bell", "dee"], "editions": [{"slug": "1760", "id": "bell.corr.1760"}]}]},
]
DOCUMENTS = [
    {"id": "bell.solo.1740", "metadata": {"title": "Solo", "authors": "Bell", "dictionary": {"lay": "=lie"}}, "blocks": [BLOCK("bell.solo.1740.title", PAR("SOLO."))],
     "children": [{"id": "bell.solo.1740.1", "metadata": {"title": "One", "imported": False}, "blocks": [BLOCK("bell.solo.1740.1.1", PAR("They lay betwixt causes."))], "children": [{"id": "bell.solo.1740.1.a", "blocks": [BLOCK("bell.solo.1740.1.a.1", PAR("A ", WRAP("deletion", "bad"), WRAP("insertion", "good"), " end."))]}]}]},
    {"id": "bell.solo.1750", "metadata": {"title": "Solo"}, "blocks": [], "children": [{"id": "bell.solo.1750.1", "blocks": [BLOCK("bell.solo.1750.1.1", PAR("Hens lay; ", WRAP("word", "lay", value="=lie"), " ", WRAP("person", "Lay"), "."))]}]},
    {"id": "bell.corr.1760", "metadata": {"title": "Letters"}, "blocks": [], "children": [{"id": "bell.solo.1740", "blocks": []}, {"id": "bell.corr.1760.2", "blocks": [BLOCK("bell.corr.1760.2.1", PAR("A letter."))]}]},
]
REGISTER = [{"between": None, "betwixt": "between", "cause": None, "causes": "=cause"}, {"lay": [None, "=lie"], "lie": None, "'tis": "it is", "it": None, "is": "=be", "be": None}]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("documents")
    (at / "catalogue.json").write_text(json.dumps(CATALOGUE))
    for kind, rows in (("documents", DOCUMENTS), ("dictionary", REGISTER)):
        (at / kind).mkdir()
        for i, x in enumerate(rows):
            (at / kind / f"{i}.json").write_text(json.dumps(x))
    return artefacts.compiled(markup.read_folder(spark, str(at)))


def test_register(corpus):
    got = {(r.surface, r.reading_idx, r.word_idx): (r.spelling, r.lemma) for r in corpus.readings.collect()}
    assert got["betwixt", 0, 0] == ("between", "between") and got["causes", 0, 0] == ("causes", "cause") and got["lay", 1, 0] == ("lay", "lie")
    assert (got["'tis", 0, 0], got["'tis", 0, 1]) == (("it", "it"), ("is", "be"))


def test_tables(corpus):
    e = {r.edition_id: r for r in corpus.editions.collect()}
    assert [(r.host_slug, r.work, r.edition, r.canonical) for _, r in sorted(e.items())] == [("bell", "solo", "1740", False), ("bell", "solo", "1750", True), ("bell-dee", "corr", "1760", True)]
    assert e[3].author_names == ["Ann Bell", "Bo Dee"]
    u = corpus.units.orderBy("unit_id").collect()
    assert [(r.unit_id, r.edition_id, r.path_key, r.block_id, r.has_editorial) for r in u] == [(1, 1, "", "title", False), (2, 1, "1", "1", False), (3, 1, "1/a", "1", True), (4, 2, "1", "1", False), (5, 3, "2", "1", False)]
    assert u[2].text_original == "A bad end." and json.loads(u[2].block)["id"] == "bell.solo.1740.1.a.1"
    assert [tuple(r) for r in corpus.members.collect()] == [(3, 1)]
    ids = sorted(r.edition_id for r in scope.scoped(corpus, work="corr").collect())
    assert ids == [1, 3]


def test_readings_are_chosen(corpus):
    lay = {(r.unit_id, r.pos): r.reading_idx for r in corpus.tokens.filter("surface = 'lay'").collect()}
    assert lay == {(2, 1): 1, (4, 1): 0, (4, 2): 1, (4, 3): -1}  # by the text's override, by default, by its own value, exempt
    found = search.phrase(corpus, "lie", resolved=True)[1]
    assert {(r.unit_id, r.pos) for r in found.collect()} == {(2, 1), (4, 2)}


def test_sections_inherit(spark):
    docs = spark.createDataFrame([(json.dumps(d),) for d in DOCUMENTS], "json string")
    s = {(r.id, r.path_key): r for r in markup.document_sections(docs).collect()}
    assert not s["bell.solo.1740", "1/a"].imported and s["bell.solo.1740", "1/a"].authors == ["bell"] and s["bell.solo.1740", "1/a"].title == "a"
    assert s["bell.corr.1760", "solo"].owner == "bell.solo.1740" and s["bell.corr.1760", "2"].owner == "bell.corr.1760"


def test_trees_side_by_side():
    old = [BLOCK("w.1700.s.1", PAR("Same.")), BLOCK("w.1700.s.2", PAR("The old ", WRAP("emphasis", "fine word"), ", here.")), BLOCK("w.1700.s.9", PAR("Gone."))]
    new = [BLOCK("w.1710.s.1", PAR("Same.")), BLOCK("w.1710.s.2", PAR("The new ", WRAP("emphasis", "fine word"), "; here.")), BLOCK("w.1710.s.X", PAR("Come."))]
    got = compare.compare_trees(old, new)
    assert [b["id"] for b in got] == ["w.1710.s.1", "w.1710.s.2", "w.1700.s.9", "w.1710.s.X"] and got[0] == new[0]
    assert markup.extract_text(got[1])[0] == "The new fine word; here." and markup.extract_text(got[1], "original")[0] == "The old fine word, here."
    inline = got[1]["content"][0]["content"]
    assert [x["type"] for x in inline] == ["plainText", "deletion", "insertion", "emphasis", "deletion", "insertion", "plainText"] and inline[3]["content"] == [TEXT(" fine word")]
    assert got[2] == markup.mark_block(old[2], "deletion") and got[3] == markup.mark_block(new[2], "insertion")
