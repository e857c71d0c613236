"""The functions as a caller meets them, over the small corpus."""

import pytest
from pyspark.sql import functions as F

from quirewise.api import Engine
from tests.fixture import build


@pytest.fixture(scope="module")
def engine(spark):
    c = build(spark)
    c.works = c.works.withColumn("breadcrumb", F.upper("work"))
    return Engine(c)


def test_search(engine):
    a = engine.search(q="avarice", work="comp", per_page="5")
    assert a["total"].first().asDict() == {"total": 1, "pages": 1}
    hit = a["results"].first()
    assert (hit.work, hit.edition, hit.path_key, hit.work_breadcrumb, hit.authors, hit.text) == ("tw", "1750", "3", "TW", ["test"], "Avarice was withdrawn from later editions of this work.") and len(hit.ranges) == 1
    assert engine.search(q="of", page=9)["results"].count() == 0 and engine.search(q="")["total"].first().total == 0
    assert engine.search(q="corrcted", match="exact", version="original")["results"].first().text.startswith("The editor corrcted")


@pytest.mark.parametrize("ask", [dict(q="x", colour="red"), dict(q="x", match="fuzzy"), dict(q="x", page=0), dict(q="x", edition="1750"), dict(q="x", work="tw", edition="1750", editions="all"), dict(q="x", case_sensitive="maybe"), dict(q="x", version="both")])
def test_wrong_arguments(engine, ask):
    with pytest.raises(ValueError):
        engine.search(**ask)


def test_frequency_and_concordance(engine):
    f = engine.frequency(q="of the", match="exact", group_by="work").collect()
    assert [(r.label, r["count"]) for r in f] == [("SOLO", 2), ("TW", 2)]
    c = engine.concordance(q="liberty", match="exact", window=2, sort="right")
    assert c["total"].first().total == 2 and [r.rights for r in c["lines"].collect()] == [["of", "the"], ["of", "thinking"]]


def test_statistics(engine):
    k = {r.term: r.log_likelihood for r in engine.keywords(author="test", work="tw", min=1).collect()}
    assert k["liberty"] == pytest.approx(2.61, abs=1e-3) and engine.keywords(work="tw").count() == 0
    c = engine.collocations(q="liberty", author="test", work="tw", min=1)
    assert c["figures"].first().window_tokens == 16 and c["results"].first().term == "age"


def test_vectors(engine):
    assert {r.work: r.score for r in engine.similar(author="test", work="tw", level="work").collect()}["solo"] == pytest.approx(0.2372, abs=5e-4)
    t = engine.topics(terms=2, works=1)
    assert t["terms"].count() == 24 and t["labels"].count() == 12 and t["works"].filter("rank > 1").count() == 0
    assert engine.topic_mix(author="test", work="tw", level="work", limit=1).first().weight == pytest.approx(0.3233, abs=5e-4)


def test_reading_and_comparison(engine):
    assert engine.catalogue().filter("author = 'test'").count() == 1
    e = engine.edition(host="test", work="tw")
    assert e["edition"].first().edition == "1760" and [r.path_key for r in e["sections"].collect()] == ["1", "2"]
    assert [r.place for r in engine.full_text(host="test", work="tw", version="both").collect()] == list(range(1, 8))
    s = engine.section_full_text(host="test", work="solo", path="1")
    assert s["section"].first().next == "1/1" and s["blocks"].count() == 5 and engine.section(host="test", work="solo", path="1")["blocks"].count() == 1
    assert [r.path_key for r in engine.compare(host="test", work="tw", a="1750", b="1760").collect()] == ["1", "3", "2"]
    assert engine.compare(host="test", work="tw", a="1750", b="1750").count() == 0
    c = engine.compare_section(host="test", work="tw", a="1750", b="1760", path="1")
    assert [(r.block, r.kind) for r in c["blocks"].collect()] == [("title", "equal"), ("1", "changed"), ("2", "equal"), ("3", "inserted")]
    assert "{+betwixt+}" in c["blocks"].filter("block = '1'").first().marked and c["nav"].first().next is None and c["others"].count() == 0
