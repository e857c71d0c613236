"""Published numbers of the small corpus. The numbers expected here."""

import pytest
from pyspark.sql import functions as F

from quirewise.operators import scope, search, stats, topics, vectors
from tests.fixture import build


@pytest.fixture(scope="module")
def corpus(spark):
    return build(spark)


def rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_keyness(corpus):
    canon = corpus.editions.filter("canonical")
    got = rows(stats.keyness(corpus, canon.filter("work = 'tw'"), canon, least=1), "term")
    for term, a, b, ll, lr in [("liberty", 2, 0, 2.61, 1.88), ("of", 6, 2, 1.78, 1.47), ("passion", 2, 1, 0.26, 0.88), ("a", 4, 3, 0.07, 0.30)]:
        r = got[term]
        assert (r["target"], r["reference"]) == (a, b)
        assert r["log_likelihood"] == pytest.approx(ll, abs=1e-3) and r["log_ratio"] == pytest.approx(lr, abs=1e-3)


def test_keyness_of_nothing_is_empty(corpus):
    canon = corpus.editions.filter("canonical")
    assert stats.keyness(corpus, canon, canon, least=1).count() == 0


def test_collocations(corpus):
    s = scope.in_scope(corpus.editions, corpus.members, "test", "tw")
    got = rows(stats.collocations(corpus, "liberty", s, least=1), "term")
    for term, o, c, pmi, ll, t in [("age", 1, 1, 1.98, 2.79, 0.75), ("of", 3, 6, 0.98, 1.87, 0.85), ("every", 1, 2, 0.98, 0.58, 0.49), ("a", 1, 4, -0.02, 0, -0.02)]:
        r = got[term]
        assert (r["cooccurrence"], r["total"]) == (o, c)
        assert (r["pmi"], r["log_likelihood"], r["t_score"]) == pytest.approx((pmi, ll, t), abs=1e-3)
    assert "liberty" not in got


def test_similar(corpus):
    w = vectors.tfidf(corpus).cache()
    got = {(r.work, r.path_key): r.score for r in vectors.similar(corpus, "test", "tw", path="1", weights=w).collect()}
    assert (got["solo", "1/1"], got["solo", "1"], got["comp", "in"]) == pytest.approx((0.2174, 0.1121, 0.0904), abs=5e-4)
    got = rows(vectors.similar(corpus, "test", "tw", level="work", weights=w), "work")
    assert (got["solo"]["score"], got["comp"]["score"]) == pytest.approx((0.2372, 0.1397), abs=5e-4)
    assert "tw" not in got


def test_topics(corpus):
    terms, mix = topics.train(corpus, vectors.tfidf(corpus))
    by = {}
    for r in terms.orderBy("topic", "rank").collect():
        by.setdefault(r.topic, []).append((r.lemma, r.weight))
    assert len(by) == 12
    pair = {tuple(w for w, _ in t[:2]): tuple(x for _, x in t[:2]) for t in by.values()}
    assert pair["solitary", "treatise"] == pytest.approx((0.5, 0.5), abs=5e-4)
    assert pair["part", "I"] == pytest.approx((0.5645, 0.4286), abs=5e-4)
    assert pair["composite", "collection"] == pytest.approx((0.496, 0.496), abs=5e-4)
    label = rows(topics.labels(terms), "topic")
    got = {label[r.topic]["label"]: r.weight for r in topics.mix_of(mix.filter("edition_id = 3"), 100).collect()}
    want = {"paragraph, edition, of": 0.3233, "liberty, age, of": 0.2041, "the, foot, to": 0.1311}
    assert {k: got[k] for k in want} == pytest.approx(want, abs=5e-4)
    assert next(v for k, v in got.items() if k.startswith("test, work")) == pytest.approx(0.2819, abs=5e-4)
    assert sum(got.values()) == pytest.approx(1, abs=0.01)


def test_topics_above_the_driver_limit(corpus, monkeypatch):
    w = vectors.tfidf(corpus).cache()
    seen = []
    for limit in (topics.DRIVER_WEIGHTS, 0):
        monkeypatch.setattr(topics, "DRIVER_WEIGHTS", limit)
        terms, mix = topics.train(corpus, w, passes=6)
        seen.append(({(r.topic, r.lemma): r.weight for r in terms.collect()}, {(r.edition_id, r.path_key, r.topic): r.weight for r in mix.collect()}))
    assert seen[0][1] and seen[1][1] == pytest.approx(seen[0][1], abs=1e-5)
    assert {k: v for k, v in seen[1][0].items() if v > 0.001} == pytest.approx({k: v for k, v in seen[0][0].items() if v > 0.001}, abs=2e-6)


def test_topics_fold_in_by_whole_topics(corpus, spark):
    w = vectors.tfidf(corpus).cache()
    found = topics.model(corpus, w, topics=1, passes=20)
    assert len(found.lemmas) > 25
    cut = topics.train(corpus, w, topics=1, passes=20)[0]
    zeros = lambda t: {(r.edition_id, r.path_key) for r in topics.fold_in(w.join(found_lemmas, "lemma", "left_semi"), t, 1).collect() if r.weight == 0}
    found_lemmas = spark.createDataFrame([(x,) for x in found.lemmas], "lemma string").join(cut, "lemma", "left_anti")
    assert zeros(cut) and not zeros(found.all_terms(spark))


def test_topics_fold_in(corpus, spark):
    terms = spark.createDataFrame([(0, 1, "liberty", 1.0), (1, 1, "connection", 1.0)], "topic int, rank int, lemma string, weight double")
    got = {(r.edition_id, r.path_key, r.topic): r.weight for r in topics.fold_in(vectors.tfidf(corpus), terms, 2).collect()}
    assert got[3, "2", 0] == pytest.approx(1, abs=1e-3) and got[1, "1/2", 1] == pytest.approx(1, abs=1e-3) and got[4, "in", 0] == 0


def hits(corpus, q, match="form", work=None, wanted=None, **how):
    _, first, n = search.phrase(corpus, q, match, **how)
    s = scope.in_scope(corpus.editions, corpus.members, work=work, wanted=wanted)
    return search.ranked(corpus, first, n, s).orderBy(F.desc("score"), "unit_id").collect()


def test_search_levels(corpus):
    assert [h.edition_id for h in hits(corpus, "connection between cause and effect")] == [1]
    assert len(hits(corpus, "encrease", work="tw", wanted="all")) == 2
    assert [h.edition_id for h in hits(corpus, "encrease", "exact", wanted="all")] == [2]
    assert len(hits(corpus, "cause and effect")) == 1 and not hits(corpus, "cause and effect", "spelling")
    assert not hits(corpus, "corrcted", "exact") and len(hits(corpus, "corrcted", "exact", version="original")) == 1
    assert not hits(corpus, "also", "exact", version="original")
    assert [h.edition_id for h in hits(corpus, "avarice", work="comp")] == [2]
    assert not hits(corpus, "avarice")
    for q in ("priori", "facto", "a priori"):
        assert len(hits(corpus, q, wanted="all")) == 1
    assert not hits(corpus, "a, priori", wanted="all") and not hits(corpus, "")


def test_case(corpus):
    assert len(hits(corpus, "Men", "exact", case=True)) == 1 and not hits(corpus, "men", "exact", case=True)


def test_dictionary_nets(spark):
    reg = {"humane": [(None, None)], "human": [(None, None)], "lie": [(None, None)], "lay": [(None, None)]}
    c = build(spark, [(1, "amb", "1700", True)], [(1, "", "1", "Humane men lay."), (1, "", "2", "A human humane deed.")], reg, {}, [(9, 9)], more=[("humane", 1, 0, "human", "human"), ("lay", 1, 0, "lay", "lie")])
    assert len(hits(c, "human", "spelling")) == 2 and len(hits(c, "human", "spelling", resolved=True)) == 1
    assert len(hits(c, "lie")) == 1 and not hits(c, "lie", resolved=True)


def test_possessive(spark):
    c = build(spark, [(1, "pos", "1700", True)], [(1, "", "1", "The bishop's mitre and a wombat's whim; every bishop kneels.")], {"bishop": [(None, None)]}, {}, [(9, 9)])
    first = search.phrase(c, "bishop")[1]
    assert first.count() == 2 and search.phrase(c, "mitre's")[1].count() == 1 and search.phrase(c, "wombat")[1].count() == 0
    got = {r.surface: r.lemmas for r in c.lemmas(c.tokens).collect()}
    assert got["bishop's"] == ["bishop"] and got["wombat's"] == ["wombat's"]


def test_overlaps(spark):
    c = build(spark, [(1, "w", "1700", True)], [(1, "", "1", "echo echo echo")], {}, {}, [(9, 9)])
    s, first, n = search.phrase(c, "echo echo", "exact")
    sc = scope.in_scope(c.editions, c.members)
    assert search.frequency(c, first, n, sc).first()["count"] == 2
    assert search.concordance(c, first, n, sc).count() == 1


def test_concordance_window(corpus):
    s, first, n = search.phrase(corpus, "liberty", "exact")
    lines = search.concordance(corpus, first, n, corpus.editions, 2).orderBy("unit_id").collect()
    assert (lines[0].lefts, lines[0].rights, lines[0].cut_left, lines[0].cut_right) == (["the"], ["of", "the"], False, True)
    assert (lines[1].lefts, lines[1].keyword) == (["natural", "the"], "liberty")


def test_bm25_order(spark):
    c = build(spark, [(1, "w", "1700", True)], [(1, "a", "1", "widget " * 2 + "x y z"), (1, "b", "1", "widget " * 6), (1, "c", "1", "widget " + "pad " * 60)], {}, {}, [(9, 9)])
    assert [h.path_key for h in hits(c, "widget")] == ["b", "a", "c"]
