"""What compiled corpora read, how they are kept, and the answers put together from several operators."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quirewise import session
from quirewise.operators import compare, reading, scope, search, stats, topics, vectors
from quirewise.sources import artefacts
from quirewise.sources.corpus import latest, with_lemmas
from tests.fixture import build


@pytest.fixture(scope="module")
def corpus(spark):
    return build(spark)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


# Staging


def test_no_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda k, d=None: None)
    for master, fine in (("yarn", False), ("spark://host:7077", False), ("local-cluster[3,2,3000]", False), ("k8s://x", False)):
        fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
        with pytest.raises(RuntimeError):
            session.shared_dir(fake)
    set_ = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: "hdfs://x/shared/"), sparkContext=SimpleNamespace(master="yarn"))
    assert session.shared_dir(set_) == "hdfs://x/shared"


def test_staging_leaves_nothing_behind(spark):
    at = session.shared_dir(spark).removeprefix("file://")
    kept = session.stage(spark.range(3), "kept")
    before, tables = set(os.listdir(at)), len(spark.catalog.listTables())
    with session.staging(spark):
        a, b = session.stage(spark.range(5), "some"), session.stage_bucketed(spark.range(5), "others", "id", 2)
        assert a.count() == b.count() == 5 and len(os.listdir(at)) == len(before) + 2
    assert set(os.listdir(at)) == before and len(spark.catalog.listTables()) == tables and kept.count() == 3


def test_fits_and_lookup(spark):
    small = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert session.fits(small) and not session.fits(small, rows=1) and not session.fits(small, most=1)
    big = spark.createDataFrame([("a", i) for i in range(100)] + [("z", 1), (None, 2)], "k string, i int")
    for few in (True, False):
        got = session.join_lookup(big, small, "k", few=few)
        assert got.count() == 100 and got.filter("v <> 1").count() == 0
        left = session.join_lookup(big, small, "k", "left", few=few)
        assert left.count() == 102 and left.filter("v IS NULL").count() == 2 and left.columns == ["k", "i", "v"]


def test_lemmas_beyond_the_broadcast(spark):
    reg = spark.createDataFrame([("ox", 0, 0, None, None), ("bear", 1, 0, "bore", "bore")], "surface string, reading_idx int, word_idx int, spelling string, lemma string")
    t = spark.createDataFrame([("ox", None), ("bear", 1), ("bear's", 1), ("x y", 0)], "surface string, reading_idx int")
    rows = lambda few: sorted(str(tuple(r)) for r in with_lemmas(t, reg, few=few).collect())
    assert rows(True) == rows(False)


def test_latest_compares_texts(spark):
    rows = [(1, 1, "a" * 50, 1), (1, 1, "a" * 50, 1), (1, 1, "b", 1), (1, 0, "old", 1), (1, 1, None, 1)]
    got = latest(spark.createDataFrame(rows, "k int, t int, text_edited string, n int"), "k", "t").collect()
    assert sorted(str(r.text_edited) for r in got) == ["None", "a" * 50, "b"]


# Compiled corpora


def test_queries_read_the_compiled_vocabulary(corpus):
    assert corpus.vocabulary_readings is corpus.compiled
    one = search.phrase(corpus, "passion")[1]
    logical, physical = plan(one)
    assert "Exchange" not in physical and physical.count("FileScan") == 1 and "postings" in physical
    assert "surface" in physical.split("PushedFilters")[1].split("]")[0]
    phrase = plan(search.phrase(corpus, "of the", "exact")[1])[1]
    assert "Exchange" not in phrase  # tokens lie by unit


def test_many_surfaces_are_joined(corpus, monkeypatch):
    monkeypatch.setattr(search, "LISTED", 0)
    found = lambda q, **how: sorted(map(tuple, search.phrase(corpus, q, **how)[1].collect()))
    joined = [found("passion"), found("of the", match="exact"), found("a priori"), found("nothing of it")]
    monkeypatch.setattr(search, "LISTED", 1000)
    assert joined == [found("passion"), found("of the", match="exact"), found("a priori"), found("nothing of it")] and joined[0]


def test_content_decides(spark, tmp_path):
    names = ("authors", "works", "editions", "units", "tokens", "readings")
    for i, name in enumerate(names[:3]):
        for at in ("one", "two"):
            spark.range(4).withColumn("x", F.when(F.col("id") > i, F.lit(name))).repartition(1 if at == "one" else 3).write.parquet(str(tmp_path / at / f"{name}.parquet"))
    mark = artefacts.fingerprint(spark, str(tmp_path / "one"))
    assert mark == artefacts.fingerprint(spark, str(tmp_path / "two")) and artefacts.stamp(spark, str(tmp_path / "one")) != artefacts.stamp(spark, str(tmp_path / "two"))
    spark.range(4).withColumn("x", F.when(F.col("id") > 1, F.lit("authors"))).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "one" / "authors.parquet"))
    assert mark != artefacts.fingerprint(spark, str(tmp_path / "one"))


def test_serve_builds_once(spark, tmp_path, monkeypatch):
    built = []
    monkeypatch.setattr(artefacts, "read", lambda s, folder: build(s))
    compile_ = artefacts.compiled
    monkeypatch.setattr(artefacts, "compiled", lambda c: built.append(1) or compile_(c))
    folder, kept = str(tmp_path / "data"), str(tmp_path / "kept")
    for _ in range(2):
        c = artefacts.serve(spark, folder, kept)
    assert len(built) == 1 and c.borrowed.count() == 1 and c.postings.count() == c.tokens.count()
    assert search.phrase(c, "passion")[1].count() > 0


def test_missing_parts_are_empty(spark, tmp_path):
    import shutil

    c, to = build(spark), str(tmp_path / "kept")
    artefacts.write(c, to, "m")
    for name in ("members", "borrowed", "postings", "originals", "works"):
        shutil.rmtree(f"{to}/{name}")
    again = artefacts.reopen(spark, to)
    assert again.members.count() == again.originals.count() == again.works.count() == 0 and again.borrowed is None
    assert search.phrase(again, "passion")[1].count() == search.phrase(c, "passion")[1].count()
    shutil.rmtree(f"{to}/tokens")
    with pytest.raises(FileNotFoundError):
        artefacts.reopen(spark, to)


def test_units_of_an_edition(corpus):
    assert [r.unit_id for r in artefacts.units_of(corpus, 3, 14, 16).orderBy("unit_id").collect()] == [14, 15, 16]


# Scope


def test_compiled_borrowing(spark):
    c = build(spark, members=((4, 2), (2, 1)))
    ids = lambda df: sorted(r.edition_id for r in df.collect())
    assert ids(scope.scoped(c, work="comp")) == [1, 2, 4]
    target, rest = stats.sides(c, "test", "comp")
    assert ids(target) == [1, 2, 4] and ids(rest) == [1, 3, 4, 5]
    assert ids(stats.sides(c, None, "comp")[0]) == [] and stats.keyness(c, *stats.sides(c, None)).count() == 0
    assert scope.scope_name(editions="all") == "all" and scope.scope_name(edition="1750") == "canonical"


# Answers


def test_labels_and_totals(corpus):
    _, first, n = search.phrase(corpus, "of the", "exact")
    s = scope.scoped(corpus)
    w = search.labelled(corpus.__class__(**{**vars_of(corpus), "works": corpus.works.withColumn("breadcrumb", F.upper("work"))}), search.frequency(corpus, first, n, s, "edition"), "edition").collect()
    assert [r["count"] for r in w] == sorted((r["count"] for r in w), reverse=True) and {r.label for r in w} <= {"SOLO (1740)", "TW (1760)", "COMP (1755)"}
    hits = search.ranked(corpus, first, n, s)
    assert search.total_and_pages(hits, 1).first().pages == hits.count() and search.total_and_pages(hits.limit(0)).first().pages == 1


def vars_of(c):
    return {k: getattr(c, k) for k in c.__dataclass_fields__}


def test_lines_are_cut_from_the_text(spark):
    c = build(spark, [(1, "w", "1700", True)], [(1, "", "1", "One, two; THREE four -- five.")], {}, {}, [(9, 9)])
    at = {"one": (0, 3), "two": (5, 8), "three": (10, 15), "four": (16, 20), "five": (24, 28)}
    t = c.tokens.withColumns({"start_char": F.element_at(F.create_map(*(F.lit(x) for k, v in at.items() for x in (k, v[0]))), F.col("surface")).cast("long"), "end_char": F.element_at(F.create_map(*(F.lit(x) for k, v in at.items() for x in (k, v[1]))), F.col("surface")).cast("long")})
    c.tokens = c.postings = session.stage(t, "tokens")
    _, first, n = search.phrase(c, "three", "exact")
    line = search.lines(c, search.concordance(c, first, n, c.editions, 2)).first()
    assert (line.left, line.key, line.right, line.cut_left, line.cut_right) == ("One, two", "THREE", "four -- five", False, False)
    _, first, n = search.phrase(c, "one", "exact")
    assert search.lines(c, search.concordance(c, first, n, c.editions, 1)).first().left == ""


def test_collocations_of_what_is_not_there(corpus):
    s = scope.scoped(corpus)
    assert stats.collocations(corpus, " -- ", s).count() == 0 and stats.collocations(corpus, "zebra", s, least=1).count() == 0
    assert stats.colloc_figures(corpus, "", s).first().asDict() == {"scope_tokens": 0, "node_count": 0, "window_tokens": 0}
    f = stats.colloc_figures(corpus, "liberty", scope.scoped(corpus, "test", "tw")).first()
    assert (f.scope_tokens, f.node_count, f.window_tokens) == (63, 2, 16)
    assert stats.colloc_figures(corpus, "a priori", scope.scoped(corpus, wanted="all")).first().node_count == 1  # fused


def test_similar_answers(corpus):
    a = vectors.similar_answer(corpus.__class__(**{**vars_of(corpus), "works": corpus.works.withColumn("breadcrumb", F.upper("work"))}), "test", "tw", level="work").collect()
    assert {r.work: r.score for r in a}["solo"] == pytest.approx(0.2372, abs=5e-4) and all(r.found for r in a)
    with_b = corpus.__class__(**{**vars_of(corpus), "works": corpus.works.withColumn("breadcrumb", F.upper("work"))})
    none = vectors.similar_answer(with_b, "test", "gone", level="work").collect()
    assert [(r.found, r.work) for r in none] == [(False, None)]


def test_topic_mix(corpus):
    terms, mix = topics.train(corpus, vectors.tfidf(corpus))
    got = topics.topic_mix(corpus, "test", "tw", level="work", limit=4, terms=terms, mix=mix).collect()
    assert [r.weight for r in got] == pytest.approx([0.3233, 0.2819, 0.2041, 0.1311], abs=5e-4)
    assert got[0].label == "paragraph, edition, of" and len(got[0].terms.split(" ")) == 6 and all(r.found for r in got)
    for who in (("test", "gone"), (None, "tw"), ("test", "stub")):
        assert [(r.found, r.topic) for r in topics.topic_mix(corpus, *who, level="work", terms=terms, mix=mix).collect()] == [(False, None)]


def test_reading_answers(corpus):
    one = corpus.editions.filter("edition_id = 1")
    r = reading.section_answer(corpus, one, "1/2").first()
    assert (r.previous, r.next, r.above, r.others) == ("1/1", None, ["1"], [])
    assert reading.section_answer(corpus, corpus.editions.filter("edition_id = 3"), "1").first().others == ["1750"]
    assert [t.text for t in reading.title_blocks(corpus, one).collect()] == ["A SOLITARY TREATISE."]
    assert [t.place for t in reading.ordered_text(corpus, one).orderBy("unit_id").collect()] == [1, 2, 3, 4, 5, 6]
    assert [w.surname for w in reading.find_work(corpus, "TEST", "Solo").collect()] == ["Author"]


# Comparison


def test_exactly_as_many_edits_as_allowed():
    a = [x for i in range(1500) for x in (("k", i), ("a", i))]
    b = [x for i in range(1500) for x in (("k", i), ("b", i))]
    script = compare.shortest_script(a, b)
    assert sum(e - s for op, s, e in script if op != "equal") == 3000 and sum(op == "equal" for op, _, _ in script) == 1500
    assert [op for op, _, _ in compare.shortest_script([*a, ("a", 1500)], [*b, ("b", 1500)])] == ["equal", "delete", "insert"]


def test_blocks_in_order(spark):
    c = build(spark, [(1, "w", "1700", False), (2, "w", "1710", True)], [(1, "s", "1", "Same."), (1, "s", "2", "Only a."), (1, "s", "3", "Old word here."), (2, "s", "1", "Same."), (2, "s", "x", "Only b."), (2, "s", "3", "New word here.")], {}, {}, [(9, 9)])
    pairs = compare.pair_of(c, "test", "w", "1700", "1710")
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)] and compare.pair_of(c, "test", "w", "1700", "1700").count() == compare.pair_of(c, "test", "w", "1700", "1799").count() == 0
    got = compare.diff_ops(compare.ordered_blocks(c, pairs)).orderBy("ordinal").withColumn("marked", compare.as_text(F.col("ops"))).collect()
    assert [(r.block, r.kind, r.marked) for r in got] == [("1", "equal", "Same."), ("x", "deleted", "[-Only b.-]"), ("2", "inserted", "{+Only a.+}"), ("3", "changed", "[-New-] {+Old+} word here.")]
    assert [tuple(r)[2:] for r in compare.neighbours_in_both(c, pairs).collect()] == [("s", None, None)]


def test_one_sided_stretches_match_the_word_by_word_ones(spark):
    texts = [("  A, b \n c ", "A, b c"), ("x", ""), ("", "y  z"), (None, None), ("", " "), ("a b", "a  b")]
    df = spark.createDataFrame(texts, "text_a string, text_b string")
    for r in compare.diff_ops(df).collect():
        assert [o.asDict() for o in r.ops] == compare.word_ops(r.text_b or "", r.text_a or "")
