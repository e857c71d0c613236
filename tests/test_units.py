"""Rules of words, readings, scope and comparison. The expected words and readings."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirewise.functions import params
from quirewise.functions.text import fold_py, fold_surface, half_up, is_capital, words
from quirewise.operators import compare, reading, scope
from quirewise.operators.search import QueryWord, parse_query
from quirewise.sources import artefacts, model
from quirewise.sources.corpus import latest, reading_lemmas, with_lemmas
from tests.fixture import build


def test_words(spark):
    df = spark.createDataFrame([("The “school-men, tho' — wrote i.e. so",), ("'' — !",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(words(F.col("t"))).collect()]
    assert got == [["The", "school", "men", "tho'", "wrote", "i.e", "so"], [], [], None]


@pytest.mark.parametrize("s, want", [("The", "the"), ("I", "I"), (" I​", "I"), ("co­in", "coin"), ("é", "é"), ("It’s ", "it's"), ("", ""), (" A b ", "a b")])
def test_fold(spark, s, want):
    assert fold_py(s) == want
    assert spark.createDataFrame([(s,)], "s string").select(fold_surface(F.col("s"))).first()[0] == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=6), min_size=1, max_size=30))
def test_fold_is_one_rule(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", fold_surface(F.col("s"))).collect()
    assert [r[1] for r in sorted(got)] == [fold_py(t) for t in texts]


def test_rounding_and_capitals(spark):
    assert [r[0] for r in spark.createDataFrame([(-2.5,), (2.5,), (1.005,)], "x double").select(half_up(F.col("x"), 0)).collect()] == [-2.0, 3.0, 1.0]
    assert [r[0] for r in spark.createDataFrame([("The",), ("'Tis",), ("x",), ("1",)], "x string").select(is_capital(F.col("x"))).collect()] == [True, False, False, False]


def test_latest(spark):
    rows = [(1, 1, "old"), (1, 2, "new"), (1, 2, "new"), (1, 2, "too"), (2, None, "a"), (None, 1, "n"), (None, 1, "n")]
    got = latest(spark.createDataFrame(rows, "k int, t int, x string"), "k", "t").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(1, 2, "new"), (1, 2, "too"), (2, None, "a"), (None, 1, "n")]))
    assert latest(spark.createDataFrame([], "k int, t int, x string"), "k", "t").count() == 0


def test_lemmas(spark):
    reg = spark.createDataFrame([("'twas", 0, 0, "it", None), ("'twas", 0, 1, "was", "be"), ("a b", 0, 0, None, None), ("bear", 0, 0, None, None), ("bear", 1, 0, "bore", "bore"), ("bear", 1, 0, "bore", "bore")], "surface string, reading_idx int, word_idx int, spelling string, lemma string")
    assert {(r.surface, r.reading_idx): r.lemmas for r in reading_lemmas(reg).collect()}["'twas", 0] == ["it", "be"]
    t = spark.createDataFrame([("'twas", None), ("'twas", -1), ("a b", 0), ("a c", 0), ("bear", 1), ("bear", 7), ("bear's", 1), ("bear's", 5), ("ox's", 0)], "surface string, reading_idx int")
    got = [(r.surface, r.reading_idx, r.lemmas) for r in with_lemmas(t, reg).collect()]
    want = [("'twas", None, ["it", "be"]), ("'twas", -1, ["'twas"]), ("a b", 0, ["a b"]), ("a c", 0, ["a", "c"]), ("bear", 1, ["bore"]), ("bear", 7, ["bear"]), ("bear's", 1, ["bore"]), ("bear's", 5, ["bear's"]), ("ox's", 0, ["ox's"])]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_scope():
    assert scope.check_scope() is None and scope.check_scope(editions="all") == "all" and scope.check_scope("w", "1750") == "1750"
    for bad in ({"editions": "some"}, {"edition": "1750"}, {"work": "w", "edition": "1750", "editions": "all"}):
        with pytest.raises(ValueError):
            scope.check_scope(**bad)


def test_scope_containment(spark):
    c = build(spark)
    ids = lambda **k: sorted(r.edition_id for r in scope.in_scope(c.editions, c.members, **k).collect())
    assert ids() == [1, 3, 4, 5] and ids(work="comp") == [2, 4] and ids(work="tw") == [3] and ids(work="tw", wanted="1750") == [2]
    assert ids(author="nobody") == [] and ids(wanted="all") == [1, 2, 3, 4, 5]


def test_scope_follows_chains(spark):
    e = spark.createDataFrame([(i, f"w{i}", True, ["x"], "1") for i in range(1, 5)], "edition_id long, work string, canonical boolean, authors array<string>, edition string")
    m = spark.createDataFrame([(1, 2), (2, 3)], "edition_id long, member_id long")
    assert sorted(r.edition_id for r in scope.in_scope(e, m, work="w1").collect()) == [1, 2, 3]


def test_closure_of_a_long_chain(spark):
    m = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 39)], "edition_id long, member_id long")
    got = {(r.edition_id, r.member_id) for r in scope.closure(m).collect()}
    assert got == {(i, j) for i in range(41) for j in range(i + 1, 41)} | {(39, 39), (40, 39), (40, 40)}


def test_closure(spark):
    m = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 2)], "edition_id long, member_id long")
    assert sorted(map(tuple, scope.closure(m).collect())) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_parse():
    fused = {"a priori", "a priori rule"}
    f = lambda q: [w.surface for w in parse_query(q, fused)]
    assert f("reason A priori") == ["reason", "a priori"] and f("a, priori") == ["a", "priori"] and f("a priori rule I i") == ["a priori rule", "I", "i"]
    assert f("a priori") == ["a priori"] and f(" — ") == []
    assert parse_query("The") == [QueryWord("the", True)]


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, best[j + 1] = best[j + 1], last + 1 if x == y else max(best[j + 1], best[j])
    return best[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_shortest_script(a, b):
    s = compare.shortest_script(a, b)
    assert "".join(a[x:y] for o, x, y in s if o != "insert") == a
    assert "".join((a if o == "equal" else b)[x:y] for o, x, y in s if o != "delete") == b
    assert sum(y - x for o, x, y in s if o == "equal") == lcs(a, b)


def test_long_scripts_are_whole():
    assert compare.shortest_script(list(range(1600)), list(range(2000, 3600))) == [("delete", 0, 1600), ("insert", 0, 1600)]


def test_align_and_diff(spark):
    c = build(spark)
    got = [(r.path_key, r.in_a, r.in_b) for r in compare.align_sections(c, spark.createDataFrame([(2, 3)], "a long, b long")).orderBy("ordinal").collect()]
    assert [g[0] for g in got] == ["1", "3", "2"] and got[0] == ("1", True, True)
    d = compare.diff_ops(compare.block_status(c, spark.createDataFrame([(2, 3)], "a long, b long"))).collect()
    by = {r.block: r for r in d}
    assert (by["title"].status, by["1"].status, by["2"].status, by["3"].status) == ("equal", "changed", "equal", "deleted")
    ops = {(o.op, o.text) for o in by["1"].ops}
    assert {("insert", "betwixt"), ("delete", "between"), ("insert", "encrease"), ("delete", "increase")} <= ops


def test_orphan_sections_align():
    assert compare.align_trees([("1/1", "x")], [("1", "y"), ("1/1", "z")]) == [("1", "y", False, True), ("1/1", "z", True, True)]


def test_navigation(spark):
    c = build(spark)
    nav = {r.path_key: (r.previous, r.next) for r in reading.navigation(c).filter("edition_id = 3").collect()}
    assert nav == {"1": (None, "2"), "2": ("1", None)}
    assert [r.other for r in reading.matching_editions(c).filter("edition_id = 3").collect()] == ["1750"]
    assert reading.choose_edition(c, "TEST", "tw").first().edition_id == 3
    assert reading.text_of(c, c.editions.filter("edition_id = 1"), "original").filter("unit_id = 4").first().text.startswith("The editor corrcted")
    assert reading.ancestors(c).filter("path_key = '1/2'").first().ancestor == "1"


def test_params():
    assert params.whole("n", "7", most=5) == 5 and params.whole("n", "") is None and params.flag("f", "true") and params.choice("c", "a", ["a"]) == "a"
    for f in (lambda: params.whole("n", "x"), lambda: params.whole("n", 0), lambda: params.whole("n", True), lambda: params.flag("f", "yes"), lambda: params.choice("c", "b", ["a"]), lambda: params.known_only({"z": 1}, ["a"])):
        with pytest.raises(ValueError):
            f()


def test_artefacts(spark, tmp_path):
    c = build(spark)
    to = str(tmp_path / "kept")
    artefacts.write(c, to, "one")
    assert artefacts.is_fresh(spark, to, "one") and not artefacts.is_fresh(spark, to, "two")
    again = artefacts.reopen(spark, to)
    assert again.tokens.count() == c.tokens.count() and again.vocabulary_readings.count() == c.vocabulary_readings.count()
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file").write_text("x")
    with pytest.raises(FileExistsError):
        artefacts.write(c, str(tmp_path / "other"), "one")
    with pytest.raises(FileNotFoundError):
        artefacts.reopen(spark, str(tmp_path / "none"))


def test_stream(spark, tmp_path):
    from quirewise.streaming.ingest import append_tokens, read_documents

    docs = spark.createDataFrame([(1, "One word more."), (2, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    append_tokens(read_documents(spark, str(tmp_path / "in"), docs.schema), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == model.from_documents(docs).count() == 3
