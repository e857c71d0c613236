"""Each operator against a plain version of itself, and the cases that its docstring defines."""

import itertools
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirewise.llm import cooccurrence, distinctive, encoding, mixing, neighbours, spans, subjects, vocabulary

DATA = "/root/testdata/sf0.001"


# 1


def plain_ngrams(rows, sigma):
    seqs = defaultdict(list)
    for r, p, t, k in rows:
        if r is not None and t is not None:
            seqs[r, k or ""].append((p, t))
    times, where = Counter(), defaultdict(set)
    for (r, k), seq in seqs.items():
        seq = [t for _, t in sorted(seq)]
        for i in range(len(seq)):
            for n in range(1, min(sigma, len(seq) - i) + 1):
                g = (k, tuple(seq[i : i + n]))
                times[g] += 1
                where[g].add(r)
    return {g: (times[g], len(where[g])) for g in times}


@pytest.mark.parametrize("sigma", [1, 2, 3])
def test_ngrams(spark, sigma):
    rng = random.Random(sigma)
    rows = [(rng.randint(1, 12), i, rng.choice("aaaabcd"), rng.choice(["x", "y"])) for i in range(400)]
    rows += [(None, 1, "a", "x"), (3, 9999, None, "x"), (5, 10_000, "é", None)]
    df = spark.createDataFrame([(*r, "other") for r in rows], "doc long, p long, word string, kind string, n string").withColumnRenamed("n", "records")
    got = vocabulary.ngram_counts(df, "doc", ["p"], "word", "kind", sigma).collect()
    assert {(r.kind, tuple(r.ngram)): (r.occurrences, r.records) for r in got} == plain_ngrams(rows, sigma)
    assert len(got) == len(plain_ngrams(rows, sigma))


def test_stack_keeps_what_is_open():
    rows = [("x", "b", "b", 2, 1, 1), ("x", "b", "a", 1, 1, 1), ("x", "b", None, 3, 2, 0), ("x", "a", None, 1, 1, 0), ("y", "a", "c", 4, 2, 2)]
    cols = list(zip(*rows))
    names = ["kind", "term_1", "term_2", "n", "first_1", "first_2"]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)
    want = {("x", "b", "b"): (2, 1), ("x", "b", "a"): (1, 1), ("x", "b", None): (6, 4), ("x", "a", None): (1, 1), ("y", "a", "c"): (4, 2), ("y", "a", None): (4, 2)}
    for cuts in ([5], [1, 1, 1, 1, 1], [2, 3], [4, 1]):
        at, parts = 0, []
        for n in cuts:
            parts.append(whole.slice(at, n))
            at += n
        out = [r for b in vocabulary._stack(2)(iter(parts)) for r in b.to_pylist()]
        assert {(r["kind"], r["term_1"], r["term_2"]): (r["occurrences"], r["records"]) for r in out} == want and len(out) == len(want)


def test_vocabulary_comes_from_the_stack(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1, "a", "k"), (1, 2, "b", "k"), (2, 1, "a", "k")], "doc long, p long, word string, kind string")
    monkeypatch.setattr(vocabulary, "_stack", lambda sigma: lambda batches: iter(()))
    assert vocabulary.ngram_counts(df, "doc", ["p"], "word", "kind", 2).count() == 0


def test_ngrams_empty_and_marks(spark):
    empty = spark.createDataFrame([], "doc long, p long, word string, kind string")
    assert vocabulary.ngram_counts(empty, "doc", ["p"], "word", "kind", 2).count() == 0
    c = spark.createDataFrame([(1,), (2,), (3,), (21,)], "records long")
    assert [r.mark for r in vocabulary.marked(c, F.lit(100)).orderBy("records").collect()] == ["rare", "rare", None, "common"]


# 2


def test_parsimonious():
    c, q = np.array([5.0, 1, 1, 7]), np.array([0.5, 0.01, 0.3, 0.0])
    p = distinctive.parsimonious(c, q, np.array([0, 3]))
    e = c[:3] / c[:3].sum()
    for _ in range(60):
        x = c[:3] * 0.1 * e / (0.1 * e + 0.9 * q[:3])
        e = x / x.sum()
    assert p[:3] == pytest.approx(e, abs=1e-4) and p[3] == 1
    assert p[1] > p[2]


def test_parsimonious_converges():
    rng = np.random.default_rng(2)
    c, q = rng.integers(1, 4, 120).astype(float), rng.dirichlet(np.ones(120)) * 0.3
    starts = np.array([0, 50])
    step = lambda p: np.concatenate([e / e.sum() for e in np.split(c * 0.1 * p / (0.1 * p + 0.9 * q), starts[1:])])
    p = np.concatenate([x / x.sum() for x in np.split(c, starts[1:])])
    for _ in range(60):
        p = step(p)
    assert np.abs(step(p) - p).max() > 1e-6  # 60 steps aren't enough
    p = distinctive.parsimonious(c, q, starts)
    assert np.abs(step(p) - p).max() <= 1e-6


def test_distinctive(spark):
    wide = "w" * 80
    rows = [(1, "a", 3), (1, "b", 1), (2, "a", 1), (2, "c", 2), (3, "a", 1), (None, "a", 1), (4, None, 1), (5, "z", 0)] + [(r, wide, 1) for r in (1, 2, 3)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "record long, term string, c long, q double")
    df_of = {"a": 3, "b": 1, "c": 1, wide: 3}
    raw = {(r, t): (1 + math.log(c)) * (math.log(4 / (df_of[t] + 1)) + 1) for r, t, c in rows if r and t and c}
    want = {k: w / math.sqrt(sum(v * v for (r, _), v in raw.items() if r == k[0])) for k, w in raw.items()}
    for most in (100, 1):  # 1: all but the commonest term take the exchange
        got = distinctive.distinctive(df, broadcast_rows=most).collect()
        assert {(r.record, r.term): r.weight for r in got} == pytest.approx(want)
        assert {r.record: r.tokens for r in got} == {1: 5, 2: 4, 3: 2}
    for r in {1, 2, 3}:
        mine = sorted((x for x in got if x.record == r), key=lambda x: x.rank)
        assert [x.rank for x in mine] == list(range(1, len(mine) + 1)) and [(-x.p, x.term) for x in mine] == sorted((-x.p, x.term) for x in mine)
        assert [x.rest for x in mine] == pytest.approx([sum(y.weight**2 for y in mine[i:]) for i in range(len(mine))])
    assert distinctive.distinctive(df.limit(0)).count() == 0


def test_candidates_lose_none(spark):
    rng = random.Random(8)
    rows = [(d, f"t{int(60 * rng.random() ** 3)}", rng.choice([1, 1, 2, 9])) for d in range(60) for _ in range(25)]
    rows = list({(d, t): c for d, t, c in rows}.items())
    df = spark.createDataFrame([(d, t, c) for (d, t), c in rows], "record long, term string, c long")
    got = distinctive.distinctive(df).cache()
    for least in (0.2, 0.3, 0.5):
        kept = distinctive.candidates(got, least)
        heavy = lambda x: sorted(map(tuple, x.filter(F.col("weight") >= least).select("record", "term").collect()))
        assert heavy(kept) == heavy(got) != [] and kept.count() < got.count()


def test_candidates_rest_on_the_model(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (2, "a", 9)], "record long, term string, c long")
    by = {r.term: r for r in distinctive.distinctive(df).filter("record = 1").collect()}
    assert by["b"].rank == 1 and by["b"].p > 0.9 > by["a"].p  # what the collection is full of explains nothing


# 3


def exact_nearest(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    return {i: [j for _, j in sorted((-s[a, b], ids[b]) for b in range(len(ids)) if a != b)[:k]] for a, i in enumerate(ids)}


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.dirichlet(np.full(8, 0.3), 600)
    x[100:140] = x[7]  # a group of equal vectors, larger than k
    x[200] *= 3
    ids = rng.permutation(5000)[:600].tolist()
    rows = [(int(i), [float(v) for v in r], "x") for i, r in zip(ids, x)] + [(9001, [0.0] * 8, "x"), (9002, None, "x"), (None, [1.0] * 8, "x")]
    df = spark.createDataFrame(rows, "id long, vec array<double>, unit string")
    want = exact_nearest(ids, x, 5)
    got = {r.id: [n.id for n in r.near] for r in neighbours.nearest(df, reach=300, block=64, slice_rows=100).collect()}
    assert set(got) == set(ids) and all(len(v) == 5 for v in got.values())
    hit = sum(len(set(got[i]) & set(want[i])) for i in ids) / (5 * len(ids))
    assert hit >= 0.9
    assert got[ids[110]] == want[ids[110]]  # ties to the smaller id
    whole = {r.id: [n.id for n in r.near] for r in neighbours.nearest(df, reach=10_000).collect()}
    assert whole == want


def test_shards_are_even():
    rng = np.random.default_rng(4)
    c1, c2 = rng.random((16, 3)), rng.random((16, 3))
    pop = rng.integers(0, 200, (16, 16)).astype(np.int32)
    for block in (10**6, 3000, 400):
        shard, salts = neighbours.shards_of(pop, c1, c2, block)
        per = np.bincount(shard.ravel(), weights=pop.ravel(), minlength=len(salts))
        assert (per <= salts * block).all() and -(-pop.sum() // block) <= len(salts) <= 2 * -(-pop.sum() // block)
    assert len(np.unique(shard[0])) > 1  # more shards than first centroids: the second ones tell too


def test_nearest_of_few(spark):
    one = spark.createDataFrame([(1, [1.0, None, float("nan")])], "id long, vec array<double>")
    assert [list(r.near) for r in neighbours.nearest(one).collect()] == [[]]
    assert neighbours.nearest(one.limit(0)).count() == 0


def test_traverse_is_in_order():
    rng = np.random.default_rng(1)
    d1, d2 = rng.random(7), rng.random(9)
    out = neighbours.traverse(d1, d2, np.ones((7, 9), int), 10**6)
    sums = [d1[i] + d2[j] for i, j in out]
    assert len(set(out)) == 63 and sums == sorted(sums)


# 4


def test_together(spark):
    rng = random.Random(5)
    baskets = {b: {f"i{rng.randint(0, 40)}" for _ in range(rng.randint(1, 9))} for b in range(300)}
    for b in range(300, 320):
        baskets[b] = {"p", "q", "i1"}
    rows = [(b, i) for b, s in baskets.items() for i in s]
    df = spark.createDataFrame([(*r, 0) for r in rows * 2] + [(None, "a", 0), (1, None, 0)], "basket long, item string, n int")
    freq, both = Counter(i for _, i in rows), Counter(p for s in baskets.values() for p in itertools.combinations(sorted(s), 2))
    want = {p: (n, freq[p[0]], freq[p[1]]) for p, n in both.items() if n >= 3 and n * 320 >= 1.5 * freq[p[0]] * freq[p[1]]}
    for block in (512, 2):
        got = cooccurrence.together(df, least=3, lift=1.5, block=block).collect()
        assert {(r.item_a, r.item_b): (r.n, r.a, r.b) for r in got} == want and len(got) == len(want)
    by = {(r.item_a, r.item_b): r for r in got}
    assert by["p", "q"].significant and by["p", "q"].expected < 5 and by["p", "q"].log10_p < -8
    assert cooccurrence.together(df.limit(0)).count() == 0


def test_together_ranks_every_pair(spark):
    rng = random.Random(6)
    rows = [(b, f"i{int(40 * rng.random() ** 2)}") for b in range(200) for _ in range(6)] + [(b, i) for b in range(190) for i in ("hot", "warm")] + [(b, i) for b in range(300, 306) for i in ("p", "q")] + [(400, "r"), (400, "s")]
    df = spark.createDataFrame(rows, "basket long, item string")
    baskets = defaultdict(set)
    for b, i in rows:
        baskets[b].add(i)
    freq, both = Counter(i for s in baskets.values() for i in s), Counter(p for s in baskets.values() for p in itertools.combinations(sorted(s), 2))
    got = {(r.item_a, r.item_b): r for r in cooccurrence.together(df).collect()}
    assert {p: (r.n, r.a, r.b, r.baskets) for p, r in got.items()} == {p: (n, freq[p[0]], freq[p[1]], len(baskets)) for p, n in both.items()}
    assert ("hot", "warm") in got and ("r", "s") in got and min(r.n for r in got.values()) == 1
    ps, tests = sorted(10**r.log10_p for r in got.values()), len(freq) * (len(freq) - 1) / 2
    limit = max((p for k, p in enumerate(ps, 1) if p * tests <= 0.01 * k), default=0)
    assert {p for p, r in got.items() if r.significant} == {p for p, r in got.items() if 10**r.log10_p <= limit} != set()
    some = {(r.item_a, r.item_b): r for r in cooccurrence.together(df, least=6, lift=20).collect()}
    assert some and some == {p: r for p, r in got.items() if r.n >= 6 and r.n * r.baskets >= 20 * r.a * r.b}


def test_tail_of_one():
    p, m = np.array([[0.001, 0.02, 0.0]]), np.array([30.0, 5, 9])
    want = 1 - 0.999**30 * 0.98**5
    assert cooccurrence.tail_log10(np.array([1]), p, m)[0] == pytest.approx(math.log10(want), abs=1e-9)


def test_tail():
    rng = np.random.default_rng(0)
    for _ in range(5):
        p, m = rng.random((1, 12)) ** 3 * 0.3, rng.integers(1, 20, 12).astype(float)
        pmf = np.array([1.0])
        for q, k in zip(p[0], m):
            for _ in range(int(k)):
                pmf = np.convolve(pmf, [1 - q, q])
        for n in (int((p * m).sum()) + 2, int((p * m).sum()) + 9):
            assert cooccurrence.tail_log10(np.array([n]), p, m)[0] == pytest.approx(math.log10(pmf[n:].sum()), abs=0.02)


def test_null_keeps_degrees():
    d, m, f, n = np.array([1.0, 3, 6]), np.array([50.0, 20, 5]), np.array([2.0, 20, 35]), np.array([17.0, 3, 1.0])
    f[2] = (d * m).sum() - 2 * 17 - 60
    x, y = cooccurrence.fit_null(d, m, f, n)
    p = x[:, None] * y / (1 + x[:, None] * y)
    assert (p * n).sum(1) == pytest.approx(d, rel=1e-4) and (p * m[:, None]).sum(0) == pytest.approx(f, rel=1e-4)


# 5


def plain_spans(texts, least):
    own = defaultdict(set)
    for i, t in texts.items():
        for p in range(len(t) - least + 1):
            own[t[p : p + least]].add(i)
    pairs = {p for s in own.values() for p in itertools.combinations(sorted(s), 2)}
    cover = set()
    for i, t in texts.items():
        on = [False] * len(t)
        for p in range(len(t) - least + 1):
            if len(own[t[p : p + least]]) > 1:
                on[p : p + least] = [True] * least
        for k, g in itertools.groupby(enumerate(on), key=lambda e: e[1]):
            if k:
                g = list(g)
                cover.add((i, g[0][0], g[-1][0] + 1))
    return pairs, cover


@pytest.mark.parametrize("seed", range(3))
def test_spans(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé🙂", k=rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    texts = {i: text(rng.randint(0, 120)) for i in range(40)}
    for _ in range(60):
        a, b = rng.sample(range(40), 2)
        at, n = rng.randint(0, max(0, len(texts[a]) - 1)), rng.choice([118, 119, 120, 121, 150, 300])
        cut = rng.randint(0, len(texts[b]))
        texts[b] = texts[b][:cut] + texts[a][at : at + n] + texts[b][cut:]
    texts |= {100: "ab" * 400, 101: "x" + "ab" * 90, 102: "a" * 500, 103: "b" + "a" * 119, 104: "c" + "a" * 130, 105: "", 106: texts[3], 107: "y" * 119}
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()] + [(None, "z", 0), (200, None, 0)], "id long, text string, start int")
    pairs, cover = plain_spans(texts, 120)
    # Whole texts; texts cut into pieces, with every label frequent and pairs in small blocks.
    for how, side in (({}, 512), ({"piece": 150, "hot": 0.0}, 2)):
        got = spans.SharedSpans(df, **how)
        assert sorted(map(tuple, got.pairs(side).collect())) == sorted(pairs)
        assert {(r.id, r.start, r.end) for r in got.spans().collect()} == cover
    c = {r.id: r for r in got.coverage().collect()}
    assert c[105].share == 0 and len(c) == len(texts) and c[102].share == 1


def test_pieces_have_the_edges_of_the_whole():
    rng = random.Random(9)
    text = "".join(rng.choices("abcde é", k=3000)) + "ab" * 300
    start, end, label = spans.edges(text, 120)
    around, size = spans.margin(120, spans.K, spans.W), 400
    rows = [(7, max(0, lo - around), lo, min(lo + size, len(text)), text[max(0, lo - around) : min(lo + size, len(text)) + around]) for lo in range(0, len(text), size)]
    b = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["id", "at", "lo", "hi", "part"])
    out = [r for x in spans._edges(120, spans.K, spans.W)(iter([b])) for r in x.to_pylist()]
    assert [(r["start"], r["end"], r["label"]) for r in out] == list(zip(start.tolist(), end.tolist(), label.tolist()))
    assert [r["before"] for r in out] == [None, *start[:-1].tolist()] and [r["prev"] for r in out] == [None, *label[:-1].tolist()] and [r["next"] for r in out] == [*label[1:].tolist(), None]


def test_sets_of_texts(spark):
    licence = "".join(random.Random(1).choices("abcdefgh ", k=300))
    df = spark.createDataFrame([(i, f"{i} " * 30 + licence) for i in range(40)] + [(90, "x" * 50)], "id long, text string")
    s = spark.createDataFrame(spans.SharedSpans(df).sets().collect())
    # One set of all that hold the licence; one for each digit that stands before it.
    assert s.count() == 80 and s.filter("n = 40").groupBy("h1", "h2").count().collect()[0][2] == 40 and s.filter("n = 4").select("h1").distinct().count() == 10


def test_unlike_windows_of_one_digest(spark, monkeypatch):
    a, b = ("".join(random.Random(s).choices("abcdefgh ", k=200)) for s in (1, 2))
    rows = [(1, a), (2, a), (3, b), (4, b), (5, a + b)]
    monkeypatch.setattr(spans, "digest_of", lambda chars: b"\0" * 16)
    got = spans.SharedSpans(spark.createDataFrame(rows, "id long, text string")).pairs()
    assert sorted(map(tuple, got.collect())) == [(1, 2), (1, 5), (2, 5), (3, 4), (3, 5), (4, 5)]


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert spans.SharedSpans(df).pairs().count() == 0
    with pytest.raises(ValueError):
        spans.SharedSpans(df, least=20)


# 6

TEXTS = [None, "", " ", "<|endoftext|> a", "I'll 've 'S it's", "a" * 3000, " " * 500 + "x", "12ⅷ½ ४५ x²", "\r\n\r\n  \t x\n", "λόγος ἀρχή אבג 🙂🙂", "a b  c ", "é é"]


def tokenizer():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("hot", [400_000, 3])
def test_encode(spark, hot):
    want, texts = tokenizer(), TEXTS * 2
    df = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "doc_id long, text string, word string")
    got = encoding.encode(df, hot_words=hot)
    assert {r.doc_id: list(r.ids) for r in got.collect()} == {i: want(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in encoding.decode(got).collect()} == {i: t or "" for i, t in enumerate(texts)}
    n = encoding.token_counts(df, hot_words=hot)
    assert {r.doc_id: r.n_tokens for r in n.collect()} == {i: len(want(t)) for i, t in enumerate(texts)}


def test_encode_nothing(spark):
    assert encoding.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_encode_any_text(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    want = tokenizer()
    got = encoding.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: want(t) for i, t in enumerate(texts)}


# 7


def test_budget_is_best():
    rng = random.Random(1)
    for _ in range(200):
        sizes = np.array(rng.sample(range(1, 40), rng.randint(1, 5)))
        have = np.array([rng.randint(1, 4) for _ in sizes])
        budget = rng.randint(0, int((sizes * have).sum()) + 5)
        took = mixing.fit_budget(sizes, have, budget)
        best = max(v for c in itertools.product(*[range(n + 1) for n in have]) if (v := int((np.array(c) * sizes).sum())) <= budget)
        assert (took >= 0).all() and (took <= have).all() and int((took * sizes).sum()) == best


def test_budget_of_few_long_documents():
    sizes, have = np.array([9000, 9700, 17001]), np.array([40, 40, 40])
    best = max(s for a in range(41) for b in range(41) for c in range(41) if (s := 9000 * a + 9700 * b + 17001 * c) <= 700_001)
    took = mixing.fit_budget(sizes, have, 700_001)
    assert (took <= have).all() and int((took * sizes).sum()) == best
    even = mixing.fit_budget(np.array([300, 200]), np.array([5, 5]), 1550)  # nothing but hundreds
    assert int((even * np.array([300, 200])).sum()) == 1500
    narrow = mixing.fit_budget(sizes, have, 700_001, window=40_000)
    assert (narrow <= have).all() and 700_001 - 9000 < (narrow * sizes).sum() <= 700_001


def test_large_budget():
    sizes = np.arange(1, 3000)
    have = np.random.default_rng(0).integers(1, 9, len(sizes))
    for budget in (10**6, 7_654_321):
        took = mixing.fit_budget(sizes, have, budget)
        assert (took <= have).all() and (took * sizes).sum() == budget


def test_mixture(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["big", "big", "big", "mid", "low", None, "unlisted"]), rng.randint(0, 30)) for i in range(3000)]
    docs = [(i, s, n if s != "low" else n % 3) for i, s, n in docs]
    targets = spark.createDataFrame([("big ", 0.5, 1), ("MID", 0.4, 3), ("low", 0.08, 2), ("gone", 0.02, 5), ("gone", 0.02, 5)], "source string, target_share double, max_repeats int")
    lengths = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    plan = mixing.plan_mixture(lengths, targets).cache()
    size = Counter()
    for _, s, n in docs:
        size[s] += n
    total = size["big"] + size["mid"] + size["low"]
    shares = {r.source: r for r in mixing.mixture_shares(plan).collect()}
    for s, share, most in [("big", 0.5, 1), ("mid", 0.4, 3), ("low", 0.08, 2), ("gone", 0.02, 5)]:
        assert shares[s].short == (share * total > most * size[s])
        assert shares[s].used == min(most * size[s], int(share * total)) == shares[s].budget and shares[s].gap == 0
    picks = mixing.pick_documents(lengths, plan, slices=4).collect()
    used, cap = Counter(), {"big": 1, "mid": 3, "low": 2}
    for r in picks:
        used[r.source] += r.copies * r.n_tokens
        assert 1 <= r.copies <= cap[r.source]
    assert len({r.doc_id for r in picks}) == len(picks) and dict(used) == {s: shares[s].used for s in cap}
    assert mixing.plan_mixture(lengths.limit(0), targets).filter("passes + extra > 0").count() == 0


# 8


def test_subjects(spark):
    rng = random.Random(4)
    own = {"law": ["court", "plaintiﬀ", "statute", "heir"], "sea": ["ſhip", "mast", "anchor", "tide"], "food": ["broth", "pie", "dish", "oven"]}
    plain = ["the", "of", "and", "some", "every"]
    sentence = lambda s: " ".join(rng.choices(plain, k=4) + rng.choices(own[s], k=2)).capitalize() + "."
    truth, docs = {}, []
    for i in range(400):
        s = rng.sample(sorted(own), rng.choice([1, 1, 2]))
        truth[i] = set(s)
        docs.append((i, " ".join(sentence(x) for x in s for _ in range(6)), 0.5))
    names = ["Quorl Zemp, 12; Vrin Tok, 13", "Ulb Xan\nOrro Pim", "", "  ", None]
    docs += [(1000 + i, t, 0.5) for i, t in enumerate(names)]
    marks = [(i, rng.choice([str.upper, str.title, lambda x: f" {x} "])(s), "r") for i in range(60) for s in truth[i]]
    marks += [(1000, None, "r"), (1001, None, "r"), (5, "nonsense", "r"), (None, "law", "r")] + marks[:5]
    p = subjects.subject_posteriors(spark.createDataFrame(docs, "doc_id long, text string, share double"), spark.createDataFrame(marks, "doc_id long, subject string, words string"), sorted(own))
    got = {r.doc_id: {s for s, x in zip(sorted(own), r.posterior) if x >= 0.5} for r in p.collect()}
    assert set(got) == {i for i, t, _ in docs if t is not None}
    held = [i for i in range(60, 400)]
    assert sum(got[i] == truth[i] for i in held) >= 0.97 * len(held)
    assert not any(got[1000 + i] for i in range(4))


def test_labels_stay_and_all_mass_counts():
    bins = pa.array([[1, 2, -1, 3], [4, -1, 5, 5], [1, 6]], pa.list_(pa.int32()))
    s = subjects.Sentences(bins)
    known, labels = np.array([10, 30]), np.array([[0.0, 1, 0], [0, 0, 0]])
    w = np.random.default_rng(0).normal(size=(8, 3)).astype(np.float32)
    r = s.taught(np.array([10, 20, 30]), w, known, labels)
    assert (r[s.row == 0] == [0, 1, 0]).all() and (r[s.row == 2] == 0).all()
    assert r[s.row == 1] == pytest.approx(s.posteriors(w)[s.row == 1]) and r[s.row == 1].sum(1) == pytest.approx(1)
    first = s.taught(np.array([10, 20, 30]), None, known, labels)
    assert (first[s.row == 0] == [0, 1, 0]).all() and not first[s.row > 0].any()


def test_shares_leave_a_document_out():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 12, 9).tolist() + [-1] + rng.integers(0, 12, 5).tolist() for _ in range(6)]
    s = subjects.Sentences(pa.array(docs, pa.list_(pa.int32())))
    r = rng.dirichlet(np.ones(3), len(s.starts))
    of = lambda rows: np.stack([np.bincount(s.bins[rows[s.of]], weights=c[s.of][rows[s.of]], minlength=16) for c in r.T], 1)
    every = np.ones(len(s.starts), bool)
    got = subjects.without_own(s, r, of(every), of(every).sum(0))
    for d in range(6):
        want = s.posteriors(subjects.complement_weights(of(s.row != d)))
        assert got[s.row == d] == pytest.approx(want[s.row == d], rel=1e-3)


def test_subjects_without_labels(spark):
    d = spark.createDataFrame([(1, "A text. Another."), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    assert all(x < 0.5 for r in subjects.subject_posteriors(d, none, ["a", "b"]).collect() for x in r.posterior)
    assert subjects.subject_posteriors(d.limit(0), none, ["a", "b"]).count() == 0


there = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def run(spark, name, data=DATA):
    from quirewise.llm.queries import QUERIES

    return QUERIES[name](spark, data).toPandas()


@there
def test_oracles_belong_to_queries():
    from quirewise.llm.queries import ORACLE, QUERIES

    assert set(ORACLE) <= set(QUERIES)


@there
def test_p2_tables(spark):
    d, found = run(spark, "p2_distinctive"), run(spark, "p2_found")
    heavy = d[(d.tokens >= 60) & (d.weight >= 0.3)]
    assert len(found) and set(zip(found.doc_id, found.surface)) == set(zip(heavy.doc_id, heavy.surface)) and (d.groupby("doc_id").p.sum().round(6) == 1).all()


@there
def test_p3_tables(spark):
    v = neighbours.unit_vectors(neighbours.section_vectors(spark, DATA)).toPandas()
    want = exact_nearest(v["id"].tolist(), np.array(v.unit.tolist()), 5)
    got = run(spark, "p3_nearest").sort_values(["doc_id", "rank"])
    assert len(want) and got.groupby("doc_id").near.apply(list).to_dict() == want


@there
def test_p4_tables(spark):
    t, c, found = run(spark, "p4_together"), run(spark, "p4_counts"), run(spark, "p4_found")
    cols = ["surface_a", "surface_b", "n", "a", "b"]
    assert len(t) and sorted(map(tuple, t[cols].values)) == sorted(map(tuple, c[cols].values)) and (t.surface_a < t.surface_b).all()
    kept = t[(t.n >= 6) & (t.n * t.baskets >= 20 * t.a * t.b)]
    assert set(zip(kept.surface_a, kept.surface_b)) == set(zip(found.surface_a, found.surface_b))


@there
def test_p5_tables(spark):
    texts = {r.id: r.text for r in spans.edition_texts(spark, DATA).collect()}
    pairs, cover = plain_spans(texts, 120)
    sets, found = run(spark, "p5_sets"), run(spark, "p5_found")
    assert pairs and set(zip(found.edition_a, found.edition_b)) == pairs
    assert {p for _, m in sets.groupby("passage").edition_id for p in itertools.combinations(sorted(m), 2)} == pairs and (sets.groupby("passage").edition_id.size() == sets.groupby("passage").editions.max()).all()
    assert set(run(spark, "p5_spans").itertuples(index=False, name=None)) == cover


@there
def test_p6_tables(spark):
    want, texts = tokenizer(), spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    got = run(spark, "p6_ids").set_index("doc_id").ids
    assert len(got) == len(texts) and all(list(got[i]) == want(t) for i, t in zip(texts.doc_id, texts.text))


@there
def test_p7_tables(spark):
    shares, picks, found = run(spark, "p7_shares").set_index("source"), run(spark, "p7_picks"), run(spark, "p7_found")
    want, texts = tokenizer(), spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    texts = texts[texts.source.notna()]
    size = texts.text.map(lambda t: len(want(t))).groupby(texts.source.str.strip().str.lower()).sum()
    assert len(shares) == 20 and (shares["size"] == [size.get(s, 0) for s in shares.index]).all() and (shares.total == shares["size"].sum()).all()
    assert set(found.source) == set(shares.index[shares.target_share * shares.total > shares.max_repeats * shares["size"]]) != set()
    used = (picks.copies * picks.n_tokens).groupby(picks.source).sum()
    assert (shares.used == [used.get(s, 0) for s in shares.index]).all() and not picks.doc_id.duplicated().any() and (picks.copies <= shares.max_repeats[picks.source].values).all()
    assert (shares.gap >= 0).all() and (shares.gap == shares.budget - shares.used).all() and shares.real_share.sum() == pytest.approx(1)


@there
def test_p8_tables(spark):
    # The smallest tables have a label for a dozen documents, too few to tell anything by.
    s, found, c = (run(spark, name, "/root/testdata/sf0.01") for name in ("p8_subjects", "p8_found", "p8_composition"))
    assert len(s) and set(zip(s.doc_id, s.subject)) == set(zip(found.doc_id, found.subject)) and (s.posterior >= 0.5).all()
    assert c.set_index("subject").documents.to_dict() == s.groupby("subject").size().to_dict()
