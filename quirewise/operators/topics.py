"""Topics by non-negative matrix factorisation, and what is read off them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirewise.functions.text import half_up
from quirewise.operators import vectors
from quirewise.session import partitions, stage, unstage
from quirewise.sources.model import Corpus

TOPICS, PASSES, COMMON, TINY = 24, 100, 0.5, 1e-10
#: Non-zero weights up to which the factorisation runs in the driver; beyond, it runs over the documents' partitions.
DRIVER_WEIGHTS = 5_000_000


class Mulberry:
    """The 32-bit generator whose sequence the published weights rest on. Its seed and constants. It can
    start after `skipped` numbers."""

    def __init__(self, seed: int = 0x9E3779B9, skipped: int = 0):
        self.state = (seed + 0x6D2B79F5 * skipped) & 0xFFFFFFFF

    def take(self, n: int) -> np.ndarray:
        word = 0xFFFFFFFF
        a = (np.uint64(self.state) + np.uint64(0x6D2B79F5) * np.arange(1, n + 1, dtype=np.uint64)) & np.uint64(word)
        self.state = int(a[-1]) if n else self.state
        mul = lambda x, y: (x * y) & np.uint64(word)
        t = mul(a ^ (a >> np.uint64(15)), a | np.uint64(1))
        t = t ^ ((t + mul(t ^ (t >> np.uint64(7)), t | np.uint64(61))) & np.uint64(word))
        return (t ^ (t >> np.uint64(14))).astype(float) / 2**32


def columns(weights: DataFrame, sections: DataFrame, topics: int = TOPICS, common: float = COMMON) -> DataFrame:
    """lemma of the columns that topics are made of: those in at most the share `common` of the sections, or all if fewer than
    min(topics, sections) would be left."""
    n = sections.agg(F.count(F.lit(1))).scalar()
    df = weights.groupBy("lemma").agg(F.count(F.lit(1)).alias("df")).withColumn("keep", F.col("df") <= F.lit(common) * n)
    enough = df.agg(F.sum(F.col("keep").cast("long"))).scalar() >= F.least(F.lit(topics), n)
    return df.filter(F.col("keep") | ~enough).select("lemma")


def factorise(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, m: int, k: int, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """W (n x k), H (k x m) of a sparse matrix by multiplicative updates, H before W, from the seeded start."""
    rng = Mulberry()
    w = rng.take(n * k).reshape(n, k) + TINY
    h = rng.take(k * m).reshape(k, m) + TINY
    order = np.lexsort((cols, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    for _ in range(passes):
        h *= by_column(rows, cols, values, w, m) / (w.T @ w @ h + TINY)
        w *= by_row(rows, cols, values, h, n) / (w @ (h @ h.T) + TINY)
    return w, h


def by_column(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, w: np.ndarray, m: int) -> np.ndarray:
    """W'V (k x m), a topic at a time, so that no more than one number a weight is held."""
    return np.stack([np.bincount(cols, weights=values * t[rows], minlength=m) for t in np.ascontiguousarray(w.T)])


def by_row(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """VH' (n x k)."""
    return np.stack([np.bincount(rows, weights=values * t[cols], minlength=n) for t in h], 1)


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row within the batch, column and value of each weight."""
    c = b.column("cols")
    return np.repeat(np.arange(b.num_rows), np.diff(c.offsets.to_numpy())), c.flatten().to_numpy(), b.column("vals").flatten().to_numpy()


STATE = "row long, cols array<int>, vals array<double>, w array<double>"


def _updated(k: int, h=None):
    """One pass over the rows of W under H; without H, their seeded start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hh = None if h is None else h.value @ h.value.T
        for b in batches:
            if not b.num_rows:
                continue
            row = b.column("row").to_numpy()
            if h is None:
                w = np.stack([Mulberry(skipped=int(r) * k).take(k) for r in row]) + TINY
            else:
                w = b.column("w").flatten().to_numpy().reshape(-1, k)
                w = w * by_row(*_flat(b), h.value, b.num_rows) / (w @ hh + TINY)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("cols"), b.column("vals"), _lists(w)], names=["row", "cols", "vals", "w"])

    return run


def _lists(a: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(pa.from_numpy_dtype(a.dtype)))


def _gathered(k: int, m: int):
    """A partition's share of W'V (the columns it holds) and, as columns m to m + k - 1, of W'W."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wv, ww, seen = np.zeros((k, m)), np.zeros((k, k)), np.zeros(m, bool)
        for b in batches:
            w = b.column("w").flatten().to_numpy().reshape(-1, k)
            rows, cols, values = _flat(b)
            wv += by_column(rows, cols, values, w, m)
            ww += w.T @ w
            seen[cols] = True
        at = np.flatnonzero(seen)
        col = np.concatenate([at, np.arange(m, m + k)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(col), _lists(np.concatenate([wv.T[at], ww]))], names=["col", "s"])

    return run


def factorise_apart(v: DataFrame, n: int, m: int, k: int, passes: int = PASSES) -> tuple[DataFrame, np.ndarray]:
    """factorise() over the partitions of v (row, cols, vals): the rows of W (row, w) stay with those of v, H is broadcast, W'V
    and W'W are aggregated. Sums depend on the order of partitions, so it equals factorise() but for rounding."""
    spark = v.sparkSession
    h = Mulberry(skipped=n * k).take(k * m).reshape(k, m) + TINY
    state = stage(v.select("row", "cols", "vals").mapInArrow(_updated(k), STATE), "topics")
    for _ in range(passes):
        parts = state.mapInArrow(_gathered(k, m), "col int, s array<double>")
        got = parts.groupBy("col").agg(F.array(*(F.sum(F.col("s")[t]) for t in range(k))).alias("s")).toArrow()  # m + k rows
        both = np.zeros((m + k, k))
        both[got["col"].to_numpy()] = got["s"].combine_chunks().flatten().to_numpy().reshape(-1, k)
        h *= both[:m].T / (both[m:] @ h + TINY)
        sent = spark.sparkContext.broadcast(h)
        last, state = state, stage(state.mapInArrow(_updated(k, sent), STATE), "topics")
        unstage(last)
        sent.destroy()
    return state.select("row", "w"), h


def scaled(w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Topics (rows of h) and mixes (rows of w) that sum to 1; the topics' mass goes to w first. Rows of zeros stay."""
    mass = h.sum(1)
    terms = np.divide(h, mass[:, None], out=np.zeros_like(h), where=mass[:, None] > 0)
    mix = w * mass
    total = mix.sum(1, keepdims=True)
    return terms, np.divide(mix, total, out=np.zeros_like(mix), where=total > 0)


@dataclass
class Model:
    """lemmas and terms (topics x lemmas, rows that sum to 1, nothing cut or rounded); mix: edition_id, path_key, mix
    ARRAY<FLOAT> of every section."""

    lemmas: list[str]
    terms: np.ndarray
    mix: DataFrame

    def all_terms(self, spark: SparkSession) -> DataFrame:
        """topic, lemma, weight of every lemma that a topic holds: what fold_in() takes."""
        t, j = np.nonzero(self.terms)
        return spark.createDataFrame(pa.table({"topic": pa.array(t.astype(np.int32)), "lemma": pa.array(self.lemmas, pa.string()).take(pa.array(j)), "weight": pa.array(self.terms[t, j])}))


def coded(corpus: Corpus, weights: DataFrame, topics: int = TOPICS) -> tuple[DataFrame, list[str]]:
    """row (from 0, by first unit), edition_id, path_key, cols, vals of every section, staged; the columns' lemmas. No more
    than the vocabulary and a number for each partition reaches the driver."""
    spark = corpus.spark
    sections = corpus.units.groupBy("edition_id", "path_key").agg(F.min("unit_id").alias("first"))
    # The columns' lemmas, as they are met walking the sorted printed surfaces and their readings: a row a lemma, as H has.
    met = corpus.vocabulary_readings.groupBy("lemma").agg(F.min(F.struct("surface", "reading_idx", "word_idx")).alias("met"))
    kept = columns(weights, sections, topics).join(met, "lemma", "left")
    lemmas = kept.orderBy(F.col("met").asc_nulls_last(), "lemma").select("lemma").toArrow()["lemma"].to_pylist()
    code = spark.createDataFrame(pa.table({"lemma": pa.array(lemmas, pa.string()), "col": pa.array(np.arange(len(lemmas), dtype=np.int32))}))
    placed = stage(sections.repartitionByRange(partitions(spark), "first").withColumn("part", F.spark_partition_id()), "sections")
    per = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for part, n in per:
        offsets.append((part, before))
        before += n
    within = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    placed = placed.join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part").select((F.col("before") + within).alias("row"), "edition_id", "path_key")
    x = weights.join(F.broadcast(code), "lemma").select(F.col("edition_id").alias("e"), F.col("path_key").alias("p"), F.struct("col", F.col("weight").cast("double").alias("v")).alias("x"))
    x = x.groupBy("e", "p").agg(F.sort_array(F.collect_list("x")).alias("x"))
    v = placed.join(x, F.col("edition_id").eqNullSafe(F.col("e")) & F.col("path_key").eqNullSafe(F.col("p")), "left")
    list_of = lambda c, kind: F.coalesce(F.col(f"x.{c}"), F.array().cast(f"array<{kind}>"))
    return stage(v.select("row", "edition_id", "path_key", list_of("col", "int").alias("cols"), list_of("v", "double").alias("vals")), "coded"), lemmas


def model(corpus: Corpus, weights: DataFrame, topics: int = TOPICS, passes: int = PASSES) -> Model | None:
    """The whole factorisation, None of a corpus without text: in the driver up to DRIVER_WEIGHTS non-zero weights, which is
    checked first, else over the sections' partitions."""
    spark = corpus.spark
    v, lemmas = coded(corpus, weights, topics)
    size = v.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("cols")).alias("weights")).first()
    if not size.n or not lemmas:
        return None
    k, m = max(1, min(topics, size.n, len(lemmas))), len(lemmas)
    if size.weights > DRIVER_WEIGHTS:
        rows, h = factorise_apart(v, size.n, m, k, passes)
        mass = h.sum(1)
        mix = F.zip_with("w", F.lit(mass.tolist()), lambda w, x: w * x)
        rows = rows.select("row", mix.alias("x")).withColumn("total", F.aggregate("x", F.lit(0.0), lambda a, b: a + b))
        rows = rows.select("row", F.transform("x", lambda x: F.when(F.col("total") > 0, x / F.col("total")).otherwise(0.0).cast("float")).alias("mix"))
        terms = scaled(np.zeros((0, k)), h)[0]
    else:
        t = v.select("row", "cols", "vals").toArrow().combine_chunks()
        at, cols, values = _flat(t.to_batches()[0])
        row = t["row"].to_numpy()
        w, h = factorise(row[at], cols, values, size.n, m, k, passes)
        terms, mix = scaled(w, h)
        rows = spark.createDataFrame(pa.table({"row": pa.array(np.arange(size.n)), "mix": _lists(mix.astype(np.float32))}))
    return Model(lemmas, terms, v.select("row", "edition_id", "path_key").join(rows, "row").select("edition_id", "path_key", "mix"))


def train(corpus: Corpus, weights: DataFrame, topics: int = TOPICS, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """topic_terms (topic, rank, lemma, weight), the 25 first of each topic, and topic_mix (edition_id, path_key, topic,
    weight FLOAT) of model()."""
    spark = corpus.spark
    found = model(corpus, weights, topics, passes)
    if found is None:
        return spark.createDataFrame([], "topic int, rank int, lemma string, weight double"), spark.createDataFrame([], "edition_id long, path_key string, topic int, weight float")
    out = []
    for t, terms in enumerate(found.terms):
        best = np.argsort(-terms, kind="stable")[:25]
        out += [(t, r + 1, found.lemmas[j], float(np.floor(terms[j] * 1e6 + 0.5) / 1e6)) for r, j in enumerate(best) if np.floor(terms[j] * 1e6 + 0.5) > 0]
    tt = spark.createDataFrame(out, "topic int, rank int, lemma string, weight double")
    return tt, found.mix.select("edition_id", "path_key", F.posexplode("mix").alias("topic", "weight"))


def stored(corpus: Corpus) -> tuple[DataFrame, DataFrame]:
    """train() of a corpus, done once: topic_terms and topic_mix are staged when they are first asked for."""
    if corpus.topic_terms is None or corpus.topic_mix is None:
        terms, mix = train(corpus, vectors.stored(corpus))
        corpus.topic_terms, corpus.topic_mix = stage(terms, "topic_terms"), stage(mix, "topic_mix")
    return corpus.topic_terms, corpus.topic_mix


def fold_in(weights: DataFrame, terms: DataFrame, k: int, passes: int = 50) -> DataFrame:
    """edition_id, path_key, topic, weight of any number of sections under given topics: rows of W alone, partition by
    partition. terms are Model.all_terms(): with the 25 lemmas a topic of topic_terms, a section that has none of them
    would get zeros. The topics (k times their lemmas) are broadcast, as in training."""
    t = terms.toPandas()
    lemmas = sorted(t.lemma.unique())
    at = {w: i for i, w in enumerate(lemmas)}
    h = np.zeros((k, len(lemmas)))
    h[t.topic.to_numpy(), t.lemma.map(at).to_numpy()] = t.weight.to_numpy()
    hh = h @ h.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column("x").to_pylist():
                c = [(at[y["lemma"]], y["weight"]) for y in x if y["lemma"] in at]
                w = np.full(k, 1.0 / k)
                if c:
                    vh = h[:, [i for i, _ in c]] @ np.array([v for _, v in c])
                    for _ in range(passes):
                        w *= vh / (w @ hh + TINY)
                total = w.sum() if c else 0
                rows.append((w / total if total > 0 else np.zeros(k)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column("edition_id"), b.column("path_key"), pa.array([r.tolist() for r in rows], pa.list_(pa.float32()))], names=["edition_id", "path_key", "mix"])

    g = weights.groupBy("edition_id", "path_key").agg(F.collect_list(F.struct("lemma", F.col("weight").cast("double").alias("weight"))).alias("x"))
    m = g.mapInArrow(run, "edition_id long, path_key string, mix array<float>")
    return m.select("edition_id", "path_key", F.posexplode("mix").alias("topic", "weight"))


def aggregate_mix(mix: DataFrame, *keys: str) -> DataFrame:
    """keys, topic, weight: mixes summed over a group and brought back to 1; a group of zeros stays one of zeros."""
    s = mix.groupBy(*keys, "topic").agg(F.sum(F.col("weight").cast("double")).alias("w"))
    total = F.sum("w").over(Window.partitionBy(*keys))
    return s.select(*keys, "topic", F.when(total > 0, F.col("w") / total).otherwise(0.0).alias("weight"))


def prominent(mix: DataFrame, editions: DataFrame, works: int = 8) -> DataFrame:
    """topic, rank, host_slug, work, weight: the canonical works with most of each topic. mix: edition_id, topic, weight."""
    m = mix.join(editions.filter("canonical").select("edition_id", "host_slug", "work"), "edition_id")
    a = aggregate_mix(m, "host_slug", "work").withColumn("weight", half_up(F.col("weight"), 4)).filter("weight > 0")
    r = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "host_slug", "work"))
    return a.withColumn("rank", r).filter(F.col("rank") <= max(1, min(works, 50))).select("topic", "rank", "host_slug", "work", "weight")


def mix_of(mix: DataFrame, limit: int = 10) -> DataFrame:
    """topic, weight of one group's summed mixes, largest first. mix: topic, weight of all its sections."""
    a = aggregate_mix(mix.withColumn("one", F.lit(1)), "one").withColumn("weight", half_up(F.col("weight"), 4)).filter("weight > 0")
    return a.orderBy(F.desc("weight"), "topic").limit(max(1, limit)).select("topic", "weight")


def labels(terms: DataFrame, words: int = 3) -> DataFrame:
    """topic, label: its first lemmas."""
    t = terms.filter(F.col("rank") <= words)
    return t.groupBy("topic").agg(F.array_join(F.sort_array(F.collect_list(F.struct("rank", "lemma"))).getField("lemma"), ", ").alias("label"))


#: Lemmas that stand beside a topic of a mix.
CONTEXT = 6


def topic_mix(corpus: Corpus, author: str | None, work: str | None, level: str | None = None, path: str | None = None, edition: str | None = None, limit: int = 10, terms: DataFrame | None = None, mix: DataFrame | None = None) -> DataFrame:
    """topic, label, terms, weight, found: the topics of a work, an edition or a section, most of it first, ties by topic, with
    their first lemmas. The target is found as for similar(). A target that isn't there, or has no text, is one row
    with found = false. terms, mix: of train(), stored() if not given."""
    level = vectors.level_of(level, path)
    terms, mix = (terms, mix) if terms is not None and mix is not None else stored(corpus)
    one = vectors.target_edition(corpus, author, work, level, edition) if author is not None and work is not None else corpus.editions.select("edition_id").limit(0)
    m = mix.join(F.broadcast(one), "edition_id", "left_semi")
    if level == "section":
        m = m.filter(F.col("path_key") == (path or "").lower())
    top = mix_of(m, limit)
    t = terms.filter(F.col("rank") <= CONTEXT).groupBy("topic").agg(F.array_join(F.sort_array(F.collect_list(F.struct("rank", "lemma"))).getField("lemma"), " ").alias("terms"))
    rows = top.join(F.broadcast(labels(terms).join(t, "topic")), "topic").select("topic", "label", "terms", "weight", F.lit(True).alias("found"))
    none = corpus.spark.range(1).join(top.limit(1).select(F.lit(True).alias("t")), how="left").filter("t IS NULL")
    return rows.unionByName(none.select(*(F.lit(None).cast(k).alias(c) for c, k in rows.drop("found").dtypes), F.lit(False).alias("found"))).orderBy(F.desc("weight"), "topic")
