"""Distinctive vocabulary of a part of the corpus, and words that keep company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewise.functions.text import half_up
from quirewise.operators.scope import flagged, scoped
from quirewise.operators.search import expand, marked, parse
from quirewise.session import fits, stage
from quirewise.sources.model import Corpus


def log2(x: Column) -> Column:
    return F.log(x) / F.log(F.lit(2.0))


def xlog(a: Column, e: Column) -> Column:
    return F.when(a > 0, a * F.log(a / e)).otherwise(0.0)


def top(df: DataFrame, limit: int, most: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(max(1, min(limit, most)))


def sides(corpus: Corpus, author: str | None, work: str | None = None, wanted: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Target and reference of an author's vocabulary, or of a work's: what is in scope, borrowed editions included, and
    all else that passes the edition filter. Without an author there is no target, hence no keyword."""
    universe = flagged(corpus.editions, wanted)
    if author is None:
        return universe.filter(F.lit(False)), universe
    return scoped(corpus, author, work, wanted), universe


def keyness(corpus: Corpus, target: DataFrame, reference: DataFrame, match: str = "form", version: str = "edited", least: int = 5, limit: int = 50) -> DataFrame:
    """term, target, reference, log_likelihood, log_ratio, target_rate, reference_rate of the terms that the target's editions
    over-use. exact: terms are surfaces, else lemmas of the resolved readings (a contraction counts under each). target,
    reference: edition_id; an edition in both belongs to the target. Sizes are token counts of the edited text."""
    side = target.select("edition_id", F.lit(1).alias("side")).unionByName(reference.join(target, "edition_id", "left_anti").select("edition_id", F.lit(0).alias("side"))).distinct()
    sized = corpus.units.join(side, "edition_id").agg(F.struct(F.sum(F.when(F.col("side") == 1, F.col("token_count"))).alias("t"), F.sum(F.when(F.col("side") == 0, F.col("token_count"))).alias("r")).alias("z")).scalar()
    # What is counted first has a row for each surface and reading; only these are resolved to lemmas.
    tokens = corpus.version(version).select("edition_id", "surface", "reading_idx").join(F.broadcast(side) if fits(side) else side, "edition_id")
    counts = [F.sum("side").alias("target"), F.sum(1 - F.col("side")).alias("reference")]
    if match == "exact":
        g = tokens.groupBy(F.col("surface").alias("term")).agg(*counts)
    else:
        per = corpus.lemmas(tokens.groupBy("surface", "reading_idx").agg(*counts))
        g = per.select(F.explode("lemmas").alias("term"), "target", "reference").groupBy("term").agg(F.sum("target").alias("target"), F.sum("reference").alias("reference"))
        # An exempt word that is no lemma of the vocabulary has no group here.
        g = g.join(corpus.vocabulary_readings.select(F.col("lemma").alias("term")).distinct(), "term", "left_semi")
    g = g.withColumn("z", sized).withColumns({"big_t": F.coalesce("z.t", F.lit(0)).cast("double"), "big_r": F.coalesce("z.r", F.lit(0)).cast("double")})
    big_t, big_r = F.col("big_t"), F.col("big_r")
    a, b = F.col("target").cast("double"), F.col("reference").cast("double")
    e1, e2 = big_t * (a + b) / (big_t + big_r), big_r * (a + b) / (big_t + big_r)
    g = g.filter((big_t > 0) & (big_r > 0) & (a >= least) & (a / big_t > b / big_r))
    ll = half_up(2 * (xlog(a, e1) + xlog(b, e2)), 2)
    lr = half_up(log2((a / big_t) / (F.when(b > 0, b).otherwise(0.5) / big_r)), 2)
    g = g.select("term", "target", "reference", ll.alias("log_likelihood"), lr.alias("log_ratio"), half_up(a / big_t * 1000, 1).alias("target_rate"), half_up(b / big_r * 1000, 1).alias("reference_rate"))
    return top(g, limit, 500, F.desc("log_likelihood"), F.desc("log_ratio"), "term")


def _windows(corpus: Corpus, q: str, scope: DataFrame, match: str, window: int) -> DataFrame | None:
    """surface, node, c1, o11 of the tokens in scope: whether it is a word of q, how often it is printed, and how often near
    one. Only units that hold a node are sorted; the totals are a plain count. None of a query without a word."""
    words, known = parse(corpus, q.strip())
    if not words:
        return None
    ids = scope.select("edition_id")
    t = corpus.tokens.select("edition_id", "unit_id", "pos", "surface").join(F.broadcast(ids) if fits(ids) else ids, "edition_id", "left_semi")
    nodes = marked(corpus.version("edited", by_surface=True).select("unit_id", "pos", "surface"), [expand(corpus, w.surface, match, known) for w in words])
    held = nodes.select("unit_id").distinct()
    at_node = nodes.select("unit_id", "pos", F.lit(True).alias("node"))
    t_near = t.join(held, "unit_id", "left_semi").join(at_node, ["unit_id", "pos"], "left").withColumn("node", F.coalesce("node", F.lit(False)))
    # Nearness to a node is the distance to the last and to the next one, along the unit: no join, no double counting.
    w = Window.partitionBy("unit_id").orderBy("pos")
    at = F.when(F.col("node"), F.col("pos"))
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # Looked for from the other end, as a frame that runs to the end is evaluated anew for each row.
    after = F.last(at, ignorenulls=True).over(Window.partitionBy("unit_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1))
    near = F.coalesce(F.col("pos") - before <= window, F.lit(False)) | F.coalesce(after - F.col("pos") <= window, F.lit(False))
    o = t_near.withColumn("near", near & ~F.col("node")).groupBy("surface").agg(F.sum(F.col("near").cast("long")).alias("o11"), F.max("node").alias("node"))
    c = t.groupBy("surface").agg(F.count(F.lit(1)).alias("c1"))
    return c.join(o, "surface", "left").select("surface", F.coalesce("node", F.lit(False)).alias("node"), "c1", F.coalesce("o11", F.lit(0).cast("long")).alias("o11"))


FOUND = "term string, cooccurrence long, total long, log_likelihood double, pmi double, t_score double, per_1000 double"


def colloc_figures(corpus: Corpus, q: str, scope: DataFrame, match: str = "form", window: int = 5) -> DataFrame:
    """One row: scope_tokens, node_count, window_tokens, that is N, the nodes in scope and the positions near them."""
    g = _windows(corpus, q, scope, match, max(1, min(window, 25)))
    if g is None:
        return corpus.spark.range(1).select(*(F.lit(0).cast("long").alias(c) for c in ("scope_tokens", "node_count", "window_tokens")))
    zero = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n)
    return g.agg(zero("c1", "scope_tokens"), zero(F.when(F.col("node"), F.col("c1")), "node_count"), zero("o11", "window_tokens"))


def collocations(corpus: Corpus, q: str, scope: DataFrame, match: str = "form", by: str = "lemma", window: int = 5, least: int = 3, limit: int = 50) -> DataFrame:
    """term, cooccurrence, total, log_likelihood, pmi, t_score, per_1000 of what stands within `window` tokens of any word of q,
    in the edited text. Each position counts once, however many nodes it is near; nodes are no context, their own
    groups no collocates. by: lemma (first word of the default reading) or surface. A query without a word has none."""
    groups = _windows(corpus, q, scope, match, max(1, min(window, 25)))
    if groups is None:
        return corpus.spark.createDataFrame([], FOUND)
    if by == "lemma":
        first = corpus.vocabulary_readings.filter("reading_idx = 0 AND word_idx = 0").select("surface", F.col("lemma").alias("term"))
        groups = groups.join(first, "surface", "left").withColumn("term", F.coalesce("term", "surface"))
    else:
        groups = groups.withColumn("term", F.col("surface"))
    groups = stage(groups, "collocates")  # a row a surface: read for the sums and for the terms
    g = groups.groupBy("term").agg(F.sum("c1").alias("total"), F.sum("o11").alias("cooccurrence"), F.max("node").alias("own"))
    sums = groups.agg(F.struct(F.sum("c1").alias("n"), F.sum("o11").alias("r")).alias("z")).scalar()
    # As columns, not as subqueries in each of the many places that use them, which would all be planned.
    g = g.withColumn("z", sums).withColumns({"n": F.col("z.n").cast("double"), "r1": F.col("z.r").cast("double")})
    n, r1 = F.col("n"), F.col("r1")
    o, c1 = F.col("cooccurrence").cast("double"), F.col("total").cast("double")
    g = g.filter(~F.col("own") & (o >= least) & (r1 > 0))
    o12, o21 = r1 - o, c1 - o
    o22 = n - r1 - c1 + o
    e = r1 * c1 / n
    ll = 2 * (xlog(o, e) + xlog(o12, r1 * (n - c1) / n) + xlog(o21, (n - r1) * c1 / n) + xlog(o22, (n - r1) * (n - c1) / n))
    g = g.select("term", "cooccurrence", "total", half_up(ll, 2).alias("log_likelihood"), half_up(log2(o / e), 2).alias("pmi"), half_up((o - e) / F.sqrt(o), 2).alias("t_score"), half_up(o / r1 * 1000, 1).alias("per_1000"))
    return top(g, limit, 500, F.desc("log_likelihood"), F.desc("cooccurrence"), "term")
