"""Sections as vectors of lemma weights, and their likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirewise.functions.text import half_up
from quirewise.session import fits, join_lookup, stage
from quirewise.sources.model import Corpus

LEVELS = ("section", "edition", "work")


def lemma_counts(corpus: Corpus) -> DataFrame:
    """edition_id, path_key, lemma, c: lemmas of each section's own units, every word of each occurrence's reading."""
    t = corpus.lemmas(corpus.tokens.select("unit_id", "surface", "reading_idx"))
    per = t.select("unit_id", F.explode("lemmas").alias("lemma")).groupBy("unit_id", "lemma").agg(F.count(F.lit(1)).alias("c"))
    return per.join(corpus.units.select("unit_id", "edition_id", "path_key"), "unit_id").groupBy("edition_id", "path_key", "lemma").agg(F.sum("c").alias("c"))


def sections_with_text(corpus: Corpus) -> DataFrame:
    """edition_id, path_key of every section document: those with a unit."""
    return corpus.units.select("edition_id", "path_key").distinct()


def tfidf(corpus: Corpus, counts: DataFrame | None = None) -> DataFrame:
    """edition_id, path_key, lemma, c, raw, weight: (1 + ln c) * (ln((N + 1) / (df + 1)) + 1), and the same over the section's
    length, as a FLOAT. N counts all sections, those without a token too."""
    c = counts if counts is not None else lemma_counts(corpus)
    n = sections_with_text(corpus).agg(F.count(F.lit(1)).cast("double")).scalar()
    df = c.groupBy("lemma").agg(F.count(F.lit(1)).alias("df"))
    w = join_lookup(c, df, "lemma").withColumn("n", n).withColumn("raw", (1 + F.log("c")) * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("edition_id", "path_key")))
    return w.select("edition_id", "path_key", "lemma", "c", "raw", (F.col("raw") / norm).cast("float").alias("weight"))


def stored(corpus: Corpus) -> DataFrame:
    """tfidf() of a corpus, computed and staged when it is first asked for."""
    if corpus.weights is None:
        corpus.weights = stage(tfidf(corpus), "weights")
    return corpus.weights


KEYS = {"section": ["host_slug", "work", "edition_id", "path_key"], "edition": ["host_slug", "work", "edition_id"], "work": ["host_slug", "work"]}


def lengths(corpus: Corpus, level: str, weights: DataFrame | None = None) -> DataFrame:
    """The keys of each group of canonical sections, yy: its summed weights squared, and its first edition. The whole table
    is regrouped for it, so it is staged when first asked for; weights given are those of this call alone."""
    if weights is None and level in corpus.norms:
        return corpus.norms[level]
    ed = corpus.editions.filter("canonical").select("edition_id", "host_slug", "work")
    w = (stored(corpus) if weights is None else weights).join(F.broadcast(ed) if fits(ed) else ed, "edition_id")
    keys = KEYS[level]
    v = w.groupBy(*keys, "lemma").agg(F.sum(F.col("weight").cast("double")).alias("y"), F.min("edition_id").alias("first"))
    n = v.groupBy(*keys).agg(F.sum(F.col("y") * F.col("y")).alias("yy"), F.min("first").alias("first"))
    if weights is None:
        corpus.norms[level] = n = stage(n, "lengths")
    return n


def target_edition(corpus: Corpus, author: str, work: str, level: str, edition: str | None = None) -> DataFrame:
    """edition_id of the edition asked about: the work's canonical one or the named one, at the work level the canonical one.
    No row if there is none."""
    mine = F.array_contains("authors", author) & (F.col("work") == work)
    one = mine & (F.col("canonical") if edition is None or level == "work" else F.col("edition") == edition)
    return corpus.editions.filter(one).orderBy("edition_id").limit(1).select("edition_id")


def level_of(level: str | None, path: str | None) -> str:
    level = level or ("section" if path is not None else "edition")
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    return level


def similar(corpus: Corpus, author: str, work: str, level: str | None = None, path: str | None = None, edition: str | None = None, limit: int = 20, weights: DataFrame | None = None) -> DataFrame:
    """host_slug, work, edition_id, path_key, score of the canonical items most like the target, which is the author's work: its
    canonical edition or the named one (the work level takes the canonical one), or a section of it. The target's own
    work is left out. Columns that the level doesn't tell apart are null."""
    level = level_of(level, path)
    ed = corpus.editions.select("edition_id", "host_slug", "work", "canonical", "authors")
    mine = F.array_contains("authors", author) & (F.col("work") == work)
    w = (weights if weights is not None else stored(corpus)).select("edition_id", "path_key", "lemma", F.col("weight").cast("double").alias("weight"))
    goal = w.join(F.broadcast(target_edition(corpus, author, work, level, edition)), "edition_id", "left_semi")
    if level == "section":
        goal = goal.filter(F.col("path_key") == (path or "").lower())
    goal = stage(goal.groupBy("lemma").agg(F.sum("weight").alias("x")), "goal")
    others = ed.filter(F.col("canonical") & ~mine).select("edition_id", "host_slug", "work")
    keys = KEYS[level]
    # Only lemmas of the goal matter to the product, and it has a row a lemma: most weights end before any exchange.
    v = join_lookup(w, goal, "lemma").join(F.broadcast(others) if fits(others) else others, "edition_id")
    dot = v.groupBy(*keys).agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    xx = goal.agg(F.sum(F.col("x") * F.col("x"))).scalar()
    d = dot.join(lengths(corpus, level, weights), keys)
    d = d.filter("dot > 0 AND yy > 0").withColumn("xx", xx).withColumn("score", half_up(F.col("dot") / F.sqrt(F.col("yy") * F.col("xx")), 4))
    cols = [F.col(k) if k in keys else F.lit(None).cast("bigint" if k == "edition_id" else "string").alias(k) for k in ("host_slug", "work", "edition_id", "path_key")]
    return d.orderBy(F.desc("score"), "first", *keys).limit(max(1, min(limit, 200))).select(*cols, "score")


def similar_answer(corpus: Corpus, author: str, work: str, level: str | None = None, path: str | None = None, edition: str | None = None, limit: int = 20) -> DataFrame:
    """similar() with `found` (whether the target has a text), the works' breadcrumbs and the editions' slugs as labels. A
    target without a text is one row with found = false."""
    level = level_of(level, path)
    s = similar(corpus, author, work, level, path, edition, limit)
    e = corpus.editions.select("edition_id", "edition")
    b = corpus.works.groupBy("host_slug", "work").agg(F.min("breadcrumb").alias("work_breadcrumb"))
    rows = s.join(b, ["host_slug", "work"], "left").join(e, "edition_id", "left").withColumn("found", F.lit(True))
    docs = corpus.units.join(target_edition(corpus, author, work, level, edition), "edition_id", "left_semi")
    if level == "section":
        docs = docs.filter(F.col("path_key") == (path or "").lower())
    none = corpus.spark.range(1).join(docs.filter("token_count > 0").limit(1).select(F.lit(True).alias("t")), how="left").filter("t IS NULL")
    empty = none.select(*(F.lit(None).cast(t).alias(c) for c, t in rows.drop("found").dtypes), F.lit(False).alias("found"))
    return rows.unionByName(empty)
