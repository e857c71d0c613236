"""The catalogue, tables of contents, full texts and the way through an edition's sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirewise.sources.model import Corpus


def catalogue(corpus: Corpus) -> DataFrame:
    """author, host_slug, work, title, canonical_slug, edition_id, edition: a row for each edition under each of its work's
    authors; works without editions have null editions, authors without works null works."""
    w = corpus.works.select("host_slug", "work", F.col("title").alias("work_title"), "canonical_slug", F.explode_outer("author_slugs").alias("slug"))
    a = corpus.authors.select("slug", "surname").distinct()
    e = corpus.editions.select("host_slug", "work", "edition_id", "edition")
    return a.join(w, "slug", "left").join(e, ["host_slug", "work"], "left").select(F.col("slug").alias("author"), "host_slug", "work", "work_title", "canonical_slug", "edition_id", "edition")


def catalogue_tree(corpus: Corpus) -> DataFrame:
    """author, works ARRAY<STRUCT<host_slug, work, editions>>: the same, nested."""
    c = catalogue(corpus)
    w = c.groupBy("author", "host_slug", "work").agg(F.sort_array(F.collect_list("edition")).alias("editions"))
    return w.groupBy("author").agg(F.sort_array(F.collect_list(F.when(F.col("work").isNotNull(), F.struct("host_slug", "work", "editions")))).alias("works"))


def choose_edition(corpus: Corpus, host: str, work: str, edition: str | None = None) -> DataFrame:
    """The edition named, else the work's canonical one. Slugs are compared in lower case."""
    e = corpus.editions.filter((F.col("host_slug") == host.lower()) & (F.col("work") == work.lower()))
    if edition is not None:
        return e.filter(F.col("edition") == edition.lower())
    w = corpus.works.filter((F.col("host_slug") == host.lower()) & (F.col("work") == work.lower())).select("canonical_slug").distinct()
    return e.join(w, e.edition == w.canonical_slug, "left_semi")


def default_editions(corpus: Corpus) -> DataFrame:
    """host_slug, work, edition_id, edition that each work opens with."""
    w = corpus.works.select("host_slug", "work", F.col("canonical_slug").alias("edition")).distinct()
    return corpus.editions.select("edition_id", "host_slug", "work", "edition").join(w, ["host_slug", "work", "edition"]).select("host_slug", "work", "edition_id", "edition")


def contents(corpus: Corpus, edition_ids: DataFrame) -> DataFrame:
    """edition_id, ordinal, path_key, depth, title of the sections of editions, in reading order."""
    return corpus.sections.filter("path_key <> ''").join(edition_ids.select("edition_id"), "edition_id", "left_semi").select("edition_id", "ordinal", "path_key", "depth", "title")


def text_of(corpus: Corpus, edition_ids: DataFrame, version: str = "edited", path: str | None = None, subtree: bool = True) -> DataFrame:
    """edition_id, unit_id, path_key, block_id, is_title, text of editions, or of one section with or without what is under
    it. both: the edited and the original text, side by side."""
    u = corpus.units.join(edition_ids.select("edition_id"), "edition_id", "left_semi")
    if path is not None:
        p = path.lower()
        here = F.col("path_key") == p
        u = u.filter(here | F.col("path_key").startswith(f"{p}/") if subtree and p else here if p else F.lit(True) if subtree else here)
    original = F.coalesce(F.when(F.col("has_editorial"), F.col("text_original")), F.col("text_edited"))
    cols = ["edition_id", "unit_id", "path_key", "block_id", "is_title"]
    if version == "both":
        return u.select(*cols, F.col("text_edited").alias("text"), original.alias("original"))
    return u.select(*cols, (F.col("text_edited") if version == "edited" else original).alias("text"))


def ordered_text(corpus: Corpus, edition_ids: DataFrame, version: str = "edited", path: str | None = None, subtree: bool = True) -> DataFrame:
    """text_of() with `place`, the place of each unit in its edition's reading order, from 1."""
    return text_of(corpus, edition_ids, version, path, subtree).withColumn("place", F.row_number().over(Window.partitionBy("edition_id").orderBy("unit_id")))


def title_blocks(corpus: Corpus, edition_ids: DataFrame) -> DataFrame:
    """edition_id, unit_id, block_id, text of the titles that an edition opens with."""
    return text_of(corpus, edition_ids, path="", subtree=False).filter("path_key = '' AND is_title").select("edition_id", "unit_id", "block_id", "text")


def find_work(corpus: Corpus, host: str, work: str) -> DataFrame:
    """A work by its host and slug, in lower case, a row for each of its authors with what the register has of them."""
    w = corpus.works.filter((F.col("host_slug") == host.lower()) & (F.col("work") == work.lower())).dropDuplicates(["host_slug", "work"])
    return w.withColumn("slug", F.explode_outer("author_slugs")).join(corpus.authors.dropDuplicates(["slug"]).withColumnRenamed("title", "author_title") if "title" in corpus.authors.columns else corpus.authors.dropDuplicates(["slug"]), "slug", "left")


def section_answer(corpus: Corpus, edition_ids: DataFrame, path: str) -> DataFrame:
    """edition_id, path_key, title, previous, next, above ARRAY, others ARRAY: a section with the way to its neighbours, what lies
    above it from the root down, and further editions of the work that have it, in the order of their slugs."""
    p = path.lower()
    here = contents(corpus, edition_ids).filter(F.col("path_key") == p).select("edition_id", "path_key", "title")
    nav = navigation(corpus).filter(F.col("path_key") == p).select("edition_id", "previous", "next")
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("path_key", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path_key", "/"), F.lit(1), n), "/"))
    others = matching_editions(corpus).filter(F.col("path_key") == p).groupBy("edition_id").agg(F.sort_array(F.collect_list("other")).alias("others"))
    none = F.array().cast("array<string>")
    got = here.join(nav, "edition_id").join(others, "edition_id", "left")
    return got.select("edition_id", "path_key", "title", "previous", "next", F.when(F.size(F.split("path_key", "/")) > 1, above).otherwise(none).alias("above"), F.coalesce("others", none).alias("others"))


def navigation(corpus: Corpus) -> DataFrame:
    """edition_id, path_key, ordinal, previous, next: neighbours in reading order."""
    w = Window.partitionBy("edition_id").orderBy("ordinal")
    s = corpus.sections.filter("path_key <> ''")
    return s.select("edition_id", "path_key", "ordinal", F.lag("path_key").over(w).alias("previous"), F.lead("path_key").over(w).alias("next"))


def ancestors(corpus: Corpus) -> DataFrame:
    """edition_id, path_key, ancestor, depth: the sections above each one, from the root down."""
    s = corpus.sections.filter("path_key <> ''").select("edition_id", "path_key", F.split("path_key", "/").alias("p")).filter(F.size("p") > 1)
    up = s.select("edition_id", "path_key", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("depth"))
    return up.select("edition_id", "path_key", F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("ancestor"), "depth")


def matching_editions(corpus: Corpus) -> DataFrame:
    """edition_id, path_key, other_id, other: further editions of the work that have the same section. Editions of one
    work are few, so the join by work and path makes few pairs."""
    e = corpus.editions.select("edition_id", "host_slug", "work", "edition")
    s = corpus.sections.filter("path_key <> ''").select("edition_id", "path_key").join(e, "edition_id")
    o = s.select(F.col("edition_id").alias("other_id"), F.col("edition").alias("other"), "host_slug", "work", "path_key")
    return s.join(o, ["host_slug", "work", "path_key"]).filter("edition_id <> other_id").select("edition_id", "path_key", "other_id", "other")


def stats(corpus: Corpus) -> DataFrame:
    """One row: authors, works, editions, units, tokens, surfaces, spellings, lemmas."""
    v = corpus.vocabulary_readings.agg(F.countDistinct("surface").alias("surfaces"), F.countDistinct("spelling").alias("spellings"), F.countDistinct("lemma").alias("lemmas"))
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n)).select(n).scalar().alias(n)
    return v.select(
        one(corpus.authors.select("slug").distinct(), "authors"),
        one(corpus.works.select("host_slug", "work").distinct(), "works"),
        one(corpus.editions, "editions"),
        one(corpus.units, "units"),
        one(corpus.tokens, "tokens"),
        "surfaces",
        "spellings",
        "lemmas",
    )
