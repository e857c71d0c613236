"""The corpus as a bundle of lazy tables, whatever they were read from."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirewise.session import fits
from quirewise.sources import corpus as tables


@dataclass
class Corpus:
    """editions, units, tokens (edited), originals (tokens of the original text of units with editorial marks),
    readings, members (direct borrowing), works, authors. Rows are those that count."""

    editions: DataFrame
    units: DataFrame
    tokens: DataFrame
    originals: DataFrame
    readings: DataFrame
    members: DataFrame
    works: DataFrame | None = None
    authors: DataFrame | None = None
    #: The compiled vocabulary, where there is one.
    compiled: DataFrame | None = None
    #: What is borrowed, directly or in turn, where it is compiled.
    borrowed: DataFrame | None = None
    #: A copy of the edited tokens that lies in the order of surfaces, where there is one.
    postings: DataFrame | None = None
    #: The sections' lemma weights, the lengths of their groups and the topics, once they were asked for.
    weights: DataFrame | None = None
    norms: dict[str, DataFrame] = field(default_factory=dict)
    topic_terms: DataFrame | None = None
    topic_mix: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.editions.sparkSession

    def version(self, version: str, by_surface: bool = False) -> DataFrame:
        """Tokens of a version: the original text is the edited one, but for the units that editors touched. by_surface: they
        will be looked for by their surfaces, so the copy in that order serves best, if there is one."""
        tokens = self.postings if by_surface and self.postings is not None else self.tokens
        if version == "edited":
            return tokens
        if version != "original":
            raise ValueError(f"version must be edited or original, not {version!r}")
        touched = self.units.filter("has_editorial").select("unit_id")
        return tokens.join(touched, "unit_id", "left_anti").unionByName(self.originals.join(touched, "unit_id", "left_semi").select(*tokens.columns))

    @cached_property
    def few_registered(self) -> bool:
        """Whether the register may be broadcast; counted once."""
        return fits(tables.register(self.readings))

    @cached_property
    def longest(self) -> int:
        """Words of the longest printed surface."""
        return self.vocabulary_readings.agg(F.max(F.size(F.split("surface", " ")))).first()[0] or 1

    @cached_property
    def register(self) -> DataFrame:
        """surface, reading_idx, word_idx, spelling, lemma of registered surfaces, nulls resolved."""
        r = self.readings.dropDuplicates().filter("surface IS NOT NULL")
        return r.select("surface", "reading_idx", "word_idx", F.coalesce("spelling", "surface").alias("spelling"), F.coalesce("lemma", "spelling", "surface").alias("lemma"))

    @cached_property
    def printed(self) -> DataFrame:
        """Each surface of the edited texts, and of the original ones where editors touched them."""
        touched = self.units.filter("has_editorial").select("unit_id")
        return self.tokens.select("surface").unionByName(self.originals.join(touched, "unit_id", "left_semi").select("surface")).distinct()

    @property
    def vocabulary_readings(self) -> DataFrame:
        """The same of every printed surface: its own entry, else that of a possessive's base, else its own words. Read from
        the compiled table, if there is one."""
        return self.compiled if self.compiled is not None else self._derived_readings

    @cached_property
    def _derived_readings(self) -> DataFrame:
        printed = self.printed
        reg = self.register
        known = reg.select("surface").distinct()
        own = printed.join(reg, "surface")
        free = printed.join(known, "surface", "left_anti")
        base = F.expr("substring(surface, 1, length(surface) - 2)")
        words = reg.groupBy("surface", "reading_idx").agg(F.sort_array(F.collect_list(F.struct("word_idx", "spelling", "lemma"))).alias("w"))
        words = words.select(F.col("surface").alias("base"), "reading_idx", F.array_join("w.spelling", " ").alias("spelling"), F.array_join("w.lemma", " ").alias("lemma"))
        owned = free.filter(F.col("surface").endswith("'s")).withColumn("base", base).join(words, "base").select("surface", "reading_idx", F.lit(0).alias("word_idx"), F.concat("spelling", F.lit("'s")).alias("spelling"), "lemma")
        rest = free.join(owned.select("surface").distinct(), "surface", "left_anti")
        same = rest.select("surface", F.lit(0).alias("reading_idx"), F.posexplode(F.split("surface", " ")).alias("word_idx", "spelling")).withColumn("lemma", F.col("spelling"))
        return own.unionByName(owned).unionByName(same)

    @cached_property
    def sections(self) -> DataFrame:
        """edition_id, path_key, ordinal (order of first appearance, from 1), depth, title, units."""
        s = self.units.groupBy("edition_id", "path_key").agg(F.min("unit_id").alias("first"), F.min_by("section_title", "unit_id").alias("title"), F.count(F.lit(1)).alias("units"))
        depth = F.when(F.col("path_key") == "", 0).otherwise(F.size(F.split("path_key", "/"))).cast("int")
        ordinal = F.row_number().over(Window.partitionBy("edition_id").orderBy("first"))
        return s.select("edition_id", "path_key", ordinal.alias("ordinal"), depth.alias("depth"), "title", "units")

    def lemmas(self, tokens: DataFrame) -> DataFrame:
        """tokens with the lemmas of their resolved reading."""
        return tables.with_lemmas(tokens, self.readings, few=self.few_registered)


#: Works of a host that make up one chain of the stand-in for borrowing.
CHAIN = 4


def derived_members(editions: DataFrame) -> DataFrame:
    """A deterministic stand-in for the test tables, which hold no borrowing: a host's works, by code point, form chains of
    four, along which the canonical editions of each work borrow all editions of the next."""
    works = editions.select("host_slug", "work").distinct().withColumn("n", F.row_number().over(Window.partitionBy("host_slug").orderBy("work")))
    following = works.filter((F.col("n") - 1) % CHAIN != 0).select("host_slug", F.col("work").alias("b"), (F.col("n") - 1).alias("n"))
    steps = works.join(following, ["host_slug", "n"]).drop("n")
    left = editions.filter("canonical").join(steps, ["host_slug", "work"]).select("edition_id", "host_slug", "b")
    right = editions.select("host_slug", F.col("work").alias("b"), F.col("edition_id").alias("member_id"))
    return left.join(right, ["host_slug", "b"]).select("edition_id", "member_id")


def read(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus in the Parquet tables of a folder, nothing computed yet."""
    e = tables.counted_editions(spark, sf_dir)
    cols = ["edition_id", "unit_id", "pos", "surface", "is_capital", "reading_idx", "start_char", "end_char"]
    return Corpus(
        editions=e,
        units=tables.counted_units(spark, sf_dir),
        tokens=tables.run_tokens(spark, sf_dir).select(*cols),
        originals=tables.run_tokens(spark, sf_dir, "original").select(*cols),
        readings=tables.table(spark, sf_dir, "readings").dropDuplicates(),
        members=derived_members(e.select("edition_id", "host_slug", "work", "canonical")),
        works=tables.table(spark, sf_dir, "works").dropDuplicates(),
        authors=tables.table(spark, sf_dir, "authors").dropDuplicates(),
    )


def from_documents(docs: DataFrame) -> DataFrame:
    """doc_id, pos, token, surface, is_capital of plain documents: the tokeniser on texts that no editor prepared."""
    from quirewise.functions.text import fold_word, is_capital, words

    t = docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "token"))
    return t.select("doc_id", F.col("pos").cast("long").alias("pos"), "token", fold_word(F.col("token")).alias("surface"), is_capital(F.col("token")).alias("is_capital"))
