"""The corpus tables and the rows of them that count.

An exact copy of a row counts once; of rebuilt editions, re-extracted units and re-indexed token runs only
the latest count. Everything here is lazy and stays on the JVM but for Unicode folding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirewise.functions.text import fold_ascii, fold_odd
from quirewise.session import fits, join_lookup

GROWING = ("works", "editions", "units", "tokens", "topic_docs", "topic_mix", "documents", "doc_labels")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, stamp: str, *first: str) -> DataFrame:
    """The rows of each key with its latest stamp, exact copies once. A null stamp is older than any other;
    rows of a null key are one group. One exchange by the key and one sort, through which rows stream (and
    spill): the newest stamp comes first and an exact copy stands beside its like. Texts are sorted by two digests, and
    compared themselves."""
    rest = [*first, *(c for c in df.columns if c not in (key, stamp, *first))]
    texts = [c for c, t in df.dtypes if c in rest and t == "string" and c.startswith("text")]
    digests = [F.xxhash64(F.lit(seed), *texts) for seed in (1, 2)] if texts else []
    w = Window.partitionBy(key).orderBy(F.col(stamp).desc_nulls_last(), *(c for c in rest if c not in texts), *digests)
    newest, copy = F.first(stamp).over(w), F.row_number().over(w) > 1
    for c in (stamp, *rest):
        copy = copy & F.lag(c).over(w).eqNullSafe(F.col(c))
    return df.withColumns({"__newest": newest, "__copy": copy}).filter(F.col("__newest").eqNullSafe(F.col(stamp)) & ~F.col("__copy")).drop("__newest", "__copy")


def counted_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "editions"), "edition_id", "built_at")


def counted_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "units"), "unit_id", "extracted_at")


def run_tokens(spark: SparkSession, sf_dir: str, version: str = "edited") -> DataFrame:
    """Tokens of the latest run of each unit in one version, without the surfaces that are missing, and with
    `surface` folded. Hash-partitioned by unit_id."""
    t = table(spark, sf_dir, "tokens").filter(F.col("version") == version).drop("version")
    # What end_char exceeds start_char and surface by is mostly 0: it compares alike and hardly weighs in the exchange.
    t = t.withColumn("end_char", F.col("end_char") - F.col("start_char") - F.coalesce(F.length("surface"), F.lit(0)))
    # Python comes before the exchange, as what follows it would no longer count as partitioned.
    t = latest(t.withColumn("__folded", fold_odd(F.col("surface"))), "unit_id", "indexed_at", "pos")
    t = t.withColumn("end_char", F.col("end_char") + F.col("start_char") + F.coalesce(F.length("surface"), F.lit(0)))
    return t.filter("surface IS NOT NULL").withColumn("surface", F.coalesce("__folded", fold_ascii(F.col("surface")))).drop("__folded")


def token_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id of each unit that holds a counted token: its latest run has a surface. One small exchange."""
    t = table(spark, sf_dir, "tokens").filter("version = 'edited'")
    at = F.col("indexed_at")
    found = t.groupBy("unit_id").agg(F.max(at).alias("a"), F.max(F.when(F.col("surface").isNotNull(), at)).alias("b"), F.count("surface").alias("n"))
    return found.filter("a = b OR (a IS NULL AND n > 0)").select("unit_id")


def reading_lemmas(readings: DataFrame) -> DataFrame:
    """surface, reading_idx, lemmas (one a word). A null spelling means the surface, a null lemma the spelling."""
    return (
        readings.dropDuplicates()
        .groupBy("surface", "reading_idx")
        .agg(F.sort_array(F.collect_list(F.struct("word_idx", F.coalesce("lemma", "spelling", "surface").alias("lemma")))).alias("w"))
        .select("surface", "reading_idx", F.col("w.lemma").alias("lemmas"))
    )


def register(readings: DataFrame) -> DataFrame:
    """surface, by_idx: all readings of a registered surface as a map from reading_idx to lemmas, so that one
    join finds both whether a surface is registered and the reading asked for."""
    return reading_lemmas(readings).groupBy("surface").agg(F.map_from_entries(F.collect_list(F.struct("reading_idx", "lemmas"))).alias("by_idx"))


def with_lemmas(tokens: DataFrame, readings: DataFrame, surface: str = "surface", idx: str = "reading_idx", few: bool | None = None) -> DataFrame:
    """tokens with `lemmas`: those of the reading named (null = 0); else of a possessive's registered base, joined
    to one lemma; else, and for reading -1, the words of the surface. The register is broadcast where it fits (few:
    whether it does, where that is known); beyond, a surface's rows are spread."""
    reg = register(readings)
    few = fits(reg) if few is None else few
    clitic = F.col(surface).endswith("'s")
    base = F.when(clitic, F.expr(f"substring({surface}, 1, length({surface}) - 2)"))
    i = F.coalesce(F.col(idx), F.lit(0))
    t = tokens.withColumns({"__s": F.col(surface), "__b": base})
    t = join_lookup(t, reg.select(F.col("surface").alias("__s"), F.col("by_idx").alias("__own")), "__s", "left", few)
    t = join_lookup(t, reg.select(F.col("surface").alias("__b"), F.col("by_idx").alias("__base")), "__b", "left", few)
    own = F.col("__own")[i]
    of_base = F.when(F.col("__own").isNull(), F.array(F.array_join(F.col("__base")[i], " ")))
    found: Column = F.when(F.col("__base")[i].isNotNull() & F.col("__own").isNull(), of_base).otherwise(own)
    return t.withColumn("lemmas", F.when(i == -1, F.split(surface, " ")).otherwise(F.coalesce(found, F.split(surface, " ")))).drop("__s", "__b", "__own", "__base")
