"""Compiling a corpus into tables that queries read, and keeping them fresh.

Compiling does once what every query would do again: it picks the rows that count, folds surfaces and works out the
readings of the vocabulary and the closure of borrowing. Tokens are bucketed by unit, so that nothing done within a unit
needs an exchange, and copied in the order of their surfaces, so that looking for a word reads the row groups that hold it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.functions.text import digest
from quirewise.operators.scope import closure
from quirewise.session import partitions, stage, stage_bucketed
from quirewise.sources.model import Corpus, read

VERSION = "2"
TABLES = ("authors", "works", "editions", "units", "tokens", "readings")
PARTS = ("editions", "units", "tokens", "originals", "readings", "members", "works", "authors", "compiled", "borrowed", "postings", "weights", "topic_terms", "topic_mix")
#: Schemas of the parts that a corpus can do without: where their files are missing they are empty.
OPTIONAL = {
    "originals": "edition_id long, unit_id long, pos long, surface string, is_capital boolean, reading_idx int, start_char long, end_char long",
    "readings": "surface string, reading_idx int, word_idx int, spelling string, lemma string",
    "members": "edition_id long, member_id long",
    "works": "host_slug string, work string, author_slugs array<string>, title string, breadcrumb string, canonical_slug string",
    "authors": "slug string, surname string",
}
#: Compiled corpora that a session keeps open; the one longest unused gives way.
KEPT = 4
_open: dict[tuple, Corpus] = {}


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def stamp(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of a folder's files: a cheap sign that nothing was touched."""
    seen = []
    for t in TABLES:
        p, fs = _file_system(spark, f"{folder}/{t}.parquet")
        if not fs.exists(p):
            seen.append([t, None])
            continue
        for f in fs.listStatus(p):
            seen.append([t, f.getPath().getName(), f.getLen(), f.getModificationTime()])
    return json.dumps([VERSION, sorted(seen, key=str)])


def fingerprint(spark: SparkSession, folder: str) -> str:
    """Changes whenever the content of a table does, and only then: the number of its rows and the sum of their digests,
    whatever the files' names, order and times. A missing table has 0 rows."""
    out = []
    for t in TABLES:
        p, fs = _file_system(spark, f"{folder}/{t}.parquet")
        n, total = 0, None
        if fs.exists(p):
            df = spark.read.parquet(f"{folder}/{t}.parquet")
            n, total = df.select(digest(df).cast("decimal(38,0)").alias("d")).agg(F.count(F.lit(1)), F.sum("d")).first()
        out.append([t, n, str(total or 0)])
    return json.dumps([VERSION, out])


def compiled(corpus: Corpus) -> Corpus:
    """The same corpus, its derived tables computed and staged."""
    tokens = stage_bucketed(corpus.tokens, "tokens", "unit_id")
    made = Corpus(
        editions=stage(corpus.editions, "editions"),
        units=stage(corpus.units, "units"),
        tokens=tokens,
        originals=stage(corpus.originals, "originals"),
        readings=corpus.readings,
        members=stage(corpus.members, "members"),
        works=corpus.works,
        authors=corpus.authors,
    )
    # Ranged by unit too, so that a surface of a tenth of the rows fills many parts.
    made.postings = stage(tokens.repartitionByRange(partitions(corpus.spark), "surface", "unit_id").sortWithinPartitions("surface", "unit_id", "pos"), "postings")
    made.borrowed = closure(made.members)
    made.compiled = stage(made.vocabulary_readings.coalesce(partitions(corpus.spark)), "vocabulary")
    return made


def load(spark: SparkSession, folder: str) -> Corpus:
    """The compiled corpus of a folder, compiled anew when its tables have changed."""
    key = (spark.sparkContext.applicationId, folder, stamp(spark, folder))
    if key in _open:
        _open[key] = _open.pop(key)  # the last used stands last
    else:
        while len(_open) >= KEPT:
            _open.pop(next(iter(_open)))
        _open[key] = compiled(read(spark, folder))
    return _open[key]


def serve(spark: SparkSession, folder: str, kept: str) -> Corpus:
    """The corpus of a folder from where it is kept, compiled and kept anew if it isn't there or isn't of this content."""
    mark = fingerprint(spark, folder)
    if not is_fresh(spark, kept, mark):
        write(compiled(read(spark, folder)), kept, mark)
    return reopen(spark, kept)


def write(corpus: Corpus, folder: str, mark: str) -> None:
    """Keep a compiled corpus in a folder. One that holds something else is refused; the manifest, written last, says
    that all of it is there, and from which fingerprint."""
    spark = corpus.spark
    p, fs = _file_system(spark, folder)
    manifest, _ = _file_system(spark, f"{folder}/manifest")
    if fs.exists(p) and fs.listStatus(p) and not fs.exists(manifest):
        raise FileExistsError(f"{folder} is not empty and holds no corpus")
    if fs.exists(manifest):
        fs.delete(manifest, True)
    for name in PARTS:
        df = corpus.vocabulary_readings if name == "compiled" else getattr(corpus, name)
        if df is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        else:  # of an earlier corpus
            q, _ = _file_system(spark, f"{folder}/{name}")
            fs.delete(q, True)
    spark.createDataFrame([(VERSION, mark)], "version string, fingerprint string").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def is_fresh(spark: SparkSession, folder: str, mark: str) -> bool:
    p, fs = _file_system(spark, f"{folder}/manifest")
    if not fs.exists(p):
        return False
    m = spark.read.schema("version string, fingerprint string").json(f"{folder}/manifest").first()
    return m is not None and (m.version, m.fingerprint) == (VERSION, mark)


def reopen(spark: SparkSession, folder: str) -> Corpus:
    """A corpus kept by write(). Of the parts that it lacks, those in OPTIONAL are empty and what can be derived is derived
    when it is asked for; editions, units and tokens must be there."""
    p, fs = _file_system(spark, f"{folder}/manifest")
    if not fs.exists(p):
        raise FileNotFoundError(f"{folder} holds no corpus")

    def part(name: str) -> DataFrame | None:
        q, _ = _file_system(spark, f"{folder}/{name}")
        if fs.exists(q):
            return spark.read.parquet(f"{folder}/{name}")
        if name in ("editions", "units", "tokens"):
            raise FileNotFoundError(f"{folder} lacks {name}")
        return spark.createDataFrame([], OPTIONAL[name]) if name in OPTIONAL else None

    return Corpus(**{name: part(name) for name in PARTS})


def units_of(corpus: Corpus, edition_id: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """The units of an edition, from unit `first` to `last`: the filters reach the scan, so row groups of other units are
    not read."""
    u = corpus.units.filter(F.col("edition_id") == edition_id)
    if first is not None:
        u = u.filter(F.col("unit_id") >= first)
    return u.filter(F.col("unit_id") <= last) if last is not None else u
