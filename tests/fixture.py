"""A small corpus, written out: two works in two printings, a collection that borrows one of them, a stub.

Fixed values: EDITIONS, UNITS, ORIGINAL and REGISTER. The published numbers of test_goldens.py rest on every word of them.
"""

from pyspark.sql import functions as F

from quirewise.session import stage
from quirewise.sources.artefacts import compiled
from quirewise.sources.model import Corpus, from_documents

N = " "
#: edition_id, work, edition, canonical
EDITIONS = [(1, "solo", "1740", True), (2, "tw", "1750", False), (3, "tw", "1760", True), (4, "comp", "1755", True), (5, "stub", "1730", True)]
#: edition_id, path, block, text
UNITS = [
    (1, "", "title", "A SOLITARY TREATISE."),
    (1, "1", "title", "PART I."),
    (1, "1/1", "1", "Of the understanding, and of the passions; a deep and abstruse philosophy."),
    (1, "1/1", "2", "The editor corrected the text and also revised it."),
    (1, "1/2", "1", "The mind never perceives any real connexion among distinct existences."),
    (1, "1/2", "2", "From experience alone we infer the connexion betwixt causes and effects."),
    (2, "", "title", "A TEST WORK."),
    (2, "1", "title", "SECT. I."),
    (2, "1", "1", "Some objects produce immediately an agreeable sensation betwixt friends, and encrease the delicacy of passion."),
    (2, "1", "2", "A second paragraph, identical in every edition of this work."),
    (2, "1", "3", f"A paragraph found only in the seventeen-fifty edition, reasoning a{N}priori and judging ipso{N}facto."),
    (2, "3", "1", "Avarice was withdrawn from later editions of this work."),
    (3, "", "title", "A TEST WORK."),
    (3, "1", "title", "SECT. I."),
    (3, "1", "1", "Some objects produce immediately an agreeable sensation between friends, and increase the delicacy of passion."),
    (3, "1", "2", "A second paragraph, identical in every edition of this work."),
    (3, "2", "1", "The liberty of the press is a passion peculiar to free governments."),
    (3, "2", "2", "Men of letters defend the natural liberty of thinking in every age."),
    (3, "2", "n1", "A remark recorded at the foot of the page."),
    (4, "", "title", "A COMPOSITE COLLECTION."),
    (4, "in", "1", "An essay belonging to the composite collection alone."),
]
ORIGINAL = {4: "The editor corrcted the text and revised it."}
#: surface, words of its one reading as (spelling, lemma)
REGISTER = {
    "a priori": [("a", "a"), ("priori", "priori")],
    "between": [(None, None)],
    "betwixt": [("between", "between")],
    "cause": [(None, None)],
    "causes": [("causes", "cause")],
    "connection": [(None, None)],
    "connexion": [("connection", "connection")],
    "effect": [(None, None)],
    "effects": [("effects", "effect")],
    "encrease": [("increase", "increase")],
    "increase": [(None, None)],
    "passion": [(None, None)],
    "passions": [("passions", "passion")],
}


def build(spark, editions=EDITIONS, units=UNITS, register=REGISTER, original=ORIGINAL, members=((4, 2),), host="test", more=()) -> Corpus:
    ed = spark.createDataFrame([(i, host, w, e, [host], [host], c) for i, w, e, c in editions], "edition_id long, host_slug string, work string, edition string, authors array<string>, author_names array<string>, canonical boolean")
    rows = [(n, e, p, b, t, original.get(n)) for n, (e, p, b, t) in enumerate(units, 1)]
    u = spark.createDataFrame([(n, e, p, None, b, b == "title", o is not None, t, o) for n, e, p, b, t, o in rows], "unit_id long, edition_id long, path_key string, section_title string, block_id string, is_title boolean, has_editorial boolean, text_edited string, text_original string")

    def tokens(column):
        t = from_documents(u.filter(F.col(column).isNotNull()).select(F.col("unit_id").alias("doc_id"), F.col(column).alias("text")))
        t = t.select(F.col("doc_id").alias("unit_id"), "pos", "surface", "is_capital", F.lit(0).alias("reading_idx"), F.lit(0).cast("long").alias("start_char"), F.lit(0).cast("long").alias("end_char"))
        return t.join(u.select("unit_id", "edition_id"), "unit_id").select("edition_id", "unit_id", "pos", "surface", "is_capital", "reading_idx", "start_char", "end_char")

    edited = tokens("text_edited")
    u = u.join(edited.groupBy("unit_id").agg(F.count("*").alias("token_count")), "unit_id", "left").na.fill(0, ["token_count"])
    r = [(s, 0, i, sp, le) for s, ws in register.items() for i, (sp, le) in enumerate(ws)]
    rd = spark.createDataFrame(r + list(more), "surface string, reading_idx int, word_idx int, spelling string, lemma string")
    m = spark.createDataFrame(list(members), "edition_id long, member_id long")
    works = spark.createDataFrame([(host, w, [host], w, next(e for _, x, e, c in editions if x == w and c)) for w in sorted({w for _, w, _, _ in editions})], "host_slug string, work string, author_slugs array<string>, title string, canonical_slug string")
    authors = spark.createDataFrame([(host, "Author"), ("other", "Other")], "slug string, surname string")
    # Staged: of tables in files Spark knows how small they are.
    small = lambda df: stage(df.coalesce(1), "fixture")
    return compiled(Corpus(small(ed), small(u), small(edited), small(tokens("text_original")), small(rd), small(m), small(works), small(authors)))
