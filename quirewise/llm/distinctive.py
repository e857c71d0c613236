"""Problem 2: how distinctive a term is of its record.

Parsimonious language model. A record's terms are a mixture of its own model and of the whole collection's;
expectation-maximisation separates them:

    E   e(t) = c(t) * a * p(t) / (a * p(t) + (1 - a) * q(t))
    M   p(t) = e(t) / sum of e

with c the count in the record, q the share of the term in the collection and p started at the record's own
shares. Terms that the collection explains lose their mass to those that it doesn't; the converged p ranks a
record's terms, ties by term.

Candidates. p2_found asks for a least TF-IDF weight w, normalised so that a record's squared weights sum to 1. The terms
are taken in the rank of the model, and `rest` says how much of that sum the term and all ranked after it hold: once it
falls below w * w, no term from there on can weigh w. So the candidates are the terms with rest >= w * w, and no term that
qualifies is lost, however the model ranks; the weight of the candidates is then checked exactly.

Scale. Counts are combined per unit before they travel to their record, so a record's rows are its distinct
terms, which the vocabulary bounds. The counted table is staged in buckets by record: neither the background
join nor the model needs another exchange of it. Background shares of terms found in many records are
broadcast: there can be at most rows / least of them; all others are joined by an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirewise.session import fits, join_lookup, stage, stage_bucketed
from quirewise.sources.corpus import latest, run_tokens, table

#: Weight of a record's own model in the mixture, and the change of p at which it has converged.
OWN, CONVERGED = 0.1, 1e-6
#: At most so many rows of the background are broadcast.
BROADCAST_ROWS, HOT_BYTES = 400_000, 64
LEAST_TOKENS, LEAST_WEIGHT = 60, 0.3


def parsimonious(c: np.ndarray, q: np.ndarray, starts: np.ndarray, own: float = OWN, converged: float = CONVERGED) -> np.ndarray:
    """Converged p of all records of a batch at once, however many steps that takes: starts holds the first row of each."""
    sizes = np.diff(np.append(starts, len(c)))
    per = lambda x: np.repeat(np.add.reduceat(x, starts), sizes)
    p = c / per(c)
    live = np.arange(len(c))
    cc, qq, pp, at, size = c, (1 - own) * q, p.copy(), starts, sizes
    while len(live):
        e = cc * own * pp / (own * pp + qq)
        new = e / np.repeat(np.add.reduceat(e, at), size)
        moved = np.maximum.reduceat(np.abs(new - pp), at) > converged
        p[live] = pp = new
        if not moved.all():  # records that have converged rest
            rows = np.repeat(moved, size)
            live, cc, qq, pp, size = live[rows], cc[rows], qq[rows], pp[rows], size[moved]
            at = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else np.zeros(0, np.int64)
    return p


def ranked(p: np.ndarray, w: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rank of each row within its record by p, from 1, equal p in the order of the rows; rest: the squared weights of the
    row and of those ranked after it in its record."""
    size = np.diff(np.append(starts, len(p)))
    record = np.repeat(np.arange(len(starts)), size)
    order = np.lexsort((-p, record))  # keeps the order of rows
    rank, rest = np.empty(len(p), np.int32), np.empty(len(p))
    rank[order] = np.arange(len(p)) - np.repeat(starts, size) + 1
    # From the end of each record, so that the sums that matter are those of few and small numbers.
    square = (w * w)[order]
    back = np.cumsum(square[::-1])[::-1]
    after = np.append(back, 0.0)[np.append(starts[1:], len(p))]
    rest[order] = back - np.repeat(after, size)
    return rank, rest


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole records from batches sorted by the key."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        k = t[key].to_numpy()
        last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if last or (held and held[-1][key][0].as_py() != k[0]):
            if done := [*held, t.slice(0, last)]:
                yield pa.concat_tables(done).combine_chunks()
            held = [t.slice(last)]
        else:
            held.append(t)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _model(own: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, "record"):
            if not t.num_rows:
                continue
            rec = t["record"].to_numpy()
            starts = np.flatnonzero(np.append(True, rec[1:] != rec[:-1]))
            c = t["c"].to_numpy().astype(float)
            p = parsimonious(c, t["q"].to_numpy(), starts, own)
            w = (1 + np.log(c)) * t["idf"].to_numpy()
            size = np.diff(np.append(starts, len(c)))
            w = w / np.repeat(np.sqrt(np.add.reduceat(w * w, starts)), size)
            rank, rest = ranked(p, w, starts)
            out = pa.table({"record": t["record"], "term": t["term"], "c": t["c"], "tokens": t["tokens"], "p": p, "rank": rank, "rest": rest, "weight": w})
            yield from out.combine_chunks().to_batches()

    return run


def distinctive(counts: DataFrame, own: float = OWN, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """record, term, c, tokens, p, rank, rest, weight of every term of every record.

    counts: record (a whole number), term, c > 0, one row each; rows with a null record or term, or without a
    positive count, take no part. p: converged share in the record's own model; no term is dropped, however
    small its share, so no later check loses one. rank: by p, from 1, ties by term; rest: the squared weights of the
    term and of all that rank after it. weight: (1 + ln c) * (ln((N + 1) / (df + 1)) + 1), normalised to
    length 1 over the record. Further columns are ignored. An empty table gives no rows.
    """
    c = counts.select(F.col("record").cast("long").alias("record"), F.col("term").cast("string").alias("term"), F.col("c").cast("long").alias("c")).filter("record IS NOT NULL AND term IS NOT NULL AND c > 0")
    c = stage_bucketed(c, "record_terms", "record")
    back = stage(c.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("c").alias("cf")), "background")
    total, terms = back.agg(F.sum("cf"), F.count(F.lit(1))).first()
    records = c.select("record").distinct().count()
    q = F.col("cf") / F.lit(float(total or 1))
    idf = F.log(F.lit(records + 1.0) / (F.col("df") + 1)) + 1
    back = back.select("term", "df", q.alias("q"), idf.alias("idf"))
    cols = ["record", "term", "c", "q", "idf"]
    if terms <= broadcast_rows and fits(back.select("term"), broadcast_rows):
        joined = c.join(F.broadcast(back), "term").select(*cols)
    else:
        # A term in more than `least` records is one of at most broadcast_rows (and of HOT_BYTES at most, so that the
        # bytes are bounded too); the others travel by term, the longer ones, which may be frequent, spread.
        least = max(1, -(-c.count() // broadcast_rows))
        is_hot = (F.col("df") > least) & (F.octet_length("term") <= HOT_BYTES)
        hot, cold = back.filter(is_hot), back.filter(~is_hot)
        known = c.join(F.broadcast(hot), "term", "left")
        rest, long = known.filter("q IS NULL").select("record", "term", "c"), F.octet_length("term") > HOT_BYTES
        near = rest.filter(~long).join(cold.filter(~long), "term")
        far = join_lookup(rest.filter(long), cold.filter(long), "term", few=False)
        joined = known.filter("q IS NOT NULL").select(*cols).unionByName(near.select(*cols)).unionByName(far.select(*cols))
    schema = "record long, term string, c long, tokens long, p double, rank int, rest double, weight double"
    # The window both keeps the buckets of the scan together and leaves the rows sorted by record and term.
    by = Window.partitionBy("record").orderBy("term").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = joined.withColumn("tokens", F.sum("c").over(by))
    return whole.mapInArrow(_model(own), schema)


def section_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record (doc_id), term (folded surface), c of the counted tokens of each section document."""
    docs = table(spark, sf_dir, "topic_docs").dropDuplicates()
    units = latest(table(spark, sf_dir, "units").select("unit_id", "edition_id", "path_key", "extracted_at"), "unit_id", "extracted_at")
    of_unit = units.join(docs, ["edition_id", "path_key"]).select("unit_id", "doc_id").distinct()
    tokens = run_tokens(spark, sf_dir).select("unit_id", "surface").groupBy("unit_id", "surface").agg(F.count(F.lit(1)).alias("n"))
    per = tokens.join(of_unit.hint("shuffle_hash"), "unit_id")
    return per.repartition("doc_id").groupBy("doc_id", "surface").agg(F.sum("n").alias("c")).select(F.col("doc_id").alias("record"), F.col("surface").alias("term"), "c")


def p2_distinctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distinctive(section_surfaces(spark, sf_dir))
    return d.select(F.col("record").alias("doc_id"), F.col("term").alias("surface"), "c", "tokens", "p", "rank", "weight")


def candidates(found: DataFrame, least: float) -> DataFrame:
    """Of distinctive() the terms that may weigh `least` or more, by their rank in the model: none after them can. (rest is
    a difference of sums, hence the small allowance for their rounding.)"""
    return found.filter(F.col("rest") >= least * least - 1e-6)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = candidates(distinctive(section_surfaces(spark, sf_dir)), LEAST_WEIGHT)
    d = d.filter((F.col("tokens") >= LEAST_TOKENS) & (F.col("weight") >= LEAST_WEIGHT))
    return d.select(F.col("record").alias("doc_id"), F.col("term").alias("surface"))
