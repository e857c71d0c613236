"""Problem 1: how often every term, or run of terms, occurs, and in how many records.

Suffix-sorted counting. Every position of a record starts a suffix, truncated to `sigma` terms. Suffixes are routed by
their terms and sorted in reverse lexicographic order, so that whatever shares a prefix stands together; one pass over the
sorted rows counts all prefixes with a stack whose entry k holds the open prefix of k + 1 terms, its occurrences and its
records. Nothing else counts: a term's figures are those of the prefix of length 1.

Records. A stack that gathers sets of records grows with them. Here each record marks, of its suffixes that share a prefix,
the first: a suffix carries for each length k how many records have it as their first with that prefix of k terms. Those
numbers add up, over suffixes and over records, to the number of records of the prefix, so the stack holds sigma rows of
three numbers, whatever the corpus.

Scale. As all a suffix carries adds up, equal suffixes are combined before they travel, and a frequent first term is
spread over its continuations: a route is the hash of the suffix, whose partial counts of a prefix are added at the end.
With sigma = 1 a term is its own suffix, and after the combination one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirewise.sources.corpus import run_tokens, table, token_units, with_lemmas

RARE_UNITS, COMMON_SHARE = 2, 0.2


def _changes(col: pa.Array) -> np.ndarray:
    """Rows at which a column differs from the row before; the first is one."""
    out = np.ones(len(col), bool)
    if len(col) > 1:
        before, here = col.slice(0, len(col) - 1), col.slice(1)
        out[1:] = pc.or_(pc.fill_null(pc.not_equal(before, here), False), pc.xor(before.is_null(), here.is_null())).to_numpy(zero_copy_only=False)
    return out


def _stack(sigma: int):
    """Sorted suffixes with n and first_1 .. first_sigma -> their prefixes with occurrences and records. A prefix that is open
    at the end of a batch stays on the stack; within a batch, what is pushed and popped again is counted by runs."""
    names = [f"term_{k + 1}" for k in range(sigma)]
    schema = pa.schema([("kind", pa.string()), *((x, pa.string()) for x in names), ("occurrences", pa.int64()), ("records", pa.int64())])

    def popped(entry: tuple) -> pa.RecordBatch:
        key, n, records = entry
        row = [*key, *[None] * (sigma + 1 - len(key)), n, records]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple | None] = [None] * sigma
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column("kind"), *(b.column(x) for x in names)]
            changed, n = _changes(cols[0]), b.column("n").to_numpy()
            for k in range(sigma):
                changed = changed | _changes(cols[k + 1])
                first = np.flatnonzero(changed)
                times = np.add.reduceat(n, first)
                records = np.add.reduceat(b.column(f"first_{k + 1}").to_numpy(), first)
                key = tuple(c[0].as_py() for c in cols[: k + 2])
                if stack[k] is not None:
                    if stack[k][0] == key:
                        times[0] += stack[k][1]
                        records[0] += stack[k][2]
                    else:
                        yield popped(stack[k])
                last = int(first[-1])
                key = tuple(c[last].as_py() for c in cols[: k + 2])
                stack[k] = (key, int(times[-1]), int(records[-1])) if key[-1] is not None else None
                done = cols[k + 1].take(pa.array(first[:-1])).is_valid().to_numpy(zero_copy_only=False)
                at = pa.array(first[:-1][done])
                if len(at):
                    out = [c.take(at) if j <= k + 1 else pa.nulls(len(at), pa.string()) for j, c in enumerate(cols)]
                    yield pa.RecordBatch.from_arrays([*out, pa.array(times[:-1][done]), pa.array(records[:-1][done])], schema=schema)
        for entry in stack:
            if entry is not None:
                yield popped(entry)

    return run


def ngram_counts(terms: DataFrame, record: str, pos: list[str], term: str, kind: str, sigma: int = 1) -> DataFrame:
    """kind, ngram ARRAY<STRING>, occurrences, records: of all runs of 1 to sigma terms.

    terms: one row a term; `record` a whole number, `pos` orders a record's terms, `kind` keeps several
    vocabularies apart. Rows with a null term or record are left out (a run doesn't bridge them: a null term
    takes no position, its neighbours become adjacent); null kinds count as ''. Rows with equal positions are
    taken in the order of their terms. Other columns are ignored, whatever their names. An empty table gives
    no rows.
    """
    t = terms.select(F.coalesce(F.col(kind).cast("string"), F.lit("")).alias("kind"), F.col(record).cast("long").alias("record"), F.col(term).alias("term_1"), *(F.col(p).alias(f"__p{i}") for i, p in enumerate(pos))).filter("term_1 IS NOT NULL AND record IS NOT NULL")
    if sigma > 1:
        w = Window.partitionBy("record", "kind").orderBy(*(f"__p{i}" for i in range(len(pos))), "term_1")
        t = t.withColumns({f"term_{k + 1}": F.lead("term_1", k).over(w) for k in range(1, sigma)})
    return count_suffixes(t, sigma)


def count_suffixes(suffixes: DataFrame, sigma: int) -> DataFrame:
    """ngram_counts() of the suffixes themselves: record, kind, term_1 .. term_sigma, null after a record's last term."""
    names = [f"term_{k + 1}" for k in range(sigma)]
    # Where the rows are partitioned by the record already, nothing up to the combination needs an exchange.
    if sigma == 1:
        rows = suffixes.groupBy("record", "kind", "term_1").agg(F.count(F.lit(1)).alias("n")).withColumn("first_1", F.lit(1))
    else:
        # Equal prefixes of a record shall stand together, in whatever order: their hashes compare faster than their terms.
        prefix = {f"__h{k}": F.xxhash64("kind", *names[:k]) for k in range(1, sigma + 1)}
        t = suffixes.select("record", "kind", *names).withColumns(prefix)
        by = Window.partitionBy("record").orderBy("__h1", "kind", *(x for k in range(1, sigma + 1) for x in ([] if k == 1 else [f"__h{k}"]) + [names[k - 1]]))
        same = F.lag("kind").over(by).eqNullSafe(F.col("kind"))
        first = []
        for k, x in enumerate(names):
            same = same & F.lag(x).over(by).eqNullSafe(F.col(x))
            first.append((~same).cast("int").alias(f"first_{k + 1}"))
        rows = t.select("kind", *names, F.lit(1).alias("n"), *first)
    sums = [F.sum(c).alias(c) for c in ("n", *(f"first_{k + 1}" for k in range(sigma)))]
    routed = rows.groupBy("kind", *names).agg(*sums)
    ordered = routed.sortWithinPartitions("kind", *(F.col(x).desc_nulls_last() for x in names))
    schema = "kind string, " + ", ".join(f"{x} string" for x in names) + ", occurrences long, records long"
    part = ordered.mapInArrow(_stack(sigma), schema)
    return (
        part.groupBy("kind", *names)
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        .select("kind", F.array_compact(F.array(*names)).alias("ngram"), "occurrences", "records")
    )


def marked(counts: DataFrame, total, rare: int = RARE_UNITS, common: float = COMMON_SHARE) -> DataFrame:
    """counts with `mark`: 'rare' in at most `rare` records, 'common' in more than the share `common` of `total`
    records (a Column), else null. A term that is both is rare."""
    return counts.withColumn("mark", F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common) * total, "common"))


def token_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count_suffixes() of the folded surfaces and the lemmas of the counted tokens, two terms long: what follows is taken
    from the next token of the unit before the lemmas are set apart."""
    t = with_lemmas(run_tokens(spark, sf_dir).select("unit_id", "indexed_at", "pos", "surface", "reading_idx"), table(spark, sf_dir, "readings"))
    # In the order in which the rows that count were picked: they need not be sorted again.
    w = Window.partitionBy("unit_id").orderBy(F.col("indexed_at").desc_nulls_last(), "pos")
    t = t.withColumns({"after": F.lead("surface").over(w), "lemma_after": F.lead(F.col("lemmas")[0]).over(w)})
    one = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("term_1"), b.alias("term_2"))
    lemmas = F.transform("lemmas", lambda x, i: one("lemma", x, F.coalesce(F.get("lemmas", i + 1), F.col("lemma_after"))))
    suffixes = F.explode(F.concat(F.array(one("surface", F.col("surface"), F.col("after"))), lemmas))
    return count_suffixes(t.select(F.col("unit_id").alias("record"), suffixes.alias("x")).select("record", "x.*"), 2)


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term_kind, term, occurrences, units, mark of every folded surface and lemma of the counted tokens."""
    c = token_ngrams(spark, sf_dir).filter(F.size("ngram") == 1)
    total = token_units(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    return marked(c, total).select(F.col("kind").alias("term_kind"), F.col("ngram")[0].alias("term"), "occurrences", F.col("records").alias("units"), "mark")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir).filter("mark IS NOT NULL").select("term_kind", "term", "mark")


def p1_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir)


def p1_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term_kind, term, next (null for a single term), occurrences, units of every term and of each two that follow each
    other within a unit."""
    c = token_ngrams(spark, sf_dir)
    return c.select(F.col("kind").alias("term_kind"), F.col("ngram")[0].alias("term"), F.get("ngram", F.lit(1)).alias("next"), "occurrences", F.col("records").alias("units"))
