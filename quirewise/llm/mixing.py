"""Problem 7: a mixture in which each source has its target share of the tokens.

Every source first gives whole passes over its documents, as many as fit into its budget; what remains of the
budget is filled by a choice of documents, a subset sum. Documents count only by their exact token length, so
the choice is a bounded knapsack over (length, documents of that length), solved by dynamic programming over a bit set of
reachable sums, in units of the lengths' greatest common divisor. A budget of more than the window (64 of the longest
documents, 16,384 tokens at least, never less than 4 of the longest) is first filled in proportion, then from the longest
down, to half of the window; the programme fills the rest, from what documents are left, exactly. `gap` tells how many
tokens short of its budget each source stays: 0 shows that the sum is the best there is, as does a budget that fits into
the window. Of each length so many documents as chosen are taken, in seeded order.

Scale. What reaches one task is a source's histogram of lengths, which has at most sqrt(2 * tokens) rows; the
programme's width depends on the longest document alone. Seeded order needs no sort of a whole (source, length) group, which
may hold a third of all rows: documents fall into SLICES slices of their hash, whole slices are taken by counts and only
the slice on the border is ranked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirewise.llm.encoding import token_counts
from quirewise.session import fits, join_lookup, stage
from quirewise.sources.corpus import table

WINDOW, LONGEST, MOST_BITS = 16_384, 64, 1 << 24
SLICES, SEED = 1024, 42


def source_key(c: Column) -> Column:
    """Trimmed of any white space, in lower case."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{IsWhite_Space}]+|[\s\p{IsWhite_Space}]+$", ""))


def window_of(longest: int) -> int:
    """Width of the programme for the longest of the documents."""
    return max(WINDOW, 4 * longest, min(LONGEST * longest, MOST_BITS))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int | None = None) -> np.ndarray:
    """How many documents of each length to take so that their tokens come as near to the budget from below as
    the programme finds: exactly the best sum if all of it fits into the window, else the best that completes
    the filling before it. Lengths are positive and distinct."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    unit = int(np.gcd.reduce(lengths))
    order = np.argsort(-lengths)
    size, have = lengths[order].astype(np.int64) // unit, counts[order].astype(np.int64)
    window = window_of(int(size[0])) if window is None else window
    total = int((size * have).sum())
    left = int(budget) // unit
    took = np.zeros(len(size), np.int64)
    if left >= total:
        took = have.copy()
    elif left > 0:
        if left > window:
            took = np.floor(have * ((left - window / 2) / total)).astype(np.int64)
            left -= int((size * took).sum())
            for i in range(len(size)):
                if left <= window:
                    break
                add = min(int(have[i] - took[i]), max(0, left - window // 2) // int(size[i]))
                took[i] += add
                left -= add * int(size[i])
        # Reachable sums up to left, one bit each; binary splitting of each length's documents. What adds no sum is no step.
        reach, mask, steps = 1, (1 << (left + 1)) - 1, []
        for i in range(len(size)):
            free = min(int(have[i] - took[i]), left // int(size[i]))
            k = 1
            while free > 0 and not reach >> left & 1:
                k = min(k, free)
                more = reach | (reach << (k * int(size[i]))) & mask
                if more == reach:
                    break
                steps.append((i, k, reach))
                reach = more
                free -= k
                k *= 2
            if reach >> left & 1:
                break
        at = reach.bit_length() - 1
        for i, k, before in reversed(steps):
            if not before >> at & 1:
                took[i] += k
                at -= k * int(size[i])
    out = np.zeros(len(size), np.int64)
    out[order] = took
    return out


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source: its histogram (n_tokens, docs; null where it has no document), share, repeats, total."""
    share, repeats, total = float(pdf.target_share.iloc[0]), int(pdf.max_repeats.iloc[0]), int(pdf.total.iloc[0])
    h = pdf[pdf.n_tokens.notna() & (pdf.n_tokens > 0)]
    lengths, counts = h.n_tokens.to_numpy(np.int64), h.docs.to_numpy(np.int64)
    size = int((lengths * counts).sum())
    short = share * total > repeats * size
    budget = repeats * size if short else int(share * total)
    passes = min(repeats, budget // size) if size else 0
    extra = fit_budget(lengths, counts, budget - passes * size) if passes < repeats and size else np.zeros(len(lengths), np.int64)
    out = pd.DataFrame({"n_tokens": lengths, "docs": counts, "passes": passes, "extra": extra})
    if not len(out):
        out = pd.DataFrame({"n_tokens": [0], "docs": [0], "passes": [0], "extra": [0]})
    return out.assign(source=pdf.source.iloc[0], target_share=share, max_repeats=repeats, size=size, total=total, budget=budget, short=short)


PLAN = "source string, target_share double, max_repeats int, size long, total long, budget long, short boolean, n_tokens long, docs long, passes long, extra long"


def plan_mixture(lengths: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each target source and token length of it, with the passes over the whole source and the further
    documents to take. lengths: source (a key), n_tokens, one row a document; targets: source, target_share,
    max_repeats, exact copies once. Sources that aren't listed take no part; a listed source without documents or
    tokens has one row of length 0. Documents without tokens are never needed. A null share or number of
    repeats counts as 0. budget: what a source shall give, in tokens; of a short source all that it can."""
    t = targets.select(source_key(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).cast("double").alias("target_share"), F.coalesce("max_repeats", F.lit(0)).cast("int").alias("max_repeats")).filter("source IS NOT NULL").dropDuplicates()
    h = lengths.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("docs"))
    h = h.join(F.broadcast(t.select("source")), "source", "left_semi") if fits(t) else h
    j = t.join(h, "source", "left")
    total = j.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("docs")), F.lit(0))).scalar()
    return j.withColumn("total", total).groupBy("source").applyInPandas(_plan, PLAN)


def mixture_shares(plan: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, size, total, budget, used, gap, mean_uses, real_share, short: what is really reached, and
    how many tokens each source stays short of its budget."""
    s = plan.groupBy("source", "target_share", "max_repeats", "size", "total", "budget", "short").agg(F.sum(F.col("n_tokens") * (F.col("docs") * F.col("passes") + F.col("extra"))).alias("used"))
    everything = s.agg(F.sum("used")).scalar()
    uses = F.when(F.col("size") > 0, F.col("used") / F.col("size")).otherwise(0.0)
    return s.select("source", "target_share", "max_repeats", "size", "total", "budget", "used", (F.col("budget") - F.col("used")).alias("gap"), uses.alias("mean_uses"), F.when(everything > 0, F.col("used") / everything).otherwise(0.0).alias("real_share"), "short")


def pick_documents(lengths: DataFrame, plan: DataFrame, seed: int = SEED, slices: int = SLICES) -> DataFrame:
    """doc_id, source, n_tokens, copies of every document that is used. lengths: doc_id, source, n_tokens."""
    spread = F.xxhash64(F.lit(seed), "doc_id")
    d = join_lookup(lengths, plan.filter("n_tokens > 0 AND passes + extra > 0").select("source", "n_tokens", "passes", "extra"), ["source", "n_tokens"])
    d = d.withColumns({"order": spread, "slice": F.pmod(F.shiftrightunsigned(spread, 20), F.lit(slices)).cast("int")})
    need = d.filter("extra > 0").groupBy("source", "n_tokens", "slice").agg(F.count(F.lit(1)).alias("here"), F.first("extra").alias("extra"))
    w = Window.partitionBy("source", "n_tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    need = need.withColumn("left", F.col("extra") - F.coalesce(F.sum("here").over(w), F.lit(0))).filter("left > 0")
    full = need.filter("left >= here").select("source", "n_tokens", "slice", F.lit(1).alias("more"))
    border = need.filter("left < here").select("source", "n_tokens", "slice", "left")
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens").orderBy("order", "doc_id"))
    keys = ["source", "n_tokens", "slice"]
    ranked = d.join(border, keys).withColumn("r", rank).filter("r <= left").select("doc_id", F.lit(1).alias("more"))
    base = d.join(full, keys, "left").join(ranked.withColumnRenamed("more", "one"), "doc_id", "left")
    return base.withColumn("copies", F.col("passes") + F.coalesce("more", "one", F.lit(0))).filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def source_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source (key), n_tokens. Staged, as both plan and choice read it. Rows without a source have none."""
    d = docs.select("doc_id", source_key(F.col("source")).alias("source"), "text").filter("source IS NOT NULL")
    n = token_counts(d, path=path)
    return stage(d.select("doc_id", "source").join(n, "doc_id"), "source_lengths")


def _tables(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "mix_targets")


def listed_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, targets = _tables(spark, sf_dir)
    lengths = source_lengths(docs)
    return lengths, plan_mixture(lengths, targets)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_shares(listed_plan(spark, sf_dir)[1]).filter("short").select("source")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_shares(listed_plan(spark, sf_dir)[1])


def p7_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths, plan = listed_plan(spark, sf_dir)
    return pick_documents(lengths, stage(plan, "mixture_plan"))
