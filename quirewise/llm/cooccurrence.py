"""Problem 4: items that appear together in a record more often than chance.

Pair counts are exact. Chance is the bipartite configuration model, the null that honours each item's frequency
and each basket's size: item i lies in basket u with probability x_u y_i / (1 + x_u y_i), x and y fitted so that
all expected frequencies and sizes are the real ones. A pair's number of shared baskets is then a sum of unequal
Bernoulli variables; its upper tail (Poisson-binomial, by saddle point) is the surprise, and false discoveries
are controlled over all pairs of items (Benjamini-Hochberg).

Scale. Every pair that shares a basket is counted and scored, as the step-up rule ranks them all.
Equal baskets are counted once, with their number. Baskets of more than BLOCK items are cut into blocks by the items' hash:
a row holds two blocks of a basket, so none grows with a basket, and rows are spread anew. Pairs are combined in the task that makes them. The model knows
items and baskets only by their degree: the tables that reach the driver have a row for each distinct degree up to EXACT,
beyond it one for each class 1/EXACT wide, that is EXACT for each e-fold, 4,300 for degrees up to 10^9; the fit goes through
the classes' matrix in strips. Pairs of like degrees and number have one tail, worked out once and joined back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirewise.session import fits, join_lookup, stage, stage_bucketed
from quirewise.sources.corpus import run_tokens

BLOCK, EXACT, STRIP, FLUSH = 512, 256, 512, 4_000_000
LEAST, LIFT, FALSE_SHARE = 6, 20, 0.01


def degree_class(d: Column) -> Column:
    """The degree itself up to EXACT, beyond it the lower end of its class."""
    step = F.floor(F.log(d / F.lit(float(EXACT))) * EXACT)
    return F.when(d <= EXACT, d.cast("double")).otherwise(F.lit(float(EXACT)) * F.exp(step / F.lit(float(EXACT))))


def fit_null(d: np.ndarray, m: np.ndarray, f: np.ndarray, n: np.ndarray, rounds: int = 500, close: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """x of the basket classes (degree d, m of them), y of the item classes (degree f, n of them)."""
    total = (d * m).sum()
    x, y = d / math.sqrt(total), f / math.sqrt(total)

    def sums(of: np.ndarray, weight: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.concatenate([(weight * by / (1 + of[at : at + STRIP, None] * by)).sum(1) for at in range(0, len(of), STRIP)])

    for _ in range(rounds):
        new = d / np.maximum(sums(x, n, y), 1e-300)
        y = f / np.maximum(sums(y, m, new), 1e-300)
        # an item in all baskets, or a basket of all items, has no finite solution
        new, y = np.minimum(new, 1e12), np.minimum(y, 1e12)
        moved = np.max(np.abs(new - x) / np.maximum(x, 1e-300))
        x = new
        if moved < close:
            break
    return x, y


def log_mills(w: np.ndarray) -> np.ndarray:
    """(1 - Phi(w)) / phi(w) for w >= 0: by erfc where it holds, else by a continued fraction."""
    small = np.minimum(w, 5.0)
    near = np.array([math.erfc(v / math.sqrt(2)) / 2 for v in small]) / (np.exp(-small * small / 2) / math.sqrt(2 * math.pi))
    far = np.maximum(w, 1.0)
    c = far.copy()
    for k in range(40, 0, -1):
        c = far + k / c
    return np.where(w < 5, near, 1 / c)


def tail_log10(n: np.ndarray, p: np.ndarray, m: np.ndarray, rounds: int = 60) -> np.ndarray:
    """log10 P(X >= n) of X, the sum of m[j] Bernoulli variables of p[:, j]. By Lugannani and Rice's saddle point with
    its correction for lattices; 0 where n isn't above the mean by more than rounding."""
    mean, top = (p * m).sum(1), m.sum()
    out = np.zeros(len(n))
    todo = np.flatnonzero((n > mean * (1 + 1e-6)) & (n > 0))
    if not len(todo):
        return out
    one = n[todo] == 1  # in closed form
    out[todo[one]] = np.log10(np.maximum(-np.expm1((m * np.log1p(-np.minimum(p[todo[one]], 1 - 1e-16))).sum(1)), 1e-300))
    todo = todo[~one]
    if not len(todo):
        return out
    k, q = n[todo].astype(float), p[todo]
    sure = k >= (m * (q > 0)).sum(1)
    k = np.where(sure, k - 0.5, k)  # all of them at once: the saddle point lies at infinity
    t = np.log(np.maximum(k, 1e-9) / np.maximum(mean[todo], 1e-300))
    for _ in range(rounds):
        e = q * np.exp(t)[:, None]
        r = e / (1 - q + e)
        step = ((m * r).sum(1) - k) / np.maximum((m * r * (1 - r)).sum(1), 1e-300)
        step = np.clip(step, -2, 2)
        t = np.maximum(t - step, 1e-9)
        if np.max(np.abs(step)) < 1e-10:
            break
    e = q * np.exp(t)[:, None]
    r = e / (1 - q + e)
    cumulant = (m * np.log1p(q * np.expm1(t)[:, None])).sum(1)
    var = np.maximum((m * r * (1 - r)).sum(1), 1e-300)
    w = np.sqrt(np.maximum(2 * (t * k - cumulant), 0))
    u = (1 - np.exp(-t)) * np.sqrt(var)
    phi = -w * w / 2 - math.log(2 * math.pi) / 2
    inner = np.where(w > 1e-3, log_mills(w) + 1 / np.maximum(u, 1e-300) - 1 / np.maximum(w, 1e-300), math.sqrt(2 * math.pi) / 2)
    out[todo] = np.minimum((phi + np.log(np.maximum(inner, 1e-300))) / math.log(10), 0.0)
    return out


def _pairs_of(left: pa.Array, right: pa.Array, times: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of a row's block, or where there is a right block, of one of the left with one of the right; rows of like
    size at once."""
    lo, ro = left.offsets.to_numpy().astype(np.int64), right.offsets.to_numpy().astype(np.int64)
    lv, rv = left.values.to_numpy(), right.values.to_numpy()
    ln, rn = np.diff(lo), np.diff(ro)
    for a in np.unique(ln[rn == 0]):
        i, j = np.triu_indices(a, 1)
        rows = np.flatnonzero((ln == a) & (rn == 0))
        per = max(1, FLUSH // max(len(i), 1))
        for at in range(0, len(rows), per) if len(i) else ():
            r = rows[at : at + per]
            yield lv[lo[r][:, None] + i].ravel(), lv[lo[r][:, None] + j].ravel(), np.repeat(times[r], len(i))
    for r in np.flatnonzero(rn > 0):  # of baskets of more than one block
        x, y = np.meshgrid(lv[lo[r] : lo[r + 1]], rv[ro[r] : ro[r + 1]])
        yield np.minimum(x, y).ravel(), np.maximum(x, y).ravel(), np.full(x.size, times[r])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def combined() -> Iterator[pa.RecordBatch]:
        t = pa.table(dict(zip("abn", (np.concatenate(x) for x in zip(*held)))))
        t = t.group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).select(["a", "b", "n_sum"]).rename_columns(["a", "b", "n"])
        yield from t.combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        for part in _pairs_of(batch.column("left"), batch.column("right"), batch.column("times").to_numpy()):
            held.append(part)
            size += len(part[0])
            if size >= FLUSH:
                yield from combined()
                held, size = [], 0
    if held:
        yield from combined()


def _surprise(d: np.ndarray, m: np.ndarray, x: np.ndarray, f: np.ndarray, y: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = np.stack([b.column(c).to_numpy().astype(float) for c in ("low", "high", "n")], 1)
            mean, tail = np.zeros(len(k)), np.zeros(len(k))
            for at in range(0, len(k), 2000):
                ya, yb = (y[np.clip(np.searchsorted(f, k[at : at + 2000, c] - 1e-9), 0, len(f) - 1)][:, None] for c in (0, 1))
                p = (x * ya / (1 + x * ya)) * (x * yb / (1 + x * yb))
                mean[at : at + 2000] = (p * m).sum(1)
                tail[at : at + 2000] = tail_log10(k[at : at + 2000, 2], p, m)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("low", "high", "n", "pairs")), pa.array(mean), pa.array(tail)], names=["low", "high", "n", "pairs", "expected", "log10_p"])

    return run


def discovery_limit(log10_p: np.ndarray, counts: np.ndarray, tests: float, share: float) -> float:
    """The largest log10 p that the step-up rule accepts; minus infinity if none. log10_p are upper ends of bins."""
    o = np.argsort(log10_p)
    rank = np.cumsum(counts[o])
    ok = log10_p[o] + math.log10(max(tests, 1)) <= np.log10(rank) + math.log10(share)
    return float(log10_p[o][np.flatnonzero(ok)[-1]]) if ok.any() else -math.inf


def together(incidence: DataFrame, least: int = 1, lift: float = 0, false_share: float = FALSE_SHARE, block: int = BLOCK) -> DataFrame:
    """item_a < item_b, n, a, b, baskets, expected, lift, log10_p, significant of all pairs of items that share a basket; where
    least or lift is given, only of those with n >= least shared baskets and n * baskets >= lift * a * b (n, a and b exact).

    incidence: basket (a whole number), item (a string); repeated rows count once, null baskets or items take no part.
    expected and log10_p come from the fitted null; significant: accepted at a false discovery share of false_share
    over all pairs of items, whatever least and lift (those that share no basket count as tests that failed). Other
    columns are ignored; an empty table gives no rows.
    """
    spark = incidence.sparkSession
    inc = incidence.select(F.col("basket").cast("long").alias("basket"), F.col("item").cast("string").alias("item")).filter("basket IS NOT NULL AND item IS NOT NULL").groupBy("basket", "item").agg(F.lit(1).alias("one")).drop("one")
    inc = stage_bucketed(inc, "incidence", "basket")
    items = stage(inc.groupBy("item").agg(F.count(F.lit(1)).alias("df")).withColumn("id", F.monotonically_increasing_id()), "items")
    sizes = inc.groupBy("basket").agg(F.count(F.lit(1)).alias("size"))
    of_size = sizes.groupBy(degree_class(F.col("size")).alias("k")).agg(F.count(F.lit(1)).alias("m"), F.avg("size").alias("d"), F.max("size").alias("most")).orderBy("k").toPandas()
    of_freq = items.groupBy(degree_class(F.col("df")).alias("k")).agg(F.count(F.lit(1)).alias("m"), F.avg("df").alias("d")).orderBy("k").toPandas()
    baskets, kinds, largest = int(of_size.m.sum()), int(of_freq.m.sum()), of_size.most.max()
    d, m, f, freq = (c.to_numpy(float) for c in (of_size.d, of_size.m, of_freq.d, of_freq.m))
    x, y = fit_null(d, m, f, freq) if baskets else (d, f)
    few = fits(items)
    held = join_lookup(inc, items.select("item", "id"), "item", few=few)
    in_blocks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("basket")) / F.lit(block)).cast("int") if largest > block else F.lit(1)
    cut = held.select("basket", "id", in_blocks.alias("blocks")).withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cut = cut.groupBy("basket", "blocks", "i").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    none = F.array().cast("array<bigint>")
    rows = cut.filter("blocks = 1 AND size(ids) > 1").groupBy("ids").agg(F.count(F.lit(1)).alias("times")).select(F.col("ids").alias("left"), none.alias("right"), "times")
    if largest > block:  # two blocks of a basket make a row, each one with itself too
        many = cut.filter("blocks > 1")
        one = many.select("basket", F.col("ids").alias("left"), "i", F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j"))
        other = many.select("basket", F.col("ids").alias("right"), F.explode(F.sequence(F.lit(0), "i")).alias("i"), F.col("i").alias("j"))
        two = one.join(other, ["basket", "i", "j"]).select("left", F.when(F.col("i") == F.col("j"), none).otherwise(F.col("right")).alias("right"), F.lit(1).cast("long").alias("times"))
        rows = rows.unionByName(two)
    counted = rows.repartition(F.xxhash64("left", "right")).mapInArrow(_count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    with_item = lambda t, s, *cols: join_lookup(t, items.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in cols)), s, few=few)
    known = stage(with_item(with_item(counted, "a", "df"), "b", "df"), "pairs")
    classes = [degree_class(F.col(c)) for c in ("df_a", "df_b")]
    known = known.withColumns({"low": F.least(*classes), "high": F.greatest(*classes)})
    tails = known.groupBy("low", "high", "n").agg(F.count(F.lit(1)).alias("pairs"))
    scored = stage(tails.mapInArrow(_surprise(d, m, x, of_freq.k.to_numpy(float), y), "low double, high double, n long, pairs long, expected double, log10_p double"), "scored")
    bins = scored.groupBy(F.ceil(F.col("log10_p") * 1000).alias("bin")).agg(F.sum("pairs").alias("pairs")).toPandas()  # a bin each thousandth of a decade
    limit = discovery_limit(bins["bin"].to_numpy(float) / 1000, bins["pairs"].to_numpy(), kinds * (kinds - 1) / 2, false_share)
    known = known.filter((F.col("n") >= least) & (F.col("n") * baskets >= F.lit(lift) * F.col("df_a") * F.col("df_b")))
    swap = F.col("item_a") > F.col("item_b")
    pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    known = join_lookup(known, scored.drop("pairs"), ["low", "high", "n"])  # most pairs may be of one class
    return with_item(with_item(known, "a", "item"), "b", "item").select(
        pick("item_a", "item_b").alias("item_a"),
        pick("item_b", "item_a").alias("item_b"),
        "n",
        pick("df_a", "df_b").alias("a"),
        pick("df_b", "df_a").alias("b"),
        F.lit(baskets).cast("long").alias("baskets"),
        "expected",
        (F.col("n") / F.col("expected")).alias("lift"),
        "log10_p",
        (F.ceil(F.col("log10_p") * 1000) / 1000 <= F.lit(limit)).alias("significant"),
    )


def unit_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_tokens(spark, sf_dir).select(F.col("unit_id").alias("basket"), F.col("surface").alias("item"))


def p4_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    return together(unit_surfaces(spark, sf_dir)).withColumnsRenamed({"item_a": "surface_a", "item_b": "surface_b"})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = p4_together(spark, sf_dir)
    return t.filter((F.col("n") >= LEAST) & (F.col("n") * F.col("baskets") >= LIFT * F.col("a") * F.col("b"))).select("surface_a", "surface_b")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """surface_a, surface_b, n, a, b of every two surfaces of one unit."""
    return p4_together(spark, sf_dir).select("surface_a", "surface_b", "n", "a", "b")
