"""Problem 3: for each vector, the k most similar of the collection, by cosine.

Inverted multi-index. The two halves of the unit vectors are quantised by a codebook each; a pair of centroids
is a cell. For each query the pairs are traversed in the order of their summed distances, with a heap over the
two sorted lists of centroids, until the visited cells hold `reach` vectors; these are reranked by their exact
cosines.

Scale. Equal vectors are searched once: a vector stands for all its documents, of which the k + 1 smallest ids
can be in an answer; how the answers of a vector of very many documents reach them is no hot key either. The codebooks grow
with the root of the number of vectors, so that a cell holds PER_CELL of them, up to CENTROIDS a half; they are fitted on a
sample that grows with them, and these and the populations of the cells (67 MB at most) are what reaches the driver. Cells
are put together into shards of about BLOCK vectors, by both of their centroids, so that a query travels once to each shard
that it visits, and their number depends on `reach` and not on the number of vectors: what travels is in proportion to the
vectors. A shard of more is salted into blocks, and the queries of a shard are cut into slices, so that no task holds more
than a block and a slice, whatever the skew.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirewise.session import stage
from quirewise.sources.corpus import table

#: The codebooks are fitted on at most SAMPLE vectors, or PER_CENTROID for each centroid if that is more (those of the
#: smallest hash), with SEED.
SAMPLE, PER_CENTROID, SEED, ROUNDS = 20_000, 40, 7, 12
#: Vectors of a cell on average, and centroids of a half at most.
PER_CELL, CENTROIDS = 40, 4096
#: A vector of more documents than this share of all is one of at most as many as its inverse.
HOT = 1 / 1000
#: Vectors that a query's cells hold; vectors a block and queries a slice hold.
REACH, BLOCK, SLICE = 4000, 8192, 16_384
PLACES, TOPICS, NEAREST = 9, 24, 5


def fit_codebook(a: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """k-means from distinct rows; fewer centroids if there are fewer of them."""
    rows = np.unique(a, axis=0)
    c = rows[np.random.default_rng(seed).choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        near = closest(a, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, weights=a[:, d], minlength=len(c)) for d in range(a.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def distances(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ c.T + (c * c).sum(1)


def closest(a: np.ndarray, c: np.ndarray, rows: int = 4096) -> np.ndarray:
    """The nearest centroid of each row."""
    return np.concatenate([distances(a[at : at + rows], c).argmin(1) for at in range(0, len(a), rows)]) if len(a) else np.zeros(0, np.int64)


def traverse(d1: np.ndarray, d2: np.ndarray, pop, reach: int) -> list[tuple[int, int]]:
    """The pairs of centroids by summed distance until their cells (pop[a, b]) hold reach vectors. A pair is pushed by its
    left or upper neighbour alone, so none is met twice."""
    o1, o2 = np.argsort(d1).tolist(), np.argsort(d2).tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, out, held = [(s1[0] + s2[0], 0, 0)], [], 0
    while heap and held < reach:
        _, a, b = heapq.heappop(heap)
        if n := pop[o1[a], o2[b]]:
            out.append((o1[a], o2[b]))
            held += n
        if b + 1 < len(s2):
            heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))
        if b == 0 and a + 1 < len(s1):
            heapq.heappush(heap, (s1[a + 1] + s2[0], a + 1, 0))
    return out


def in_line(c: np.ndarray, n: np.ndarray, groups: int) -> np.ndarray:
    """group of each centroid: they are laid in a line along their main direction and cut into groups of like population."""
    centred = c - c.mean(0)
    order = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")
    before = np.cumsum(n[order]) - n[order]
    group = np.empty(len(c), np.int64)
    group[order] = np.minimum(before * groups // max(int(n.sum()), 1), groups - 1)
    return group


def shards_of(pop: np.ndarray, c1: np.ndarray, c2: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """shard of each cell, as group[first], group[second] -> number, and into how many blocks each shard is salted. As many
    shards as blocks; by the first centroid alone as long as there are no more of them than centroids."""
    wanted = max(1, -(-int(pop.sum()) // block))
    g1 = min(wanted, len(c1))
    g2 = min(-(-wanted // g1), len(c2))
    of = in_line(c1, pop.sum(1), g1)[:, None] * g2 + in_line(c2, pop.sum(0), g2)
    per = np.bincount(of.ravel(), weights=pop.ravel(), minlength=g1 * g2)
    return of.astype(np.int32), np.maximum(1, np.ceil(per / block)).astype(np.int64)


def _matrix(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy().reshape(len(col), -1)


def _assign(c1: np.ndarray, c2: np.ndarray):
    half = c1.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("unit"))
                i, j = closest(x[:, :half], c1), closest(x[:, half:], c2)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("unit"), pa.array(i, pa.int32()), pa.array(j, pa.int32())], names=["id", "unit", "i", "j"])

    return run


def _visit(c1: np.ndarray, c2: np.ndarray, layout, reach: int):
    half, k2 = c1.shape[1], len(c2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pop, shard = (memoryview(np.ascontiguousarray(x)) for x in layout.value)
        # Slices bound the matrix of distances.
        for b in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            x = _matrix(b.column("unit"))
            d1, d2 = distances(x[:, :half], c1), distances(x[:, half:], c2)
            row, to, cells = [], [], []
            for r in range(len(x)):
                by: dict[int, list[int]] = {}
                for i, j in traverse(d1[r], d2[r], pop, reach):
                    by.setdefault(shard[i, j], []).append(i * k2 + j)
                for s, c in by.items():
                    row.append(r)
                    to.append(s)
                    cells.append(c)
            t = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([t.column("id"), t.column("unit"), pa.array(to, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], names=["id", "unit", "shard", "cells"])

    return run


def best(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, id, similarity of the k largest of each row, ties to the smaller id. ids ascend."""
    if sim.shape[1] > k:
        least = -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k]
        row, col = np.nonzero(sim >= least)
    else:
        row, col = np.indices(sim.shape).reshape(2, -1)
    s = sim[row, col]
    o = np.lexsort((ids[col], -s, row))
    row, col, s = row[o], col[o], s[o]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], ids[col[keep]], s[keep]


FOUND = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("sim", pa.float64())])


def _rerank(k: int):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not data.num_rows or not queries.num_rows:
            return FOUND.empty_table()
        ids, x = data["id"].to_numpy(), _matrix(data["unit"])
        cell = data["cell"].to_numpy()
        o = np.lexsort((ids, cell))
        ids, x, cell = ids[o], x[o], cell[o]
        qid, q = queries["id"].to_numpy(), _matrix(queries["unit"])
        visits = queries["cells"].combine_chunks()
        of = np.repeat(np.arange(len(qid)), np.diff(visits.offsets.to_numpy()))
        wanted = visits.flatten().to_numpy()
        v = np.argsort(wanted, kind="stable")
        of, wanted = of[v], wanted[v]
        rows, near, sims = [], [], []
        for c in np.unique(wanted):
            lo, hi = np.searchsorted(cell, [c, c + 1])
            if lo == hi:
                continue
            a, z = np.searchsorted(wanted, [c, c + 1])
            for at in range(a, z, 2048):
                who = of[at : min(z, at + 2048)]
                r, i, s = best(np.round(q[who] @ x[lo:hi].T, PLACES), ids[lo:hi], k)
                rows.append(who[r])
                near.append(i)
                sims.append(s)
        if not rows:
            return FOUND.empty_table()
        r, i, s = np.concatenate(rows), np.concatenate(near), np.concatenate(sims)
        o = np.lexsort((i, -s, r))
        r, i, s = r[o], i[o], s[o]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        return pa.table([pa.array(qid[r[keep]]), pa.array(i[keep]), pa.array(s[keep])], schema=FOUND)

    return run


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """id, unit of id, vec ARRAY<DOUBLE>: of length 1; null components count as 0, rows without a positive length, a
    null id or a null vector take no part."""
    vec = F.transform("vec", lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))
    v = vectors.select(F.col("id").cast("long").alias("id"), vec.alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL")
    v = v.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).filter("norm > 0")
    return v.select("id", F.transform("vec", lambda x: x / F.col("norm")).alias("unit"))


def nearest(vectors: DataFrame, k: int = NEAREST, reach: int = REACH, sample: int = SAMPLE, block: int = BLOCK, slice_rows: int = SLICE) -> DataFrame:
    """id, near ARRAY<STRUCT<sim, id>>: of each vector, the k others of the largest cosines, rounded to 9 places, ties to
    the smaller id. vectors: id (unique), vec of one length in all rows. A vector alone has an empty list; an empty
    table gives no rows."""
    spark = vectors.sparkSession
    units = unit_vectors(vectors)
    digest = F.struct(F.xxhash64("unit").alias("a"), F.xxhash64(F.lit(1), "unit").alias("b"))
    units = stage(units.select("id", "unit", digest.alias("h")), "units")
    # Of equal vectors the k + 1 smallest ids: the limit is taken before the exchange, so a large group stays small.
    w = Window.partitionBy("h").orderBy("id")
    firsts = units.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    rep = firsts.groupBy("h").agg(F.min("id").alias("id"), F.min_by("unit", "id").alias("unit"), F.sort_array(F.collect_list("id")).alias("ids"))
    rep = stage(rep, "distinct_vectors")
    n = rep.count()
    if not n:
        return units.select("id", F.expr("CAST(array() AS array<struct<sim: double, id: bigint>>)").alias("near"))
    size = int(np.clip(np.sqrt(n / PER_CELL), 4, CENTROIDS))
    fit = _matrix(rep.orderBy(F.xxhash64("id")).limit(max(sample, PER_CENTROID * size)).select("unit").toArrow()["unit"])
    if fit.shape[1] == 1:
        raise ValueError("vectors need two components at least")
    half = fit.shape[1] // 2
    c1, c2 = fit_codebook(fit[:, :half], size), fit_codebook(fit[:, half:], size)
    cells = rep.select("id", "unit").mapInArrow(_assign(c1, c2), "id long, unit array<double>, i int, j int")
    cells = stage(cells.withColumn("cell", F.col("i") * F.lit(len(c2)) + F.col("j")), "cells")
    held = cells.groupBy("cell").agg(F.count(F.lit(1)).cast("int").alias("n")).toArrow()  # a row a cell, CENTROIDS^2 at most
    pop = np.zeros(len(c1) * len(c2), np.int32)
    pop[held["cell"].to_numpy()] = held["n"].to_numpy()
    pop = pop.reshape(len(c1), len(c2))
    shard, salts = shards_of(pop, c1, c2, block)
    layout = spark.sparkContext.broadcast((pop, shard))
    to = cells.select("id", "unit").repartition(spark.sparkContext.defaultParallelism * 4, "id").mapInArrow(_visit(c1, c2, layout, reach), "id long, unit array<double>, shard int, cells array<int>")
    to = stage(to, "visits")
    # A row a shard, of which there are as many as blocks of vectors.
    asked_of = to.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("slices")).toArrow()
    slices = np.ones(len(salts), np.int32)
    slices[asked_of["shard"].to_numpy()] = asked_of["slices"].to_numpy()
    plan = spark.createDataFrame(pa.table({"shard": pa.array(range(len(salts)), pa.int32()), "salts": pa.array(salts, pa.int32()), "slices": pa.array(slices)}))
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def shard_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = layout.value[1].ravel()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("unit"), b.column("cell"), pa.array(of[b.column("cell").to_numpy()], pa.int32())], names=["id", "unit", "cell", "shard"])

    placed = cells.select("id", "unit", "cell").mapInArrow(shard_of, "id long, unit array<double>, cell int, shard int")
    data = placed.join(F.broadcast(plan), "shard").select("shard", spread("salts").alias("salt"), each("slices").alias("slice"), "id", "unit", "cell")
    asked = to.join(F.broadcast(plan), "shard").select("shard", each("salts").alias("salt"), spread("slices").alias("slice"), "id", "unit", "cells")
    keys = ["shard", "salt", "slice"]
    got = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_rerank(k + 1), "id long, near long, sim double")
    top = got.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "near"))).filter(F.col("r") <= k + 1)
    wide = top.join(rep.select(F.col("id").alias("near"), "ids"), "near").select("id", "sim", F.explode("ids").alias("doc"))
    lists = wide.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("s"), F.col("doc").alias("id")))).alias("l"))
    lists = stage(rep.select("id", "h").join(lists, "id").select("h", "l"), "lists")  # read for frequent vectors and for the others
    # A third of all rows may have one vector: those of many rows are few, so their lists are broadcast.
    total = units.count()
    often = units.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > max(1, int(total * HOT))).select("h")
    hot = stage(often.join(lists, "h"), "hot_lists")
    mine = units.select("id", "h").join(F.broadcast(hot.select("h", F.col("l").alias("hl"))), "h", "left")
    mine = mine.filter("hl IS NOT NULL").select("id", "h", F.col("hl").alias("l")).unionByName(mine.filter("hl IS NULL").select("id", "h").join(lists, "h"))
    near = F.slice(F.filter("l", lambda x: x["id"] != F.col("id")), 1, k)
    return mine.select("id", F.transform(near, lambda x: F.struct((-x["s"]).alias("sim"), x["id"].alias("id"))).alias("near"))


def section_vectors(spark: SparkSession, sf_dir: str, topics: int = TOPICS) -> DataFrame:
    """id, vec of each section document with a positive weight. Exact copies count once; a missing or null weight is 0."""
    docs = table(spark, sf_dir, "topic_docs").select("doc_id").distinct()
    mix = table(spark, sf_dir, "topic_mix").dropDuplicates().join(docs, "doc_id", "left_semi")
    one = [F.coalesce(F.sum(F.when(F.col("topic") == t, F.col("weight").cast("double"))), F.lit(0.0)) for t in range(topics)]
    g = mix.groupBy("doc_id").agg(F.array(*one).alias("vec"), F.max("weight").alias("most"))
    return g.filter("most > 0").select(F.col("doc_id").alias("id"), "vec")


def p3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, rank, near, similarity."""
    n = nearest(section_vectors(spark, sf_dir))
    return n.select(F.col("id").alias("doc_id"), F.posexplode("near").alias("rank", "x")).select("doc_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("near"), F.col("x.sim").alias("similarity"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = p3_nearest(spark, sf_dir)
    return n.select(F.least("doc_id", "near").alias("doc_a"), F.greatest("doc_id", "near").alias("doc_b")).distinct()
