"""Problem 5: spans of at least `least` characters that stand letter for letter in more than one text.

De Bruijn compaction. A text is cut at anchors: the positions whose hash of K characters is the least of some
window of W such positions. Anchors depend on the characters near them alone, so texts that share a run share
its anchors, and what lies between two of them is a token. A chain of tokens from an anchor on, long enough to
span SPAN = least - 2 * (W - 1) characters, is an edge of the graph, known by the hash of its characters; any shared run of
`least` characters holds one whole edge at least, the same in either text. Edges are aggregated by label, which tells those
of several texts and what alone stands before or after them; a join of that table with itself finds the edges that are each
other's only neighbour, so that the path does not branch between them; a second join brings this to the edges of the
texts, where nonbranching stretches are put together along the source coordinates, as unitigs with the same sources
throughout. (No path can close on itself: the first edge of a text has nothing before it, so it never is unbranched.)

Verification. A window of `least` characters that two texts share lies in a unitig or sticks out of its end, and
then holds its first or last edge whole. So for each unitig in each text the windows over its ends, and the one at its
start, are taken from the text itself by their source coordinates and told by 128 bits of a cryptographic hash. Texts of
one set of windows are paired only after the characters at their coordinates have been compared.

Scale. About one position in W / 2 is an edge. Texts are cut into pieces of PIECE characters, with what lies around, so that
no task holds more than a piece, however long a text is. Copies of an edge are combined before they travel, and labels of
more than a thousandth of all edges, which are a thousand at most, are joined by broadcast: a licence in a third of all texts
makes no hot task. Pairs are made only of texts that do share a window, once for each distinct set of texts and not once a
window, and in blocks of SIDE texts. The pairs of a set are quadratic in its texts; sets() has the same result as sets and
their members, which isn't.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirewise.session import join_lookup, stage
from quirewise.sources.corpus import latest, table

K, W, LEAST, PIECE = 16, 20, 120, 1 << 20
#: Texts of a set that make one block of pairs, and the share of all edges from which a label is frequent.
SIDE, HOT = 512, 1 / 1000
#: Odd base of the hash by which anchors are chosen.
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(text: str, k: int) -> np.ndarray:
    """A hash of each k characters, from prefix sums modulo 2^64. It chooses anchors; nothing is told by it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points)
    if n < k:
        return np.zeros(0, np.uint64)
    power = np.full(n, BASE, np.uint64)
    power[0] = 1
    back = np.full(n - k + 1, pow(BASE, -1, 2**64), np.uint64)
    back[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(points + np.uint64(1)) * np.cumprod(power), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * np.cumprod(back))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(text: str, k: int = K, w: int = W) -> np.ndarray:
    """Positions that are the least of some window; all of them where several are equal."""
    x = rolling(text, k)
    if len(x) < w:
        return np.zeros(0, np.int64)
    least = sliding_min(x, w)
    # x is at least the minimum of each window over it, and equal to the largest of them where one chose it.
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero(~sliding_min(~padded, w) == x)


def label_of(chars: str) -> int:
    """64 bits, by which edges meet."""
    return xxhash.xxh3_64_intdigest(chars.encode("utf-8", "surrogatepass"))


def digest_of(chars: str) -> bytes:
    """128 bits, by which windows are told."""
    return blake2b(chars.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def edges(text: str, least: int, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and label of the chain of each anchor; anchors without a whole chain have none."""
    a = anchors(text, k, w)
    to = np.searchsorted(a, a + (least - 2 * (w - 1)) - k)
    start = a[to < len(a)]
    end = a[to[to < len(a)]] + k
    return start, end, np.array([label_of(text[s:e]) for s, e in zip(start.tolist(), end.tolist())], np.uint64).view(np.int64)


def margin(least: int, k: int, w: int) -> int:
    """Characters around a piece on which its edges, and their neighbours, may depend."""
    return least + 4 * w + 2 * k


def pieces(texts: DataFrame, size: int, around: int) -> DataFrame:
    """id, n (its length), p, at, lo, hi, part: of each text the pieces from lo to hi, with what lies around them; part
    begins at `at`."""
    n = F.length("text")
    t = texts.withColumn("n", n).withColumn("p", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / size).cast("int")))))
    lo = F.col("p") * size
    t = t.withColumns({"lo": lo, "hi": F.least(lo + size, F.col("n")), "at": F.greatest(F.lit(0), lo - around)})
    return t.select("id", "n", "p", "at", "lo", "hi", F.when(F.col("n") <= size, F.col("text")).otherwise(F.substr(F.col("text"), F.col("at") + 1, F.col("hi") - F.col("at") + around)).alias("part"))


EDGE = "id long, start int, end int, before int, label long, prev long, next long"


def _edges(least: int, k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, at, lo, hi, text in zip(*(b.column(c).to_pylist() for c in ("id", "at", "lo", "hi", "part"))):
                if len(text) < least:
                    continue
                start, end, label = edges(text, least, k, w)
                start, end = start + at, end + at
                mine = (start >= lo) & (start < hi)
                if not mine.any():
                    continue
                n = np.arange(len(start))
                before = pa.array(np.append(0, start[:-1]).astype(np.int32)[mine], mask=n[mine] == 0)
                prev = pa.array(np.append(0, label[:-1])[mine], mask=n[mine] == 0)
                following = pa.array(np.append(label[1:], 0)[mine], mask=n[mine] == len(n) - 1)
                out.append(pa.RecordBatch.from_arrays([pa.array(np.full(mine.sum(), i)), pa.array(start[mine].astype(np.int32)), pa.array(end[mine].astype(np.int32)), before, pa.array(label[mine]), prev, following], names=["id", "start", "end", "before", "label", "prev", "next"]))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run


def _windows(least: int):
    """Digests of the windows that start in the ranges of each piece; again: whether the piece has the same window before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, at, text, many, ranges in zip(*(b.column(c).to_pylist() for c in ("id", "at", "part", "many", "ranges"))):
                starts = sorted({x for r in ranges for x in range(r["a"], r["z"])})
                if not starts:
                    continue
                digests = [digest_of(text[x - at : x - at + least]) for x in starts]
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                first = dict(zip(reversed(digests), range(len(starts) - 1, -1, -1)))
                again = np.ones(len(starts), bool)
                again[list(first.values())] = False
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), i)), pa.array(np.array(starts, np.int32)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(again), pa.array(np.full(len(starts), many))], names=["id", "at", "h1", "h2", "again", "many"])

    return run


class SharedSpans:
    """texts: id (a whole number, unique), text. Null ids and texts, and texts shorter than `least`, share nothing.
    `least` must be at least 2 * W + K. Other columns are ignored; copies of a text share all of it."""

    def __init__(self, texts: DataFrame, least: int = LEAST, k: int = K, w: int = W, piece: int = PIECE, hot: float = HOT):
        if least < 2 * w + k:
            raise ValueError(f"least must be at least {2 * w + k}")
        self.least, self.piece = least, piece
        t = texts.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
        cut = pieces(t, piece, margin(least, k, w))
        self.pieces = stage(cut.repartition(t.sparkSession.sparkContext.defaultParallelism * 2, "id", "p"), "pieces")
        e = stage(self.pieces.mapInArrow(_edges(least, k, w), EDGE), "edges")
        total = e.count()
        # The graph: edges of several texts, and their only neighbours.
        alone = lambda c: F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c)).alias(c)
        nodes = e.groupBy("label").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least_id"), F.max("id").alias("most_id"), alone("prev"), alone("next"))
        nodes = stage(nodes.filter("least_id < most_id").drop("least_id", "most_id"), "nodes")
        links = nodes.filter("next IS NOT NULL").select(F.col("label").alias("prev"), F.col("next").alias("label"))
        linked = nodes.filter("prev IS NOT NULL").join(links, ["label", "prev"]).select("label", F.lit(True).alias("linked"))
        nodes = stage(nodes.select("label", "copies").join(linked, "label", "left").select("label", "copies", F.coalesce("linked", F.lit(False)).alias("linked")), "linked")
        # Back to the texts.
        often = F.col("copies") > max(1, int(total * hot))
        e = e.select("id", "start", "end", "before", "label")
        known = e.join(F.broadcast(nodes.filter(often).select("label", F.col("linked").alias("__hot"))), "label", "left")
        cols = ["id", "start", "end", "before"]
        kept = known.filter("__hot IS NOT NULL").select(*cols, F.col("__hot").alias("linked")).unionByName(known.filter("__hot IS NULL").join(nodes.filter(~often), "label").select(*cols, "linked"))
        by = Window.partitionBy("id").orderBy("start")
        joined = F.col("linked") & (F.lag("start").over(by) == F.col("before"))
        path = F.sum(F.when(joined, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
        #: id, start, end, first_end, last_start of each unitig in each text.
        self.unitigs = stage(
            kept.withColumn("path", path)
            .groupBy("id", "path")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("end").alias("first_end"), F.max("start").alias("last_start"))
            .drop("path"),
            "unitigs",
        )
        #: id, at, h1, h2 of the windows over the ends of unitigs; many: of a text of several pieces.
        self.windows = stage(self._ranged().mapInArrow(_windows(least), "id long, at int, h1 long, h2 long, again boolean, many boolean"), "windows")
        #: h1, h2, and a signature of the set of texts that hold the window.
        once = self.windows.filter("NOT again")
        texts_of = once.filter("NOT many").select("h1", "h2", "id").unionByName(once.filter("many").select("h1", "h2", "id").distinct())
        word = lambda s: F.bit_xor(F.xxhash64(F.lit(s), "id"))
        self.shared = texts_of.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), word(1).alias("s1"), word(2).alias("s2")).filter("n > 1")

    def _ranged(self) -> DataFrame:
        """The pieces with the starts of the windows to look at, as ranges cut at the pieces' ends."""
        least = F.lit(self.least)
        span = lambda a, z: F.struct(a.cast("int").alias("a"), z.cast("int").alias("z"))
        long = F.col("end") - F.col("start") >= least
        over = F.array(
            span(F.greatest(F.lit(0), F.col("first_end") - least), F.col("start")),
            span(F.greatest(F.lit(0), F.col("end") - least + 1), F.col("last_start") + 1),
            span(F.col("start"), F.when(long, F.col("start") + 1).otherwise(F.col("start"))),
        )
        r = self.unitigs.select("id", F.explode(over).alias("r")).filter("r.z > r.a")
        r = r.withColumn("p", F.explode(F.sequence(F.floor(F.col("r.a") / self.piece).cast("int"), F.floor((F.col("r.z") - 1) / self.piece).cast("int"))))
        per = r.groupBy("id", "p").agg(F.collect_list("r").alias("rs"))  # at most as many as a piece has edges
        cut = lambda x: span(F.greatest(x["a"], F.col("lo")), F.least(x["z"], F.col("hi"), F.col("n") - least + 1))
        return self.pieces.join(per, ["id", "p"]).select("id", "at", "part", (F.col("n") > self.piece).alias("many"), F.transform("rs", cut).alias("ranges"))

    def _told(self, windows: DataFrame) -> DataFrame:
        """windows with the characters that stand at their coordinates."""
        w = windows.withColumn("p", F.floor(F.col("at") / self.piece).cast("int"))
        chars = F.substr(F.col("part"), F.col("at") - F.col("from") + 1, F.lit(self.least))
        return w.join(self.pieces.select("id", "p", F.col("at").alias("from"), "part"), ["id", "p"]).select("h1", "h2", "n", "id", chars.alias("chars"))

    def sets(self) -> DataFrame:
        """h1, h2, n, id: each set of n texts that share a window, once, and its members: a row a text and set. Which
        texts share a window is told by its digest; the characters are compared here."""
        one = stage(self.shared.groupBy("n", "s1", "s2").agg(F.min(F.struct("h1", "h2")).alias("h")).select("h.h1", "h.h2", "n"), "sets")
        named = join_lookup(self.windows.filter("NOT again").select("h1", "h2", "id", "at"), one, ["h1", "h2"])
        told = stage(self._told(named.groupBy("h1", "h2", "id", "n").agg(F.min("at").alias("at"))), "span_sets")
        unlike = told.groupBy("h1", "h2").agg(F.min("chars").alias("a"), F.max("chars").alias("z")).filter("a <> z")
        if unlike.take(1):  # equal digests of unlike windows: then no set is taken for another, all windows are looked at
            told = stage(self._told(self.windows.select("h1", "h2", "id", "at").join(self.shared.select("h1", "h2", "n"), ["h1", "h2"])).distinct(), "span_sets")
            per = told.groupBy("h1", "h2", "chars").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
            told = told.join(per, ["h1", "h2", "chars"]).withColumns({"h2": F.xxhash64("h2", "chars"), "n": F.col("k")})
        return told.select("h1", "h2", "n", "id")

    def pairs(self, side: int = SIDE) -> DataFrame:
        """id_a < id_b, each pair of texts with a shared span once."""
        # Two blocks of a set make a group of their own, so none has more than side * side pairs or so.
        s = self.sets().withColumn("blocks", F.ceil(F.col("n") / side).cast("int"))
        s = s.withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        left = s.select("h1", "h2", F.col("id").alias("x"), F.col("b").alias("i"), F.explode(F.sequence("b", F.col("blocks") - 1)).alias("j"))
        right = s.select("h1", "h2", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), "b")).alias("i"), F.col("b").alias("j"))
        p = left.join(right, ["h1", "h2", "i", "j"]).filter("i < j AND x <> y OR i = j AND x < y")
        return p.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

    def spans(self) -> DataFrame:
        """id, start, end: the maximal stretches of each text that lie in shared spans; end is exclusive."""
        over = self.windows.join(self.shared.select("h1", "h2"), ["h1", "h2"], "left_semi").select("id", F.col("at").alias("s"))
        long = self.unitigs.filter(F.col("end") - F.col("start") >= self.least).select("id", F.col("start").alias("s"), F.col("end").alias("e"))
        # A unitig is shared if the window at its start is.
        over = over.join(long, ["id", "s"], "left").select("id", "s", F.coalesce("e", F.col("s") + self.least).alias("e"))
        by = Window.partitionBy("id").orderBy("s", "e")
        before = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
        new = F.when(before >= F.col("s"), 0).otherwise(1)
        return over.withColumn("new", new).withColumn("k", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("id", "k").agg(F.min("s").alias("start"), F.max("e").alias("end")).drop("k")

    def coverage(self) -> DataFrame:
        """id, chars, shared_chars, share of every text; an empty text shares 0."""
        s = self.spans().groupBy("id").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("shared_chars"))
        t = self.pieces.filter("p = 0").select("id", F.col("n").cast("long").alias("chars")).join(s, "id", "left").na.fill(0, ["shared_chars"])
        return t.withColumn("share", F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(0.0))


def edition_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text of the counted editions."""
    e = latest(table(spark, sf_dir, "editions").select("edition_id", "built_at", "text"), "edition_id", "built_at")
    return e.filter("text IS NOT NULL").select(F.col("edition_id").alias("id"), "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(edition_texts(spark, sf_dir)).pairs().select(F.col("id_a").alias("edition_a"), F.col("id_b").alias("edition_b"))


def p5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(edition_texts(spark, sf_dir)).coverage().withColumnRenamed("id", "edition_id")


def p5_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(edition_texts(spark, sf_dir)).spans().withColumnRenamed("id", "edition_id")


def p5_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """passage, editions, edition_id: each set of editions that share a passage, named by the digest of one, and its members."""
    s = SharedSpans(edition_texts(spark, sf_dir)).sets()
    return s.select(F.concat(F.hex("h1"), F.lit("-"), F.hex("h2")).alias("passage"), F.col("n").alias("editions"), F.col("id").alias("edition_id"))
