"""Problem 8: the subjects that a text is about.

Complement naive Bayes, trained on labelled documents and refined by expectation-maximisation over all others. A
text is read sentence by sentence, as a document may treat two subjects in turn: the E step gives each sentence a
posterior over the subjects, the M step counts words by these posteriors, all of them and in full, and the complement rule
weighs a word by the subjects it is *not* found in. A labelled document stays with its labels in every round: its
sentences' posteriors are confined to them, and one labelled as without subject counts for none.

A document's share of a subject is the part of its words that stand in sentences of that subject. It is worked out by a
model from whose counts the document's own part is taken out, so that no text, labelled or not, is told by what it taught;
independent posteriors are calibrated for each subject on such shares of the labelled documents.

Scale. Words are hashed into 2^BITS bins, so the model has a fixed size, whatever the vocabulary, and may be
broadcast; counts are added up in each task and then by bin. Texts are tokenised once and staged as bins; every
pass reads them in parallel without an exchange of texts. Labels are a bounded sample: those of at most LABELLED
documents, the ones of the smallest hash. Sentences, EM, shares and posteriors cover all documents.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.session import stage
from quirewise.sources.corpus import table

BITS, LABELLED, ROUNDS = 18, 50_000, 4
#: Smoothing of the complement counts, and the posterior at which a sentence is taken to treat a subject (for the shares;
#: every posterior counts in training).
SMOOTH, SURE = 0.1, 0.6
#: Weights are differences of logarithms of counts of all subjects but one, hence small; so much they are raised, or the E step
#: would spread a sentence over subjects that it shows nothing of. Measured on the test tables.
SHARP = 2.0
#: Numbers in a model at most: with very many subjects there are fewer bins.
MODEL = 1 << 24
#: Bins of the calibration, weight of all subjects' rate in that of one, and the posterior that makes a row.
SHARES, PRIOR, ACCEPTED = 20, 10.0, 0.5

#: Words, with what may stand unseen inside them, and ends of sentences.
PIECES = r"[\p{L}\p{M}\x{00AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]+|[.!?;:\n\r]+"


def plain_word(w: str) -> str:
    """Lower case, compatibility forms resolved (long s, ligatures), marks and unseen characters dropped."""
    return "".join(c for c in unicodedata.normalize("NFKD", w.lower()) if unicodedata.category(c) not in ("Mn", "Mc", "Me", "Cf"))


def _bins(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("words")
            flat = words.flatten().dictionary_encode()
            code = []
            for w in flat.dictionary.to_pylist():
                p = plain_word(w)
                code.append(-1 if not p or not p[0].isalpha() else zlib.crc32(p.encode()) & ((1 << bits) - 1))
            ids = np.array(code, np.int32)[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int32)
            at = words.offsets.to_numpy() - words.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=["doc_id", "bins"])

    return run


def word_bins(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, bins of each text that isn't null: a bin a word, -1 where a sentence ends. Staged."""
    w = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all("text", F.lit(PIECES), F.lit(0)).alias("words"))
    return stage(w.mapInArrow(_bins(bits), "doc_id long, bins array<int>"), "word_bins")


class Sentences:
    """The sentences of a batch: bins of their words, start of each, its length and the row it is of."""

    def __init__(self, bins: pa.ListArray):
        at = bins.offsets.to_numpy().astype(np.int64)
        flat = bins.values.to_numpy()[at[0] : at[-1]]
        at = at - at[0]
        row = np.repeat(np.arange(len(bins)), np.diff(at))
        word = flat >= 0
        ends = np.cumsum(~word)  # grows at each end of a sentence
        self.bins, row, ends = flat[word], row[word], ends[word]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (ends[1:] != ends[:-1])
        self.starts = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1  # the sentence of each word
        self.size = np.diff(np.append(self.starts, len(row)))
        self.row = row[self.starts]
        self.rows = len(bins)

    def posteriors(self, weights: np.ndarray, of_words: np.ndarray | None = None) -> np.ndarray:
        """By the weights of the bins, or of a table that of_words points into."""
        s = np.add.reduceat(weights[self.bins if of_words is None else of_words], self.starts, axis=0).astype(float)
        p = np.exp(s - s.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def taught(self, ids: np.ndarray, weights: np.ndarray | None, known: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """What each sentence counts for each subject: its posterior; of labelled documents that among their labels, or before
        there are weights the labels in equal parts; none without labels in that case."""
        hit, mine = _labels_of(ids, known, labels)
        hit, mine = hit[self.row], mine[self.row]
        r = np.zeros((len(self.starts), labels.shape[1])) if weights is None else self.posteriors(weights)
        r[hit] = (mine[hit] + 0.0) if weights is None else r[hit] * mine[hit]
        total = r.sum(1, keepdims=True)
        return np.divide(r, total, out=np.zeros_like(r), where=total > 0)


def weigh(other: np.ndarray, all_other: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Weights of words (rows) by their counts in the other subjects than each (columns) and the sums of these over all words:
    the less the others use it, the more; centred, so that a word that no subject prefers weighs nothing, as one
    that was never seen."""
    w = np.log(all_other) - np.log(other)
    return np.where(seen, SHARP * (w - w.mean(1, keepdims=True)), 0).astype(np.float32)


def complement_weights(counts: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    total = counts.sum(1, keepdims=True)
    other = total - counts + smooth
    return weigh(other, other.sum(0), total > 0)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[tuple[np.ndarray, Sentences]]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            s = Sentences(part.column("bins"))
            yield part.column("doc_id").to_numpy(), s


def _labels_of(ids: np.ndarray, known: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.clip(np.searchsorted(known, ids), 0, max(len(known) - 1, 0))
    hit = known[at] == ids if len(known) else np.zeros(len(ids), bool)
    return hit, labels[at] if len(known) else np.zeros((len(ids), labels.shape[1]))


def _counts(model, labels_of, bits: int):
    """One M step: words by subject. Without a model only labelled documents count, by their labels; then all sentences of
    all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, labels = labels_of.value
        weights = None if model is None else model.value
        total = np.zeros((labels.shape[1], 1 << bits))
        for ids, s in _slices(batches):
            if not len(s.starts):
                continue
            r = s.taught(ids, weights, known, labels).T
            for c in np.flatnonzero(r.any(1)):
                total[c] += np.bincount(s.bins, weights=r[c][s.of], minlength=1 << bits)
        bins = np.flatnonzero(total.any(0))
        if len(bins):
            yield pa.RecordBatch.from_arrays([pa.array(bins.astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(total[:, bins].T.ravel()), len(total)).cast(pa.list_(pa.float64()))], names=["bin", "n"])

    return run


def without_own(s: Sentences, r: np.ndarray, counts: np.ndarray, sums: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """Posteriors of the sentences by counts (bins x subjects, sums over the bins) without what each document, by r, has
    added to them itself."""
    subjects, bins = counts.shape[1], len(counts)
    pairs, of_pair = np.unique(s.row[s.of].astype(np.int64) * bins + s.bins, return_inverse=True)
    doc, word = pairs // bins, pairs % bins
    own = np.stack([np.bincount(of_pair, weights=c[s.of], minlength=len(pairs)) for c in np.ascontiguousarray(r.T)], 1)
    left = np.maximum(counts[word] - own, 0)
    total = left.sum(1, keepdims=True)
    own_all = np.stack([np.bincount(doc, weights=c, minlength=s.rows) for c in own.T], 1)
    rest = np.maximum(sums - own_all, 0)  # of all words, for each document
    all_other = rest.sum(1, keepdims=True) - rest + smooth * bins
    seen = total > 1e-4 * subjects  # more than rounding leaves
    return s.posteriors(weigh(total - left + smooth, all_other[doc], seen), of_pair)


def _shares(before, counts_of, labels_of, sure: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, labels), counts = labels_of.value, counts_of.value
        sums, subjects = counts.sum(0, dtype=float), labels.shape[1]
        for ids, s in _slices(batches):
            share, words = np.zeros((len(ids), subjects)), np.zeros(len(ids), np.int64)
            if len(s.starts):
                words = np.bincount(s.row, weights=s.size, minlength=len(ids)).astype(np.int64)
                p = without_own(s, s.taught(ids, before and before.value, known, labels), counts, sums)
                best, ok = p.argmax(1), p.max(1) > sure
                np.add.at(share, (s.row[ok], best[ok]), s.size[ok])
                share /= np.maximum(words, 1)[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(words), pa.FixedSizeListArray.from_arrays(pa.array(share.ravel()), subjects).cast(pa.list_(pa.float64()))], names=["doc_id", "words", "share"])

    return run


def calibrate(share: np.ndarray, label: np.ndarray, bins: int = SHARES, prior: float = PRIOR) -> np.ndarray:
    """Posterior of each subject (row) in each bin of share: its rate of labels, drawn toward that of all subjects, made
    to rise with the share (pool adjacent violators). Bins without labels lie between their neighbours."""
    k = np.clip((share * bins).astype(int), 0, bins - 1)
    n_all, y_all = np.bincount(k.ravel(), minlength=bins), np.bincount(k.ravel(), weights=label.ravel(), minlength=bins)
    seen = np.flatnonzero(n_all)
    pooled = np.interp(np.arange(bins), seen, y_all[seen] / n_all[seen]) if len(seen) else np.linspace(0, 1, bins)
    out = np.zeros((share.shape[1], bins))
    for c in range(share.shape[1]):
        n, y = np.bincount(k[:, c], minlength=bins) + prior, np.bincount(k[:, c], weights=label[:, c], minlength=bins) + prior * pooled
        blocks: list[list[float]] = []
        for i in range(bins):
            blocks.append([y[i], n[i], 1])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
                a = blocks.pop()
                blocks[-1] = [p + q for p, q in zip(blocks[-1], a)]
        out[c] = np.repeat([b[0] / b[1] for b in blocks], [int(b[2]) for b in blocks])
    return out


def label_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s\p{IsWhite_Space}]+|[\s\p{IsWhite_Space}]+$", ""))


def subject_posteriors(docs: DataFrame, labels: DataFrame, subjects: list[str], rounds: int = ROUNDS, labelled: int = LABELLED, bits: int = BITS, sure: float = SURE) -> DataFrame:
    """doc_id, words, share ARRAY<DOUBLE>, posterior ARRAY<DOUBLE>, by the order of subjects, of every text not null.

    docs: doc_id (unique), text. labels: doc_id, subject; a null subject says that the document has none, labels
    are compared without regard to case and outer white space, others than `subjects` are ignored, repeated ones
    count once. Blank texts have words 0 and shares 0. Without any label no subject is preferred and all posteriors
    are small. Other columns are ignored.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    bits = max(1, min(bits, int(np.log2(MODEL / max(len(subjects), 1)))))
    number = {s.strip().lower(): i for i, s in enumerate(subjects)}
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label_key(F.col("subject")).alias("s")).filter("doc_id IS NOT NULL")
    rows = rows.filter(F.col("s").isNull() | F.col("s").isin(list(number)))
    per = rows.groupBy("doc_id").agg(F.collect_set("s").alias("s")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    got = sorted((d, s) for d, s in per.collect())  # at most `labelled` documents
    known = np.array([d for d, _ in got], np.int64)
    marks = np.zeros((len(got), len(subjects)))
    for r, (_, s) in enumerate(got):
        marks[r, [number[x] for x in s]] = 1
    labels_of = sc.broadcast((known, marks))
    bins = word_bins(docs, bits)
    model = None
    for i in range(rounds + 1):
        step = bins.mapInArrow(_counts(model, labels_of, bits), "bin int, n array<double>")
        added = step.groupBy("bin").agg(F.array(*(F.sum(F.col("n")[c]) for c in range(len(subjects)))).alias("n")).toArrow()  # at most 2^bits rows
        counts = np.zeros((1 << bits, len(subjects)), np.float32)
        if added.num_rows:
            counts[added["bin"].to_numpy()] = added["n"].combine_chunks().flatten().to_numpy().reshape(-1, len(subjects))
        if i < rounds:  # a model is of no use after its round; the shares need the last one and the counts it led to
            last, model = model, sc.broadcast(complement_weights(counts.astype(float)))
            if last is not None:
                last.destroy()
    counts_of = sc.broadcast(counts)
    shares = stage(bins.mapInArrow(_shares(model, counts_of, labels_of, sure), "doc_id long, words long, share array<double>"), "shares")
    for sent in (model, counts_of, labels_of):
        if sent is not None:
            sent.destroy()
    mine = shares.join(F.broadcast(spark.createDataFrame(pa.table({"doc_id": pa.array(known, pa.int64())}))), "doc_id").select("doc_id", "share").toArrow()
    hit, y = _labels_of(mine["doc_id"].to_numpy(), known, marks)
    x = mine["share"].combine_chunks().flatten().to_numpy().reshape(-1, len(subjects)) if mine.num_rows else np.zeros((0, len(subjects)))
    curve = calibrate(x, y) if len(x) else np.zeros((len(subjects), SHARES))

    # The curve has subjects * SHARES numbers.
    def at(c: int) -> Column:
        steps = F.array(*(F.lit(float(v)) for v in curve[c]))
        return steps[F.least(F.floor(F.col("share")[c] * SHARES), F.lit(SHARES - 1)).cast("int")]

    return shares.withColumn("posterior", F.array(*(at(c) for c in range(len(subjects)))))


def _listed(spark: SparkSession, sf_dir: str) -> list[str]:
    return [r[0] for r in table(spark, sf_dir, "subjects").select("subject").distinct().orderBy("subject").collect()]


def p8_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, subject, share, posterior of each accepted subject."""
    names = _listed(spark, sf_dir)
    p = subject_posteriors(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "doc_labels"), names)
    x = F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("subject"), "share", "posterior")).alias("x")
    return p.select("doc_id", x).select("doc_id", "x.subject", "x.share", "x.posterior").filter(F.col("posterior") >= ACCEPTED)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_subjects(spark, sf_dir).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, documents, share: what part of all accepted mentions falls to each subject."""
    c = p8_subjects(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.avg("share").alias("mean_share"))
    return c
