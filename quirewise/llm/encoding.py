"""Problem 6: every text as the ids of a public byte-level BPE tokenizer.

Distinct-word table. Texts are split into the tokenizer's pieces by Spark; every distinct piece is encoded
once; the ids are joined back by position. Ids are decoded by a join with the pieces of the vocabulary.

Scale. Distinct pieces are combined before they travel. A piece that occurs at least total / HOT_WORDS times is
one of at most HOT_WORDS, whatever the corpus, so these (of at most HOT_BYTES bytes each) are broadcast and
joined where the text lies, as Arrow columns; a text that holds no other is done there, without an exchange.
Of the remaining texts only the rare pieces travel, by piece, and the runs between them travel once, by record.

Null and empty texts have the empty list. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.session import join_lookup, stage
from quirewise.sources.corpus import table

HOT_WORDS, HOT_BYTES = 400_000, 64

#: The splitting pattern of the vocabulary, with white space spelt out as Java's \s is ASCII only.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pieces(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


def _encode(ranks_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        enc = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks_of.value, special_tokens={})
        for b in batches:
            ids = [enc.encode_ordinary(w) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return run


def word_table(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """word, n, ids of every distinct piece of docs.text. Staged."""
    spark = docs.sparkSession
    words = docs.select(F.explode(pieces(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return stage(words.mapInArrow(_encode(spark.sparkContext.broadcast(ranks)), "word string, n long, ids array<int>"), "words")


def split_hot(words: DataFrame, hot_words: int = HOT_WORDS) -> tuple[pa.Table, DataFrame | None]:
    """The frequent pieces with their ids, at most hot_words; and the others, None if there are none."""
    total, n, wide = words.agg(F.sum("n"), F.count(F.lit(1)), F.sum((F.octet_length("word") > HOT_BYTES).cast("long"))).first()
    least = 1 if n <= hot_words else -(-total // hot_words)
    is_hot = (F.col("n") >= least) & (F.octet_length("word") <= HOT_BYTES)
    hot = words.filter(is_hot).select("word", "ids").toArrow()
    return hot, words.filter(~is_hot).select("word", "ids") if n > hot.num_rows else None


OUT = ["key", "pos", "got", "word", "whole"]


def _look_up(hot_of, lengths_only: bool):
    """Batches of key, words -> key, pos, ids (or n_tokens), word, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = pa.ipc.open_stream(hot_of.value).read_all().combine_chunks()
        known, lists = hot["word"].combine_chunks(), hot["ids"].combine_chunks()
        flat_ids = lists.flatten().to_numpy()
        offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        sizes = np.diff(offsets)
        for b in batches:
            key, words = b.column(0), b.column("words")
            if isinstance(words, pa.ChunkedArray):
                words = words.combine_chunks()
            at = words.offsets.to_numpy().astype(np.int64)
            flat = words.flatten()
            at = at - at[0]
            found = pc.index_in(flat, value_set=known) if len(known) else pa.nulls(len(flat), pa.int32())
            miss = found.is_null().to_numpy(zero_copy_only=False)
            idx = found.fill_null(0).to_numpy()
            n = np.where(miss, 0, sizes[idx]) if len(sizes) else np.zeros(len(flat), np.int64)
            ends = np.concatenate([[0], np.cumsum(n)])
            missed = np.concatenate([[0], np.cumsum(miss)])
            part = (missed[at[1:]] - missed[at[:-1]]) > 0
            if lengths_only:
                ids = None
            else:
                # Position by position: id j of word i stands at offsets[idx[i]] + j.
                take = np.repeat(offsets[idx] - ends[:-1], n) + np.arange(ends[-1]) if len(flat) and len(sizes) else np.zeros(0, np.int64)
                ids = flat_ids[take]
            of = np.repeat(np.arange(len(part)), np.diff(at))
            # A stretch is a rare piece, or what lies between two of them in one text; all stretches at once.
            opens = miss.copy()
            opens[1:] |= miss[:-1]
            opens[at[:-1][np.diff(at) > 0]] = True
            lo = np.flatnonzero(opens)
            bounds = np.append(ends[lo], ends[-1])
            row = of[lo]
            got = pa.array(np.diff(bounds)) if lengths_only else pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            word = flat.take(pa.array(lo)) if len(lo) else pa.nulls(0, pa.string())
            word = pc.if_else(pa.array(miss[lo]), word, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([key.take(pa.array(row)), pa.array((lo - at[row]).astype(np.int32)), got, word, pa.array(~part[row])], names=OUT)
            bare = np.flatnonzero(np.diff(at) == 0)  # texts without a piece
            if len(bare):
                none = pa.array(np.zeros(len(bare), np.int64)) if lengths_only else pa.array([[]] * len(bare), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([key.take(pa.array(bare)), pa.array(np.zeros(len(bare), np.int32)), none, pa.nulls(len(bare), pa.string()), pa.array(np.ones(len(bare), bool))], names=OUT)

    return run


def _joined(docs: DataFrame, ranks: dict[bytes, int], lengths_only: bool, hot_words: int) -> DataFrame:
    """key, got: the ids of each text, or their number. docs: key (unique, a whole number), text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("key").cast("long").alias("key"), "text")
    hot, rare = split_hot(word_table(docs, ranks), hot_words)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, hot.schema) as w:
        w.write_table(hot)
    hot_of = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    kind = "long" if lengths_only else "array<int>"
    found = docs.select("key", pieces(F.col("text")).alias("words")).mapInArrow(_look_up(hot_of, lengths_only), f"key long, pos int, got {kind}, word string, whole boolean")
    if rare is None:
        return found.select("key", "got")
    found = stage(found, "pieces")
    whole = found.filter("whole").select("key", "got")
    runs = found.filter("NOT whole AND word IS NULL").select("key", "pos", "got")
    rare_ids = rare.select("word", (F.size("ids").cast("long") if lengths_only else F.col("ids")).alias("got"))
    # A rare piece occurs less than total / hot_words times, so none is a hot key; a long one may, so these are spread.
    asked = found.filter("NOT whole AND word IS NOT NULL").select("key", "pos", "word")
    long = F.octet_length("word") > HOT_BYTES
    near = asked.filter(~long).join(rare_ids.filter(~long), "word")
    far = join_lookup(asked.filter(long), rare_ids.filter(long), "word", few=False)
    fetched = near.select("key", "pos", "got").unionByName(far.select("key", "pos", "got"))
    both = runs.unionByName(fetched).groupBy("key")
    if lengths_only:
        put = both.agg(F.sum("got").alias("got"))
    else:
        put = both.agg(F.flatten(F.sort_array(F.collect_list(F.struct("pos", "got"))).getField("got")).alias("got"))
    return whole.unionByName(put)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """key, ids ARRAY<INT> of every row: key must be unique and not null. Null and empty texts have the empty list;
    other columns are ignored. An empty table gives no rows."""
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return _joined(d, read_ranks(path or vocabulary_path()), False, hot_words).select(F.col("key").alias(key), F.col("got").alias("ids"))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """key, n_tokens: the number of ids that encode() gives."""
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return _joined(d, read_ranks(path or vocabulary_path()), True, hot_words).select(F.col("key").alias(key), F.col("got").alias("n_tokens"))


def decode(encoded: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """key, text of key, ids: ids are joined with the vocabulary's pieces (a table of fixed size, hence broadcast) and
    their bytes put together by position. The empty list gives the empty text, as does a null list; an id that the
    vocabulary lacks raises an error."""
    spark = encoded.sparkSession
    ranks = read_ranks(path or vocabulary_path())
    vocab = spark.createDataFrame(pa.table({"id": pa.array(ranks.values(), pa.int32()), "piece": pa.array([k.hex() for k in ranks])}))
    at = encoded.select(F.col(key).alias("key"), F.posexplode_outer("ids").alias("pos", "id"))
    joined = at.join(F.broadcast(vocab), "id", "left").withColumn("piece", F.when(F.col("id").isNotNull() & F.col("piece").isNull(), F.raise_error(F.lit("unknown token id"))).otherwise(F.coalesce("piece", F.lit(""))))
    got = joined.groupBy("key").agg(F.array_join(F.sort_array(F.collect_list(F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), "piece"))).getField("piece"), "").alias("hex"))
    return got.select(F.col("key").alias(key), F.decode(F.unhex("hex"), "UTF-8").alias("text"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the round trip of every document."""
    return decode(p6_ids(spark, sf_dir))
