"""Editions side by side: which sections they share, which blocks changed, and how."""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewise.sources.markup import extract_text, last_segment, mark_block, resolve_block
from quirewise.sources.model import Corpus

MOST_EDITS = 3000
EQUAL, DELETE, INSERT = "equal", "delete", "insert"

#: A word of the comparison, or one other sign.
SIGN = r"[\p{L}\p{N}'’—&-]+|\S"


def shortest_script(a: Sequence[Hashable], b: Sequence[Hashable], most: int = MOST_EDITS) -> list[tuple[str, int, int]]:
    """(op, lo, hi) of a shortest edit script from a to b: stretches of a for equal and delete, of b for insert. The
    furthest reaching path of each diagonal keeps a chain of its edits, so nothing is traced back through copies of the
    frontier; of two paths that reach alike, the one that deletes last wins. Beyond `most` edits all of a is deleted and all
    of b inserted."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    out = [(EQUAL, 0, lo)] if lo else []
    if not x or not y:
        out += [(DELETE, lo, lo + len(x))] if x else [(INSERT, lo, lo + len(y))] if y else []
    else:
        n, m = len(x), len(y)
        limit = min(n + m, most)
        reach: dict[int, tuple[int, tuple | None]] = {1: (0, None)}
        chain = None
        for d in range(limit + 1):
            for k in range(-d, d + 1, 2):
                left, right = reach.get(k - 1, (-1, None)), reach.get(k + 1, (-1, None))
                if k == -d or (k != d and left[0] < right[0]):
                    i, path = right
                    step = (INSERT, i - k - 1)
                else:
                    i, path = left[0] + 1, left[1]
                    step = (DELETE, i - 1)
                path = (path, step) if d else None
                j = i - k
                while i < n and j < m and x[i] == y[j]:
                    i, j = i + 1, j + 1
                reach[k] = (i, path)
                if i >= n and j >= m:
                    chain, done = path, True
                    break
            else:
                continue
            break
        else:
            done = False
        if not done:
            out += [(DELETE, lo, lo + n), (INSERT, lo, lo + m)]
        else:
            edits = []
            while chain is not None:
                chain, step = chain
                edits.append(step)
            i = j = 0
            for op, at in reversed(edits):
                gap = at - (i if op == DELETE else j)
                if gap > 0:
                    out.append((EQUAL, lo + i, lo + i + gap))
                    i, j = i + gap, j + gap
                out.append((op, lo + at, lo + at + 1))
                i, j = (i + 1, j) if op == DELETE else (i, j + 1)
            if i < n:
                out.append((EQUAL, lo + i, lo + n))
    if hi:
        out.append((EQUAL, len(a) - hi, len(a)))
    merged: list[tuple[str, int, int]] = []
    for op, s, e in out:
        if merged and merged[-1][0] == op and merged[-1][2] == s:
            merged[-1] = (op, merged[-1][1], e)
        else:
            merged.append((op, s, e))
    return merged


def signs(text: str) -> tuple[list[str], list[bool]]:
    """The signs of a text, and whether white space stands before each."""
    found = list(regex.finditer(SIGN, text))
    return [m.group() for m in found], [m.start() > 0 and text[m.start() - 1].isspace() for m in found]


def word_ops(a: str, b: str) -> list[dict]:
    """Stretches of op and text that turn a into b."""
    (ta, sa), (tb, sb) = signs(a), signs(b)
    out = []
    for op, lo, hi in shortest_script(ta, tb):
        t, s = (tb, sb) if op == INSERT else (ta, sa)
        out.append({"op": op, "text": "".join((" " if s[i] and i > lo else "") + t[i] for i in range(lo, hi))})
    return out


def _in_place(block: dict) -> tuple[list[str], list[bool], list[tuple[dict, ...]]]:
    """The signs of a block, whether white space stands before each, and the inline elements around each."""
    text, spans = extract_text(block, "both")
    words, spaced, around, last, at = [], [], [], 0, 0
    for m in regex.finditer(SIGN, text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        words.append(m.group())
        spaced.append(m.start() > last)
        around.append(spans[at][2] if at < len(spans) and spans[at][0] <= m.start() else ())
        last = m.end()
    return words, spaced, around


def merged(old: dict, new: dict) -> list[dict]:
    """The running text that turns one block into another: what both have keeps the new block's inline elements, what only one
    has is a deletion or an insertion of plain text."""
    a, b = _in_place(old), _in_place(new)
    plain = lambda side, lo, hi: {"type": "plainText", "content": "".join(" " * side[1][i] + side[0][i] for i in range(lo, hi))}
    out: list[dict] = []
    done = 0  # of the new block: where its stretch of an equal run begins
    for op, lo, hi in shortest_script(a[0], b[0]):
        if op == DELETE:
            out.append({"type": "deletion", "content": [plain(a, lo, hi)]})
            continue
        start, done = done, done + hi - lo
        if op == INSERT:
            out.append({"type": "insertion", "content": [plain(b, lo, hi)]})
            continue
        for around, run in groupby(range(start, done), key=lambda i: b[2][i]):
            at = list(run)
            x = plain(b, at[0], at[-1] + 1)
            for element in reversed(around):
                x = element | {"content": [x]}
            out.append(x)
    return out


def compare_trees(old: Sequence[dict], new: Sequence[dict], version: str = "edited") -> list[dict]:
    """Two lists of blocks as one, in order, the changes as editorial marks: blocks are matched by the last part of their ids
    in lower case; one that is equal stays, one that changed holds a paragraph of merged text, one that only one side
    has is marked whole."""
    x, y = [resolve_block(b, version) for b in old], [resolve_block(b, version) for b in new]
    key = lambda b: last_segment(b["id"]).lower()
    out = []
    for i, j in align([key(b) for b in x], [key(b) for b in y]):
        if j is None:
            out.append(mark_block(x[i], "deletion"))
        elif i is None:
            out.append(mark_block(y[j], "insertion"))
        elif extract_text(x[i], "both")[0] == extract_text(y[j], "both")[0]:
            out.append(y[j])
        else:
            out.append(y[j] | {"content": [{"type": "paragraph", "content": merged(x[i], y[j])}]})
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Index pairs of two sequences of keys, in order; None where one of them lacks the key."""
    out, i, j = [], 0, 0
    for op, lo, hi in shortest_script(a, b):
        for _ in range(hi - lo):
            out.append((i if op != INSERT else None, j if op != DELETE else None))
            i, j = i + (op != INSERT), j + (op != DELETE)
    return out


def align_trees(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> list[tuple[str, str, bool, bool]]:
    """path, title, in_a, in_b of two lists of (path, title) in reading order: siblings are aligned level by level, what
    only one side has keeps its children; the title is b's where both have the section. A section that is only named
    in the paths below it holds them together, but has no row."""

    def tree(rows):
        kids: dict[str, list[str]] = {}
        seen: set[str] = set()
        for path, _ in rows:
            parts = path.split("/")
            for n in range(1, len(parts) + 1):
                at = "/".join(parts[:n])
                if at not in seen:
                    seen.add(at)
                    kids.setdefault("/".join(parts[: n - 1]), []).append(at)
        return kids, dict(rows)

    (ka, ta), (kb, tb) = tree(a), tree(b)
    out: list[tuple[str, str, bool, bool]] = []

    def walk(parent: str, in_a: bool, in_b: bool) -> None:
        left, right = ka.get(parent, []) if in_a else [], kb.get(parent, []) if in_b else []
        for i, j in align(left, right):
            path = right[j] if j is not None else left[i]
            here_a, here_b = i is not None and path in ta, j is not None and path in tb
            if here_a or here_b:
                out.append((path, tb[path] if here_b else ta[path], here_a, here_b))
            walk(path, i is not None, j is not None)

    walk("", True, True)
    return out


def paired(corpus: Corpus) -> DataFrame:
    """host_slug, work, a, b: each two editions of a work, the earlier slug first. Printings of one work are few."""
    e = corpus.editions.select("host_slug", "work", "edition", "edition_id")
    o = e.select("host_slug", "work", F.col("edition").alias("later"), F.col("edition_id").alias("b"))
    both = e.join(o, ["host_slug", "work"]).filter(F.struct("edition", "edition_id") < F.struct("later", "b"))
    return both.select("host_slug", "work", F.col("edition_id").alias("a"), "b")


def pair_of(corpus: Corpus, host: str, work: str, a: str, b: str) -> DataFrame:
    """a, b: the editions of two slugs; no row if one is missing or both are the same."""
    e = corpus.editions.filter((F.col("host_slug") == host.lower()) & (F.col("work") == work.lower()))
    one = lambda slug, c: e.filter(F.col("edition") == slug.lower()).select(F.col("edition_id").alias(c))
    return one(a, "a").crossJoin(one(b, "b")).filter("a <> b")  # a row each


def align_sections(corpus: Corpus, pairs: DataFrame) -> DataFrame:
    """a, b, ordinal, path_key, title, in_a, in_b: the sections of each pair of editions aligned, in order. A pair's two lists of
    sections are one row; texts take no part."""
    s = corpus.sections.filter("path_key <> ''").groupBy("edition_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "path_key", "title"))).alias("s"))
    p = pairs.select("a", "b").join(s.select(F.col("edition_id").alias("a"), F.col("s").alias("sa")), "a", "left").join(s.select(F.col("edition_id").alias("b"), F.col("s").alias("sb")), "b", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                la, lb = ([(x["path_key"], x["title"]) for x in r[c] or []] for c in ("sa", "sb"))
                rows += [{"a": r["a"], "b": r["b"], "ordinal": i, "path_key": p, "title": t, "in_a": ia, "in_b": ib} for i, (p, t, ia, ib) in enumerate(align_trees(la, lb))]
            yield pa.RecordBatch.from_pylist(rows, ALIGNED)

    return p.mapInArrow(run, "a long, b long, ordinal int, path_key string, title string, in_a boolean, in_b boolean")


ALIGNED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ordinal", pa.int32()), ("path_key", pa.string()), ("title", pa.string()), ("in_a", pa.bool_()), ("in_b", pa.bool_())])


def block_status(corpus: Corpus, pairs: DataFrame, version: str = "edited") -> DataFrame:
    """a, b, path_key, block, status, text_a, text_b of the blocks of the sections that both editions of a pair have: equal,
    changed, deleted (a alone) or inserted (b alone). Blocks are matched by the last part of their id, in lower case."""
    original = F.coalesce(F.when(F.col("has_editorial"), F.col("text_original")), F.col("text_edited"))
    text = F.col("text_edited") if version == "edited" else original
    u = corpus.units.filter("path_key <> ''").select("edition_id", "path_key", F.lower(F.element_at(F.split("block_id", "[./]"), -1)).alias("block"), "unit_id", text.alias("text"))
    both = corpus.sections.select("edition_id", "path_key")
    keys = pairs.select("a", "b").join(both.withColumnRenamed("edition_id", "a"), "a").join(both.withColumnRenamed("edition_id", "b"), ["b", "path_key"])
    left = keys.join(u.withColumnsRenamed({"edition_id": "a", "text": "text_a", "unit_id": "unit_a"}), ["a", "path_key"])
    right = keys.join(u.withColumnsRenamed({"edition_id": "b", "text": "text_b", "unit_id": "unit_b"}), ["b", "path_key"])
    j = left.join(right, ["a", "b", "path_key", "block"], "full_outer")
    status = F.when(F.col("unit_a").isNull(), "inserted").when(F.col("unit_b").isNull(), "deleted").when(F.col("text_a").eqNullSafe(F.col("text_b")), "equal").otherwise("changed")
    return j.filter("path_key <> ''").select("a", "b", "path_key", "block", status.alias("status"), "unit_a", "unit_b", "text_a", "text_b")


ORDERED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("path_key", pa.string()), ("ordinal", pa.int32()), ("block", pa.string()), ("unit_a", pa.int64()), ("unit_b", pa.int64())])


def ordered_blocks(corpus: Corpus, pairs: DataFrame, version: str = "edited") -> DataFrame:
    """a, b, path_key, ordinal, block, kind, unit_a, unit_b, text_a, text_b: the blocks of each section that both editions
    have, in the order in which b's are turned into a's: equal, changed, inserted (a alone) or deleted (b alone). The ids
    are aligned by the shortest script, so repeated ids pair once; texts are joined after."""
    key = F.lower(F.element_at(F.split("block_id", "[./]"), -1))
    lists = corpus.units.filter("path_key <> ''").groupBy("edition_id", "path_key").agg(F.sort_array(F.collect_list(F.struct("unit_id", key.alias("block")))).alias("u"))
    side = lambda e, c: lists.select(F.col("edition_id").alias(e), "path_key", F.col("u").alias(c))
    both = pairs.select("a", "b").join(side("a", "ua"), "a").join(side("b", "ub"), ["b", "path_key"]).select("a", "b", "path_key", "ua", "ub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found = align([x["block"] for x in r["ub"]], [x["block"] for x in r["ua"]])
                for n, (j, i) in enumerate(found):
                    ub, ua = r["ub"][j] if j is not None else None, r["ua"][i] if i is not None else None
                    rows.append({"a": r["a"], "b": r["b"], "path_key": r["path_key"], "ordinal": n, "block": (ua or ub)["block"], "unit_a": ua and ua["unit_id"], "unit_b": ub and ub["unit_id"]})
            yield pa.RecordBatch.from_pylist(rows, ORDERED)

    o = both.mapInArrow(run, "a long, b long, path_key string, ordinal int, block string, unit_a long, unit_b long")
    original = F.coalesce(F.when(F.col("has_editorial"), F.col("text_original")), F.col("text_edited"))
    u = corpus.units.select("unit_id", (F.col("text_edited") if version == "edited" else original).alias("text"))
    o = o.join(u.withColumnsRenamed({"unit_id": "unit_a", "text": "text_a"}), "unit_a", "left").join(u.withColumnsRenamed({"unit_id": "unit_b", "text": "text_b"}), "unit_b", "left")
    kind = F.when(F.col("unit_a").isNull(), "deleted").when(F.col("unit_b").isNull(), "inserted").when(F.col("text_a").eqNullSafe(F.col("text_b")), "equal").otherwise("changed")
    return o.select("a", "b", "path_key", "ordinal", "block", kind.alias("kind"), "unit_a", "unit_b", "text_a", "text_b")


def neighbours_in_both(corpus: Corpus, pairs: DataFrame) -> DataFrame:
    """a, b, path_key, previous, next: along a's reading order, the nearest sections that b has too, for each section of both."""
    s = corpus.sections.filter("path_key <> ''").select("edition_id", "path_key", "ordinal")
    both = pairs.select("a", "b").join(s.withColumnRenamed("edition_id", "a"), "a").join(s.select(F.col("edition_id").alias("b"), "path_key"), ["b", "path_key"])
    w = Window.partitionBy("a", "b").orderBy("ordinal")
    return both.select("a", "b", "path_key", F.lag("path_key").over(w).alias("previous"), F.lead("path_key").over(w).alias("next"))


def child_rows(aligned: DataFrame, path: str) -> DataFrame:
    """Of align_sections() what lies under a section."""
    return aligned.filter(F.col("path_key").startswith(path.lower() + "/"))


#: How stretches are marked where a comparison is read as a text.
MARKS = {DELETE: ("[-", "-]"), INSERT: ("{+", "+}")}


def as_text(ops: Column) -> Column:
    """Stretches put together as one text, with what was taken out or in marked."""
    mark = lambda x: F.when(x["op"] == DELETE, F.concat(F.lit(MARKS[DELETE][0]), x["text"], F.lit(MARKS[DELETE][1]))).when(x["op"] == INSERT, F.concat(F.lit(MARKS[INSERT][0]), x["text"], F.lit(MARKS[INSERT][1]))).otherwise(x["text"])
    return F.array_join(F.transform(ops, mark), " ")


OPS = "array<struct<op: string, text: string>>"


def diff_ops(blocks: DataFrame) -> DataFrame:
    """Blocks with text_a and text_b with `ops` ARRAY<STRUCT<op, text>>. The text of b is compared to that of a, so what a alone
    has is an insertion. Blocks that are equal or that one side lacks have one stretch, put there by built-in
    expressions (none if it has no sign); only changed ones go to Python."""

    @F.arrow_udf(OPS)
    def ops(a: pa.Array, b: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("op", pa.string()), ("text", pa.string())]))
        return pa.array([None if x is None or y is None else word_ops(y, x) for x, y in zip(a.to_pylist(), b.to_pylist())], kind)

    a, b = F.coalesce("text_a", F.lit("")), F.coalesce("text_b", F.lit(""))
    # As it is read by signs: white space between them is one space, none at the ends.
    plain = lambda t: F.regexp_replace(F.regexp_replace(t, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", ""), r"\p{IsWhite_Space}+", " ")
    same, only_a, only_b = plain(a) == plain(b), plain(b) == "", plain(a) == ""
    whole = F.array(F.struct(F.when(same, EQUAL).when(only_a, INSERT).otherwise(DELETE).alias("op"), F.when(only_b, plain(b)).otherwise(plain(a)).alias("text")))
    alike = same | only_a | only_b
    found = blocks.withColumn("__ops", ops(F.when(~alike, a), F.when(~alike, b)))
    none = F.array().cast(OPS)
    return found.withColumn("ops", F.when(same & only_b, none).when(alike, whole.cast(OPS)).otherwise(F.col("__ops"))).drop("__ops")
