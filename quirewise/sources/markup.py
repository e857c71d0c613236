"""Documents as trees of blocks, the register of readings as it is written, and the tables made of them.

A document is {id, metadata, blocks, children}. Its id names author, work and edition, parted by full stops, and below them
its sections; a child whose id doesn't continue its parent's is borrowed. A block is {id, content}, of paragraphs, headings
(of lines), block quotes and stage directions (of further elements), lists (items that may hold a list) and tables (rows of
cells). What holds running text has a content of inline elements: {type: plainText, content: text}, or {type, content: [...]}.

Trees are walked in Python, a document at a time and in parallel; all that follows is tables.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirewise.functions.text import WORD
from quirewise.sources.model import Corpus

INSERTION, DELETION = "insertion", "deletion"
#: Inline markup whose words are read as they are printed.
EXEMPT_TYPES = ("person", "place", "org", "citation", "language")
EXEMPT = -1
_NESTING = ("heading", "blockquote", "stageDirection")


def holders(node: dict) -> Iterator[dict]:
    """Whatever in a block holds running text, in reading order."""
    kind = node.get("type")
    if kind in _NESTING or kind is None and "id" in node:
        for x in node.get("content", []):
            yield from holders(x)
    elif kind == "list":
        for item in node.get("items", []):
            yield item
            if item.get("nestedList"):
                yield from holders(item["nestedList"])
    elif kind == "table":
        for row in node.get("rows", []):
            yield from row.get("cells", [])
    else:
        yield node


def _any(inline: list, test) -> bool:
    return any(test(x) or isinstance(x.get("content"), list) and _any(x["content"], test) for x in inline)


def has_editorial(block: dict) -> bool:
    """Whether an editor inserted or deleted anything in it."""
    return any(_any(h.get("content", []), lambda x: x["type"] in (INSERTION, DELETION)) for h in holders(block))


def mark_block(block: dict, kind: str) -> dict:
    """The block with all its running text as one insertion or deletion; what is empty stays empty."""
    block = copy.deepcopy(block)
    for h in holders(block):
        h["content"] = [{"type": kind, "content": h["content"]}] if h.get("content") else []
    return block


def resolve_block(block: dict, version: str) -> dict:
    """The block as edited (insertions kept, deletions gone) or original (the other way round); both: as it is."""
    if version == "both":
        return block
    keep, drop = (INSERTION, DELETION) if version == "edited" else (DELETION, INSERTION)

    def plain(inline: list) -> list:
        out = []
        for x in inline:
            if x["type"] == keep:
                out += plain(x["content"])
            elif x["type"] != drop:
                out.append(x | {"content": plain(x["content"])} if isinstance(x.get("content"), list) else x)
        return out

    block = copy.deepcopy(block)
    for h in holders(block):
        h["content"] = plain(h.get("content", []))
    return block


def extract_text(block: dict, version: str = "edited") -> tuple[str, list[tuple[int, int, tuple[dict, ...]]]]:
    """The text of a block, its parts on lines of their own (cells of a row parted by ' | '), and its spans: start, end, and
    the inline elements around it from the outermost in."""
    text, spans = "", []

    def add(inline: list, around: tuple[dict, ...]) -> None:
        nonlocal text
        for x in inline:
            c = x.get("content")
            if isinstance(c, list):
                add(c, (*around, {k: v for k, v in x.items() if k != "content"}))
            elif c:
                spans.append((len(text), len(text) + len(c), around))
                text += c

    resolved = resolve_block(block, version)
    rows = {id(c): i for t in _tables(resolved) for i, row in enumerate(t.get("rows", [])) for c in row.get("cells", [])}
    last = None
    for h in holders(resolved):
        if text:
            text += " | " if id(h) in rows and last is not None and rows.get(id(last)) == rows[id(h)] else "\n"
        add(h.get("content", []), ())
        last = h
    return text, spans


def _tables(node: dict) -> Iterator[dict]:
    if node.get("type") == "table":
        yield node
    for x in node.get("content", []):
        if isinstance(x, dict):
            yield from _tables(x)


def tokens_of(block: dict, version: str = "edited") -> list[dict]:
    """text, start, end, exempt, word of each token: whether it stands in markup that exempts it from readings, and the value
    of a word element around it."""
    text, spans = extract_text(block, version)
    out, at = [], 0
    for m in regex.finditer(WORD.replace(r"\x{00A0}", r" "), text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        around = spans[at][2] if at < len(spans) and spans[at][0] <= m.start() else ()
        word = next((x.get("value") for x in reversed(around) if x["type"] == "word"), None)
        out.append({"text": m.group(), "start": m.start(), "end": m.end(), "exempt": any(x["type"] in EXEMPT_TYPES for x in around), "word": word})
    return out


def last_segment(name: str) -> str:
    return regex.split(r"[./]", name)[-1]


def work_segment(name: str) -> str:
    """The work in an id of author, work and edition."""
    parts = name.split(".")
    return (parts[1] if len(parts) > 1 else parts[0]).lower()


def child_slug(child: str, parent: str) -> str:
    """By which name a child stands in its parent's path: of a child of its own the last part of its id, of a borrowed one its
    work."""
    return last_segment(child).lower() if owns(parent, child) else work_segment(child)


def owns(parent: str, child: str) -> bool:
    return child.lower().startswith(parent.lower() + ".")


def _authors(meta: dict) -> list[str] | None:
    a = meta.get("authors")
    return None if a is None else [x.lower() for x in ([a] if isinstance(a, str) else a)]


def sections_of(doc: dict) -> Iterator[dict]:
    """The sections of a document in reading order, with whose text each is (owner: the id of the document that holds it), title
    and breadcrumb (else the title, else the id's last part), imported and authors (else those of what is above it)."""

    def walk(node: dict, path: list[str], imported: bool, authors: list[str], overrides: dict, owner: str) -> Iterator[dict]:
        for child in node.get("children", []):
            meta = child.get("metadata") or {}
            mine = owns(node["id"], child["id"])
            own = overrides | (meta.get("dictionary") or {})
            row = {
                "path": [*path, child_slug(child["id"], node["id"])],
                "owner": owner if mine else child["id"],
                "title": meta.get("title") or last_segment(child["id"]),
                "breadcrumb": meta.get("breadcrumb") or meta.get("title") or last_segment(child["id"]),
                "imported": meta.get("imported", imported),
                "authors": _authors(meta) or authors,
                "overrides": own,
                "node": child,
            }
            yield row
            yield from walk(child, row["path"], row["imported"], row["authors"], own, row["owner"])

    meta = doc.get("metadata") or {}
    yield from walk(doc, [], meta.get("imported", True), _authors(meta) or [], meta.get("dictionary") or {}, doc["id"])


def units_of(doc: dict) -> Iterator[tuple[list[str], str | None, dict, dict]]:
    """path, section title, block, overrides of every block that is the document's own: its titles first, then its sections in
    reading order. What it borrows is left to the document that holds it."""
    meta = doc.get("metadata") or {}
    for block in doc.get("blocks", []):
        yield [], meta.get("title"), block, meta.get("dictionary") or {}
    for s in sections_of(doc):
        if s["owner"] == doc["id"]:
            for block in s["node"].get("blocks", []):
                yield s["path"], s["title"], block, s["overrides"]


UNITS = "id string, seq long, path_key string, section_title string, block_id string, is_title boolean, has_editorial boolean, text_edited string, text_original string, block string, overrides map<string,string>, edited array<struct<text:string,start:long,end:long,exempt:boolean,word:string>>, original array<struct<text:string,start:long,end:long,exempt:boolean,word:string>>"
_TOKEN = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("exempt", pa.bool_()), ("word", pa.string())]))
_UNITS = pa.schema([("id", pa.string()), ("seq", pa.int64()), ("path_key", pa.string()), ("section_title", pa.string()), ("block_id", pa.string()), ("is_title", pa.bool_()), ("has_editorial", pa.bool_()), ("text_edited", pa.string()), ("text_original", pa.string()), ("block", pa.string()), ("overrides", pa.map_(pa.string(), pa.string())), ("edited", _TOKEN), ("original", _TOKEN)])
SECTIONS = "id string, seq long, owner string, path_key string, depth int, title string, breadcrumb string, imported boolean, authors array<string>"
_SECTIONS = pa.schema([("id", pa.string()), ("seq", pa.int64()), ("owner", pa.string()), ("path_key", pa.string()), ("depth", pa.int32()), ("title", pa.string()), ("breadcrumb", pa.string()), ("imported", pa.bool_()), ("authors", pa.list_(pa.string()))])


def _rows(of, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column("json").to_pylist():
                yield pa.RecordBatch.from_pylist(list(of(json.loads(text))), schema)

    return run


def _unit_rows(doc: dict) -> Iterator[dict]:
    for n, (path, title, block, overrides) in enumerate(units_of(doc)):
        name = last_segment(block["id"])
        touched = has_editorial(block)
        yield {
            "id": doc["id"], "seq": n, "path_key": "/".join(path), "section_title": title, "block_id": name, "is_title": name.lower() in ("title", "subtitle"),
            "has_editorial": touched, "text_edited": extract_text(block)[0], "text_original": extract_text(block, "original")[0] if touched else None,
            "block": json.dumps(block, ensure_ascii=False), "overrides": list(overrides.items()), "edited": tokens_of(block), "original": tokens_of(block, "original") if touched else [],
        }


def _section_rows(doc: dict) -> Iterator[dict]:
    for n, s in enumerate(sections_of(doc)):
        yield {"id": doc["id"], "seq": n, "owner": s["owner"], "path_key": "/".join(s["path"]), "depth": len(s["path"]), "title": s["title"], "breadcrumb": s["breadcrumb"], "imported": s["imported"], "authors": s["authors"]}


def document_units(documents: DataFrame) -> DataFrame:
    """The blocks of documents (json: one tree a row), each with its texts and tokens."""
    return documents.select("json").filter("json IS NOT NULL").mapInArrow(_rows(_unit_rows, _UNITS), UNITS)


def document_sections(documents: DataFrame) -> DataFrame:
    """The sections of documents, borrowed ones too."""
    return documents.select("json").filter("json IS NOT NULL").mapInArrow(_rows(_section_rows, _SECTIONS), SECTIONS)


def _entry_rows(shard: dict) -> Iterator[dict]:
    for surface, entry in shard.items():
        for i, reading in enumerate(entry if isinstance(entry, list) else [entry]):
            words = surface.split(" ") if reading is None else reading.split(" ")
            for w, x in enumerate(words):
                own = reading is None
                lemma = x[1:] if not own and x.startswith("=") else None
                yield {"surface": surface, "reading_idx": i, "word_idx": w, "spelling": surface if lemma is not None else x, "lemma": lemma if lemma is not None else x if own else None}


_ENTRIES = pa.schema([("surface", pa.string()), ("reading_idx", pa.int32()), ("word_idx", pa.int32()), ("spelling", pa.string()), ("lemma", pa.string())])


def dictionary_readings(shards: DataFrame) -> DataFrame:
    """surface, reading_idx, word_idx, spelling, lemma of a register written as objects (json) of surface and entry: null, the
    surface itself; 'x', spelling and lemma of entry x; '=x', its own spelling with lemma x; several words, one reading of
    them; a list, several readings, the first by default."""
    r = shards.select("json").filter("json IS NOT NULL").mapInArrow(_rows(_entry_rows, _ENTRIES), "surface string, reading_idx int, word_idx int, spelling string, lemma string")
    first = r.filter("reading_idx = 0 AND word_idx = 0 AND lemma IS NOT NULL").select(F.col("surface").alias("spelling"), F.col("lemma").alias("of_entry")).dropDuplicates(["spelling"])
    return r.join(first, "spelling", "left").select("surface", "reading_idx", "word_idx", "spelling", F.coalesce("lemma", "of_entry", "spelling").alias("lemma"))


def catalogue_tables(catalogue: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """authors, works, editions of a catalogue of authors (slug, ..., works of slug, ..., editions of slug, id, ...), a row an
    author. A work of several authors stands under each but is taken once, under its host. The edition named canonical, else
    the latest slug, is canonical."""
    a = catalogue.select("slug", *[c for c in catalogue.columns if c not in ("slug", "works")])
    w = catalogue.select(F.col("slug").alias("host"), F.explode("works").alias("w")).select("host", "w.*")
    w = w.withColumn("author_slugs", F.coalesce(F.col("authors"), F.array("host")) if "authors" in w.columns else F.array("host"))
    w = w.withColumn("host_slug", F.array_join("author_slugs", "-")).dropDuplicates(["host_slug", "slug"])
    slugs = F.array_sort(F.transform("editions", lambda e: e["slug"]))
    canonical = F.coalesce(F.col("canonical"), F.element_at(slugs, -1)) if "canonical" in w.columns else F.element_at(slugs, -1)
    works = w.select("host_slug", F.col("slug").alias("work"), "author_slugs", "title", F.coalesce(F.col("breadcrumb"), F.col("title")).alias("breadcrumb") if "breadcrumb" in w.columns else F.col("title").alias("breadcrumb"), canonical.alias("canonical_slug"), "editions")
    names = a.select(F.col("slug").alias("author"), F.concat_ws(" ", *(c for c in ("forename", "surname") if c in a.columns)).alias("name"))
    e = works.select("host_slug", "work", "author_slugs", "canonical_slug", F.explode("editions").alias("e"))
    named = e.select("host_slug", "work", F.posexplode("author_slugs").alias("n", "author")).distinct().join(names, "author", "left").groupBy("host_slug", "work").agg(F.sort_array(F.collect_list(F.struct("n", "name"))).getField("name").alias("author_names"))
    editions = e.join(named, ["host_slug", "work"]).select(F.col("e.id").alias("id"), "host_slug", "work", F.col("e.slug").alias("edition"), F.col("author_slugs").alias("authors"), "author_names", (F.col("e.slug") == F.col("canonical_slug")).alias("canonical"))
    return a, works.drop("editions"), editions


def read_documents(catalogue: DataFrame, documents: DataFrame, dictionary: DataFrame) -> Corpus:
    """A corpus of trees: catalogue of authors, documents and register shards (json, one a row). Editions and units are
    numbered in the order of authors, works and editions, and of their blocks; what an edition borrows is its member and
    stays the unit of the edition that holds it."""
    authors, works, editions = catalogue_tables(catalogue)
    number = F.row_number().over(Window.orderBy("host_slug", "work", "edition"))  # a row an edition
    editions = editions.withColumn("edition_id", number.cast("long"))
    ids = editions.select("id", "edition_id")
    u = document_units(documents).join(ids, "id")
    size = u.groupBy("edition_id").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("edition_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = u.join(size.select("edition_id", before.alias("before")), "edition_id").withColumn("unit_id", F.col("before") + F.col("seq") + 1)
    readings = dictionary_readings(dictionary)
    by = readings.groupBy("surface", "reading_idx").agg(F.sort_array(F.collect_list(F.struct("word_idx", "spelling", "lemma"))).alias("w"))
    by = by.groupBy("surface").agg(F.sort_array(F.collect_list(F.struct("reading_idx", "w"))).alias("readings"))
    sections = document_sections(documents).join(ids, "id").join(ids.select(F.col("id").alias("owner"), F.col("edition_id").alias("member_id")), "owner")
    members = sections.filter("member_id <> edition_id").select("edition_id", "member_id").distinct()

    def tokens(column: str) -> DataFrame:
        t = u.select("edition_id", "unit_id", "overrides", F.posexplode(column).alias("pos", "t"))
        folded = F.when(F.col("t.text") == "I", F.col("t.text")).otherwise(F.lower(F.translate("t.text", " ", " ")))
        first = F.substring("t.text", 1, 1)
        t = t.withColumn("surface", folded).withColumn("base", F.when(F.col("surface").rlike("['’]s$"), F.expr("substring(surface, 1, length(surface) - 2)")))
        t = t.join(by, "surface", "left").join(by.select(F.col("surface").alias("base"), F.col("readings").alias("of_base")), "base", "left")
        t = t.withColumn("known", F.coalesce("readings", "of_base")).withColumn("override", F.element_at("overrides", F.col("surface")))
        wanted = lambda v: F.get(F.filter("known", lambda r: F.when(v.startswith("="), F.concat(F.lit("="), F.array_join(r["w"]["lemma"], " "))).otherwise(F.array_join(r["w"]["spelling"], " ")) == v), F.lit(0))["reading_idx"]
        idx = F.when(F.col("t.exempt"), EXEMPT).otherwise(F.coalesce(wanted(F.col("t.word")), wanted(F.col("override")), F.lit(0)))
        return t.select("edition_id", "unit_id", F.col("pos").cast("long").alias("pos"), "surface", ((first != F.lower(first)) & (first == F.upper(first))).alias("is_capital"), idx.cast("int").alias("reading_idx"), F.col("t.start").alias("start_char"), F.col("t.end").alias("end_char"))

    units = u.select("unit_id", "edition_id", "path_key", "section_title", "block_id", "is_title", F.size("edited").cast("long").alias("token_count"), "has_editorial", "text_edited", "text_original", "block")
    return Corpus(editions=editions.drop("id"), units=units, tokens=tokens("edited"), originals=tokens("original"), readings=readings, members=members, works=works, authors=authors)


def read_folder(spark: SparkSession, folder: str) -> Corpus:
    """read_documents() of catalogue.json (a list of authors), documents/*.json and dictionary/*.json of a folder."""
    whole = lambda p: spark.read.text(f"{folder}/{p}", wholetext=True).withColumnRenamed("value", "json")
    return read_documents(spark.read.json(f"{folder}/catalogue.json", multiLine=True), whole("documents"), whole("dictionary"))
