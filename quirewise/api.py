"""The fifteen functions of the engine over one corpus, with their arguments checked.

Arguments are given by name, as values or as texts; what is absent takes its default, what is unknown or wrong raises
ValueError. Answers are lazy tables, several under their names where an answer has several parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.functions.params import absent, choice, flag, known_only, whole
from quirewise.functions.text import half_up
from quirewise.operators import compare, reading, scope, search, stats, topics, vectors
from quirewise.sources.model import Corpus

SCOPE = ("author", "work", "edition", "editions")
FIND = ("q", *SCOPE, "match", "case_sensitive", "version")
VERSIONS, BOTH = ("edited", "original"), ("edited", "original", "both")


class Engine:
    """What can be asked of a corpus."""

    def __init__(self, corpus: Corpus):
        self.corpus = corpus

    # Reading

    def catalogue(self) -> DataFrame:
        """Authors with their works and editions."""
        return reading.catalogue_tree(self.corpus)

    def _edition(self, given: dict) -> DataFrame:
        return reading.choose_edition(self.corpus, given["host"], given["work"], given.get("edition") or None)

    def edition(self, **given) -> dict[str, DataFrame]:
        """titles and sections of an edition, the canonical one if none is named (host, work, edition)."""
        known_only(given, ("host", "work", "edition"))
        e = self._edition(given)
        return {"edition": e, "titles": reading.title_blocks(self.corpus, e), "sections": reading.contents(self.corpus, e).orderBy("ordinal")}

    def full_text(self, **given) -> DataFrame:
        """All blocks of an edition in reading order (host, work, edition, version)."""
        known_only(given, ("host", "work", "edition", "version"))
        version = choice("version", given.get("version"), BOTH, "edited")
        return reading.ordered_text(self.corpus, self._edition(given), version).orderBy("place")

    def section(self, subtree: bool = False, **given) -> dict[str, DataFrame]:
        """A section and the way through the edition, and its blocks in reading order (host, work, edition, path, version)."""
        known_only(given, ("host", "work", "edition", "path", "version"))
        version = choice("version", given.get("version"), BOTH, "edited")
        e = self._edition(given)
        return {"section": reading.section_answer(self.corpus, e, given["path"]), "blocks": reading.ordered_text(self.corpus, e, version, given["path"], subtree).orderBy("place")}

    def section_full_text(self, **given) -> dict[str, DataFrame]:
        """section() with all that is under it."""
        return self.section(subtree=True, **given)

    # Comparison

    def _pair(self, given: dict) -> DataFrame:
        return compare.pair_of(self.corpus, given["host"], given["work"], given["a"], given["b"])

    def compare(self, **given) -> DataFrame:
        """The sections of two editions side by side, in order (host, work, a, b); nothing if one is missing or both are one."""
        known_only(given, ("host", "work", "a", "b"))
        return compare.align_sections(self.corpus, self._pair(given)).orderBy("ordinal")

    def compare_section(self, **given) -> dict[str, DataFrame]:
        """A section of two editions (host, work, a, b, path, version): its blocks in order with what changed, the neighbours that
        both have, what lies under it, and further editions that have it."""
        known_only(given, ("host", "work", "a", "b", "path", "version"))
        version = choice("version", given.get("version"), VERSIONS, "edited")
        pair, path = self._pair(given), given["path"].lower()
        here = F.col("path_key") == path
        blocks = compare.diff_ops(compare.ordered_blocks(self.corpus, pair, version).filter(here)).withColumn("marked", compare.as_text(F.col("ops")))
        others = reading.matching_editions(self.corpus).filter(here).join(pair.select(F.col("a").alias("edition_id"), "b"), "edition_id").filter("other_id <> b")
        return {
            "blocks": blocks.orderBy("ordinal"),
            "nav": compare.neighbours_in_both(self.corpus, pair).filter(here),
            "children": compare.child_rows(compare.align_sections(self.corpus, pair), path).orderBy("ordinal"),
            "others": others.select("other_id", "other").orderBy("other"),
        }

    # Finding

    def _scope(self, given: dict) -> DataFrame:
        g = {k: None if absent(given.get(k)) else given[k] for k in SCOPE}
        wanted = scope.check_scope(g["work"], g["edition"], g["editions"])
        return scope.scoped(self.corpus, g["author"], g["work"], wanted)

    def _phrase(self, given: dict, resolved: bool = False):
        version = choice("version", given.get("version"), VERSIONS, "edited")
        match = choice("match", given.get("match"), search.LEVELS, "form")
        return *search.phrase(self.corpus, given.get("q") or "", match, flag("case_sensitive", given.get("case_sensitive")), resolved, version), version

    def search(self, **given) -> dict[str, DataFrame]:
        """A page of the blocks that hold a phrase, best first, with their citations and where in their texts the matches
        stand (ranges), and how many there are."""
        known_only(given, (*FIND, "resolved", "page", "per_page"))
        page, size = whole("page", given.get("page"), 1), whole("per_page", given.get("per_page"), 20, most=100)
        s, first, n, version = self._phrase(given, flag("resolved", given.get("resolved")))
        hits = search.ranked(self.corpus, first, n, self._scope(given)).withColumn("score", half_up(F.col("score"), 9))
        top = search.page(hits, [F.desc("score"), "unit_id"], page, size).select("unit_id", "score")
        only = lambda df: df.join(F.broadcast(top.select("unit_id")), "unit_id", "left_semi")
        marks = search.highlights(only(s), only(first), n).groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char"))).alias("ranges"))
        text = F.col("text_edited") if version == "edited" else F.coalesce(F.when(F.col("has_editorial"), F.col("text_original")), F.col("text_edited"))
        rows = search.cited(self.corpus, top).join(marks, "unit_id").join(self.corpus.units.select("unit_id", text.alias("text")), "unit_id")
        return {"total": search.total_and_pages(hits, size), "results": rows.orderBy(F.desc("score"), "unit_id")}

    def frequency(self, **given) -> DataFrame:
        """How often a phrase occurs by author, work or edition (group_by), and for each 1,000 tokens, most frequent first."""
        known_only(given, (*FIND, "group_by"))
        by = choice("group_by", given.get("group_by"), ("author", "work", "edition"), "work")
        _, first, n, _ = self._phrase(given)
        return search.labelled(self.corpus, search.frequency(self.corpus, first, n, self._scope(given), by), by)

    def concordance(self, **given) -> dict[str, DataFrame]:
        """A page of the occurrences of a phrase with what stands around them, as printed, and how many there are."""
        known_only(given, (*FIND, "window", "sort", "page", "per_page"))
        page, size = whole("page", given.get("page"), 1), whole("per_page", given.get("per_page"), 20, most=100)
        order = search.line_order(choice("sort", given.get("sort"), ("position", "left", "right"), "position"))
        _, first, n, version = self._phrase(given)
        found = search.concordance(self.corpus, first, n, self._scope(given), whole("window", given.get("window"), 6, most=25), version)
        rows = search.lines(self.corpus, search.page(found, order, page, size), version)
        return {"total": search.total_and_pages(found, size), "lines": search.cited(self.corpus, rows).orderBy(*order)}

    # Statistics

    def keywords(self, **given) -> DataFrame:
        """What an author, or a work of theirs, over-uses. Without an author nothing."""
        known_only(given, (*SCOPE, "by", "version", "min", "limit"))
        by = choice("by", given.get("by"), ("exact", "form", "lemma"), "lemma")
        version = choice("version", given.get("version"), VERSIONS, "edited")
        g = {k: None if absent(given.get(k)) else given[k] for k in SCOPE}
        wanted = scope.check_scope(g["work"], g["edition"], g["editions"])
        target, reference = stats.sides(self.corpus, g["author"], g["work"], wanted)
        return stats.keyness(self.corpus, target, reference, by, version, whole("min", given.get("min"), 5), whole("limit", given.get("limit"), 50, most=500))

    def collocations(self, **given) -> dict[str, DataFrame]:
        """What stands near the words of q more often than chance, and the figures that this rests on."""
        known_only(given, ("q", *SCOPE, "match", "by", "window", "min", "limit"))
        q, match = given.get("q") or "", choice("match", given.get("match"), search.LEVELS, "form")
        by, window = choice("by", given.get("by"), ("lemma", "exact"), "lemma"), whole("window", given.get("window"), 5, most=25)
        s = self._scope(given)
        rows = stats.collocations(self.corpus, q, s, match, "surface" if by == "exact" else by, window, whole("min", given.get("min"), 3), whole("limit", given.get("limit"), 50, most=500))
        return {"figures": stats.colloc_figures(self.corpus, q, s, match, window), "results": rows}

    # Vectors

    def similar(self, **given) -> DataFrame:
        """What is most like a work, an edition or a section (author, work, edition, path, level, limit)."""
        known_only(given, ("author", "work", "edition", "path", "level", "limit"))
        level = choice("level", given.get("level"), vectors.LEVELS)
        return vectors.similar_answer(self.corpus, given["author"], given["work"], level, given.get("path"), given.get("edition"), whole("limit", given.get("limit"), 20, most=200))

    def topics(self, **given) -> dict[str, DataFrame]:
        """The topics with their first lemmas, their labels, and the works with most of each (terms, works)."""
        known_only(given, ("terms", "works"))
        n, works = whole("terms", given.get("terms"), 12, most=25), whole("works", given.get("works"), 8, most=50)
        terms, mix = topics.stored(self.corpus)
        shown = terms.filter(F.col("rank") <= n).withColumn("weight", half_up(F.col("weight"), 4))
        return {"terms": shown.orderBy("topic", "rank"), "labels": topics.labels(terms).orderBy("topic"), "works": topics.prominent(mix, self.corpus.editions, works).orderBy("topic", "rank")}

    def topic_mix(self, **given) -> DataFrame:
        """The topics of a work, an edition or a section (author, work, edition, path, level, limit)."""
        known_only(given, ("author", "work", "edition", "path", "level", "limit"))
        level = choice("level", given.get("level"), vectors.LEVELS)
        return topics.topic_mix(self.corpus, given.get("author"), given.get("work"), level, given.get("path"), given.get("edition"), whole("limit", given.get("limit"), 10))
