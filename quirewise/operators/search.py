"""Phrase search: matching, ranking, frequency, concordance."""

from __future__ import annotations

from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewise.functions.text import WORD, half_up
from quirewise.session import join_lookup
from quirewise.sources.model import Corpus

LEVELS = ("exact", "spelling", "form")
K1, B, TITLE = 1.2, 0.75, 3.0


@dataclass(frozen=True)
class QueryWord:
    surface: str
    capital: bool


def _printed_words(q: str) -> list[tuple[str, bool, int, int]]:
    """Folded word, whether it begins with a capital, start and end of each word of a query."""
    pattern = regex.compile(WORD.replace(r"\x{00A0}", r"\u00a0"))
    fold = lambda w: w if w == "I" else w.replace("\u00a0", " ").lower()
    return [(fold(m.group()), m.group()[0] != m.group()[0].lower() and m.group()[0] == m.group()[0].upper(), m.start(), m.end()) for m in pattern.finditer(q)]


def runs_of(q: str, longest: int) -> list[str]:
    """What stands in a query with white space alone between its words, in runs of two to `longest` words."""
    found, out = _printed_words(q), []
    for i in range(len(found)):
        for j in range(i + 1, min(i + longest, len(found))):
            if not q[found[j - 1][3] : found[j][2]].isspace():
                break
            out.append(" ".join(w[0] for w in found[i : j + 1]))
    return out


def parse_query(q: str, fused: set[str] | frozenset[str] = frozenset()) -> list[QueryWord]:
    """The words of a query, folded; runs of words that white space alone parts are fused, longest first, where their
    joined fold is a printed surface of several words (fused)."""
    found = _printed_words(q)
    longest = max((s.count(" ") + 1 for s in fused), default=1)
    out, i = [], 0
    while i < len(found):
        size = 1
        for n in range(min(longest, len(found) - i), 1, -1):
            run = found[i : i + n]
            apart = all(q[a[3] : b[2]].isspace() for a, b in zip(run, run[1:]))
            if apart and " ".join(w[0] for w in run) in fused:
                size = n
                break
        out.append(QueryWord(" ".join(w[0] for w in found[i : i + size]), found[i][1]))
        i += size
    return out


#: Readings of printed surfaces, by surface.
Known = dict[str, list]
CLITICS = ("'s", "\u2019s")


def look_up(corpus: Corpus, surfaces: list[str]) -> Known:
    """The readings of those surfaces, and of the bases of possessives among them, that are printed: one job, whose rows
    are bounded by the query."""
    names = sorted({*surfaces, *(s[:-2] for s in surfaces if s.endswith(CLITICS))})
    known: Known = {}
    for r in corpus.vocabulary_readings.filter(F.col("surface").isin(names)).select("surface", "reading_idx", "word_idx", "spelling", "lemma").collect() if names else []:
        known.setdefault(r.surface, []).append(r)
    return known


def parse(corpus: Corpus, q: str) -> tuple[list[QueryWord], Known]:
    """The words of a query, and what is known of them. Only runs that stand in the query are looked up, so however many
    surfaces of several words are printed, none but these reach the driver."""
    runs = runs_of(q, corpus.longest)
    known = look_up(corpus, [*runs, *(w[0] for w in _printed_words(q))])
    return parse_query(q, {r for r in runs if r in known}), known


def bucket(corpus: Corpus, surface: str, known: Known | None = None) -> tuple[str, str]:
    """Spelling and lemma by which a query word is expanded: its own first reading (for one word its first word alone);
    else, for an unprinted possessive, its printed base's; else itself."""
    known = look_up(corpus, [surface]) if known is None else known
    first = lambda n: sorted((r for r in known.get(n, []) if r.reading_idx == 0), key=lambda r: r.word_idx)
    join = lambda rs, c: " ".join(r[c] for r in rs)
    if own := first(surface):
        return (join(own, "spelling"), join(own, "lemma")) if " " in surface else (own[0].spelling, own[0].lemma)
    if surface.endswith(CLITICS) and (base := first(surface[:-2])):
        return join(base, "spelling") + surface[-2:], join(base, "lemma")
    return surface, surface


def expand(corpus: Corpus, surface: str, match: str, known: Known | None = None) -> DataFrame:
    """surface of all printed surfaces that match a query word at the level. Several words must match a whole reading."""
    if match not in LEVELS:
        raise ValueError(f"match must be one of {LEVELS}")
    v = corpus.vocabulary_readings
    if match == "exact":
        return v.filter(F.col("surface") == surface).select("surface").distinct()
    column = "spelling" if match == "spelling" else "lemma"
    target = bucket(corpus, surface, known)[match == "form"]
    if " " not in target:
        return v.filter(F.col(column) == target).select("surface").distinct()
    # The first of the target's words picks the readings that can match; only these are put together.
    some = v.join(v.filter((F.col("word_idx") == 0) & F.lit(target).startswith(F.col(column))).select("surface", "reading_idx").distinct(), ["surface", "reading_idx"], "left_semi")
    whole = some.groupBy("surface", "reading_idx").agg(F.array_join(F.sort_array(F.collect_list(F.struct("word_idx", column))).getField(column), " ").alias("w"))
    return whole.filter(F.col("w") == target).select("surface").distinct()


#: Surfaces of a query that go into the filter of the scan; more are joined.
LISTED = 1000


def marked(tokens: DataFrame, sets: list[DataFrame]) -> DataFrame:
    """The tokens whose surface is in some of the sets, with m0 .. mk: in which. A few surfaces become a filter that reaches
    the scan; more are joined, one row a surface."""
    e = sets[0].withColumn("slot", F.lit(0))
    for i, s in enumerate(sets[1:], 1):
        e = e.unionByName(s.withColumn("slot", F.lit(i)))
    got = e.take(LISTED + 1)
    if len(got) <= LISTED:
        of = [sorted(r.surface for r in got if r.slot == i) for i in range(len(sets))]
        t = tokens.filter(F.col("surface").isin(sorted({r.surface for r in got})))
        return t.withColumns({f"m{i}": F.col("surface").isin(x) if x else F.lit(False) for i, x in enumerate(of)})
    e = e.groupBy("surface").agg(F.collect_set("slot").alias("__slots"))
    t = join_lookup(tokens, e, "surface")
    return t.withColumns({f"m{i}": F.array_contains("__slots", i) for i in range(len(sets))}).drop("__slots")


def slots(corpus: Corpus, words: list[QueryWord], match: str = "form", case: bool = False, resolved: bool = False, version: str = "edited", known: Known | None = None) -> DataFrame:
    """edition_id, unit_id, pos, m0 .. mk of the tokens that can stand for some word: for which of them. Filtered by surface
    before anything else is done; one word is looked for in the copy that lies in the order of surfaces, a phrase where
    units lie together."""
    known = look_up(corpus, [w.surface for w in words]) if known is None else known
    t = corpus.version(version, by_surface=len(words) == 1).select("edition_id", "unit_id", "pos", "surface", "is_capital", "reading_idx", "start_char", "end_char")
    t = marked(t, [expand(corpus, w.surface, match, known) for w in words])
    if case:
        t = t.withColumns({f"m{i}": F.col(f"m{i}") & (F.col("is_capital") == F.lit(w.capital)) for i, w in enumerate(words)})
    if resolved and match == "form":
        t = corpus.lemmas(t)
        for i, w in enumerate(words):
            target = bucket(corpus, w.surface, known)[1]
            ok = F.array_contains("lemmas", target) if " " not in target else F.array_join("lemmas", " ") == target
            t = t.withColumn(f"m{i}", F.col(f"m{i}") & ok)
    if resolved and match == "spelling":
        r = corpus.vocabulary_readings.select("surface", F.col("reading_idx").alias("ri"), "spelling")
        for i, w in enumerate(words):
            target = bucket(corpus, w.surface, known)[0]
            pair = r.filter(F.col("spelling") == target).groupBy("surface").agg(F.collect_set("ri").alias("ok"))
            # an exempt token reads as its own words
            own = (F.col("reading_idx") == -1) & F.array_contains(F.split("surface", " "), target)
            ok = F.coalesce(F.array_contains("ok", F.coalesce("reading_idx", F.lit(0))), F.lit(False))
            t = join_lookup(t, pair, "surface", "left").withColumn(f"m{i}", F.col(f"m{i}") & (ok | own)).drop("ok")
    return t


def starts(slotted: DataFrame, n: int) -> DataFrame:
    """edition_id, unit_id, pos of the first token of each match of an n-word phrase: one exchange by unit, whatever n."""
    if n == 1:
        return slotted.filter("m0").select("edition_id", "unit_id", "pos")
    # Only tokens that stand for some word of the phrase are sorted: of a match, none is missing between.
    slotted = slotted.filter(" OR ".join(f"m{i}" for i in range(n)))
    w = Window.partitionBy("unit_id").orderBy("pos")
    ok: Column = F.col("m0")
    for i in range(1, n):
        ok = ok & F.coalesce(F.lead(f"m{i}", i).over(w), F.lit(False)) & (F.lead("pos", i).over(w) == F.col("pos") + i)
    return slotted.withColumn("hit", ok).filter("hit").select("edition_id", "unit_id", "pos")


def positions(first: DataFrame, n: int) -> DataFrame:
    """The distinct positions that the matches cover."""
    if n == 1:
        return first
    return first.select("edition_id", "unit_id", F.explode(F.sequence("pos", F.col("pos") + n - 1)).alias("pos")).distinct()


def occurrences(first: DataFrame, n: int) -> DataFrame:
    """edition_id, unit_id, pos, end_pos of occurrences that don't overlap, from the left; a run's tail too short is none."""
    p = positions(first, n)
    w = Window.partitionBy("unit_id").orderBy("pos")
    p = p.withColumn("island", F.col("pos") - F.row_number().over(w))
    runs = p.groupBy("edition_id", "unit_id", "island").agg(F.min("pos").alias("a"), F.count(F.lit(1)).alias("size")).filter(F.col("size") >= n)
    k = F.floor(F.col("size") / n)
    return runs.select("edition_id", "unit_id", F.explode(F.sequence(F.lit(0).cast("long"), k - 1)).alias("i"), "a").select("edition_id", "unit_id", (F.col("a") + F.col("i") * n).alias("pos"), (F.col("a") + F.col("i") * n + n - 1).alias("end_pos"))


def ranked(corpus: Corpus, first: DataFrame, n: int, scope: DataFrame) -> DataFrame:
    """unit_id, edition_id, path_key, block_id, is_title, tf, score of the units in scope with a match. Frequencies in
    the corpus come before scoping; lengths are those of the edited text."""
    u = corpus.units.select("unit_id", "edition_id", "path_key", "section_title", "block_id", "is_title", F.coalesce("token_count", F.lit(0)).alias("length"))
    tf = first.groupBy("unit_id").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    whole = u.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg")).alias("z")).scalar()
    df = tf.agg(F.count(F.lit(1))).scalar()
    hits = u.join(tf, "unit_id").join(scope.select("edition_id"), "edition_id", "left_semi")
    hits = hits.withColumns({"df": df, "z": whole}).withColumns({"idf": F.log(1 + (F.col("z.n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), "mean": F.col("z.avg")})
    score = F.col("idf") * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))) * F.when(F.col("is_title"), TITLE).otherwise(1.0)
    return hits.withColumn("score", score).drop("df", "z", "idf", "mean")


def page(df: DataFrame, order: list, number: int = 1, size: int = 20, most: int = 100) -> DataFrame:
    """One page, in order; sizes beyond the most are cut to it, pages past the end are empty."""
    size = max(1, min(size, most))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def phrase(corpus: Corpus, q: str, match: str = "form", case: bool = False, resolved: bool = False, version: str = "edited") -> tuple[DataFrame, DataFrame, int]:
    """Slots, starts and length of a query."""
    words, known = parse(corpus, q.strip())
    if not words:
        s = corpus.version(version).select("edition_id", "unit_id", "pos", "surface", "is_capital", "reading_idx", "start_char", "end_char").filter(F.lit(False)).withColumn("m0", F.lit(False))
        return s, starts(s, 1), 1
    s = slots(corpus, words, match, case, resolved, version, known)
    return s, starts(s, len(words)), len(words)


def total_and_pages(hits: DataFrame, size: int = 20) -> DataFrame:
    """total, pages: of a ranking, and of how many pages of that size it is (1 at least)."""
    return hits.agg(F.count(F.lit(1)).alias("total")).select("total", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / size)).alias("pages"))


def cited(corpus: Corpus, hits: DataFrame) -> DataFrame:
    """Hits (unit_id and what else) with whose text it is and where it stands: authors, author_names, host_slug, work,
    work_breadcrumb, edition, path_key, section_title, block_id. For a page of hits, as it looks up each."""
    e = corpus.editions.select("edition_id", "authors", "author_names", "host_slug", "work", "edition")
    w = corpus.works.groupBy("host_slug", "work").agg(F.min("breadcrumb").alias("work_breadcrumb"))
    u = corpus.units.select("unit_id", "edition_id", "path_key", "section_title", "block_id")
    rest = [c for c in hits.columns if c not in ("edition_id", "path_key", "section_title", "block_id")]
    return hits.select(*rest).join(u, "unit_id").join(e, "edition_id").join(w, ["host_slug", "work"], "left")


def frequency(corpus: Corpus, first: DataFrame, n: int, scope: DataFrame, by: str = "work") -> DataFrame:
    """key columns, count, tokens, per_1000 by author, work or edition. Tokens are those of all in-scope editions of the groups
    that have a match. An edition of several authors counts for each."""
    covered = positions(first, n).groupBy("edition_id", "unit_id").agg(F.count(F.lit(1)).alias("p"))
    per = covered.groupBy("edition_id").agg(F.sum(F.floor(F.col("p") / n + 0.5)).cast("long").alias("count"))
    size = corpus.units.groupBy("edition_id").agg(F.sum("token_count").alias("tokens"))
    s = scope.join(size, "edition_id", "left").join(per, "edition_id", "left").na.fill(0, ["tokens", "count"])
    keys = {"author": ["author"], "work": ["host_slug", "work"], "edition": ["host_slug", "work", "edition"]}[by]
    if by == "author":
        s = s.withColumn("author", F.explode("authors"))
    g = s.groupBy(*keys).agg(F.sum("count").alias("count"), F.sum("tokens").alias("tokens")).filter("count > 0")
    rate = F.when(F.col("tokens") > 0, half_up(F.col("count") / F.col("tokens") * 1000, 1)).otherwise(0.0)
    return g.select(*keys, "count", "tokens", rate.alias("per_1000"))


def labelled(corpus: Corpus, f: DataFrame, by: str = "work") -> DataFrame:
    """frequency() with `label`, most frequent first, ties by key: an author's name, a work's breadcrumb, or that with the
    edition in brackets."""
    keys = {"author": ["author"], "work": ["host_slug", "work"], "edition": ["host_slug", "work", "edition"]}[by]
    if by == "author":
        names = corpus.editions.select(F.explode(F.arrays_zip("authors", "author_names")).alias("x")).groupBy(F.col("x.authors").alias("author")).agg(F.min("x.author_names").alias("label"))
        f = f.join(names, "author", "left")
    else:
        f = f.join(corpus.works.groupBy("host_slug", "work").agg(F.min("breadcrumb").alias("label")), ["host_slug", "work"], "left")
        if by == "edition":
            f = f.withColumn("label", F.concat("label", F.lit(" ("), "edition", F.lit(")")))
    return f.select("label", *keys, "count", "tokens", "per_1000").orderBy(F.desc("count"), *keys)


def concordance(corpus: Corpus, first: DataFrame, n: int, scope: DataFrame, window: int = 6, version: str = "edited") -> DataFrame:
    """unit_id, pos, lefts (nearest first), keyword, rights of each occurrence in scope, clamped to the unit; cut_left and
    cut_right tell whether the unit goes on; span: where in the text the left context, the keyword and the right context
    begin and end."""
    window = max(1, min(window, 25))
    occ = occurrences(first, n).join(scope.select("edition_id"), "edition_id", "left_semi")
    near = corpus.version(version).join(occ.select("unit_id").distinct(), "unit_id", "left_semi").select("unit_id", F.col("pos").alias("p"), "surface", "start_char", "end_char")
    lo, hi = F.col("pos") - window - 1, F.col("end_pos") + window + 1
    o = occ.select("unit_id", "pos", "end_pos", F.explode(F.sequence(lo, hi)).alias("p")).join(near, ["unit_id", "p"])
    left = (F.col("p") < F.col("pos")) & (F.col("p") >= F.col("pos") - window)
    key = F.col("p").between(F.col("pos"), F.col("end_pos"))
    right = (F.col("p") > F.col("end_pos")) & (F.col("p") <= F.col("end_pos") + window)
    pick = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.struct("p", "surface")))).getField("surface")
    ends = [f(F.when(cond, F.col(c))).alias(f"{side}_{c[:-5]}") for side, cond in (("left", left), ("key", key), ("right", right)) for f, c in ((F.min, "start_char"), (F.max, "end_char"))]
    g = o.groupBy("unit_id", "pos", "end_pos").agg(
        pick(left).alias("before"),
        pick(key).alias("key"),
        pick(right).alias("rights"),
        F.max(F.col("p") < F.col("pos") - window).alias("cut_left"),
        F.max(F.col("p") > F.col("end_pos") + window).alias("cut_right"),
        F.struct(*ends).alias("span"),
    )
    return g.select("unit_id", "pos", F.reverse("before").alias("lefts"), F.array_join("key", " ").alias("keyword"), "rights", "cut_left", "cut_right", "span")


def lines(corpus: Corpus, found: DataFrame, version: str = "edited") -> DataFrame:
    """A page of concordance() with left, key and right as printed: cut from the text of the version."""
    text = F.col("text_edited")
    if version == "original":
        text = F.coalesce(F.when(F.col("has_editorial"), F.col("text_original")), text)
    u = corpus.units.select("unit_id", text.alias("text"))
    cut = lambda side: F.coalesce(F.substr(F.col("text"), (F.col(f"span.{side}_start") + 1).cast("int"), (F.col(f"span.{side}_end") - F.col(f"span.{side}_start")).cast("int")), F.lit("")).alias(side)
    return found.join(u, "unit_id").select(*found.columns, cut("left"), cut("key"), cut("right"))


def line_order(sort: str) -> list:
    """How the lines of a concordance are sorted."""
    where = ["unit_id", "pos"]
    return {"position": where, "left": ["lefts", *where], "right": ["rights", *where]}[sort]


def highlights(slotted: DataFrame, first: DataFrame, n: int) -> DataFrame:
    """unit_id, start_char, end_char: stretches of the text that matches cover; neighbouring tokens merge."""
    p = positions(first, n)
    w = Window.partitionBy("unit_id").orderBy("pos")
    p = p.withColumn("island", F.col("pos") - F.row_number().over(w)).join(slotted.select("unit_id", "pos", "start_char", "end_char"), ["unit_id", "pos"])
    return p.groupBy("unit_id", "island").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char")).drop("island")
