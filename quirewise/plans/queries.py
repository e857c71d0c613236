"""The named queries over the reference tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.functions.text import WORD, half_up, is_capital, words
from quirewise.operators import compare, reading, scope, search, stats, topics, vectors
from quirewise.plans.prelude import CTES, sql
from quirewise.plans.prelude import half_up as half_up_sql
from quirewise.sources.artefacts import load
from quirewise.sources.corpus import table
from quirewise.sources.model import Corpus, from_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Words that the queries look for.
WORD_1, WORD_2, PHRASE_2, PHRASE_3, ODD = "merchant", "author", "of the", "opinion of the", "surprized"
#: The section of which like ones are looked for.
SECTION = "2"


def query(text: str | None = None):
    def add(f: Callable[[Corpus], DataFrame]):
        QUERIES[f.__name__] = lambda spark, d: f(load(spark, d))
        if text is not None:
            ORACLE[f.__name__] = text
        return f

    return add


def raw(text: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE[f.__name__] = text
        return f

    return add


def subject(c: Corpus) -> tuple[str, str]:
    """The author and work that scoped queries ask for: the first of the canonical editions."""
    e = c.editions.filter("canonical").select(F.col("authors")[0].alias("a"), F.explode("authors").alias("author"), "work")
    least = e.agg(F.min("a")).scalar()
    row = e.filter(F.col("author") == least).groupBy("author").agg(F.min("work").alias("work")).first()
    return row.author, row.work


IDS = ["edition_id", "host_slug", "work", "edition"]

# Tokens, readings, vocabulary


@raw("SELECT doc_id, (i - 1)::BIGINT AS pos, w AS token, CASE WHEN w = 'I' THEN w ELSE lower(replace(w, ' ', ' ')) END AS surface FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '" + WORD.replace("'", "''") + "') AS l FROM documents))")
def tokens_by_doc(spark: SparkSession, d: str) -> DataFrame:
    return from_documents(table(spark, d, "documents")).drop("is_capital")


@raw("SELECT doc_id, count(*) AS tokens, sum((w[1] <> lower(w[1]) AND w[1] = upper(w[1]))::INT)::BIGINT AS capitals FROM (SELECT doc_id, unnest(regexp_extract_all(text, '" + WORD.replace("'", "''") + "')) AS w FROM documents) GROUP BY 1")
def tokens_capital(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.explode(words(F.col("text"))).alias("w"))
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.sum(is_capital(F.col("w")).cast("long")).alias("capitals"))


@query(sql("SELECT edition_id, unit_id, pos, surface, is_capital FROM tk", "tk"))
def counted_tokens(c: Corpus) -> DataFrame:
    return c.tokens.select("edition_id", "unit_id", "pos", "surface", "is_capital")


@query(sql("SELECT edition_id, unit_id, pos, surface FROM torig", "torig"))
def original_tokens(c: Corpus) -> DataFrame:
    return c.version("original").select("edition_id", "unit_id", "pos", "surface")


@query(sql("SELECT surface, reading_idx, word_idx, spelling, lemma FROM vr WHERE surface NOT IN (SELECT surface FROM rd) AND NOT surface LIKE '%''s'", "vr"))
def readings_identity(c: Corpus) -> DataFrame:
    v = c.vocabulary_readings.filter(~F.col("surface").endswith("'s"))
    return v.join(c.register.select("surface").distinct(), "surface", "left_anti").select("surface", "reading_idx", "word_idx", "spelling", "lemma")


@query(sql("SELECT surface, reading_idx, word_idx, spelling, lemma FROM vr WHERE surface LIKE '%''s' AND surface NOT IN (SELECT surface FROM rd)", "vr"))
def possessive_form(c: Corpus) -> DataFrame:
    v = c.vocabulary_readings.filter(F.col("surface").endswith("'s"))
    return v.join(c.register.select("surface").distinct(), "surface", "left_anti").select("surface", "reading_idx", "word_idx", "spelling", "lemma")


@query(sql("SELECT unit_id, pos, array_to_string(lemmas, ' ') AS lemmas FROM tl", "tl"))
def resolved_readings(c: Corpus) -> DataFrame:
    return c.lemmas(c.tokens).select("unit_id", "pos", F.array_join("lemmas", " ").alias("lemmas"))


@query(sql("SELECT 'spelling' AS kind, spelling AS word, surface FROM vr UNION SELECT 'lemma', lemma, surface FROM vr", "vr"))
def vocab_buckets(c: Corpus) -> DataFrame:
    v = c.vocabulary_readings
    return v.select(F.lit("spelling").alias("kind"), F.col("spelling").alias("word"), "surface").unionByName(v.select(F.lit("lemma").alias("kind"), F.col("lemma").alias("word"), "surface")).distinct()


@query(sql("SELECT surface, count(*) AS cf, count(DISTINCT unit_id) AS df FROM tk GROUP BY 1", "tk"))
def vocab_df_cf(c: Corpus) -> DataFrame:
    per = c.tokens.groupBy("unit_id", "surface").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("surface").agg(F.sum("n").alias("cf"), F.count(F.lit(1)).alias("df"))


@query(sql("SELECT (SELECT count(DISTINCT slug) FROM au) AS authors, (SELECT count(*) FROM (SELECT DISTINCT host_slug, work FROM wk)) AS works, (SELECT count(*) FROM ed) AS editions, (SELECT count(*) FROM un) AS units, (SELECT count(*) FROM tk) AS tokens, count(DISTINCT surface) AS surfaces, count(DISTINCT spelling) AS spellings, count(DISTINCT lemma) AS lemmas FROM vr", "au", "wk", "ed", "un", "vr"))
def corpus_stats(c: Corpus) -> DataFrame:
    return reading.stats(c)


# Scope

@query(sql("SELECT edition_id, member_id FROM bor", "bor"))
def edition_members(c: Corpus) -> DataFrame:
    return c.borrowed


@query(sql("SELECT DISTINCT edition_id, member_id FROM mem", "mem"))
def edition_borrows(c: Corpus) -> DataFrame:
    return c.members.distinct()


@query(sql("SELECT DISTINCT edition FROM ed", "ed"))
def edition_slugs(c: Corpus) -> DataFrame:
    return c.editions.select("edition").distinct()


@query(sql("SELECT edition_id, host_slug, work, edition FROM ed WHERE canonical", "ed"))
def scope_canonical(c: Corpus) -> DataFrame:
    return scope.scoped(c).select(*IDS)


@query(sql("SELECT edition_id, host_slug, work, edition FROM ed", "ed"))
def scope_all(c: Corpus) -> DataFrame:
    return scope.scoped(c, wanted=scope.check_scope(editions="all")).select(*IDS)


def in_scope_sql(work: str, table: str = "bor", more: str = "") -> str:
    """SQL of the ids in the scope of a work: its canonical editions and what they borrow."""
    return f"SELECT edition_id FROM ed WHERE edition_id IN (SELECT edition_id FROM ed WHERE canonical AND work = {work} UNION SELECT member_id FROM {table} JOIN ed USING (edition_id) WHERE canonical AND work = {work}){more}"


_CONTAINER = "(SELECT min(work) FROM ed WHERE edition_id IN (SELECT edition_id FROM mem))"
_CHAINED = "(SELECT min(work) FROM ed WHERE edition_id IN (SELECT edition_id FROM mem2))"


def first_work(c: Corpus, holding: DataFrame) -> str:
    return c.editions.join(holding.select("edition_id"), "edition_id", "left_semi").agg(F.min("work")).first()[0] or ""


def chained(c: Corpus) -> DataFrame:
    """Editions that borrow from one that borrows."""
    return c.members.join(c.members.select(F.col("edition_id").alias("member_id")), "member_id", "left_semi")


@query(sql(f"SELECT edition_id, host_slug, work, edition FROM ed WHERE edition_id IN ({in_scope_sql(_CONTAINER)})", "bor"))
def scope_work_containment(c: Corpus) -> DataFrame:
    return scope.scoped(c, work=first_work(c, c.members)).select(*IDS)


@query(sql(f"SELECT edition_id, host_slug, work, edition FROM ed WHERE edition_id IN ({in_scope_sql(_CHAINED)})", "bor"))
def scope_transitive(c: Corpus) -> DataFrame:
    return scope.scoped(c, work=first_work(c, chained(c))).select(*IDS)


@query(sql("SELECT edition_id, host_slug, work, edition FROM ed WHERE canonical AND list_contains(authors, (SELECT author FROM who))", "ed", "who"))
def scope_author(c: Corpus) -> DataFrame:
    return scope.scoped(c, author=subject(c)[0]).select(*IDS)


# Search


def level_sql(column: str, word: str, out: str = "s0") -> str:
    target = f"coalesce((SELECT {column} FROM vr WHERE surface = '{word}' AND reading_idx = 0 AND word_idx = 0), '{word}')"
    return f"SELECT DISTINCT surface FROM vr WHERE {column} = {target}"


@query(sql(level_sql("spelling", ODD), "vr"))
def expand_spelling(c: Corpus) -> DataFrame:
    return search.expand(c, ODD, "spelling")


@query(sql(level_sql("lemma", WORD_1), "vr"))
def expand_form(c: Corpus) -> DataFrame:
    return search.expand(c, WORD_1, "form")


def exact_starts(words_: list[str], tk: str = "tk", more: str = "") -> str:
    joins = "".join(f" JOIN {tk} t{i} ON t{i}.unit_id = t0.unit_id AND t{i}.pos = t0.pos + {i} AND t{i}.surface = '{w}'" for i, w in enumerate(words_) if i)
    return f"SELECT t0.edition_id, t0.unit_id, t0.pos FROM {tk} t0{joins} WHERE t0.surface = '{words_[0]}'{more}"


@query(sql(exact_starts(PHRASE_2.split()), "tk"))
def phrase2(c: Corpus) -> DataFrame:
    return search.phrase(c, PHRASE_2, "exact")[1]


@query(sql(exact_starts(PHRASE_3.split()), "tk"))
def phrase3(c: Corpus) -> DataFrame:
    return search.phrase(c, PHRASE_3, "exact")[1]


@query(
    sql(
        """SELECT unit_id, (a + i * 2)::BIGINT AS pos FROM (SELECT unit_id, island, min(pos) AS a, count(*) AS n FROM (SELECT unit_id, pos, pos - row_number() OVER (PARTITION BY unit_id ORDER BY pos) AS island FROM p) GROUP BY 1, 2) r,
        LATERAL (SELECT unnest(range(0, n // 2)) AS i) WHERE n >= 2""",
        "tk",
        s=exact_starts(PHRASE_2.split()),
        p="SELECT unit_id, pos FROM s UNION SELECT unit_id, pos + 1 FROM s",
    )
)
def phrase_occurrences(c: Corpus) -> DataFrame:
    _, first, n = search.phrase(c, PHRASE_2, "exact")
    return search.occurrences(first, n).select("unit_id", "pos")


@query(sql(f"SELECT t0.edition_id, t0.unit_id, t0.pos FROM tk t0 WHERE surface = '{WORD_1}' AND is_capital", "tk"))
def search_case(c: Corpus) -> DataFrame:
    return search.phrase(c, WORD_1.capitalize(), "exact", case=True)[1]


_TARGET = f"coalesce((SELECT lemma FROM vr WHERE surface = '{WORD_1}' AND reading_idx = 0 AND word_idx = 0), '{WORD_1}')"


@query(sql(f"SELECT edition_id, unit_id, pos FROM tl WHERE surface IN ({level_sql('lemma', WORD_1)}) AND list_contains(lemmas, {_TARGET})", "tl", "vr"))
def search_resolved(c: Corpus) -> DataFrame:
    return search.phrase(c, WORD_1, "form", resolved=True)[1]


@query(sql(f"SELECT edition_id, unit_id, pos FROM torig WHERE surface = '{WORD_2}'", "torig"))
def search_original(c: Corpus) -> DataFrame:
    return search.phrase(c, WORD_2, "exact", version="original")[1]


def ranked_sql(first: str) -> dict[str, str]:
    idf = "ln(1 + ((SELECT count(*) FROM un) - (SELECT count(*) FROM f) + 0.5) / ((SELECT count(*) FROM f) + 0.5))"
    tf = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * coalesce(token_count, 0) / (SELECT avg(coalesce(token_count, 0)) FROM un)))"
    return {
        "s": first,
        "f": "SELECT unit_id, count(*)::DOUBLE AS tf FROM s GROUP BY 1",
        "r": f"SELECT u.unit_id, u.edition_id, u.path_key, u.block_id, u.is_title, u.text_edited, tf, {idf} * ({tf}) * CASE WHEN u.is_title THEN 3 ELSE 1 END AS score FROM un u JOIN f USING (unit_id) JOIN ed e ON e.edition_id = u.edition_id AND e.canonical",
    }


def _form(word: str) -> str:
    return f"SELECT edition_id, unit_id, pos FROM tk WHERE surface IN ({level_sql('lemma', word)})"


@query(sql(f"SELECT unit_id, tf, {half_up_sql('score', 6)} AS score FROM r", "un", "ed", "vr", **ranked_sql(exact_starts([WORD_1]))))
def bm25(c: Corpus) -> DataFrame:
    _, first, n = search.phrase(c, WORD_1, "exact")
    return search.ranked(c, first, n, scope.scoped(c)).select("unit_id", "tf", half_up(F.col("score"), 6).alias("score"))


def _hits(c: Corpus, number: int) -> DataFrame:
    _, first, n = search.phrase(c, WORD_1, "form")
    hits = search.ranked(c, first, n, scope.scoped(c))
    # Rounded first, so that equal scores are ties; texts are fetched for the page alone.
    top = search.page(hits.withColumn("score", half_up(F.col("score"), 9)), [F.desc("score"), "unit_id"], number)
    e = c.editions.select("edition_id", "host_slug", "work", "edition")
    p = top.join(e, "edition_id").join(c.units.select("unit_id", "text_edited"), "unit_id")
    return p.select("host_slug", "work", "edition", "path_key", "block_id", "unit_id", half_up(F.col("score"), 6).alias("score"), F.col("text_edited").alias("text"))


def _page_sql(number: int) -> str:
    body = f"SELECT host_slug, work, edition, path_key, block_id, unit_id, {half_up_sql('score', 6)} AS score, text_edited AS text FROM (SELECT * FROM r ORDER BY {half_up_sql('score', 9)} DESC, unit_id LIMIT 20 OFFSET {20 * (number - 1)}) JOIN ed USING (edition_id)"
    return sql(body.replace("text_edited AS text", "text_edited AS text"), "un", "ed", "vr", **ranked_sql(_form(WORD_1)))


@query(_page_sql(1))
def search_form(c: Corpus) -> DataFrame:
    return _hits(c, 1)


@query(_page_sql(2))
def search_page2(c: Corpus) -> DataFrame:
    return _hits(c, 2)


@query(sql("SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0))::BIGINT AS pages FROM r", "un", "ed", "vr", **ranked_sql(_form(WORD_1))))
def search_total(c: Corpus) -> DataFrame:
    _, first, n = search.phrase(c, WORD_1, "form")
    return search.total_and_pages(search.ranked(c, first, n, scope.scoped(c)))


_MARKED = "(SELECT unit_id, string_agg(start_char || '-' || end_char, ' ' ORDER BY start_char) AS marks FROM (SELECT unit_id, min(start_char) AS start_char, max(end_char) AS end_char FROM (SELECT t.unit_id, t.start_char, t.end_char, t.pos - row_number() OVER (PARTITION BY t.unit_id ORDER BY t.pos) AS island FROM s JOIN tk t USING (unit_id, pos)) GROUP BY unit_id, island) GROUP BY 1)"


@query(
    sql(
        f"""SELECT h.unit_id, array_to_string(e.authors, ' ') AS authors, array_to_string(e.author_names, ', ') AS author_names, e.host_slug, e.work, w.b AS work_breadcrumb, e.edition, u.path_key, u.section_title, u.block_id, m.marks, u.text_edited AS text
        FROM (SELECT unit_id, edition_id FROM r ORDER BY {half_up_sql("score", 9)} DESC, unit_id LIMIT 20) h JOIN ed e USING (edition_id) JOIN un u ON u.unit_id = h.unit_id JOIN {_MARKED} m ON m.unit_id = h.unit_id
        LEFT JOIN (SELECT host_slug, work, min(breadcrumb) AS b FROM wk GROUP BY 1, 2) w ON w.host_slug = e.host_slug AND w.work = e.work""",
        "un", "ed", "vr", "wk",
        **ranked_sql(_form(WORD_1)),
    )
)
def search_cited(c: Corpus) -> DataFrame:
    """A page of hits with their citations, and where in the text the matches stand."""
    s, first, n = search.phrase(c, WORD_1, "form")
    hits = search.ranked(c, first, n, scope.scoped(c)).withColumn("score", half_up(F.col("score"), 9))
    top = search.page(hits, [F.desc("score"), "unit_id"]).select("unit_id")
    near = s.join(F.broadcast(top), "unit_id", "left_semi")
    marks = search.highlights(near, first.join(F.broadcast(top), "unit_id", "left_semi"), n)
    at = F.transform(F.sort_array(F.collect_list(F.struct("start_char", "end_char"))), lambda x: F.concat(x["start_char"], F.lit("-"), x["end_char"]))
    marks = marks.groupBy("unit_id").agg(F.array_join(at, " ").alias("marks"))
    cited = search.cited(c, top).join(marks, "unit_id").join(c.units.select("unit_id", F.col("text_edited").alias("text")), "unit_id")
    return cited.withColumns({"authors": F.array_join("authors", " "), "author_names": F.array_join("author_names", ", ")}).drop("edition_id")


@query(
    sql(
        """SELECT unit_id, min(start_char) AS start_char, max(end_char) AS end_char FROM (SELECT t.unit_id, t.start_char, t.end_char, t.pos - row_number() OVER (PARTITION BY t.unit_id ORDER BY t.pos) AS island FROM p JOIN tk t USING (unit_id, pos)) GROUP BY unit_id, island""",
        "tk",
        s=exact_starts(PHRASE_2.split()),
        p="SELECT unit_id, pos FROM s UNION SELECT unit_id, pos + 1 FROM s",
    )
)
def search_ranges(c: Corpus) -> DataFrame:
    s, first, n = search.phrase(c, PHRASE_2, "exact")
    return search.highlights(s, first, n)


# Frequency


def frequency_sql(keys: str, n: int, first: str, source: str = "g") -> str:
    rate = half_up_sql("sum(c)::DOUBLE / sum(tokens) * 1000", 1)
    return sql(
        f"SELECT {keys}, sum(c)::BIGINT AS count, sum(tokens)::BIGINT AS tokens, CASE WHEN sum(tokens) > 0 THEN {rate} ELSE 0.0 END AS per_1000 FROM {source} GROUP BY {keys} HAVING sum(c) > 0",
        "un",
        "ed",
        "vr",
        s=first,
        p="SELECT edition_id, unit_id, pos FROM s" + "".join(f" UNION SELECT edition_id, unit_id, pos + {i} FROM s" for i in range(1, n)),
        k=f"SELECT edition_id, sum(floor(p / {float(n)} + 0.5)) AS c FROM (SELECT edition_id, unit_id, count(*) AS p FROM p GROUP BY 1, 2) GROUP BY 1",
        z="SELECT edition_id, sum(token_count) AS tokens FROM un GROUP BY 1",
        g="SELECT e.host_slug, e.work, e.edition, e.authors, coalesce(k.c, 0) AS c, coalesce(z.tokens, 0) AS tokens FROM ed e LEFT JOIN k USING (edition_id) LEFT JOIN z USING (edition_id) WHERE e.canonical",
        ga="SELECT unnest(authors) AS author, c, tokens FROM g",
    )


def _frequency(c: Corpus, q: str, match: str, by: str) -> DataFrame:
    _, first, n = search.phrase(c, q, match)
    return search.frequency(c, first, n, scope.scoped(c), by)


@query(frequency_sql("host_slug, work", 1, _form(WORD_1)))
def freq_work(c: Corpus) -> DataFrame:
    return _frequency(c, WORD_1, "form", "work")


@query(frequency_sql("host_slug, work, edition", 2, exact_starts(PHRASE_2.split())))
def freq_edition(c: Corpus) -> DataFrame:
    return _frequency(c, PHRASE_2, "exact", "edition")


@query(frequency_sql("author", 1, _form(WORD_1), "ga"))
def freq_author(c: Corpus) -> DataFrame:
    return _frequency(c, WORD_1, "form", "author")


def labelled_sql(by: str, keys: str, label: str, n: int, first: str, source: str = "g") -> str:
    join = {"author": "(SELECT a AS author, min(n) AS l FROM (SELECT unnest(authors) AS a, unnest(author_names) AS n FROM ed) GROUP BY 1)", "work": "(SELECT host_slug, work, min(breadcrumb) AS l FROM wk GROUP BY 1, 2)"}[by]
    with_, body = frequency_sql(keys, n, first, source).rsplit("\nSELECT", 1)
    return f"{with_}, wk AS ({CTES['wk']})\nSELECT {label} AS label, f.* FROM (SELECT{body}) f LEFT JOIN {join} x USING ({'author' if by == 'author' else 'host_slug, work'})"


@query(labelled_sql("work", "host_slug, work", "l", 1, _form(WORD_1)))
def freq_labels_work(c: Corpus) -> DataFrame:
    return search.labelled(c, _frequency(c, WORD_1, "form", "work"), "work")


@query(labelled_sql("work", "host_slug, work, edition", "l || ' (' || edition || ')'", 2, exact_starts(PHRASE_2.split())))
def freq_labels_edition(c: Corpus) -> DataFrame:
    return search.labelled(c, _frequency(c, PHRASE_2, "exact", "edition"), "edition")


@query(labelled_sql("author", "author", "l", 1, _form(WORD_1), "ga"))
def freq_labels_author(c: Corpus) -> DataFrame:
    return search.labelled(c, _frequency(c, WORD_1, "form", "author"), "author")


# Concordance


def concordance_sql(order: str) -> str:
    words_of = lambda cond, way: f"coalesce((SELECT string_agg(n.surface, ' ' ORDER BY n.pos {way}) FROM tk n WHERE n.unit_id = o.unit_id AND {cond}), '')"
    left, right = words_of("n.pos BETWEEN o.pos - 6 AND o.pos - 1", "DESC"), words_of("n.pos BETWEEN o.pos + 1 AND o.pos + 6", "ASC")
    return sql(
        f"SELECT unit_id, pos, lefts, '{WORD_1}' AS keyword, rights FROM (SELECT o.unit_id, o.pos, {left} AS lefts, {right} AS rights FROM (SELECT s.* FROM s JOIN ed e ON e.edition_id = s.edition_id AND e.canonical) o) ORDER BY {order} LIMIT 20",
        "tk",
        "ed",
        s=exact_starts([WORD_1]),
    )


def _lines(c: Corpus, sort: str) -> DataFrame:
    _, first, n = search.phrase(c, WORD_1, "exact")
    lines = search.concordance(c, first, n, scope.scoped(c))
    return search.page(lines, search.line_order(sort)).select("unit_id", "pos", F.array_join("lefts", " ").alias("lefts"), "keyword", F.array_join("rights", " ").alias("rights"))


@query(concordance_sql("unit_id, pos"))
def concordance(c: Corpus) -> DataFrame:
    return _lines(c, "position")


@query(concordance_sql("string_split(lefts, ' '), unit_id, pos"))
def concordance_left(c: Corpus) -> DataFrame:
    return _lines(c, "left")


@query(concordance_sql("string_split(rights, ' '), unit_id, pos"))
def concordance_right(c: Corpus) -> DataFrame:
    return _lines(c, "right")


@query(
    sql(
        """SELECT o.unit_id, o.pos, coalesce(substr(u.text_edited, (l.a + 1)::INT, (l.z - l.a)::INT), '') AS left, substr(u.text_edited, (o.start_char + 1)::INT, (o.end_char - o.start_char)::INT) AS key, coalesce(substr(u.text_edited, (r.a + 1)::INT, (r.z - r.a)::INT), '') AS right
        FROM (SELECT s.*, t.start_char, t.end_char FROM s JOIN ed e ON e.edition_id = s.edition_id AND e.canonical JOIN tk t ON t.unit_id = s.unit_id AND t.pos = s.pos ORDER BY s.unit_id, s.pos LIMIT 20) o JOIN un u ON u.unit_id = o.unit_id
        LEFT JOIN LATERAL (SELECT min(start_char) AS a, max(end_char) AS z FROM tk n WHERE n.unit_id = o.unit_id AND n.pos BETWEEN o.pos - 6 AND o.pos - 1) l ON true
        LEFT JOIN LATERAL (SELECT min(start_char) AS a, max(end_char) AS z FROM tk n WHERE n.unit_id = o.unit_id AND n.pos BETWEEN o.pos + 1 AND o.pos + 6) r ON true""",
        "tk", "ed", "un",
        s=exact_starts([WORD_1]),
    )
)
def concordance_lines(c: Corpus) -> DataFrame:
    """The lines as printed, cut from the texts."""
    _, first, n = search.phrase(c, WORD_1, "exact")
    page = search.page(search.concordance(c, first, n, scope.scoped(c)), search.line_order("position"))
    return search.lines(c, page).select("unit_id", "pos", "left", "key", "right")


# Keyness and collocations


def keyness_sql(terms: str, target: str, limit: int = 50, original: bool = False, who: str = CTES["who"], what: str = CTES["what"]) -> str:
    xl = lambda a, e: f"CASE WHEN {a} > 0 THEN {a} * ln({a} / ({e})) ELSE 0 END"
    ll = half_up_sql(f"2 * ({xl('a', 't * (a + b) / (t + r)')} + {xl('b', 'r * (a + b) / (t + r)')})", 2)
    lr = half_up_sql("ln((a / t) / ((CASE WHEN b > 0 THEN b ELSE 0.5 END) / r)) / ln(2.0)", 2)
    return sql(
        f"SELECT term, a::BIGINT AS target, b::BIGINT AS reference, {ll} AS log_likelihood, {lr} AS log_ratio, {half_up_sql('a / t * 1000', 1)} AS target_rate, {half_up_sql('b / r * 1000', 1)} AS reference_rate FROM g, z WHERE t > 0 AND r > 0 AND a >= 5 AND a / t > b / r ORDER BY log_likelihood DESC, log_ratio DESC, term LIMIT {limit}",
        "ed", "un", "vr", "tl", "bor",
        original=original,
        who=who,
        what=what,
        target=target,
        side="SELECT edition_id, (edition_id IN (FROM target))::INT AS side FROM ed WHERE canonical OR edition_id IN (FROM target)",
        z="SELECT sum(token_count) FILTER (side = 1)::DOUBLE AS t, sum(token_count) FILTER (side = 0)::DOUBLE AS r FROM un JOIN side USING (edition_id)",
        g=f"SELECT term, sum(side)::DOUBLE AS a, sum(1 - side)::DOUBLE AS b FROM ({terms}) GROUP BY 1",
    )


_LEMMAS = "SELECT * FROM (SELECT side, unnest(lemmas) AS term FROM tl JOIN side USING (edition_id)) WHERE term IN (SELECT lemma FROM vr)"
_SURFACES = "SELECT side, surface AS term FROM tk JOIN side USING (edition_id)"
_AUTHOR = "list_contains(authors, (SELECT author FROM who))"
_WORK = _AUTHOR + " AND work = (SELECT work FROM what)"
_OF_AUTHOR = f"SELECT edition_id FROM ed WHERE canonical AND {_AUTHOR}"
_OF_WORK = in_scope_sql("(SELECT work FROM what)", more=f" AND {_AUTHOR}")


def _keyness(c: Corpus, match: str, by_work: bool, version: str = "edited") -> DataFrame:
    author, work = subject(c)
    return stats.keyness(c, *stats.sides(c, author, work if by_work else None), match, version)


@query(keyness_sql(_LEMMAS, _OF_AUTHOR))
def keyness_author(c: Corpus) -> DataFrame:
    return _keyness(c, "form", False)


@query(keyness_sql(_LEMMAS, _OF_WORK))
def keyness_work(c: Corpus) -> DataFrame:
    return _keyness(c, "form", True)


@query(keyness_sql(_LEMMAS, _OF_WORK, what=f"SELECT {_CHAINED} AS work", who=f"SELECT min(authors[1]) AS author FROM ed WHERE canonical AND work = {_CHAINED}"))
def keyness_borrowed(c: Corpus) -> DataFrame:
    """Of a work that borrows from one that borrows: all of it is the target."""
    work = first_work(c, chained(c))
    author = c.editions.filter(F.col("canonical") & (F.col("work") == work)).agg(F.min(F.col("authors")[0])).first()[0]
    return stats.keyness(c, *stats.sides(c, author, work))


keyness_lemma_text = keyness_sql(_LEMMAS, _OF_AUTHOR, 50, True)


@query(keyness_lemma_text)
def keyness_original(c: Corpus) -> DataFrame:
    return _keyness(c, "lemma", False, "original")


@query(keyness_sql(_SURFACES, _OF_AUTHOR))
def keyness_exact(c: Corpus) -> DataFrame:
    return _keyness(c, "exact", False)


def colloc_sql(group: str, scope_sql: str = "canonical") -> str:
    xl = lambda a, e: f"CASE WHEN {a} > 0 THEN ({a}) * ln(({a}) / ({e})) ELSE 0 END"
    e = "r * c1 / n"
    ll = half_up_sql(f"2 * ({xl('o', e)} + {xl('(r - o)', 'r * (n - c1) / n')} + {xl('(c1 - o)', '(n - r) * c1 / n')} + {xl('(n - r - c1 + o)', '(n - r) * (n - c1) / n')})", 2)
    return sql(
        f"SELECT term, o::BIGINT AS cooccurrence, c1::BIGINT AS total, {ll} AS log_likelihood, {half_up_sql(f'ln(o / ({e})) / ln(2.0)', 2)} AS pmi, {half_up_sql(f'(o - {e}) / sqrt(o)', 2)} AS t_score, {half_up_sql('o / r * 1000', 1)} AS per_1000 FROM g, z WHERE NOT own AND o >= 3 AND r > 0 ORDER BY log_likelihood DESC, cooccurrence DESC, term LIMIT 50",
        "tk", "ed", "vr",
        node=level_sql("lemma", WORD_1),
        sc=f"SELECT t.unit_id, t.pos, t.surface, t.surface IN (SELECT surface FROM node) AS node FROM tk t JOIN ed e ON e.edition_id = t.edition_id AND e.{scope_sql}",
        near="SELECT DISTINCT a.unit_id, a.pos FROM sc a JOIN sc b ON a.unit_id = b.unit_id AND abs(a.pos - b.pos) <= 5 AND b.node WHERE NOT a.node",
        g=f"SELECT {group} AS term, count(*)::DOUBLE AS c1, count(n.pos)::DOUBLE AS o, bool_or(node) AS own FROM sc s LEFT JOIN near n USING (unit_id, pos) LEFT JOIN (SELECT surface, lemma FROM vr WHERE reading_idx = 0 AND word_idx = 0) f USING (surface) GROUP BY 1",
        z="SELECT (SELECT count(*) FROM sc)::DOUBLE AS n, (SELECT count(*) FROM near)::DOUBLE AS r",
    )


def _colloc(c: Corpus, by: str) -> DataFrame:
    return stats.collocations(c, WORD_1, scope.scoped(c), "form", by)


@query(colloc_sql("coalesce(f.lemma, s.surface)"))
def colloc_lemma(c: Corpus) -> DataFrame:
    return _colloc(c, "lemma")


@query(colloc_sql("s.surface"))
def colloc_exact(c: Corpus) -> DataFrame:
    return _colloc(c, "surface")


@query(colloc_sql("s.surface").replace(colloc_sql("s.surface")[colloc_sql("s.surface").rindex("\nSELECT") :], "\nSELECT (SELECT count(*) FROM sc) AS scope_tokens, (SELECT count(*) FROM sc WHERE node) AS node_count, (SELECT count(*) FROM near) AS window_tokens"))
def colloc_figures(c: Corpus) -> DataFrame:
    return stats.colloc_figures(c, WORD_1, scope.scoped(c))


# Vectors

_COUNTS = "SELECT edition_id, path_key, lemma, count(*) AS c FROM (SELECT unit_id, unnest(lemmas) AS lemma FROM tl) JOIN (SELECT unit_id, edition_id, path_key FROM un) USING (unit_id) GROUP BY 1, 2, 3"
_VECTORS = {
    "cnt": _COUNTS,
    "nn": "SELECT count(*)::DOUBLE AS n FROM (SELECT DISTINCT edition_id, path_key FROM un)",
    "wt": "SELECT c.*, (1 + ln(c)) * (ln((n + 1) / (df + 1)) + 1) AS raw FROM cnt c JOIN (SELECT lemma, count(*) AS df FROM cnt GROUP BY 1) USING (lemma), nn",
    "dtm": "SELECT *, (raw / sqrt(sum(raw * raw) OVER (PARTITION BY edition_id, path_key)))::FLOAT AS weight FROM wt",
}


@query(sql("SELECT DISTINCT edition_id, path_key FROM un", "un"))
def dtm_docs(c: Corpus) -> DataFrame:
    return vectors.sections_with_text(c)


@query(sql("SELECT * FROM cnt", "tl", "un", cnt=_COUNTS))
def dtm_counts(c: Corpus) -> DataFrame:
    return vectors.lemma_counts(c)


@query(sql(f"SELECT edition_id, path_key, lemma, {half_up_sql('raw', 6)} AS raw FROM wt", "tl", "un", **{k: _VECTORS[k] for k in ("cnt", "nn", "wt")}))
def tfidf(c: Corpus) -> DataFrame:
    return vectors.tfidf(c).select("edition_id", "path_key", "lemma", half_up(F.col("raw"), 6).alias("raw"))


@query(sql(f"SELECT edition_id, path_key, lemma, {half_up_sql('weight::DOUBLE', 5)} AS weight FROM dtm", "tl", "un", **_VECTORS))
def tfidf_norm(c: Corpus) -> DataFrame:
    return vectors.tfidf(c).select("edition_id", "path_key", "lemma", half_up(F.col("weight").cast("double"), 5).alias("weight"))


def similar_sql(keys: str, goal: str = "") -> str:
    mine = _WORK
    return sql(
        f"SELECT {keys}, score FROM (SELECT {keys}, min(first) AS first, {half_up_sql('sum(x * y) / sqrt(sum(y * y) * any_value(xx))', 4)} AS score, sum(x * y) AS dot FROM v LEFT JOIN goal USING (lemma), (SELECT sum(x * x) AS xx FROM goal) GROUP BY {keys} HAVING sum(x * y) > 0) ORDER BY score DESC, first, {keys} LIMIT 20",
        "tl", "un", "what",
        **_VECTORS,
        target=f"SELECT edition_id FROM ed WHERE canonical AND {mine} ORDER BY edition_id LIMIT 1",
        goal=f"SELECT lemma, sum(weight::DOUBLE) AS x FROM dtm WHERE edition_id IN (SELECT edition_id FROM target){goal} GROUP BY 1",
        v=f"SELECT {keys}, lemma, sum(weight::DOUBLE) AS y, min(edition_id) AS first FROM dtm JOIN ed e USING (edition_id) WHERE e.canonical AND NOT ({mine}) GROUP BY {keys}, lemma",
    )


@query(similar_sql("host_slug, work"))
def similar_work(c: Corpus) -> DataFrame:
    return vectors.similar(c, *subject(c), level="work").select("host_slug", "work", "score")


@query(similar_sql("host_slug, work, edition_id"))
def similar_edition(c: Corpus) -> DataFrame:
    return vectors.similar(c, *subject(c)).select("host_slug", "work", "edition_id", "score")


@query(similar_sql("host_slug, work, edition_id, path_key", f" AND path_key = '{SECTION}'"))
def similar_section(c: Corpus) -> DataFrame:
    return vectors.similar(c, *subject(c), path=SECTION).select("host_slug", "work", "edition_id", "path_key", "score")


@query()
def similar_answer(c: Corpus) -> DataFrame:
    return vectors.similar_answer(c, *subject(c), level="work")


@query(sql("SELECT lemma FROM q WHERE df <= 0.5 * n OR (SELECT count(*) FILTER (df <= 0.5 * n) FROM q) < least(24, n)", "tl", "un", cnt=_COUNTS, q="SELECT lemma, count(*) AS df, (SELECT count(*) FROM (SELECT DISTINCT edition_id, path_key FROM un)) AS n FROM cnt GROUP BY 1"))
def topic_columns(c: Corpus) -> DataFrame:
    return topics.columns(vectors.lemma_counts(c), vectors.sections_with_text(c))


@query()
def topics_terms(c: Corpus) -> DataFrame:
    return topics.stored(c)[0]


@query()
def topics_mix(c: Corpus) -> DataFrame:
    return topics.stored(c)[1]


@query()
def topic_mix_work(c: Corpus) -> DataFrame:
    return topics.topic_mix(c, *subject(c), level="work")


def _mix(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "topic_mix").dropDuplicates().select("doc_id", "topic", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    return m.join(table(spark, d, "topic_docs").dropDuplicates(), "doc_id")


_MIX = "SELECT m.doc_id, d.edition_id, topic, coalesce(weight, 0)::DOUBLE AS weight FROM (SELECT DISTINCT * FROM topic_mix) m JOIN (SELECT DISTINCT * FROM topic_docs) d USING (doc_id)"


@raw(sql(f"SELECT edition_id, topic, {half_up_sql('CASE WHEN sum(sum(weight)) OVER (PARTITION BY edition_id) > 0 THEN sum(weight) / sum(sum(weight)) OVER (PARTITION BY edition_id) ELSE 0 END', 6)} AS weight FROM m GROUP BY 1, 2", m=_MIX))
def topic_mix_edition(spark: SparkSession, d: str) -> DataFrame:
    return topics.aggregate_mix(_mix(spark, d), "edition_id").withColumn("weight", half_up(F.col("weight"), 6))


@raw(
    sql(
        "SELECT topic, rank::INT AS rank, host_slug, work, weight FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, host_slug, work) AS rank FROM a WHERE weight > 0) WHERE rank <= 8",
        "ed",
        m=_MIX,
        s="SELECT e.host_slug, e.work, topic, sum(weight) AS w FROM m JOIN ed e ON e.edition_id = m.edition_id AND e.canonical GROUP BY 1, 2, 3",
        a=f"SELECT host_slug, work, topic, {half_up_sql('CASE WHEN sum(w) OVER (PARTITION BY host_slug, work) > 0 THEN w / sum(w) OVER (PARTITION BY host_slug, work) ELSE 0 END', 4)} AS weight FROM s",
    )
)
def topics_prominent(spark: SparkSession, d: str) -> DataFrame:
    return topics.prominent(_mix(spark, d), load(spark, d).editions)


# Reading


@query(sql("SELECT a.slug AS author, w.host_slug, w.work, w.title AS work_title, w.canonical_slug, e.edition_id, e.edition FROM (SELECT DISTINCT slug, surname FROM au) a LEFT JOIN (SELECT host_slug, work, title, canonical_slug, unnest(author_slugs) AS slug FROM wk) w USING (slug) LEFT JOIN ed e ON e.host_slug = w.host_slug AND e.work = w.work", "au", "wk", "ed"))
def catalogue(c: Corpus) -> DataFrame:
    return reading.catalogue(c)


@query(sql("SELECT e.host_slug, e.work, e.edition_id, e.edition FROM ed e JOIN (SELECT DISTINCT host_slug, work, canonical_slug FROM wk) w ON w.host_slug = e.host_slug AND w.work = e.work AND w.canonical_slug = e.edition", "ed", "wk"))
def edition_default(c: Corpus) -> DataFrame:
    return reading.default_editions(c)


@query(sql("SELECT edition_id, path_key, ordinal, depth, title, units FROM sec", "sec"))
def sections_flat(c: Corpus) -> DataFrame:
    return c.sections.select("edition_id", "path_key", "ordinal", "depth", "title", "units")


_CANON = "edition_id IN (SELECT edition_id FROM ed WHERE canonical)"


@query(sql(f"SELECT edition_id, ordinal, path_key, depth, title FROM sec WHERE path_key <> '' AND {_CANON}", "sec", "ed"))
def edition_toc(c: Corpus) -> DataFrame:
    return reading.contents(c, c.editions.filter("canonical"))


@query(sql(f"SELECT edition_id, unit_id, path_key, block_id, is_title, coalesce(CASE WHEN has_editorial THEN text_original END, text_edited) AS text FROM un WHERE {_CANON}", "un", "ed"))
def full_text(c: Corpus) -> DataFrame:
    return reading.text_of(c, c.editions.filter("canonical"), "original")


@query(sql("SELECT edition_id, unit_id, path_key, block_id, is_title, text_edited AS text, coalesce(CASE WHEN has_editorial THEN text_original END, text_edited) AS original, (row_number() OVER (PARTITION BY edition_id ORDER BY unit_id))::INT AS place FROM un WHERE edition_id IN (SELECT edition_id FROM ed)", "un", "ed"))
def full_text_both(c: Corpus) -> DataFrame:
    """Every edition in reading order, both texts."""
    return reading.ordered_text(c, c.editions, "both")


@query(sql("SELECT edition_id, unit_id, block_id, text_edited AS text FROM un WHERE path_key = '' AND is_title AND edition_id IN (SELECT edition_id FROM ed)", "un", "ed"))
def edition_titles(c: Corpus) -> DataFrame:
    return reading.title_blocks(c, c.editions)


@query(sql(f"SELECT edition_id, unit_id, path_key, block_id, is_title, text_edited AS text FROM un WHERE (path_key = '1' OR starts_with(path_key, '1/')) AND {_CANON}", "un", "ed"))
def section_full(c: Corpus) -> DataFrame:
    return reading.text_of(c, c.editions.filter("canonical"), path="1")


@query(sql("SELECT edition_id, path_key, ordinal, lag(path_key) OVER w AS previous, lead(path_key) OVER w AS next FROM sec WHERE path_key <> '' WINDOW w AS (PARTITION BY edition_id ORDER BY ordinal)", "sec"))
def section_nav(c: Corpus) -> DataFrame:
    return reading.navigation(c)


@query(sql("SELECT edition_id, path_key, array_to_string(p[1:d], '/') AS ancestor, d::INT AS depth FROM (SELECT edition_id, path_key, string_split(path_key, '/') AS p FROM sec WHERE path_key <> ''), LATERAL (SELECT unnest(range(1, len(p))) AS d)", "sec"))
def section_ancestors(c: Corpus) -> DataFrame:
    return reading.ancestors(c)


@query(sql("SELECT a.edition_id, s.path_key, b.edition_id AS other_id, b.edition AS other FROM sec s JOIN ed a USING (edition_id) JOIN ed b ON a.host_slug = b.host_slug AND a.work = b.work AND a.edition_id <> b.edition_id JOIN sec t ON t.edition_id = b.edition_id AND t.path_key = s.path_key WHERE s.path_key <> ''", "sec", "ed"))
def matching_editions(c: Corpus) -> DataFrame:
    return reading.matching_editions(c)


# Comparison

_PAIRS = "SELECT x.host_slug, x.work, x.edition_id AS a, y.edition_id AS b FROM ed x JOIN ed y ON x.host_slug = y.host_slug AND x.work = y.work AND (x.edition, x.edition_id) < (y.edition, y.edition_id)"


@query(sql("SELECT a, b, path_key, bool_or(side = 1) AS in_a, bool_or(side = 2) AS in_b FROM (SELECT a, b, path_key, 1 AS side FROM pr JOIN sec ON edition_id = a UNION ALL SELECT a, b, path_key, 2 FROM pr JOIN sec ON edition_id = b) WHERE path_key <> '' GROUP BY 1, 2, 3", "sec", "ed", pr=_PAIRS))
def align_membership(c: Corpus) -> DataFrame:
    a = compare.align_sections(c, compare.paired(c))
    return a.groupBy("a", "b", "path_key").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))


@query()
def align_sections(c: Corpus) -> DataFrame:
    return compare.align_sections(c, compare.paired(c))


_BLOCK = "lower(regexp_replace(block_id, '^.*[./]', ''))"


@query(
    sql(
        """SELECT coalesce(l.a, r.a) AS a, coalesce(l.b, r.b) AS b, coalesce(l.path_key, r.path_key) AS path_key, coalesce(l.block, r.block) AS block,
        CASE WHEN l.unit_id IS NULL THEN 'inserted' WHEN r.unit_id IS NULL THEN 'deleted' WHEN l.text IS NOT DISTINCT FROM r.text THEN 'equal' ELSE 'changed' END AS status
        FROM l FULL JOIN r ON l.a = r.a AND l.b = r.b AND l.path_key = r.path_key AND l.block = r.block""",
        "sec", "ed",
        pr=_PAIRS,
        ks="SELECT a, b, s.path_key FROM pr JOIN sec s ON s.edition_id = a JOIN sec t ON t.edition_id = b AND t.path_key = s.path_key WHERE s.path_key <> ''",
        l=f"SELECT a, b, path_key, {_BLOCK} AS block, unit_id, text_edited AS text FROM ks JOIN (SELECT * FROM un) u USING (path_key) WHERE u.edition_id = a",
        r=f"SELECT a, b, path_key, {_BLOCK} AS block, unit_id, text_edited AS text FROM ks JOIN (SELECT * FROM un) u USING (path_key) WHERE u.edition_id = b",
    )
)
def diff_blocks(c: Corpus) -> DataFrame:
    return compare.block_status(c, compare.paired(c)).select("a", "b", "path_key", "block", "status")


@query(sql("SELECT a, b, path_key, lag(path_key) OVER w AS previous, lead(path_key) OVER w AS next FROM (SELECT p.a, p.b, s.path_key, s.ordinal FROM pr p JOIN sec s ON s.edition_id = p.a JOIN sec t ON t.edition_id = p.b AND t.path_key = s.path_key WHERE s.path_key <> '') WINDOW w AS (PARTITION BY a, b ORDER BY ordinal)", "sec", "ed", pr=_PAIRS))
def compare_nav(c: Corpus) -> DataFrame:
    return compare.neighbours_in_both(c, compare.paired(c))


@query()
def compare_blocks(c: Corpus) -> DataFrame:
    """The comparison of each section of each two editions: blocks in order, what changed in them, and it all as one text."""
    o = compare.diff_ops(compare.ordered_blocks(c, compare.paired(c)))
    return o.select("a", "b", "path_key", "ordinal", "block", "kind", "ops", compare.as_text(F.col("ops")).alias("marked"))


@query()
def diff_ops(c: Corpus) -> DataFrame:
    return compare.diff_ops(compare.block_status(c, compare.paired(c))).select("a", "b", "path_key", "block", "status", "ops")
