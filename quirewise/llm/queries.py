"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from quirewise.llm import cooccurrence, distinctive, encoding, mixing, neighbours, spans, subjects, vocabulary
from quirewise.plans.prelude import sql

QUERIES = {
    "p1_found": vocabulary.p1_found,
    "p1_vocabulary": vocabulary.p1_vocabulary,
    "p1_ngrams": vocabulary.p1_ngrams,
    "p2_found": distinctive.p2_found,
    "p2_distinctive": distinctive.p2_distinctive,
    "p3_found": neighbours.p3_found,
    "p3_nearest": neighbours.p3_nearest,
    "p4_found": cooccurrence.p4_found,
    "p4_together": cooccurrence.p4_together,
    "p4_counts": cooccurrence.p4_counts,
    "p5_found": spans.p5_found,
    "p5_spans": spans.p5_spans,
    "p5_coverage": spans.p5_coverage,
    "p5_sets": spans.p5_sets,
    "p6_ids": encoding.p6_ids,
    "p6_decoded": encoding.p6_decoded,
    "p7_found": mixing.p7_found,
    "p7_shares": mixing.p7_shares,
    "p7_picks": mixing.p7_picks,
    "p8_found": subjects.p8_found,
    "p8_subjects": subjects.p8_subjects,
    "p8_composition": subjects.p8_composition,
}

_TERMS = {
    "terms": "SELECT unit_id, 'surface' AS term_kind, surface AS term FROM tk UNION ALL SELECT unit_id, 'lemma', unnest(lemmas) FROM tl",
    "voc": """SELECT term_kind, term, count(*) AS occurrences, count(DISTINCT unit_id) AS units, CASE WHEN count(DISTINCT unit_id) <= 2 THEN 'rare'
    WHEN count(DISTINCT unit_id) > 0.2 * (SELECT count(DISTINCT unit_id) FROM tk) THEN 'common' END AS mark FROM terms GROUP BY 1, 2""",
}

#: Windows of 120 characters that stand in several editions, by their starts.
_SPANS = {
    "win": "SELECT edition_id, i, substr(text, i, 120) AS s FROM (SELECT edition_id, text, unnest(range(1, length(text) - 118)) AS i FROM ed WHERE length(text) >= 120)",
    "sh": "SELECT edition_id, i FROM win WHERE s IN (SELECT s FROM win GROUP BY 1 HAVING count(DISTINCT edition_id) > 1)",
}

ORACLE: dict[str, str] = {
    "p1_found": sql("SELECT term_kind, term, mark FROM voc WHERE mark IS NOT NULL", "tl", **_TERMS),
    "p1_vocabulary": sql("SELECT * FROM voc", "tl", **_TERMS),
    "p1_ngrams": sql(
        "SELECT term_kind, term, NULL::VARCHAR AS next, count(*) AS occurrences, count(DISTINCT unit_id) AS units FROM seq GROUP BY 1, 2 UNION ALL SELECT term_kind, term, next, count(*), count(DISTINCT unit_id) FROM seq WHERE next IS NOT NULL GROUP BY 1, 2, 3",
        "tl",
        terms="SELECT unit_id, 'surface' AS term_kind, pos, 0 AS i, surface AS term FROM tk UNION ALL SELECT unit_id, 'lemma', pos, generate_subscripts(lemmas, 1), unnest(lemmas) FROM tl",
        seq="SELECT *, lead(term) OVER (PARTITION BY unit_id, term_kind ORDER BY pos, i, term) AS next FROM terms",
    ),
    "p2_found": sql(
        "SELECT doc_id, surface FROM n WHERE tokens >= 60 AND weight >= 0.3",
        "tk",
        "un",
        c="SELECT d.doc_id, t.surface, count(*) AS c FROM tk t JOIN (SELECT unit_id, edition_id, path_key FROM un) u USING (unit_id) JOIN (SELECT DISTINCT * FROM topic_docs) d ON d.edition_id = u.edition_id AND d.path_key = u.path_key GROUP BY 1, 2",
        w="SELECT doc_id, surface, c, (1 + ln(c)) * (ln(((SELECT count(DISTINCT doc_id) FROM c) + 1) / (df + 1)) + 1) AS w FROM c JOIN (SELECT surface, count(*) AS df FROM c GROUP BY 1) USING (surface)",
        n="SELECT doc_id, surface, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight, sum(c) OVER (PARTITION BY doc_id) AS tokens FROM w",
    ),
    "p3_found": sql(
        "SELECT DISTINCT least(a, b) AS doc_a, greatest(a, b) AS doc_b FROM n WHERE r <= 5",
        m="SELECT doc_id, topic, sum(coalesce(weight, 0)::DOUBLE) AS w, max(weight) AS most FROM (SELECT DISTINCT * FROM topic_mix) JOIN (SELECT DISTINCT doc_id FROM topic_docs) USING (doc_id) GROUP BY 1, 2",
        v=f"SELECT doc_id, [{', '.join(f'coalesce(sum(w) FILTER (topic = {t}), 0)' for t in range(neighbours.TOPICS))}] AS v FROM m GROUP BY 1 HAVING max(most) > 0",
        u="SELECT doc_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM v",
        n="SELECT x.doc_id AS a, y.doc_id AS b, row_number() OVER (PARTITION BY x.doc_id ORDER BY round(list_inner_product(x.u, y.u), 9) DESC, y.doc_id) AS r FROM u x JOIN u y ON x.doc_id <> y.doc_id",
    ),
    "p4_found": sql(
        "SELECT x.surface AS surface_a, y.surface AS surface_b FROM i x JOIN i y ON x.unit_id = y.unit_id AND x.surface < y.surface GROUP BY x.surface, y.surface HAVING count(*) >= 6 AND count(*) * (SELECT count(DISTINCT unit_id) FROM us) >= 20 * any_value(x.df) * any_value(y.df)",
        "tk",
        us="SELECT DISTINCT unit_id, surface FROM tk",
        i="SELECT unit_id, surface, count(*) OVER (PARTITION BY surface) AS df FROM us",
    ),
    "p4_counts": sql(
        "SELECT x.surface AS surface_a, y.surface AS surface_b, count(*) AS n, any_value(x.df) AS a, any_value(y.df) AS b FROM i x JOIN i y ON x.unit_id = y.unit_id AND x.surface < y.surface GROUP BY 1, 2",
        "tk",
        us="SELECT DISTINCT unit_id, surface FROM tk",
        i="SELECT unit_id, surface, count(*) OVER (PARTITION BY surface) AS df FROM us",
    ),
    "p5_found": sql("SELECT DISTINCT a.edition_id AS edition_a, b.edition_id AS edition_b FROM (SELECT DISTINCT edition_id, s FROM win) a JOIN (SELECT DISTINCT edition_id, s FROM win) b ON a.s = b.s AND a.edition_id < b.edition_id", "ed", win=_SPANS["win"]),
    "p5_spans": sql(
        'SELECT edition_id, (min(i) - 1)::INT AS start, (max(i) + 119)::INT AS "end" FROM (SELECT *, sum(new) OVER (PARTITION BY edition_id ORDER BY i) AS k FROM (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY edition_id ORDER BY i) > 120, true)::INT AS new FROM sh)) GROUP BY edition_id, k',
        "ed",
        **_SPANS,
    ),
    "p5_coverage": sql(
        "SELECT edition_id, length(text) AS chars, coalesce(c, 0)::BIGINT AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(c, 0) / length(text) ELSE 0.0 END AS share FROM ed LEFT JOIN (SELECT edition_id, sum(least(120, coalesce(next - i, 120))) AS c FROM (SELECT *, lead(i) OVER (PARTITION BY edition_id ORDER BY i) AS next FROM sh) GROUP BY 1) USING (edition_id) WHERE text IS NOT NULL",
        "ed",
        **_SPANS,
    ),
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
