"""SQL of the tables that the named queries share: rows that count, folded tokens, readings."""

from __future__ import annotations

from quirewise.functions.text import INVISIBLE


def _fold(c: str) -> str:
    for x in INVISIBLE:
        c = f"replace({c}, '{x}', '')"
    c = f"replace(nfc_normalize({c}), '’', '''')"
    space = "".join(chr(x) for x in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
    return f"trim({c}, '{space}')"


def tokens(version: str) -> str:
    return f"""SELECT edition_id, unit_id, pos, CASE WHEN f = 'I' THEN f ELSE lower(f) END AS surface, is_capital, reading_idx, start_char, end_char
    FROM (SELECT *, {_fold("surface")} AS f FROM (SELECT DISTINCT * FROM tokens WHERE version = '{version}' QUALIFY indexed_at = max(indexed_at) OVER (PARTITION BY unit_id)) WHERE surface IS NOT NULL)"""


CTES = {
    "ed": "SELECT DISTINCT * FROM editions QUALIFY built_at = max(built_at) OVER (PARTITION BY edition_id)",
    "un": "SELECT DISTINCT * FROM units QUALIFY extracted_at = max(extracted_at) OVER (PARTITION BY unit_id)",
    "tk": tokens("edited"),
    "tor": tokens("original"),
    "torig": "SELECT * FROM tk WHERE unit_id NOT IN (SELECT unit_id FROM un WHERE has_editorial) UNION ALL SELECT * FROM tor WHERE unit_id IN (SELECT unit_id FROM un WHERE has_editorial)",
    "wk": "SELECT DISTINCT * FROM works",
    "au": "SELECT DISTINCT * FROM authors",
    "rd": "SELECT DISTINCT surface, reading_idx, word_idx, coalesce(spelling, surface) AS spelling, coalesce(lemma, spelling, surface) AS lemma FROM readings",
    "rl": "SELECT surface, reading_idx, list(lemma ORDER BY word_idx) AS lemmas, string_agg(spelling, ' ' ORDER BY word_idx) AS spelling FROM rd GROUP BY 1, 2",
    "printed": "SELECT surface FROM tk UNION SELECT surface FROM tor WHERE unit_id IN (SELECT unit_id FROM un WHERE has_editorial)",
    "vr": """SELECT surface, reading_idx, word_idx, spelling, lemma FROM rd WHERE surface IN (SELECT surface FROM printed)
    UNION ALL SELECT p.surface, r.reading_idx, 0, r.spelling || '''s', array_to_string(r.lemmas, ' ') FROM printed p JOIN rl r ON r.surface = p.surface[:-3]
      WHERE p.surface LIKE '%''s' AND p.surface NOT IN (SELECT surface FROM rd)
    UNION ALL SELECT surface, 0, (i - 1)::INT, w, w FROM (SELECT surface, unnest(string_split(surface, ' ')) AS w, generate_subscripts(string_split(surface, ' '), 1) AS i FROM printed
      WHERE surface NOT IN (SELECT surface FROM rd) AND NOT (surface LIKE '%''s' AND surface[:-3] IN (SELECT surface FROM rd)))""",
    "tl": "SELECT t.*, CASE WHEN t.reading_idx = -1 THEN string_split(t.surface, ' ') ELSE coalesce(o.lemmas, CASE WHEN t.surface NOT IN (SELECT surface FROM rd) AND b.lemmas IS NOT NULL THEN [array_to_string(b.lemmas, ' ')] END, string_split(t.surface, ' ')) END AS lemmas FROM {tokens} t LEFT JOIN rl o ON o.surface = t.surface AND o.reading_idx = coalesce(t.reading_idx, 0) LEFT JOIN rl b ON t.surface LIKE '%''s' AND b.surface = t.surface[:-3] AND b.reading_idx = coalesce(t.reading_idx, 0)",
    # The stand-in for borrowing: chains of four works of a host.
    "mem": """SELECT a.edition_id, b.edition_id AS member_id FROM (SELECT host_slug, work, row_number() OVER (PARTITION BY host_slug ORDER BY work) AS n FROM (SELECT DISTINCT host_slug, work FROM ed)) x
    JOIN (SELECT host_slug, work, row_number() OVER (PARTITION BY host_slug ORDER BY work) - 1 AS n FROM (SELECT DISTINCT host_slug, work FROM ed)) y ON x.host_slug = y.host_slug AND x.n = y.n AND y.n % 4 <> 0
    JOIN ed a ON a.host_slug = x.host_slug AND a.work = x.work AND a.canonical JOIN ed b ON b.host_slug = y.host_slug AND b.work = y.work""",
    "mem2": "SELECT x.edition_id, y.member_id FROM mem x JOIN mem y ON y.edition_id = x.member_id",
    "bor": "SELECT * FROM mem UNION SELECT * FROM mem2 UNION SELECT x.edition_id, y.member_id FROM mem2 x JOIN mem y ON y.edition_id = x.member_id",
    "sec": """SELECT edition_id, path_key, (row_number() OVER (PARTITION BY edition_id ORDER BY first))::INT AS ordinal, depth, title, units
    FROM (SELECT edition_id, path_key, min(unit_id) AS first, (CASE WHEN path_key = '' THEN 0 ELSE len(string_split(path_key, '/')) END)::INT AS depth, arg_min(section_title, unit_id) AS title, count(*) AS units FROM un GROUP BY 1, 2)""",
    "who": "SELECT min(authors[1]) AS author FROM ed WHERE canonical",
    "what": "SELECT min(work) AS work FROM ed WHERE canonical AND list_contains(authors, (SELECT author FROM who))",
}

#: What each of them reads.
NEEDS = {"torig": ["tk", "tor", "un"], "rl": ["rd"], "printed": ["tk", "tor", "un"], "vr": ["rd", "rl", "printed"], "tl": ["tk", "rl"], "mem": ["ed"], "mem2": ["mem"], "bor": ["mem", "mem2"], "sec": ["un"], "who": ["ed"], "what": ["ed", "who"]}


def sql(body: str, *names: str, original: bool = False, **more: str) -> str:
    """A query over the tables named, and those they read, in order; more: further tables of this query alone."""
    want: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS.get(n, []):
            add(x)
        if n == "tl" and original:
            add("torig")
        if n not in want:
            want.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTES[n].replace('{tokens}', 'torig' if original else 'tk')})" for n in want] + [f"{n} AS ({s})" for n, s in more.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body


def half_up(x: str, k: int) -> str:
    return f"floor(({x}) * {float(10**k)} + 0.5) / {float(10**k)}"
