"""DuckDB SQL fragments used by the oracle queries.

The oracle is written independently of the Spark expressions: the greedy
merge here is the plain list-of-units fold, not the flag string the Spark
expression uses.
"""

from __future__ import annotations

from gleaner.functions.stopwords import coherence_stopwords, segmentation_stopwords

WS = r"[\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]"


def sql_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


SEG_STOP = sql_list(segmentation_stopwords())
COH_STOP = sql_list(coherence_stopwords())


def sentences_expr(text: str) -> str:
    norm = f"trim(regexp_replace({text}, '{WS}+', ' ', 'g'))"
    return (f"coalesce(list_filter(list_transform(regexp_split_to_array({norm}, '[.!?]+'), "
            f"lambda s: trim(s)), lambda s: s <> ''), [])")


def fragments_expr(s: str) -> str:
    toks = f"regexp_extract_all(lower({s}), '[A-Za-z0-9'']+')"
    marked = f"list_transform({toks}, lambda t: CASE WHEN t IN {SEG_STOP} THEN '|' ELSE t END)"
    return (f"list_filter(list_transform(string_split(array_to_string({marked}, ' '), '|'), "
            f"lambda f: trim(f)), lambda f: f <> '')")


def merged_expr(frags: str, min_tokens: int) -> str:
    init = "{'done': []::VARCHAR[], 'buf': '', 'n': 0::BIGINT}"
    step = (
        "lambda acc, f: CASE WHEN acc.n + len(string_split(f, ' ')) >= " + str(min_tokens) +
        " THEN {'done': list_append(acc.done, CASE WHEN acc.buf = '' THEN f ELSE acc.buf || ' ' || f END),"
        " 'buf': '', 'n': 0::BIGINT}"
        " ELSE {'done': acc.done, 'buf': CASE WHEN acc.buf = '' THEN f ELSE acc.buf || ' ' || f END,"
        " 'n': acc.n + len(string_split(f, ' '))} END"
    )
    r = f"list_reduce({frags}, {step}, {init})"
    # bind the fold result once through a one-element list (no subqueries in lambdas)
    return (f"list_transform([{r}], lambda r: CASE WHEN r.n > 0 AND len(r.done) > 0 "
            f"THEN list_concat(r.done[1:len(r.done) - 1], [r.done[len(r.done)] || ' ' || r.buf]) "
            f"WHEN r.n > 0 THEN [r.buf] ELSE r.done END)[1]")


def units_base_expr(text: str) -> str:
    per = (f"lambda s: CASE WHEN len({fragments_expr('s')}) = 0 THEN [trim(lower(s))] "
           f"ELSE {fragments_expr('s')} END")
    return f"flatten(list_transform({sentences_expr(text)}, {per}))"


def units_mintoken_expr(text: str, min_tokens: int = 6, drop_if_short: int = 3) -> str:
    kept = (f"list_filter({merged_expr(fragments_expr('s'), min_tokens)}, "
            f"lambda u: len(string_split(u, ' ')) >= {drop_if_short})")
    per = f"lambda s: CASE WHEN len({kept}) = 0 THEN [trim(lower(s))] ELSE {kept} END"
    return f"flatten(list_transform({sentences_expr(text)}, {per}))"


def reviews_cte() -> str:
    return ("rv AS (SELECT d.doc_id AS review_id, d.source AS course_id, d.text AS review, "
            "l.quality AS label, d.lang AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")


def units_cte(mode: str = "mintoken", min_tokens: int = 6, drop_if_short: int = 3) -> str:
    """CTEs ``rv``, ``grp`` (review_id, course_id, label, lang, units) and
    ``units`` (review_id, course_id, label, lang, unit_pos, unit)."""
    expr = units_base_expr("review") if mode == "base" else units_mintoken_expr("review", min_tokens, drop_if_short)
    return (reviews_cte() + ", "
            f"grp AS (SELECT review_id, course_id, label, lang, {expr} AS units FROM rv), "
            "units AS (SELECT review_id, course_id, label, lang, "
            "unnest(generate_series(0, len(units) - 1)) AS unit_pos, unnest(units) AS unit FROM grp)")


def whitespace_count_expr(text: str) -> str:
    return f"coalesce(len(regexp_extract_all({text}, '[^\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\p{{Z}}]+')), 0)"
