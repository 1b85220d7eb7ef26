"""Oracle SQL (DuckDB dialect) for each query in ``gleaner.plans.catalog``.

Views available: region nation customer supplier part orders lineitem events
documents embeddings pages benchmark labels conversations.
"""

from __future__ import annotations

import re

from gleaner.plans import sqltext as S

ORACLE: dict[str, str] = {}

_DEDUP = ("dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY course_id, review "
          "ORDER BY review_id) AS rn FROM rv) WHERE rn = 1)")


def _units_dedup(mode: str = "mintoken") -> str:
    expr = (S.units_base_expr("review") if mode == "base"
            else S.units_mintoken_expr("review", 6, 3))
    return (S.reviews_cte() + ", " + _DEDUP + ", "
            f"grp AS (SELECT review_id, course_id, label, lang, {expr} AS units FROM dd), "
            "units AS (SELECT review_id, course_id, label, lang, "
            "unnest(generate_series(0, len(units) - 1)) AS unit_pos, unnest(units) AS unit FROM grp)")


ORACLE["filter_dedup_stats"] = (
    "WITH " + S.reviews_cte() + ", " + _DEDUP + " "
    "SELECT (SELECT count(*) FROM rv) AS rows_after_filter, count(*) AS unique_comments, "
    f"CAST(coalesce(sum({S.whitespace_count_expr('review')}), 0) AS BIGINT) AS total_tokens FROM dd"
)

ORACLE["token_count"] = (
    "WITH " + S.reviews_cte() + ", " + _DEDUP + " "
    f"SELECT review_id, course_id, CAST({S.whitespace_count_expr('review')} AS INTEGER) AS n_tokens FROM dd"
)

ORACLE["segment_base"] = "WITH " + _units_dedup("base") + " SELECT review_id, unit_pos, unit FROM units"

ORACLE["segment_mintoken"] = "WITH " + _units_dedup() + " SELECT review_id, unit_pos, unit FROM units"

ORACLE["group_units"] = (
    "WITH " + _units_dedup() + " SELECT review_id, course_id, CAST(len(units) AS INTEGER) AS n_units, "
    "array_to_string(units, chr(10)) AS units_text FROM grp"
)

ORACLE["corpus_ids"] = (
    "WITH " + _units_dedup() + ", num AS (SELECT unit, label, "
    "row_number() OVER (ORDER BY review_id, unit_pos) - 1 AS pos FROM units) "
    f"SELECT 'phrase_' || CAST(pos AS VARCHAR) AS id, "
    f"regexp_replace(unit, '^{S.WS}+|{S.WS}+$', '', 'g') AS text, label FROM num "
    f"WHERE regexp_replace(unit, '^{S.WS}+|{S.WS}+$', '', 'g') <> ''"
)


# ------------------------------------------------ words, diversity, coherence
def _settings_cte() -> str:
    return (_units_dedup() + ", "
            "lab AS (SELECT 'source' AS view, course_id AS cluster, review_id, unit_pos, unit FROM units "
            "UNION ALL SELECT 'lang' AS view, lang AS cluster, review_id, unit_pos, unit FROM units), "
            "sizes AS (SELECT view, cluster, count(*) AS size FROM lab "
            "WHERE cluster IS NOT NULL AND cluster <> '-1' GROUP BY view, cluster), "
            "ranked AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY size DESC, cluster) AS size_rank "
            "FROM sizes), "
            "chosen AS (SELECT view || '_top' || CAST(k AS VARCHAR) AS setting, view, k AS top_k, cluster "
            "FROM ranked, (VALUES (5), (10)) t(k) WHERE size_rank <= k), "
            "toks AS (SELECT view, cluster, unnest(regexp_extract_all(lower(unit), '[\\p{L}\\p{N}_]{2,}')) AS term "
            "FROM lab), "
            "tf_view AS (SELECT view, cluster, term, count(*) AS tf FROM toks GROUP BY view, cluster, term), "
            "tf AS (SELECT c.setting, t.cluster, t.term, t.tf FROM tf_view t JOIN chosen c "
            "ON t.view = c.view AND t.cluster = c.cluster), "
            "ncl AS (SELECT setting, count(DISTINCT cluster) AS n FROM chosen GROUP BY setting)")


def _top_words_cte(variant: str) -> str:
    if variant == "raw":
        body = ("tfx AS (SELECT * FROM tf), ")
        norm = "w AS (SELECT * FROM w0), "
    else:
        body = (f"tf2 AS (SELECT * FROM tf WHERE term NOT IN {S.COH_STOP}), "
                "tot AS (SELECT setting, term, sum(tf) AS tot FROM tf2 GROUP BY setting, term), "
                "keep AS (SELECT setting, term FROM (SELECT *, row_number() OVER (PARTITION BY setting "
                "ORDER BY tot DESC, term) AS r FROM tot) WHERE r <= 5000), "
                "tfx AS (SELECT tf2.* FROM tf2 SEMI JOIN keep ON tf2.setting = keep.setting AND tf2.term = keep.term), ")
        norm = ("nrm AS (SELECT setting, cluster, sqrt(sum(weight * weight)) AS nn FROM w0 GROUP BY setting, cluster), "
                "w AS (SELECT w0.setting, w0.cluster, w0.term, w0.weight / nrm.nn AS weight FROM w0 JOIN nrm "
                "ON w0.setting = nrm.setting AND w0.cluster = nrm.cluster), ")
    return (_settings_cte() + ", " + body +
            "dfq AS (SELECT setting, term, count(*) AS df FROM tfx GROUP BY setting, term), "
            "w0 AS (SELECT tfx.setting, tfx.cluster, tfx.term, tfx.tf * (ln((1 + ncl.n) / (1 + dfq.df)) + 1) AS weight "
            "FROM tfx JOIN dfq ON tfx.setting = dfq.setting AND tfx.term = dfq.term "
            "JOIN ncl ON tfx.setting = ncl.setting), " + norm +
            "top AS (SELECT * FROM (SELECT setting, cluster, term AS word, weight, CAST(row_number() OVER "
            "(PARTITION BY setting, cluster ORDER BY round(weight, 9) DESC, term DESC) AS INTEGER) AS rank "
            "FROM w WHERE weight > 0) WHERE rank <= 10)")


ORACLE["ctfidf_raw_top_words"] = ("WITH " + _top_words_cte("raw") +
                                  " SELECT setting, cluster, rank, word, round(weight, 6) AS weight FROM top")
ORACLE["ctfidf_l2_top_words"] = ("WITH " + _top_words_cte("l2") +
                                 " SELECT setting, cluster, rank, word, round(weight, 6) AS weight FROM top")

# Brute-force RBO: every pair of lists, every depth, the set intersection.
_RBO_CTE = (
    "lists AS (SELECT setting, cluster AS topic, rank, word FROM top), "
    "lens AS (SELECT setting, topic, max(rank) AS len FROM lists GROUP BY setting, topic), "
    "pairs AS (SELECT a.setting, a.topic AS ta, b.topic AS tb, least(a.len, b.len) AS m FROM lens a "
    "JOIN lens b ON a.setting = b.setting AND a.topic < b.topic), "
    "depths AS (SELECT setting, ta, tb, m, unnest(generate_series(1, m)) AS i FROM pairs), "
    "x AS (SELECT d.setting, d.ta, d.tb, d.i, (SELECT count(DISTINCT la.word) FROM lists la JOIN lists lb "
    "ON la.word = lb.word AND la.setting = lb.setting WHERE la.setting = d.setting AND la.topic = d.ta "
    "AND lb.topic = d.tb AND la.rank <= d.i AND lb.rank <= d.i) AS xi FROM depths d), "
    "ov AS (SELECT *, sum(xi / i) OVER (PARTITION BY setting, ta, tb ORDER BY i "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS overlap FROM x), "
    "rbo AS (SELECT setting, ta, tb, 0.1 * sum(power(0.9, i - 1) * overlap / i) AS rbo FROM ov "
    "GROUP BY setting, ta, tb), "
    "k AS (SELECT setting, count(*) AS n_topics FROM lens GROUP BY setting), "
    "irbo AS (SELECT k.setting, k.n_topics, CASE WHEN k.n_topics < 2 THEN 1.0 ELSE "
    "1 - coalesce((SELECT sum(r.rbo) FROM rbo r WHERE r.setting = k.setting), 0) / "
    "(k.n_topics * (k.n_topics - 1) / 2) END AS irbo FROM k)"
)

ORACLE["rbo_pairs"] = ("WITH " + _top_words_cte("raw") + ", " + _RBO_CTE +
                       " SELECT setting, ta AS topic_a, tb AS topic_b, round(rbo, 6) AS rbo FROM rbo "
                       "WHERE rbo > 0")
ORACLE["irbo_by_setting"] = ("WITH " + _top_words_cte("raw") + ", " + _RBO_CTE +
                             " SELECT setting, n_topics, round(irbo, 6) AS irbo FROM irbo")
ORACLE["irbo_summary"] = ("WITH " + _top_words_cte("raw") + ", " + _RBO_CTE +
                          " SELECT setting AS name, round(irbo, 6) AS irbo FROM irbo UNION ALL "
                          "SELECT 'top' || regexp_extract(setting, '_top([0-9]+)$', 1) || '_avg' AS name, "
                          "round(avg(irbo), 6) AS irbo FROM irbo GROUP BY 1")

_COH_CTE = (
    "tx AS (SELECT review_id, unit_pos, list_filter(regexp_extract_all(lower(unit), '[a-z]+'), "
    f"lambda t: t NOT IN {S.COH_STOP}) AS tokens FROM units), "
    "vocab AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT review_id, unit_pos, unnest(tokens) AS term "
    "FROM tx) GROUP BY term), "
    "tjoin AS (SELECT setting, cluster, string_agg(word, ' ' ORDER BY rank) AS txt FROM top GROUP BY setting, cluster), "
    "ttok0 AS (SELECT setting, cluster, list_filter(regexp_extract_all(lower(txt), '[a-z]+'), "
    f"lambda t: t NOT IN {S.COH_STOP}) AS tk FROM tjoin), "
    "ttok AS (SELECT setting, cluster, unnest(generate_series(0, len(tk) - 1)) AS p, unnest(tk) AS word FROM ttok0), "
    "topics AS (SELECT setting, cluster, row_number() OVER (PARTITION BY setting, cluster ORDER BY p) - 1 AS pos, word "
    "FROM ttok WHERE word IN (SELECT term FROM vocab)), "
    "occ AS (SELECT * FROM (SELECT review_id, unit_pos, len(tokens) AS L, "
    "unnest(generate_series(0, len(tokens) - 1)) AS i, unnest(tokens) AS word FROM tx) "
    "WHERE word IN (SELECT word FROM topics)), "
    # every window start containing the occurrence, materialised one by one
    "win AS (SELECT DISTINCT review_id, unit_pos, s, word FROM (SELECT review_id, unit_pos, word, "
    "unnest(generate_series(greatest(0, i - 109), least(i, greatest(L - 110, 0)))) AS s FROM occ)), "
    "cw AS (SELECT word, count(*) AS c FROM win GROUP BY word), "
    "mem AS (SELECT DISTINCT setting, cluster, word FROM topics), "
    "wm AS (SELECT w.review_id, w.unit_pos, w.s, m.setting, m.cluster, w.word FROM win w JOIN mem m ON w.word = m.word), "
    "co AS (SELECT a.setting, a.cluster, a.word AS w1, b.word AS w2, count(*) AS c12 FROM wm a JOIN wm b "
    "ON a.review_id = b.review_id AND a.unit_pos = b.unit_pos AND a.s = b.s AND a.setting = b.setting "
    "AND a.cluster = b.cluster AND a.word < b.word GROUP BY a.setting, a.cluster, a.word, b.word), "
    "nw AS (SELECT setting, sum(nwin) AS n_windows FROM (SELECT DISTINCT t.setting, o.review_id, o.unit_pos, "
    "greatest(o.L - 109, 1) AS nwin FROM occ o JOIN (SELECT DISTINCT setting, word FROM topics) t "
    "ON o.word = t.word) GROUP BY setting), "
    "pp AS (SELECT a.setting, a.cluster, a.pos AS i, a.word AS wi, b.pos AS j, b.word AS wj FROM topics a "
    "JOIN topics b ON a.setting = b.setting AND a.cluster = b.cluster), "
    "pc AS (SELECT pp.*, ci.c AS c_i, cj.c AS c_j, n.n_windows AS nn, "
    "CASE WHEN pp.wi = pp.wj THEN ci.c ELSE coalesce(co.c12, 0) END AS c12 FROM pp "
    "LEFT JOIN cw ci ON ci.word = pp.wi LEFT JOIN cw cj ON cj.word = pp.wj "
    "LEFT JOIN co ON co.setting = pp.setting AND co.cluster = pp.cluster AND co.w1 = least(pp.wi, pp.wj) "
    "AND co.w2 = greatest(pp.wi, pp.wj) JOIN nw n ON n.setting = pp.setting), "
    "np AS (SELECT *, CASE WHEN c_i IS NULL OR c_j IS NULL THEN 0.0 ELSE "
    "ln((c12 / nn + 1e-12) / ((c_i / nn) * (c_j / nn))) / (-ln(c12 / nn + 1e-12)) END AS npmi FROM pc), "
    "v AS (SELECT setting, cluster, i, wj, sum(npmi) AS v FROM np GROUP BY setting, cluster, i, wj), "
    "vs AS (SELECT setting, cluster, wj, sum(v) AS vs FROM v GROUP BY setting, cluster, wj), "
    "pw AS (SELECT v.setting, v.cluster, v.i, sum(v.v * vs.vs) AS dot, sqrt(sum(v.v * v.v)) AS nv, "
    "sqrt(sum(vs.vs * vs.vs)) AS ns FROM v JOIN vs ON v.setting = vs.setting AND v.cluster = vs.cluster "
    "AND v.wj = vs.wj GROUP BY v.setting, v.cluster, v.i), "
    "cv AS (SELECT setting, cluster, count(*) AS n_words, avg(CASE WHEN nv = 0 OR ns = 0 THEN 0.0 "
    "ELSE dot / (nv * ns) END) AS c_v FROM pw GROUP BY setting, cluster)"
)

ORACLE["vocabulary"] = ("WITH " + _units_dedup() + ", " + _COH_CTE.split(", tjoin AS")[0] +
                        " SELECT term, df FROM vocab")
ORACLE["coherence_cv"] = ("WITH " + _top_words_cte("l2") + ", " + _COH_CTE +
                          " SELECT setting, cluster, n_words, round(c_v, 6) AS c_v FROM cv")
ORACLE["coherence_summary"] = ("WITH " + _top_words_cte("l2") + ", " + _COH_CTE +
                               " SELECT setting, count(*) AS k, round(avg(c_v), 6) AS avg_c_v FROM cv GROUP BY setting")


ORACLE["irbo_sources"] = (
    "WITH " + _top_words_cte("raw") + ", " + _RBO_CTE + ", o AS (SELECT setting, n_topics, round(irbo, 6) AS irbo FROM irbo) "
    "SELECT 'clusters' AS source, * FROM o UNION ALL SELECT 'external' AS source, * FROM o WHERE ends_with(setting, '_top5')")
ORACLE["coherence_sources"] = (
    "WITH " + _top_words_cte("l2") + ", " + _COH_CTE + ", o AS (SELECT setting, count(*) AS k, round(avg(c_v), 6) AS avg_c_v FROM cv "
    "GROUP BY setting) SELECT 'clusters' AS source, * FROM o UNION ALL SELECT 'external' AS source, * FROM o WHERE ends_with(setting, '_top5')")


# ------------------------------------------ clusters, representatives, table
_CLU = (
    "cl AS (SELECT 5 AS dim, vec_id, CASE WHEN label = 0 THEN -1 ELSE label END AS cluster_id, "
    "least(1.0, abs(CAST(embedding[1] AS DOUBLE)) * 4) AS outlier, embedding AS vec FROM embeddings "
    "UNION ALL SELECT 10 AS dim, vec_id, CASE WHEN abs(CAST(embedding[3] AS DOUBLE)) < 0.03 THEN -1 ELSE "
    "1 + CAST(embedding[2] > 0 AS INTEGER) + 2 * CAST(embedding[4] > 0 AS INTEGER) "
    "+ 4 * CAST(embedding[5] > 0 AS INTEGER) END AS cluster_id, "
    "least(1.0, abs(CAST(embedding[6] AS DOUBLE)) * 4) AS outlier, embedding AS vec FROM embeddings), "
    "u AS (SELECT cl.*, d.text AS phrase, d.source FROM cl JOIN documents d ON d.doc_id = cl.vec_id), "
    "sz AS (SELECT dim, cluster_id, count(*) AS size FROM u WHERE cluster_id <> -1 GROUP BY dim, cluster_id), "
    "topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY size DESC, cluster_id) "
    "AS size_rank FROM sz) WHERE size_rank <= 10), "
    "uc AS (SELECT u.* FROM u SEMI JOIN topk ON u.dim = topk.dim AND u.cluster_id = topk.cluster_id), "
    "coords AS (SELECT dim, cluster_id, greatest(0.0, 1 - outlier) AS w, unnest(generate_series(0, len(vec) - 1)) "
    "AS pos, unnest(vec) AS x FROM uc), "
    "cen AS (SELECT dim, cluster_id, pos, CASE WHEN sum(w) = 0 THEN avg(CAST(x AS DOUBLE)) ELSE "
    "sum(w * CAST(x AS DOUBLE)) / sum(w) END AS value FROM coords GROUP BY dim, cluster_id, pos), "
    "cenv AS (SELECT dim, cluster_id, list(value ORDER BY pos) AS c FROM cen GROUP BY dim, cluster_id), "
    "sims AS (SELECT uc.dim, uc.cluster_id, uc.vec_id, uc.phrase, "
    "list_sum(list_transform(list_zip(uc.vec, cenv.c), lambda t: CAST(t[1] AS DOUBLE) * t[2])) / "
    "(sqrt(list_sum(list_transform(uc.vec, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * "
    "sqrt(list_sum(list_transform(cenv.c, lambda x: x * x)))) AS sim FROM uc JOIN cenv "
    "ON uc.dim = cenv.dim AND uc.cluster_id = cenv.cluster_id), "
    "rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dim, cluster_id ORDER BY round(sim, 9) DESC, "
    "vec_id) AS r FROM sims) WHERE r = 1), "
    "reps AS (SELECT t.dim, t.cluster_id, t.size, rep.phrase AS weighted_centroid_phrase, rep.sim AS rep_cosine_sim, "
    "rep.vec_id AS rep_id FROM topk t JOIN rep ON t.dim = rep.dim AND t.cluster_id = rep.cluster_id), "
    "samp AS (SELECT dim, cluster_id, string_agg(phrase, ' | ' ORDER BY outlier, vec_id) AS sample_phrases FROM "
    "(SELECT *, row_number() OVER (PARTITION BY dim, cluster_id ORDER BY outlier, vec_id) AS r FROM uc) "
    "WHERE r <= 8 GROUP BY dim, cluster_id), "
    "sheet AS (SELECT reps.dim, reps.cluster_id, reps.size, reps.weighted_centroid_phrase AS rep_phrase, "
    "samp.sample_phrases, trim(d.source) AS aspect_label FROM reps JOIN samp ON reps.dim = samp.dim "
    "AND reps.cluster_id = samp.cluster_id JOIN documents d ON d.doc_id = reps.rep_id), "
    "rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY size DESC, cluster_id) AS top_n "
    "FROM sheet WHERE coalesce(aspect_label, '') <> '') WHERE top_n <= 10), "
    "both_l AS (SELECT aspect_label FROM rk GROUP BY aspect_label "
    "HAVING count(DISTINCT dim) = 2 AND min(dim) = 5 AND max(dim) = 10)"
)

ORACLE["top_k_clusters"] = "WITH " + _CLU + " SELECT dim, cluster_id, size, size_rank FROM topk"
ORACLE["central_phrase"] = (
    "WITH " + _CLU + ", cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dim, cluster_id "
    "ORDER BY outlier, vec_id) AS r FROM uc) WHERE r = 1) "
    "SELECT t.dim, t.cluster_id, t.size, cp.phrase AS representative_phrase FROM topk t JOIN cp "
    "ON t.dim = cp.dim AND t.cluster_id = cp.cluster_id")
ORACLE["weighted_centroid"] = ("WITH " + _CLU + " SELECT dim, cluster_id, CAST(pos AS INTEGER) AS pos, "
                               "round(value, 6) AS value FROM cen")
ORACLE["weighted_reps"] = ("WITH " + _CLU + " SELECT dim, cluster_id, size, weighted_centroid_phrase, "
                           "round(rep_cosine_sim, 6) AS rep_cosine_sim FROM reps")
ORACLE["cluster_samples"] = ("WITH " + _CLU + " SELECT dim, cluster_id, size, rep_phrase, sample_phrases "
                             "FROM sheet")
_FMT = ("CASE WHEN rk.aspect_label IN (SELECT aspect_label FROM both_l) THEN '**' || rk.aspect_label || '**' "
        "ELSE rk.aspect_label END")
ORACLE["side_by_side"] = (
    "WITH " + _CLU + ", rows AS (SELECT CAST(range AS INTEGER) AS top_n FROM range(1, 11)), "
    f"l AS (SELECT top_n, rep_phrase AS p, {_FMT} AS lab FROM rk WHERE dim = 5), "
    f"r AS (SELECT top_n, rep_phrase AS p, {_FMT} AS lab FROM rk WHERE dim = 10), "
    "o AS (SELECT rows.top_n, replace(coalesce(l.p, ''), '|', '\\|') AS left_phrase, "
    "replace(coalesce(l.lab, ''), '|', '\\|') AS left_label, replace(coalesce(r.p, ''), '|', '\\|') AS right_phrase, "
    "replace(coalesce(r.lab, ''), '|', '\\|') AS right_label FROM rows LEFT JOIN l ON l.top_n = rows.top_n "
    "LEFT JOIN r ON r.top_n = rows.top_n) "
    "SELECT *, '| ' || CAST(top_n AS VARCHAR) || ' | ' || left_phrase || ' | ' || left_label || ' | ' || "
    "right_phrase || ' | ' || right_label || ' |' AS md_line FROM o")
ORACLE["label_membership"] = (
    "WITH " + _CLU + " SELECT aspect_label, arg_max(rep_phrase, dim * 1000 - top_n) AS rep_phrase, "
    "CASE WHEN count(DISTINCT dim) = 2 THEN 'both' WHEN max(dim) = 5 THEN '5D' ELSE '10D' END AS appears_in "
    "FROM rk GROUP BY aspect_label")


# --------------------------------------------------------------- topic table
_RESP = (
    "resp AS (SELECT event_id AS doc_pos, CASE WHEN event_id % 7 = 6 THEN 'None' ELSE '[1] ' || "
    "upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) || ': user ' || CAST(user_id AS VARCHAR) "
    "END AS response FROM events), "
    "lines AS (SELECT doc_pos, unnest(generate_series(0, len(string_split(response, chr(10))) - 1)) AS line_pos, "
    "trim(unnest(string_split(response, chr(10)))) AS line FROM resp), "
    "parsed AS (SELECT *, regexp_matches(line, '^\\[(\\d+)\\] ([\\w\\s]+):(.+)') AS ok, "
    "CAST(regexp_extract(line, '^\\[(\\d+)\\] ([\\w\\s]+):(.+)', 1) AS INTEGER) AS lvl, "
    "trim(regexp_extract(line, '^\\[(\\d+)\\] ([\\w\\s]+):(.+)', 2)) AS name, "
    "trim(regexp_extract(line, '^\\[(\\d+)\\] ([\\w\\s]+):(.+)', 3)) AS \"desc\" FROM lines), "
    "m AS (SELECT row_number() OVER (ORDER BY doc_pos, line_pos) AS idx, doc_pos, name, \"desc\", lower(name) AS key "
    "FROM parsed WHERE ok AND lvl = 1), "
    # the reference loop, run one mention at a time
    "sim AS (SELECT 0::BIGINT AS idx, []::VARCHAR[] AS seen, 0 AS run, false AS stopped "
    "UNION ALL SELECT m.idx, CASE WHEN list_contains(s.seen, m.key) THEN s.seen ELSE list_append(s.seen, m.key) END, "
    "CASE WHEN list_contains(s.seen, m.key) THEN s.run + 1 ELSE 0 END, "
    "list_contains(s.seen, m.key) AND s.run + 1 > 2000 FROM sim s JOIN m ON m.idx = s.idx + 1 WHERE NOT s.stopped), "
    "stop AS (SELECT min(sim.idx) AS stop_idx, min(m.doc_pos) AS stop_doc FROM sim JOIN m ON m.idx = sim.idx "
    "WHERE stopped)"
)


def _fold(cond: str) -> str:
    return ("SELECT min(idx) AS topic_order, 1 AS lvl, arg_min(name, idx) AS name, count(*) AS count, "
            f"arg_min(\"desc\", idx) AS \"desc\" FROM m WHERE {cond} GROUP BY key")


ORACLE["topic_fold"] = "WITH RECURSIVE " + _RESP + " " + _fold("true")
ORACLE["topic_early_stop"] = ("WITH RECURSIVE " + _RESP + " " +
                              _fold("idx <= coalesce((SELECT stop_idx FROM stop), 9223372036854775807)"))
_SEEDED = _RESP.replace("SELECT 0::BIGINT AS idx, []::VARCHAR[] AS seen",
                        "SELECT 0::BIGINT AS idx, (SELECT list(DISTINCT lower(name)) FROM sd WHERE lvl = 1) AS seen")


def _seed_fold() -> str:
    """The seeds with the mentions that they take, then the other topics."""
    lines = ("sl AS (SELECT line_no, regexp_replace(t, ' \\(Count: \\d+\\)', '') AS t FROM tl UNION ALL "
             "SELECT * FROM (VALUES (1000000, '[1] CLICK: seed'), (1000001, '[1] view: seed')) v(line_no, t)), "
             "sd AS (SELECT line_no, CAST(regexp_extract(t, '^\\[(\\d+)\\] (.+)', 1) AS INTEGER) AS lvl, "
             "trim(split_part(regexp_extract(t, '^\\[(\\d+)\\] (.+)', 2), ':', 1)) AS name FROM sl)")
    return ("WITH RECURSIVE " + _TREE.split(", pl AS")[0] + ", " + lines + ", " + _SEEDED + ", "
            "k AS (SELECT * FROM m WHERE idx <= coalesce((SELECT stop_idx FROM stop), 9223372036854775807)), "
            "f AS (SELECT *, row_number() OVER (PARTITION BY lvl, lower(name) ORDER BY line_no) AS nth FROM sd) "
            "SELECT lvl, name, 1 + CASE WHEN lvl = 1 AND nth = 1 THEN (SELECT count(*) FROM k WHERE k.key = lower(f.name)) "
            "ELSE 0 END AS count, '' AS \"desc\" FROM f UNION ALL "
            "SELECT 1, arg_min(name, idx), count(*), arg_min(\"desc\", idx) FROM k "
            "WHERE key NOT IN (SELECT lower(name) FROM sd WHERE lvl = 1) GROUP BY key")


ORACLE["processed_responses"] = ("WITH RECURSIVE " + _RESP + " SELECT doc_pos, response FROM resp "
                                 "WHERE doc_pos < coalesce((SELECT stop_doc FROM stop), 9223372036854775807)")
ORACLE["topic_rejects"] = (
    "WITH RECURSIVE " + _RESP + " SELECT doc_pos, CAST(line_pos AS INTEGER) AS line_pos, line, "
    "CASE WHEN NOT ok THEN 'invalid_format' ELSE 'lower_level' END AS status FROM parsed "
    "WHERE NOT ok OR lvl <> 1")

_TL = "^\\[(\\d+)\\] (.+) \\(Count: (\\d+)\\)\\s?:(.+)?"
_TREE = (
    "l1 AS (SELECT p_type, '' AS p_brand, printf('[1] %s (Count: %d): %s', p_type, count(*), min(p_name)) AS line "
    "FROM part GROUP BY p_type), "
    "l2 AS (SELECT p_type, p_brand, printf('    [2] %s (Count: %d): %s', p_brand, count(*), min(p_name)) AS line "
    "FROM part GROUP BY p_type, p_brand), "
    "tl AS (SELECT row_number() OVER (ORDER BY p_type, p_brand) AS line_no, trim(line) AS t FROM "
    "(SELECT * FROM l1 UNION ALL SELECT * FROM l2)), "
    f"pl AS (SELECT line_no, CAST(regexp_extract(t, '{_TL}', 1) AS INTEGER) AS lvl, "
    f"trim(regexp_extract(t, '{_TL}', 2)) AS name, CAST(regexp_extract(t, '{_TL}', 3) AS BIGINT) AS count, "
    f"trim(regexp_extract(t, '{_TL}', 4)) AS \"desc\" FROM tl WHERE regexp_matches(t, '{_TL}')), "
    "n1 AS (SELECT min(line_no) AS node_id, 1 AS lvl, name, sum(count) AS count, arg_min(\"desc\", line_no) AS \"desc\", "
    "0 AS parent_id FROM pl WHERE lvl = 1 GROUP BY name), "
    "c2 AS (SELECT pl.*, (SELECT max(node_id) FROM n1 WHERE n1.node_id < pl.line_no) AS parent_id FROM pl WHERE lvl = 2), "
    "n2 AS (SELECT min(line_no) AS node_id, 2 AS lvl, name, sum(count) AS count, arg_min(\"desc\", line_no) AS \"desc\", "
    "parent_id FROM c2 WHERE parent_id IS NOT NULL GROUP BY parent_id, name), "
    "tree AS (SELECT CAST(node_id AS BIGINT) AS node_id, CAST(lvl AS INTEGER) AS lvl, name, CAST(count AS BIGINT) AS count, "
    "\"desc\", CAST(parent_id AS BIGINT) AS parent_id FROM (SELECT * FROM n1 UNION ALL SELECT * FROM n2))"
)
_NODE = "'[' || CAST(lvl AS VARCHAR) || '] ' || name"

ORACLE["parse_topic_lines"] = "WITH " + _TREE + " SELECT CAST(line_no AS BIGINT) AS line_no, lvl, name, count, \"desc\" FROM pl"
ORACLE["topic_parents"] = "WITH " + _TREE + " SELECT * FROM tree"
ORACLE["topic_file_lines"] = (
    "WITH " + _TREE + " SELECT node_id, repeat('    ', lvl - 1) || " + _NODE +
    " || ' (Count: ' || CAST(count AS VARCHAR) || '): ' || \"desc\" AS line FROM tree WHERE length(\"desc\") > 0")
ORACLE["topic_outline"] = "WITH " + _TREE + " SELECT node_id, repeat(chr(9), lvl - 1) || " + _NODE + " AS line FROM tree"
ORACLE["find_duplicates"] = (
    "WITH " + _TREE + " SELECT s.sought, t.lvl, t.node_id, t.name, t.parent_id FROM tree t JOIN "
    "(SELECT DISTINCT lvl, upper(name) AS sought FROM tree) s ON s.lvl = t.lvl AND upper(t.name) = s.sought")
ORACLE["topic_names"] = "WITH " + _TREE + " SELECT name FROM tree"
ORACLE["remove_topic"] = (
    "WITH " + _TREE + ", v AS (SELECT min(node_id) AS id FROM tree WHERE name = 'LARGE' AND lvl = 1) "
    "SELECT * FROM tree WHERE node_id <> coalesce((SELECT id FROM v), -99) "
    "AND parent_id <> coalesce((SELECT id FROM v), -99)")
ORACLE["merge_topics"] = (
    "WITH " + _TREE + ", hit AS (SELECT * FROM tree WHERE lvl = 1 AND lower(name) IN ('economy', 'promo')) "
    "SELECT * FROM tree WHERE node_id NOT IN (SELECT node_id FROM hit) AND parent_id NOT IN (SELECT node_id FROM hit) "
    "UNION ALL SELECT (SELECT max(node_id) + 1 FROM tree), 1, 'VALUE', CAST(sum(count) AS BIGINT), "
    "'Mentions economy and promotional parts.', CAST(0 AS BIGINT) FROM hit")
ORACLE["topic_fold_seeds"] = _seed_fold()
ORACLE["drop_rare_topics"] = (
    "WITH " + _TREE + ", tot AS (SELECT lvl, sum(count) AS t FROM tree GROUP BY lvl) "
    "SELECT tree.lvl, node_id, name, count, \"desc\", parent_id FROM tree JOIN tot ON tree.lvl = tot.lvl "
    "WHERE count / t >= 0.01")
ORACLE["topic_top_words"] = (
    "WITH " + _TREE + ", w AS (SELECT node_id, unnest(generate_series(0, len(ws) - 1)) AS pos, unnest(ws) AS word "
    "FROM (SELECT node_id, regexp_extract_all(lower(\"desc\"), '[a-zA-Z'']+') AS ws FROM tree)), "
    "c AS (SELECT node_id, word, count(*) AS n, min(pos) AS first FROM w WHERE word NOT IN "
    "('the', 'and', 'of', 'to', 'in', 'for', 'a', 'an', 'is') GROUP BY node_id, word) "
    "SELECT node_id, CAST(rank AS INTEGER) AS rank, word, n AS count FROM (SELECT *, row_number() OVER "
    "(PARTITION BY node_id ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= 10")


# ------------------------------------------------------------ density clusters
_DEN = (
    "pts AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), "
    "pairs AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.x, b.x) AS dist "
    "FROM pts a, pts b WHERE a.vec_id <> b.vec_id), "
    "nn AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM pairs), "
    "cnt AS (SELECT p.vec_id, 1 + count(q.dst) AS n FROM pts p LEFT JOIN pairs q ON q.src = p.vec_id "
    "AND q.dist <= 1.2 GROUP BY p.vec_id), "
    "core AS (SELECT vec_id FROM cnt WHERE n >= 5), "
    "ce AS (SELECT src, dst FROM pairs WHERE dist <= 1.2 AND src IN (SELECT vec_id FROM core) "
    "AND dst IN (SELECT vec_id FROM core)), "
    "reach(id, l) AS (SELECT vec_id, vec_id FROM core UNION SELECT ce.dst, reach.l FROM reach JOIN ce "
    "ON ce.src = reach.id), "
    "comp AS (SELECT id, min(l) AS component FROM reach GROUP BY id), "
    "sizes AS (SELECT component, count(*) AS size FROM comp GROUP BY component HAVING count(*) >= 5), "
    "rk AS (SELECT component, CAST(row_number() OVER (ORDER BY size DESC, component) - 1 AS INTEGER) AS cluster_id "
    "FROM sizes), "
    "lab AS (SELECT p.vec_id, coalesce(rk.cluster_id, -1) AS cluster_id FROM pts p LEFT JOIN comp ON comp.id = p.vec_id "
    "LEFT JOIN rk ON rk.component = comp.component)"
)
ORACLE["knn"] = ("WITH RECURSIVE " + _DEN + " SELECT src, dst, round(dist, 9) AS dist, CAST(rank AS INTEGER) AS rank "
                 "FROM nn WHERE rank <= 5")
ORACLE["knn_cosine"] = (
    "WITH pts AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), "
    "nn AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_distance(a.x, b.x) AS dist FROM pts a, pts b "
    "WHERE a.vec_id <> b.vec_id) SELECT src, dst, round(dist, 9) AS dist, CAST(rank AS INTEGER) AS rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM nn) WHERE rank <= 5")
ORACLE["density_eps_cut"] = "WITH RECURSIVE " + _DEN + " SELECT vec_id, cluster_id FROM lab"
ORACLE["density_tree_cut"] = ORACLE["density_eps_cut"]


# Spanning tree grown point by point; u is the largest weight on the path between two points, so two points are in one
# merge from u on.  Merges, clusters and picks are then relations over the balls of u.
_HIER = (
    _DEN.split("cnt AS")[0] + "cdist AS (SELECT src AS id, dist AS core FROM nn WHERE rank = 4), "
    "mr AS MATERIALIZED (SELECT src AS a, dst AS b, greatest(dist, x.core, y.core) AS w FROM pairs JOIN cdist x ON x.id = src "
    "JOIN cdist y ON y.id = dst), "
    "grown AS (SELECT 0 AS step, vec_id AS node, (SELECT min(vec_id) FROM pts) AS par, m.w, vec_id = (SELECT min(vec_id) FROM pts) AS done "
    "FROM pts LEFT JOIN mr m ON m.a = (SELECT min(vec_id) FROM pts) AND m.b = vec_id UNION ALL "
    "SELECT g.step + 1, g.node, CASE WHEN NOT g.done AND g.node <> k.node AND m.w < g.w THEN k.node ELSE g.par END, "
    "CASE WHEN NOT g.done AND g.node <> k.node AND m.w < g.w THEN m.w ELSE g.w END, g.done OR g.node = k.node FROM grown g "
    "JOIN (SELECT arg_min(node, w) AS node FROM grown WHERE NOT done) k ON k.node IS NOT NULL "
    "LEFT JOIN mr m ON m.a = k.node AND m.b = g.node), "
    "tree AS MATERIALIZED (SELECT node AS a, par AS b, w FROM grown WHERE step = (SELECT max(step) FROM grown) AND w IS NOT NULL), "
    "sides AS MATERIALIZED (SELECT a, b, w FROM tree UNION ALL SELECT b, a, w FROM tree), "
    "walk AS (SELECT vec_id AS i, vec_id AS pt, CAST(NULL AS BIGINT) AS prev, 0.0::DOUBLE AS u FROM pts UNION ALL "
    "SELECT i, s.b, pt, greatest(u, s.w) FROM walk JOIN sides s ON s.a = pt WHERE prev IS NULL OR s.b <> prev), "
    "ball AS MATERIALIZED (SELECT DISTINCT i, u AS h, count(*) OVER o AS size, min(pt) OVER o AS rep FROM walk "
    "WINDOW o AS (PARTITION BY i ORDER BY u)), "
    "big AS MATERIALIZED (SELECT rep, size, max(h) AS h FROM ball WHERE size >= 5 GROUP BY rep, size), "
    "ups AS (SELECT i, size, lead(rep) OVER o AS prep, lead(size) OVER o AS psize FROM ball WINDOW o AS (PARTITION BY i ORDER BY size)), "
    "linked AS MATERIALIZED (SELECT big.*, ups.prep, ups.psize FROM big JOIN ups ON ups.i = big.rep AND ups.size = big.size), "
    "kids AS (SELECT prep, psize, count(*) AS kids FROM linked WHERE prep IS NOT NULL GROUP BY ALL), "
    "node AS MATERIALIZED (SELECT l.*, l.prep IS NULL OR k.kids > 1 AS first, CASE WHEN p.h IS NULL THEN 0 ELSE 1 / greatest(p.h, 1e-12) END AS birth FROM linked l "
    "LEFT JOIN kids k ON k.prep = l.prep AND k.psize = l.psize LEFT JOIN big p ON p.rep = l.prep AND p.size = l.psize), "
    "chain AS (SELECT n.rep, n.size, n.h, n.birth, arg_min(f.rep, f.size) AS crep, min(f.size) AS csize FROM node n "
    "JOIN ball b ON b.i = n.rep AND b.size >= n.size JOIN node f ON f.first AND f.rep = b.rep AND f.size = b.size GROUP BY ALL), "
    "clus AS MATERIALIZED (SELECT c.crep AS rep, c.csize AS size, up.crep AS prep, up.csize AS psize, f.birth, s.stability FROM chain c "
    "JOIN node f ON f.rep = c.rep AND f.size = c.size AND f.first JOIN (SELECT crep, csize, sum(size * (1 / greatest(h, 1e-12) - birth)) AS stability "
    "FROM chain GROUP BY ALL) s ON s.crep = c.crep AND s.csize = c.csize LEFT JOIN chain up ON up.rep = f.prep AND up.size = f.psize), "
    "eom AS (SELECT 0 AS step, c.*, CASE WHEN NOT EXISTS (SELECT 1 FROM clus k WHERE k.prep = c.rep AND k.psize = c.size) THEN stability END AS val, "
    "true AS better FROM clus c UNION ALL SELECT e.step + 1, e.rep, e.size, e.prep, e.psize, e.birth, e.stability, "
    "CASE WHEN e.val IS NOT NULL THEN e.val WHEN k.ready THEN CASE WHEN e.prep IS NOT NULL AND e.stability * (1 + 1e-9) >= k.parts THEN e.stability "
    "ELSE k.parts END END, CASE WHEN e.val IS NULL AND k.ready THEN e.stability * (1 + 1e-9) >= k.parts ELSE e.better END FROM eom e "
    "LEFT JOIN (SELECT prep, psize, sum(val) AS parts, bool_and(val IS NOT NULL) AS ready FROM eom GROUP BY ALL) k "
    "ON k.prep = e.rep AND k.psize = e.size WHERE EXISTS (SELECT 1 FROM eom WHERE val IS NULL)), "
    "better AS (SELECT * EXCLUDE (better), better AND prep IS NOT NULL AS better FROM eom WHERE step = (SELECT max(step) FROM eom)), "
    "over AS (SELECT c.rep, c.size, max(o.size) AS top FROM better c JOIN ball b ON b.i = c.rep AND b.size >= c.size "
    "JOIN better o ON o.better AND o.rep = b.rep AND o.size = b.size GROUP BY ALL), "
    "final AS MATERIALIZED (SELECT c.*, coalesce(o.top = c.size, false) AS picked FROM better c LEFT JOIN over o ON o.rep = c.rep AND o.size = c.size)"
)
ORACLE["condensed_tree"] = (
    "WITH RECURSIVE " + _HIER + " SELECT rep AS smallest_id, size, prep AS parent_id, psize AS parent_size, round(birth, 6) AS birth, "
    "round(stability, 6) AS stability, picked FROM final")
ORACLE["density_hierarchy"] = (
    "WITH RECURSIVE " + _HIER + ", rk2 AS (SELECT rep, size, CAST(row_number() OVER (ORDER BY size DESC, rep) - 1 AS INTEGER) AS cluster_id "
    "FROM final WHERE picked), mine AS (SELECT b.i, max(cluster_id) AS cluster_id FROM ball b JOIN rk2 ON rk2.rep = b.rep AND rk2.size = b.size "
    "GROUP BY b.i) SELECT vec_id, coalesce(cluster_id, -1) AS cluster_id FROM pts LEFT JOIN mine ON mine.i = vec_id")
ORACLE["outlier_score"] = (
    "WITH RECURSIVE " + _DEN + ", cd AS (SELECT src AS vec_id, dist AS core_dist FROM nn WHERE rank = 4), "
    "j AS (SELECT lab.*, cd.core_dist FROM lab LEFT JOIN cd ON cd.vec_id = lab.vec_id), "
    "dm AS (SELECT cluster_id, min(core_dist) AS dmin FROM j WHERE cluster_id <> -1 GROUP BY cluster_id) "
    "SELECT j.vec_id, j.cluster_id, round(j.core_dist, 9) AS core_dist, round(CASE WHEN j.cluster_id = -1 THEN 1.0 "
    "ELSE 1 - greatest(dm.dmin, 1e-12) / greatest(j.core_dist, 1e-12) END, 6) AS outlier "
    "FROM j LEFT JOIN dm ON dm.cluster_id = j.cluster_id")


# ------------------------------------------------------ embeddings, reduction
_HASH = (
    "hw AS (SELECT review_id, unit_pos, unnest(regexp_extract_all(lower(unit), '[\\p{L}\\p{N}_]{2,}')) AS w FROM units), "
    "hb AS (SELECT review_id, unit_pos, CAST(('0x' || substr(md5(w), 1, 8))::UBIGINT % 64 AS INTEGER) AS bucket, "
    "CASE WHEN ('0x' || substr(md5(w), 9, 8))::UBIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM hw), "
    "hv AS (SELECT review_id, unit_pos, bucket, round(sum(s), 6) AS value FROM hb GROUP BY ALL HAVING sum(s) <> 0)"
)
ORACLE["hash_embed"] = "WITH " + _units_dedup() + ", " + _HASH + " SELECT * FROM hv"
ORACLE["embed_units_plugin"] = ORACLE["hash_embed"]
ORACLE["hash_embed_dense"] = ORACLE["hash_embed"]


ORACLE["embed_models"] = (
    "WITH " + _units_dedup() + ", " + _HASH + ", " + _HASH.replace("hw AS", "hw2 AS").replace("FROM hw)", "FROM hw2)").replace(
        "hb AS", "hb2 AS").replace("FROM hb ", "FROM hb2 ").replace("hv AS", "hv2 AS").replace("% 64", "% 32")
    + ", n2 AS (SELECT review_id, unit_pos, sqrt(sum(value * value)) AS norm FROM hv2 GROUP BY ALL) "
    "SELECT review_id, unit_pos, 'hash64' AS model, bucket, value FROM hv UNION ALL SELECT hv2.review_id, hv2.unit_pos, 'hash32', "
    "bucket, round(value / norm, 6) FROM hv2 JOIN n2 ON n2.review_id = hv2.review_id AND n2.unit_pos = hv2.unit_pos")


def _proj(k: int) -> str:
    return (f"SELECT e.vec_id, '{k}d' AS dim_label, CAST(j.j AS INTEGER) AS pos, round(sum(CAST(e.embedding[i.i + 1] AS DOUBLE) * "
            f"CASE WHEN ('0x' || substr(md5('42:' || CAST(i.i * {k} + j.j AS VARCHAR)), 1, 8))::UBIGINT % 2 = 0 "
            f"THEN 1.0 ELSE -1.0 END / sqrt({k})), 6) AS value FROM embeddings e, range(0, 64) i(i), range(0, {k}) j(j) "
            "GROUP BY e.vec_id, j.j")


def _chain(k: int, eps: float) -> str:
    """Brute-force labels and outliers of one reduced dimension (tables suffixed with k)."""
    den = _DEN.replace("embeddings", f"red{k}").replace("1.2", str(eps)).replace(
        "list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x", "x")
    for t in ("pts", "pairs", "nn", "cnt", "core", "ce", "reach", "comp", "sizes", "rk", "lab"):
        den = re.sub(rf"(?<![A-Za-z_]){t}(?![A-Za-z_])", f"{t}{k}", den)
    proj = _proj(k).replace("round(sum(", "(sum(").replace(", 6) AS value", ") AS value")
    return (f"red{k} AS (SELECT p.vec_id, list(value ORDER BY pos) AS x FROM ({proj}) p "
            f"JOIN documents d ON d.doc_id = p.vec_id GROUP BY p.vec_id), {den}, "
            f"j{k} AS (SELECT l.*, n.dist AS cd FROM lab{k} l LEFT JOIN nn{k} n ON n.src = l.vec_id AND n.rank = 4), "
            f"cl{k} AS (SELECT {k} AS dim, j.vec_id, j.cluster_id, CASE WHEN j.cluster_id = -1 THEN 1.0 ELSE "
            f"1 - greatest(m.d, 1e-12) / greatest(j.cd, 1e-12) END AS outlier, r.x AS vec FROM j{k} j JOIN red{k} r ON r.vec_id = j.vec_id "
            f"LEFT JOIN (SELECT cluster_id, min(cd) AS d FROM j{k} GROUP BY cluster_id) m ON m.cluster_id = j.cluster_id)")


ORACLE["cluster_chain"] = (
    "WITH RECURSIVE " + _chain(5, 0.33) + ", " + _chain(10, 0.72) + ", cl AS (SELECT * FROM cl5 UNION ALL SELECT * FROM cl10), "
    + _CLU[_CLU.index("u AS (SELECT cl.*"):] + " SELECT rk.dim, CAST(rk.top_n AS INTEGER) AS top_n, rk.cluster_id, rk.size, rk.rep_phrase, "
    "round(reps.rep_cosine_sim, 6) AS rep_cosine_sim, rk.sample_phrases, rk.aspect_label FROM rk JOIN reps "
    "ON reps.dim = rk.dim AND reps.cluster_id = rk.cluster_id")
ORACLE["random_projection"] = " UNION ALL ".join(_proj(k) for k in (2, 3, 5, 10, 20, 50))
ORACLE["reduce_manifest"] = (
    "SELECT dim_label, n_components, count(*) AS rows FROM (SELECT 'orig' AS dim_label, 64 AS n_components "
    "FROM embeddings UNION ALL SELECT k || 'd', k FROM embeddings, (VALUES (2), (3), (5), (10), (20), (50)) t(k)) "
    "GROUP BY dim_label, n_components")
ORACLE["normalize_cosine"] = (
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) / n) * (CAST(x AS DOUBLE) / n))), 6) "
    "AS sq_norm, round(CAST(embedding[1] AS DOUBLE) / n, 6) AS cos_axis0 FROM (SELECT *, sqrt(list_sum(list_transform("
    "embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)")


# ---------------------------------------------------------- sources and sinks
ORACLE["reviews_csv_roundtrip"] = (
    "SELECT d.source AS course_id, d.text AS review, CAST(l.quality AS VARCHAR) AS label FROM documents d "
    "LEFT JOIN labels l ON d.doc_id = l.doc_id")
ORACLE["corpus_roundtrip"] = ORACLE["corpus_ids"]
ORACLE["topic_words_roundtrip"] = (
    "WITH " + _top_words_cte("raw") + " SELECT setting, CAST(dense_rank() OVER (PARTITION BY setting ORDER BY cluster) - 1 "
    "AS INTEGER) AS topic_id, rank, word FROM top")


# ------------------------------------------------- more table / topic operators
ORACLE["check_alignment"] = (
    "WITH l AS (SELECT vec_id, count(*) AS nl FROM embeddings GROUP BY vec_id), "
    "r AS (SELECT doc_id AS vec_id, count(*) AS nr FROM documents GROUP BY doc_id), "
    "j AS (SELECT * FROM l FULL OUTER JOIN r USING (vec_id)) "
    "SELECT CAST(sum(CASE WHEN nr IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS left_only, "
    "CAST(sum(CASE WHEN nl IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS right_only, "
    "CAST(sum(CASE WHEN nl > 1 THEN 1 ELSE 0 END) AS BIGINT) AS left_dups, "
    "CAST(sum(CASE WHEN nr > 1 THEN 1 ELSE 0 END) AS BIGINT) AS right_dups FROM j")
ORACLE["topic_list_forms"] = (
    "WITH " + _TREE + " SELECT node_id, 'name' AS form, " + _NODE + " AS topic FROM tree UNION ALL "
    "SELECT node_id, 'desc', " + _NODE + " || ': ' || \"desc\" FROM tree UNION ALL "
    "SELECT node_id, 'count', " + _NODE + " || ' (Count: ' || CAST(count AS VARCHAR) || ')' FROM tree UNION ALL "
    "SELECT node_id, 'full', " + _NODE + " || ' (Count: ' || CAST(count AS VARCHAR) || '): ' || \"desc\" FROM tree")
ORACLE["seed_topics"] = (
    "WITH " + _TREE.split(", pl AS")[0] + ", sl AS (SELECT line_no, "
    "regexp_replace(t, ' \\(Count: \\d+\\)', '') AS t FROM tl) "
    "SELECT CAST(line_no AS BIGINT) AS line_no, CAST(regexp_extract(t, '^\\[(\\d+)\\] (.+)', 1) AS INTEGER) AS lvl, "
    "trim(split_part(regexp_extract(t, '^\\[(\\d+)\\] (.+)', 2), ':', 1)) AS name, CAST(1 AS BIGINT) AS count, "
    "'' AS \"desc\" FROM sl WHERE regexp_matches(t, '^\\[(\\d+)\\] (.+)')")
_EST = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\p{Z}]"
_PROMPT_HEAD = "You will receive a document and a list of topics.' || chr(10) || '[Topics]' || chr(10)"
ORACLE["build_prompts"] = (
    "WITH RECURSIVE " + _RESP + ", tp AS (SELECT min(idx) AS o, arg_min(name, idx) AS name FROM m "
    "WHERE idx <= coalesce((SELECT stop_idx FROM stop), 9223372036854775807) GROUP BY key), "
    "ts AS (SELECT string_agg(trim('[1] ' || name), chr(10) ORDER BY o) AS topic_str FROM tp), "
    "pl AS (SELECT len(regexp_extract_all('You will receive a document and a list of topics.' || chr(10) || "
    "'[Topics]' || chr(10) || chr(10) || '[Document]' || chr(10) || chr(10) || "
    "'Answer with lines in the form \"[1] Topic: description\" {one per line}.', '" + _EST + "')) AS n), "
    "d AS (SELECT doc_id, text, regexp_extract_all(text, '[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\p{Z}]*(?:" + _EST + ")') AS cut, "
    "len(regexp_extract_all(text, '" + _EST + "')) AS dl FROM documents), "
    "x AS (SELECT d.*, ts.topic_str, pl.n, len(regexp_extract_all(ts.topic_str, '" + _EST + "')) AS tl "
    "FROM d, ts, pl), "
    "y AS (SELECT *, n + dl + tl > 4000 AS over, (n + dl + tl > 4000) AND dl > 4000 - n - 500 AS trunc FROM x) "
    "SELECT doc_id, 'You will receive a document and a list of topics.' || chr(10) || '[Topics]' || chr(10) || "
    "topic_str || chr(10) || '[Document]' || chr(10) || CASE WHEN trunc THEN "
    "array_to_string(list_slice(cut, 1, greatest(4000 - n - 500, 0)), '') ELSE coalesce(text, '') END || chr(10) || "
    "'Answer with lines in the form \"[1] Topic: description\" {one per line}.' AS prompt, "
    "tl > 4000 - n - CASE WHEN trunc THEN greatest(4000 - n - 500, 0) ELSE dl END AS pruned, trunc AS truncated FROM y")
