"""Normalising, ranking, blending and judging scores of candidates within queries.

Ties go to the smaller position.
"""

from __future__ import annotations

from chronolink.plans.relational import CATALOG, define, define_spark, define_stored

# Plain scorers over the history, as inputs to blends and comparisons.
define("scores", """
SELECT q.qid, q.pos, q.cand, q.label, q.src,
       round(coalesce(p.n, 0) + 0.3 * ln(1 + coalesce(d.unique_src, 0)), 6) AS s1,
       round(ln(1 + coalesce(d.degree, 0)), 6) AS s2,
       round(CASE WHEN p.last_time IS NULL THEN 0.0 ELSE 1.0 / (1.0 + CAST(q.time - p.last_time AS DOUBLE) / 86400.0) END, 6) AS s3,
       CASE WHEN d.dst IS NULL THEN 0 ELSE 1 END AS seen, CASE WHEN p.n IS NULL THEN 0 ELSE 1 END AS known
FROM {queries} q LEFT JOIN {pair_counts} p ON p.src = q.src AND p.dst = q.cand LEFT JOIN {dst_counts} d ON d.dst = q.cand
""")
define("minmax_rows", """
SELECT qid, pos, round((s1 - min(s1) OVER w) / greatest(max(s1) OVER w - min(s1) OVER w, 1e-12), 6) AS n1,
       round((s2 - min(s2) OVER w) / CASE WHEN max(s2) OVER w - min(s2) OVER w = 0 THEN 1.0 ELSE max(s2) OVER w - min(s2) OVER w END, 6) AS n2
FROM {scores} WINDOW w AS (PARTITION BY qid)
""")
# Seen candidates outside the source's past map to 0.001 .. 1 among themselves, others to 0.
define("masked_minmax", """
SELECT qid, pos, round(CASE WHEN ok IS NULL THEN 0.0 ELSE 0.001 + 0.999 * (ok - lo) / greatest(hi - lo, 1e-12) END, 6) AS score FROM (
  SELECT qid, pos, ok, min(ok) OVER (PARTITION BY qid) AS lo, max(ok) OVER (PARTITION BY qid) AS hi FROM (
    SELECT qid, pos, CASE WHEN seen = 1 AND known = 0 THEN s2 END AS ok FROM {scores}) a) b
""")
define("hard_rules", "SELECT qid, pos, CASE WHEN seen = 0 OR known = 1 THEN -1e9 ELSE s2 END AS score FROM {scores}")
define("ranked_scores", """
SELECT qid, pos, cand, label, s1, s2, s3, count(*) OVER (PARTITION BY qid) AS width,
       row_number() OVER (PARTITION BY qid ORDER BY s1 DESC, pos) AS r1, row_number() OVER (PARTITION BY qid ORDER BY s2 DESC, pos) AS r2,
       row_number() OVER (PARTITION BY qid ORDER BY s3 DESC, pos) AS r3
FROM {scores}
""")
define("rank_scores", "SELECT qid, pos, CAST(r1 AS BIGINT) AS rank, round(1.0 - CAST(r1 - 1 AS DOUBLE) / greatest(width - 1, 1), 6) AS score FROM {ranked_scores}")
# A tree of blends, normalised again after each level.
define("blend_first", "SELECT qid, pos, label, 0.65 * a + 0.35 * b AS s, c FROM {normalised}")
define("normalised", """
SELECT qid, pos, label, (s1 - min(s1) OVER w) / greatest(max(s1) OVER w - min(s1) OVER w, 1e-12) AS a,
       (s2 - min(s2) OVER w) / greatest(max(s2) OVER w - min(s2) OVER w, 1e-12) AS b, (s3 - min(s3) OVER w) / greatest(max(s3) OVER w - min(s3) OVER w, 1e-12) AS c
FROM {scores} WINDOW w AS (PARTITION BY qid)
""")
define("blend_second", """
SELECT qid, pos, label, 0.5 * (s - min(s) OVER w) / greatest(max(s) OVER w - min(s) OVER w, 1e-12) + 0.5 * c AS s FROM {blend_first} WINDOW w AS (PARTITION BY qid)
""")
define("blend_weighted", """
SELECT qid, pos, round((s - min(s) OVER w) / greatest(max(s) OVER w - min(s) OVER w, 1e-12), 6) AS score FROM {blend_second} WINDOW w AS (PARTITION BY qid)
""")
define("blend_rank", """
SELECT qid, pos, round(0.45 * (1.0 - CAST(r1 - 1 AS DOUBLE) / greatest(width - 1, 1)) + 0.55 * (1.0 - CAST(r2 - 1 AS DOUBLE) / greatest(width - 1, 1)), 6) AS score FROM {ranked_scores}
""")
# Scores of two sources joined by position; a row that one of them lacks stops the query.
define("score_files_joined", """
SELECT CASE WHEN a.qid IS NULL THEN CAST('no left row for query ' || CAST(b.qid AS STRING) AS BIGINT) ELSE a.qid END AS qid, coalesce(a.pos, b.pos) AS pos, a.score AS left_score,
       CASE WHEN b.qid IS NULL THEN CAST('no right row for query ' || CAST(a.qid AS STRING) AS DOUBLE) ELSE b.score END AS right_score
FROM {blend_weighted} a FULL OUTER JOIN {blend_rank} b ON a.qid = b.qid AND a.pos = b.pos
""")
# The last blend: 0.55 and 0.45 of two blends, normalised within the query.
define("blend_final", """
SELECT qid, pos, round((s - min(s) OVER w) / greatest(max(s) OVER w - min(s) OVER w, 1e-12), 6) AS score
FROM (SELECT qid, pos, 0.55 * left_score + 0.45 * right_score AS s FROM {score_files_joined}) b WINDOW w AS (PARTITION BY qid)
""")
define("score_validation", """
SELECT count(DISTINCT qid) AS n_queries, count(*) AS n_scores, min(score) AS lowest, max(score) AS highest,
       CAST(sum(CASE WHEN score IS NULL OR isnan(score) OR score < 0 OR score > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_invalid FROM {blend_weighted}
""")
define("positive_ranks", "SELECT qid, cand, width, min(r1) AS r1, min(r2) AS r2, min(r3) AS r3 FROM {ranked_scores} WHERE label = 1 GROUP BY qid, cand, width")
METRICS = """count(*) AS n_queries, round(avg(1e0 / r1), 6) AS mrr, round(avg(CASE WHEN r1 <= 10 THEN 1e0 / log2(CAST(r1 + 1 AS DOUBLE)) ELSE 0e0 END), 6) AS ndcg_10,
       round(avg(CAST(r1 AS DOUBLE)), 6) AS mean_rank, round(avg(CASE WHEN r1 <= 1 THEN 1e0 ELSE 0e0 END), 6) AS hits_1, round(avg(CASE WHEN r1 <= 5 THEN 1e0 ELSE 0e0 END), 6) AS recall_5,
       round(avg(CASE WHEN r1 <= 10 THEN 1e0 ELSE 0e0 END), 6) AS recall_10, round(avg(CASE WHEN r1 <= 20 THEN 1e0 ELSE 0e0 END), 6) AS recall_20, round(avg(CASE WHEN r1 <= 30 THEN 1e0 ELSE 0e0 END), 6) AS recall_30"""
define("ranking_metrics", f"SELECT {METRICS} FROM {{positive_ranks}}")
define("metrics_by_bin", f"""
SELECT bin, {METRICS} FROM (
  SELECT p.r1, CASE WHEN coalesce(d.degree, 0) < 10 THEN 'low' WHEN d.degree < 25 THEN 'middle' ELSE 'high' END AS bin
  FROM {{positive_ranks}} p LEFT JOIN {{dst_counts}} d ON d.dst = p.cand) b GROUP BY bin
""")
define("model_comparison", """
SELECT count(*) AS n_queries, round(avg(top1), 6) AS top1_agreement, round(avg(overlap), 6) AS top_overlap, round(avg(c), 6) AS mean_correlation FROM (
  SELECT qid, max(CASE WHEN r1 = 1 AND r2 = 1 THEN 1e0 ELSE 0e0 END) AS top1, sum(CASE WHEN r1 <= 20 AND r2 <= 20 THEN 1e0 ELSE 0e0 END) / least(20, max(width)) AS overlap,
         CASE WHEN stddev_pop(s1) > 0 AND stddev_pop(s2) > 0 THEN corr(s1, s2) END AS c
  FROM {ranked_scores} GROUP BY qid) m
""")
# Transparent baselines: reciprocal ranks of each query's first positive by single features, ties to the smaller position.
BASELINES = {"pair_count": "pair_count", "dst_degree": "dst_degree_log", "transition": "recent_item_transition_norm", "bipartite_cf": "bipartite_cf_support", "candidate_frequency": "candidate_frequency_log"}
define("baseline_ranks", "SELECT qid, pos, label, " + ", ".join(f"row_number() OVER (PARTITION BY qid ORDER BY {c} DESC, pos) AS r_{n}" for n, c in BASELINES.items()) + " FROM {temporal_features_30}")
define("baseline_firsts", """
SELECT b.* FROM {baseline_ranks} b JOIN (SELECT qid, min(pos) AS pos FROM {temporal_features_30} WHERE label = 1 GROUP BY qid) f ON f.qid = b.qid AND f.pos = b.pos
""")
define("baseline_mrr", "\nUNION ALL ".join(f"SELECT '{n}' AS feature, round(avg(1e0 / r_{n}), 6) AS mrr FROM {{baseline_firsts}}" for n in BASELINES))
# Spark finds each query's first positive in the pass that ranks, and keeps these rows for the five means.
define_stored("baseline_kept", "SELECT qid, pos, label, " + ", ".join(f"r_{n}" for n in BASELINES) + """ FROM (
  SELECT *, min(CASE WHEN label = 1 THEN pos END) OVER (PARTITION BY qid) AS first_pos FROM {baseline_ranks}) b WHERE pos = first_pos""")
define_spark("baseline_mrr", CATALOG["baseline_mrr"].sql.replace("{baseline_firsts}", "{baseline_kept}"))
# The whole path in one: history of a pair, popularity, normalised score, rank.
define("pair_history", """
SELECT qid, pos, src, cand, label, pair_count, pair_recency_log, popularity, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS BIGINT) AS rank FROM (
  SELECT qid, pos, src, cand, label, pair_count, pair_recency_log, popularity, round((raw - min(raw) OVER w) / greatest(max(raw) OVER w - min(raw) OVER w, 1e-12), 6) AS score FROM (
    SELECT q.qid, q.pos, q.src, q.cand, q.label, coalesce(p.n, 0) AS pair_count,
           round(ln(1 + coalesce(CAST(q.time - p.last_time AS DOUBLE), (SELECT span FROM {scales}))), 6) AS pair_recency_log,
           round(ln(1 + coalesce(d.unique_src, 0)), 6) AS popularity, coalesce(p.n, 0) + 0.3 * ln(1 + coalesce(d.unique_src, 0)) AS raw
    FROM {queries} q LEFT JOIN {pair_counts} p ON p.src = q.src AND p.dst = q.cand LEFT JOIN {dst_counts} d ON d.dst = q.cand) a
  WINDOW w AS (PARTITION BY qid)) b
""")
# Area under the ROC curve by mid-ranks, and average precision, over all candidates.
define("score_levels", "SELECT s1, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos FROM {scores} GROUP BY s1")
define("score_curve", """
SELECT s1, n, n_pos, CAST(sum(n) OVER (ORDER BY s1 DESC) AS BIGINT) AS above, CAST(sum(n_pos) OVER (ORDER BY s1 DESC) AS BIGINT) AS pos_above,
       CAST(sum(n) OVER () AS BIGINT) AS total, CAST(sum(n_pos) OVER () AS BIGINT) AS positives FROM {score_levels}
""")
define("ap_and_auc", """
SELECT round(sum(CAST(n_pos AS DOUBLE) / positives * pos_above / above), 6) AS average_precision,
       round(sum(CAST(n_pos AS DOUBLE) * ((total - above) - (positives - pos_above) + 0.5 * (n - n_pos))) / max(CAST(positives AS DOUBLE) * (total - positives)), 6) AS roc_auc
FROM {score_curve}
""")
