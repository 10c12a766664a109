"""Query-time feature operators: everything a candidate's history says strictly before the query.

Events join on their key with time < query time; aggregates are kept per
(source, time) or (candidate, time) context, so candidates that share one share
the work, and are joined to candidates last.

What Spark runs on the side of the candidates is written differently at the end:
a destination may have very many events, and their number times that of its
contexts is out of reach.
"""

from __future__ import annotations

import re

import chronolink.operators.history  # noqa: F401
from chronolink.plans.relational import CATALOG, SPARK, define, define_spark, define_stored

define("src_contexts", "SELECT DISTINCT qid, src, time FROM {queries}")
define("dst_contexts", "SELECT DISTINCT cand, time FROM {queries}")
# Events of each context, most recent first.
define("src_past", """
SELECT q.qid, q.src, q.time AS q_time, e.dst, e.time, row_number() OVER (PARTITION BY q.qid ORDER BY e.time DESC, e.dst DESC) AS rn
FROM {src_contexts} q JOIN {history} e ON e.src = q.src AND e.time < q.time
""")
define("dst_past", """
SELECT q.cand, q.time AS q_time, e.src, e.time, row_number() OVER (PARTITION BY q.cand, q.time ORDER BY e.time DESC, e.src DESC) AS rn
FROM {dst_contexts} q JOIN {history} e ON e.dst = q.cand AND e.time < q.time
""")
define("pair_past", """
SELECT q.qid, q.cand, q.time AS q_time, e.time,
       row_number() OVER (PARTITION BY q.qid, q.cand ORDER BY e.time DESC) AS rn,
       row_number() OVER (PARTITION BY q.qid, q.cand ORDER BY e.time) AS rn_up,
       CAST(e.time - lag(e.time) OVER (PARTITION BY q.qid, q.cand ORDER BY e.time) AS DOUBLE) AS gap
FROM {queries} q JOIN {history} e ON e.src = q.src AND e.dst = q.cand AND e.time < q.time
""")

# --- per context ---
define("pair_context", """
SELECT qid, cand, count(*) AS n, max(time) AS last_time,
       sum(CASE WHEN rn <= 100 THEN exp(-(q_time - time) / (SELECT tau_f FROM {scales})) ELSE 0 END) AS hawkes_f,
       sum(CASE WHEN rn <= 100 THEN exp(-(q_time - time) / (SELECT tau_m FROM {scales})) ELSE 0 END) AS hawkes_m,
       sum(CASE WHEN rn <= 100 THEN exp(-(q_time - time) / (SELECT tau_s FROM {scales})) ELSE 0 END) AS hawkes_s,
       median(CASE WHEN rn <= 7 THEN gap END) AS gap_median
FROM {pair_past} GROUP BY qid, cand
""")
define("src_context", "SELECT qid, count(*) AS degree, count(DISTINCT dst) AS unique_dst, min(time) AS first_time, max(time) AS last_time FROM {src_past} GROUP BY qid")
define("dst_context", """
SELECT cand, q_time, count(*) AS degree, count(DISTINCT src) AS unique_src, min(time) AS first_time, max(time) AS last_time,
       count(CASE WHEN time >= q_time - (SELECT short_w FROM {scales}) THEN 1 END) AS recent_short,
       count(CASE WHEN time >= q_time - (SELECT long_w FROM {scales}) THEN 1 END) AS recent_long,
       sum(CASE WHEN rn <= 100 THEN exp(-(q_time - time) / (SELECT tau_f FROM {scales})) ELSE 0 END) AS hawkes_f,
       sum(CASE WHEN rn <= 100 THEN exp(-(q_time - time) / (SELECT tau_m FROM {scales})) ELSE 0 END) AS hawkes_m,
       sum(CASE WHEN rn <= 100 THEN exp(-(q_time - time) / (SELECT tau_s FROM {scales})) ELSE 0 END) AS hawkes_s
FROM {dst_past} GROUP BY cand, q_time
""")

# --- transitions: counts span the whole history, the recent items are the query's past ---
define("recent_mass", """
SELECT p.qid, CAST(sum(m.mass) AS BIGINT) AS mass FROM {src_past} p JOIN {transition_mass} m ON m.left_item = p.dst WHERE p.rn <= 20 GROUP BY p.qid
""")
define("transition_context", """
SELECT q.qid, q.cand, CAST(sum(CASE WHEN p.rn = 1 THEN t.n ELSE 0 END) AS BIGINT) AS last_n, CAST(sum(t.n) AS BIGINT) AS recent_n
FROM {queries} q JOIN {src_past} p ON p.qid = q.qid AND p.rn <= 20 JOIN {transitions} t ON t.left_item = p.dst AND t.right_item = q.cand
GROUP BY q.qid, q.cand
""")

# --- two-hop collaborative support ---
# Users of an item: 50 most recent distinct sources. What an item lends a candidate does not depend
# on the asking source but for its own share, so it is summed per item once and that share taken off.
define("item_users", """
SELECT i.dst AS item, i.src AS usr, 1.0 / (sqrt(CAST(greatest(d.unique_src, 1) AS DOUBLE)) * sqrt(CAST(greatest(s.degree, 1) AS DOUBLE))) AS w
FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY max(time) DESC, src DESC) AS rn FROM {history} GROUP BY dst, src) i
JOIN {dst_counts} d ON d.dst = i.dst JOIN {src_counts} s ON s.src = i.src
WHERE i.rn <= 50
""")
define("user_recent", """
SELECT src AS usr, dst AS cand, count(*) AS n FROM (
  SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY time DESC, dst DESC) AS rn FROM {history}) r
WHERE rn <= 20 GROUP BY src, dst
""")
define("user_recent_size", "SELECT usr, CAST(sum(n) AS BIGINT) AS n FROM {user_recent} GROUP BY usr")
define("item_support", "SELECT i.item, r.cand, sum(i.w * r.n) AS support FROM {item_users} i JOIN {user_recent} r ON r.usr = i.usr GROUP BY i.item, r.cand")
define("item_mass", "SELECT i.item, sum(i.w * r.n) AS mass FROM {item_users} i JOIN {user_recent_size} r ON r.usr = i.usr GROUP BY i.item")
define("recent_items", "SELECT qid, src, dst AS item, count(*) AS times FROM {src_past} WHERE rn <= 10 GROUP BY qid, src, dst")
define("own_mass", """
SELECT r.qid, sum(r.times * m.mass) - sum(r.times * coalesce(i.w * z.n, 0)) AS mass
FROM {recent_items} r JOIN {item_mass} m ON m.item = r.item
LEFT JOIN {item_users} i ON i.item = r.item AND i.usr = r.src LEFT JOIN {user_recent_size} z ON z.usr = r.src
GROUP BY r.qid
""")
define("collaborative_context", """
SELECT q.qid, q.cand, sum(r.times * s.support) - sum(r.times * coalesce(i.w * u.n, 0)) AS support
FROM {queries} q JOIN {recent_items} r ON r.qid = q.qid
JOIN {item_support} s ON s.item = r.item AND s.cand = q.cand
LEFT JOIN {item_users} i ON i.item = r.item AND i.usr = r.src
LEFT JOIN {user_recent} u ON u.usr = r.src AND u.cand = q.cand
GROUP BY q.qid, q.cand
""")
define("bipartite_cf", """
SELECT q.qid, q.pos, q.cand,
       round(CASE WHEN c.support > 1e-9 THEN c.support ELSE 0 END, 6) AS cf_support,
       round(CASE WHEN m.mass > 1e-9 THEN m.mass ELSE 0 END, 6) AS cf_mass
FROM {queries} q LEFT JOIN {collaborative_context} c ON c.qid = q.qid AND c.cand = q.cand LEFT JOIN {own_mass} m ON m.qid = q.qid
""")

# --- single features as queries of their own ---
define("asof_recency", """
SELECT q.qid, q.pos, q.cand, CAST(p.last_time AS DOUBLE) AS pair_last, CAST(s.last_time AS DOUBLE) AS src_last, CAST(d.last_time AS DOUBLE) AS dst_last
FROM {queries} q LEFT JOIN {pair_context} p ON p.qid = q.qid AND p.cand = q.cand
LEFT JOIN {src_context} s ON s.qid = q.qid LEFT JOIN {dst_context} d ON d.cand = q.cand AND d.q_time = q.time
""")
define("windowed_popularity", """
SELECT cand, CAST(q_time AS DOUBLE) AS q_time, recent_short, recent_long, round(CAST(recent_short AS DOUBLE) / greatest(recent_long, 1), 6) AS recent_ratio FROM {dst_context}
""")
define("hawkes_intensity", "SELECT cand, CAST(q_time AS DOUBLE) AS q_time, round(hawkes_f, 6) AS fast, round(hawkes_m, 6) AS medium, round(hawkes_s, 6) AS slow FROM {dst_context}")
define("pair_due", "SELECT qid, cand, n AS pair_count, round(gap_median, 6) AS gap_median FROM {pair_context}")
define("transition_support", """
SELECT q.qid, q.pos, q.cand, coalesce(t.last_n, 0) AS last_n, coalesce(t.recent_n, 0) AS recent_n, coalesce(m.mass, 0) AS mass
FROM {queries} q LEFT JOIN {transition_context} t ON t.qid = q.qid AND t.cand = q.cand LEFT JOIN {recent_mass} m ON m.qid = q.qid
""")

define("temporal_raw", """
SELECT q.qid, q.pos, q.src, q.time, q.cand, q.label,
  coalesce(p.n, 0) AS pair_count,
  CASE WHEN p.last_time IS NULL THEN (SELECT span FROM {scales}) ELSE greatest(CAST(q.time - p.last_time AS DOUBLE), 0.0) END AS pair_age,
  coalesce(p.hawkes_f, 0.0) AS pair_hf, coalesce(p.hawkes_m, 0.0) AS pair_hm, coalesce(p.hawkes_s, 0.0) AS pair_hs, p.gap_median,
  coalesce(s.degree, 0) AS src_degree, coalesce(s.unique_dst, 0) AS src_unique,
  coalesce(d.degree, 0) AS dst_degree, coalesce(u.unique_src, 0) AS dst_unique,
  CASE WHEN d.last_time IS NULL THEN (SELECT span FROM {scales}) ELSE greatest(CAST(q.time - d.last_time AS DOUBLE), 0.0) END AS dst_age,
  coalesce(d.recent_short, 0) AS rs, coalesce(d.recent_long, 0) AS rl,
  coalesce(d.hawkes_f, 0.0) AS dst_hf, coalesce(d.hawkes_m, 0.0) AS dst_hm, coalesce(d.hawkes_s, 0.0) AS dst_hs,
  CASE WHEN u.dst IS NULL THEN 0 ELSE 1 END AS seen,
  coalesce(t.last_n, 0) AS last_n, coalesce(t.recent_n, 0) AS recent_n, coalesce(m.mass, 0) AS mass,
  CASE WHEN c.support > 1e-9 THEN c.support ELSE 0.0 END AS cf, CASE WHEN o.mass > 1e-9 THEN o.mass ELSE 0.0 END AS cf_mass,
  coalesce(f.frequency, 0) AS freq, (SELECT span FROM {scales}) AS span
FROM {queries} q
LEFT JOIN {pair_context} p ON p.qid = q.qid AND p.cand = q.cand
LEFT JOIN {src_context} s ON s.qid = q.qid
LEFT JOIN {dst_context} d ON d.cand = q.cand AND d.q_time = q.time
LEFT JOIN {dst_counts} u ON u.dst = q.cand
LEFT JOIN {transition_context} t ON t.qid = q.qid AND t.cand = q.cand
LEFT JOIN {recent_mass} m ON m.qid = q.qid
LEFT JOIN {collaborative_context} c ON c.qid = q.qid AND c.cand = q.cand
LEFT JOIN {own_mass} o ON o.qid = q.qid
LEFT JOIN {candidate_frequency} f ON f.cand = q.cand
""")
define("temporal_features_30", """
SELECT qid, pos, cand, label, pair_count,
  round(ln(1 + pair_count), 6) AS pair_count_log, round(ln(1 + pair_age), 6) AS pair_recency_log,
  round(pair_hf, 6) AS pair_hawkes_fast, round(pair_hm, 6) AS pair_hawkes_medium, round(pair_hs, 6) AS pair_hawkes_slow,
  round(CASE WHEN gap_median IS NULL THEN 0.0 ELSE ln(1 + pair_age / greatest(gap_median, 1.0)) END, 6) AS pair_due_ratio_log,
  round(CASE WHEN gap_median IS NULL THEN ln(1 + span) ELSE ln(1 + abs(pair_age - gap_median)) END, 6) AS pair_due_error_log,
  round(ln(1 + src_degree), 6) AS src_degree_log, round(ln(1 + src_unique), 6) AS src_unique_log,
  round(ln(1 + dst_degree), 6) AS dst_degree_log, round(ln(1 + dst_unique), 6) AS dst_unique_src_log,
  round(ln(1 + dst_age), 6) AS dst_recency_log, rs AS dst_recent_short, rl AS dst_recent_long,
  round(CAST(rs AS DOUBLE) / greatest(rl, 1), 6) AS dst_recent_ratio,
  round(dst_hf, 6) AS dst_hawkes_fast, round(dst_hm, 6) AS dst_hawkes_medium, round(dst_hs, 6) AS dst_hawkes_slow,
  round(dst_hf / greatest(dst_hm, 1e-12), 6) AS dst_intensity_acceleration,
  seen AS is_seen_dst, CASE WHEN pair_count > 0 THEN 1 ELSE 0 END AS is_src_history,
  round(CAST(pair_count AS DOUBLE) / greatest(src_degree, 1), 6) AS src_history_share,
  round(ln(1 + last_n), 6) AS last_item_transition, round(ln(1 + recent_n), 6) AS recent_item_transition,
  round(CAST(recent_n AS DOUBLE) / greatest(mass, 1), 6) AS recent_item_transition_norm,
  round(cf, 6) AS bipartite_cf_support, round(ln(1 + cf), 6) AS bipartite_cf_support_log, round(cf / greatest(cf_mass, 1e-12), 6) AS bipartite_cf_norm,
  round(ln(1 + freq), 6) AS candidate_frequency_log
FROM {temporal_raw}
""")

# --- tree features ---
define("pair_tree", """
SELECT qid, cand, max(q_time) AS q_time, count(*) AS n, max(time) AS last_time, min(time) AS first_time, avg(gap) AS mean_gap,
       CASE WHEN count(gap) > 1 THEN stddev_pop(gap) ELSE 0.0 END AS std_gap,
       sum(exp(-(q_time - time) / (0.02 * (SELECT hi FROM {scales}) + 1))) AS decay_short,
       sum(exp(-(q_time - time) / (0.2 * (SELECT hi FROM {scales}) + 1))) AS decay_long
FROM {pair_past} GROUP BY qid, cand
""")
define("pair_trend", """
SELECT p.qid, p.cand,
       (CAST(t.n - floor(t.n / 2) AS DOUBLE) / (t.q_time - p.time + 1)) / (CAST(floor(t.n / 2) AS DOUBLE) / (p.time - t.first_time + 1) + 1e-9) AS trend
FROM {pair_past} p JOIN {pair_tree} t ON t.qid = p.qid AND t.cand = p.cand
WHERE t.n >= 4 AND p.rn_up = floor(t.n / 2) + 1
""")
define("freq_trend", "SELECT qid, cand, round(trend, 6) AS trend FROM {pair_trend}")
define("past_pair_counts", "SELECT qid, dst, count(*) AS n, min(rn) AS latest, count(CASE WHEN rn <= 10 THEN 1 END) AS in_last10 FROM {src_past} GROUP BY qid, dst")
define("past_ranked", """
SELECT p.qid, p.dst, p.n, p.latest, p.in_last10, cume_dist() OVER (PARTITION BY p.qid ORDER BY p.n) AS pctile, s.degree
FROM {past_pair_counts} p JOIN {src_context} s ON s.qid = p.qid
""")
define("pair_count_pctile", "SELECT qid, dst AS cand, n, round(pctile, 6) AS pctile FROM {past_ranked}")
define("src_entropy", "SELECT qid, -sum(CAST(n AS DOUBLE) / degree * log2(CAST(n AS DOUBLE) / degree + 1e-12)) AS entropy FROM {past_ranked} GROUP BY qid")
define("node_degree", """
SELECT node, CAST(sum(n) AS BIGINT) AS degree FROM (
  SELECT src AS node, degree AS n FROM {src_counts} UNION ALL SELECT dst AS node, degree AS n FROM {dst_counts}) d GROUP BY node
""")
# Recent neighbours on both sides; sources and destinations share one space of ids here.
define("src_near", "SELECT qid, dst AS node FROM {past_pair_counts} WHERE latest <= 50")
define("dst_near", "SELECT cand, q_time, src AS node, min(rn) AS latest FROM {dst_past} WHERE rn <= 50 GROUP BY cand, q_time, src")
define("src_near_size", "SELECT qid, count(*) AS n FROM {src_near} GROUP BY qid")
define("dst_near_size", "SELECT cand, q_time, count(*) AS n, count(CASE WHEN latest <= 20 THEN 1 END) AS n20 FROM {dst_near} GROUP BY cand, q_time")
define("near_context", """
SELECT q.qid, q.cand, count(*) AS common, count(CASE WHEN d.latest <= 20 THEN 1 END) AS common20,
       sum(CASE WHEN g.degree > 1 THEN 1.0 / (ln(CAST(g.degree AS DOUBLE)) + 1e-9) ELSE 0.0 END) AS adamic,
       sum(CASE WHEN g.degree > 1 THEN 1.0 / (g.degree + 1e-9) ELSE 0.0 END) AS allocation
FROM {queries} q JOIN {dst_near} d ON d.cand = q.cand AND d.q_time = q.time
JOIN {src_near} s ON s.qid = q.qid AND s.node = d.node JOIN {node_degree} g ON g.node = d.node
GROUP BY q.qid, q.cand
""")
define("common_neighbors", """
SELECT q.qid, q.pos, q.cand, coalesce(n.common, 0) AS common,
       round(CAST(coalesce(n.common, 0) AS DOUBLE) / greatest(coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(n.common, 0), 1), 6) AS jaccard,
       round(coalesce(n.adamic, 0.0), 6) AS adamic_adar, round(coalesce(n.allocation, 0.0), 6) AS resource_allocation
FROM {queries} q LEFT JOIN {near_context} n ON n.qid = q.qid AND n.cand = q.cand
LEFT JOIN {src_near_size} a ON a.qid = q.qid LEFT JOIN {dst_near_size} b ON b.cand = q.cand AND b.q_time = q.time
""")
define("tree_raw", """
SELECT q.qid, q.pos, q.src, q.cand, q.label, CAST(q.time AS DOUBLE) AS q, (SELECT hi FROM {scales}) AS hi,
  coalesce(p.n, 0) AS pn, CAST(p.last_time AS DOUBLE) AS p_last, coalesce(p.decay_short, 0.0) AS ds, coalesce(p.decay_long, 0.0) AS dl,
  coalesce(p.mean_gap, 0.0) AS mean_gap, coalesce(p.std_gap, 0.0) AS std_gap, coalesce(r.trend, 1.0) AS trend,
  coalesce(s.degree, 0) AS sn, coalesce(s.unique_dst, 0) AS su, CAST(s.first_time AS DOUBLE) AS s_first, CAST(s.last_time AS DOUBLE) AS s_last,
  coalesce(e.entropy, 0.0) AS entropy,
  coalesce(d.degree, 0) AS dn, coalesce(d.unique_src, 0) AS du, CAST(d.first_time AS DOUBLE) AS d_first, CAST(d.last_time AS DOUBLE) AS d_last,
  coalesce(u.unique_src, 0) AS pop, coalesce(n.common, 0) AS common, coalesce(n.common20, 0) AS common20,
  coalesce(n.adamic, 0.0) AS adamic, coalesce(n.allocation, 0.0) AS allocation,
  coalesce(a.n, 0) AS near_s, coalesce(b.n, 0) AS near_d, coalesce(b.n20, 0) AS near_d20,
  coalesce(k.in_last10, 0) AS in10, coalesce(k.pctile, 0.0) AS pctile
FROM {queries} q
LEFT JOIN {pair_tree} p ON p.qid = q.qid AND p.cand = q.cand
LEFT JOIN {pair_trend} r ON r.qid = q.qid AND r.cand = q.cand
LEFT JOIN {src_context} s ON s.qid = q.qid
LEFT JOIN {src_entropy} e ON e.qid = q.qid
LEFT JOIN {dst_context} d ON d.cand = q.cand AND d.q_time = q.time
LEFT JOIN {dst_counts} u ON u.dst = q.cand
LEFT JOIN {near_context} n ON n.qid = q.qid AND n.cand = q.cand
LEFT JOIN {src_near_size} a ON a.qid = q.qid
LEFT JOIN {dst_near_size} b ON b.cand = q.cand AND b.q_time = q.time
LEFT JOIN {past_ranked} k ON k.qid = q.qid AND k.dst = q.cand
""")
TREE_COLUMNS = """
  pn AS pair_count, round(ln(1 + pn), 6) AS pair_count_log,
  round(coalesce(q - p_last, hi), 6) AS pair_recency, round(ln(1 + coalesce(q - p_last, hi)), 6) AS pair_recency_log,
  round(ds, 6) AS pair_decay_short, round(dl, 6) AS pair_decay_long,
  round(mean_gap, 6) AS pair_avg_interval, round(std_gap, 6) AS pair_std_interval, round(trend, 6) AS pair_freq_trend,
  sn AS src_degree, round(ln(1 + sn), 6) AS src_degree_log, su AS src_unique_dst, round(ln(1 + su), 6) AS src_unique_dst_log,
  round(coalesce(sn / (q - s_first + 1), 0.0), 6) AS src_activity_rate, round(coalesce(q - s_last, hi), 6) AS src_last_active, round(entropy, 6) AS src_entropy,
  dn AS dst_degree, round(ln(1 + dn), 6) AS dst_degree_log, du AS dst_unique_src, round(ln(1 + du), 6) AS dst_unique_src_log,
  round(ln(1 + pop), 6) AS dst_popularity, round(coalesce(dn / (q - d_first + 1), 0.0), 6) AS dst_activity_rate, round(coalesce(q - d_last, hi), 6) AS dst_last_active,
  common AS common_neighbors, round(ln(1 + common), 6) AS common_neighbors_log,
  round(CAST(common AS DOUBLE) / greatest(near_s + near_d - common, 1), 6) AS jaccard, round(ln(1 + sn) * ln(1 + dn), 6) AS pref_attach,
  round(adamic, 6) AS adamic_adar, round(allocation, 6) AS resource_allocation, common20 AS src_in_dst_neighbors,
  CASE WHEN in10 > 0 THEN 1 ELSE 0 END AS dst_in_recent_src, in10 AS dst_freq_in_recent_src,
  round(pctile, 6) AS pair_count_pctile, round(coalesce((q - p_last) / (q - s_last + 1), 1.0), 6) AS pair_recency_vs_src, near_d20 AS dst_recent_unique_src
"""
define("tree_features_35", f"SELECT qid, pos, cand, label, {TREE_COLUMNS} FROM {{tree_raw}}")

# --- statistical score; queries later than all history ---
define("stat_recent", """
SELECT src, dst, rn FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY time DESC, dst DESC) AS rn FROM {history}) r WHERE rn <= 50
""")
define("stat_items", "SELECT src, dst, count(*) AS times FROM {stat_recent} WHERE rn <= 20 GROUP BY src, dst")
define("stat_lent", "SELECT p.dst AS item, u.cand, CAST(sum(u.n) AS BIGINT) AS n FROM {pair_counts} p JOIN {user_recent} u ON u.usr = p.src GROUP BY p.dst, u.cand")
define("stat_asked", "SELECT DISTINCT src, cand FROM {queries}")
define("stat_cooccurrence", """
SELECT a.src, a.cand, CAST(sum(i.times * (l.n - coalesce(own.n, 0))) AS BIGINT) AS cooc
FROM {stat_asked} a JOIN {stat_items} i ON i.src = a.src JOIN {stat_lent} l ON l.item = i.dst AND l.cand = a.cand
LEFT JOIN {user_recent} own ON own.usr = a.src AND own.cand = a.cand
LEFT JOIN (SELECT DISTINCT src, dst FROM {stat_recent}) r ON r.src = a.src AND r.dst = a.cand
WHERE r.src IS NULL GROUP BY a.src, a.cand
""")
define("stat_common", """
SELECT a.src, a.cand, count(*) AS common FROM {stat_asked} a
JOIN (SELECT DISTINCT src, dst FROM {stat_recent}) r ON r.src = a.src JOIN {pair_counts} p ON p.dst = a.cand AND p.src = r.dst
GROUP BY a.src, a.cand
""")
define("stat_raw", """
SELECT q.qid, q.pos, q.cand, q.label, 0.5 * coalesce(c.cooc, 0)
  + CASE WHEN p.n IS NULL THEN 0.0 ELSE p.n + CASE WHEN q.time - p.last_time < 0.05 * (SELECT hi FROM {scales}) THEN 1.5 ELSE 0.0 END END
  + 0.3 * ln(1 + coalesce(u.unique_src, 0)) + 0.3 * coalesce(m.common, 0) AS raw
FROM {queries} q LEFT JOIN {stat_cooccurrence} c ON c.src = q.src AND c.cand = q.cand
LEFT JOIN {pair_counts} p ON p.src = q.src AND p.dst = q.cand LEFT JOIN {dst_counts} u ON u.dst = q.cand
LEFT JOIN {stat_common} m ON m.src = q.src AND m.cand = q.cand
""")
define("stat_score", """
SELECT qid, pos, cand, label, round(raw, 6) AS raw_score,
       round((raw - lo) / CASE WHEN hi - lo = 0 THEN 1.0 ELSE hi - lo END, 6) AS score
FROM (SELECT *, min(raw) OVER (PARTITION BY qid) AS lo, max(raw) OVER (PARTITION BY qid) AS hi FROM {stat_raw}) s
""")

# --- recent neighbours before the query: 30 of the source, 1 of the candidate; missing places are null ---
define("recent_neighbors", "SELECT qid, src, dst AS neighbor, CAST(time AS DOUBLE) AS time, CAST(rn AS BIGINT) AS place FROM {src_past} WHERE rn <= 30")
define("recent_dst_neighbor", "SELECT cand, CAST(q_time AS DOUBLE) AS q_time, src AS neighbor, CAST(time AS DOUBLE) AS time FROM {dst_past} WHERE rn = 1")

# --- the same 35 features where every query is later than all history: aggregates don't depend on the query ---
# Sums of decays factor into exp(-q / scale) and a sum over events that is kept per pair.
define("static_pairs", """
SELECT src, dst, count(*) AS n, min(time) AS first_time, max(time) AS last_time, avg(gap) AS mean_gap, CASE WHEN count(gap) > 1 THEN stddev_pop(gap) ELSE 0.0 END AS std_gap,
       sum(exp(time / (0.02 * (SELECT hi FROM {scales}) + 1))) AS up_short, sum(exp(time / (0.2 * (SELECT hi FROM {scales}) + 1))) AS up_long
FROM (SELECT src, dst, time, CAST(time - lag(time) OVER (PARTITION BY src, dst ORDER BY time) AS DOUBLE) AS gap FROM {history}) g GROUP BY src, dst
""")
define("static_middles", """
SELECT e.src, e.dst, e.time AS mid_time FROM (SELECT src, dst, time, row_number() OVER (PARTITION BY src, dst ORDER BY time) AS rn FROM {history}) e
JOIN {static_pairs} p ON p.src = e.src AND p.dst = e.dst WHERE p.n >= 4 AND e.rn = floor(p.n / 2) + 1
""")
define("static_ranked", "SELECT src, dst, n, cume_dist() OVER (PARTITION BY src ORDER BY n) AS pctile FROM {static_pairs}")
define("static_entropy", """
SELECT p.src, -sum(CAST(p.n AS DOUBLE) / c.degree * log2(CAST(p.n AS DOUBLE) / c.degree + 1e-12)) AS entropy FROM {static_pairs} p JOIN {src_counts} c ON c.src = p.src GROUP BY p.src
""")
define("static_src_last", """
SELECT src, dst AS node, min(rn) AS latest, count(CASE WHEN rn <= 10 THEN 1 END) AS in_last10 FROM (
  SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY time DESC, dst DESC) AS rn FROM {history}) r WHERE rn <= 50 GROUP BY src, dst
""")
define("static_dst_last", """
SELECT dst, src AS node, min(rn) AS latest FROM (
  SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY time DESC, src DESC) AS rn FROM {history}) r WHERE rn <= 50 GROUP BY dst, src
""")
define("static_src_size", "SELECT src, count(*) AS n FROM {static_src_last} GROUP BY src")
define("static_dst_size", "SELECT dst, count(*) AS n, count(CASE WHEN latest <= 20 THEN 1 END) AS n20 FROM {static_dst_last} GROUP BY dst")
define("static_near", """
SELECT a.src, a.cand, count(*) AS common, count(CASE WHEN d.latest <= 20 THEN 1 END) AS common20,
       sum(CASE WHEN g.degree > 1 THEN 1.0 / (ln(CAST(g.degree AS DOUBLE)) + 1e-9) ELSE 0.0 END) AS adamic, sum(CASE WHEN g.degree > 1 THEN 1.0 / (g.degree + 1e-9) ELSE 0.0 END) AS allocation
FROM {stat_asked} a JOIN {static_dst_last} d ON d.dst = a.cand JOIN {static_src_last} s ON s.src = a.src AND s.node = d.node JOIN {node_degree} g ON g.node = d.node GROUP BY a.src, a.cand
""")
define("static_raw", """
SELECT q.qid, q.pos, q.src, q.cand, q.label, CAST(q.time AS DOUBLE) AS q, (SELECT hi FROM {scales}) AS hi,
  coalesce(p.n, 0) AS pn, CAST(p.last_time AS DOUBLE) AS p_last,
  coalesce(p.up_short * exp(-q.time / (0.02 * (SELECT hi FROM {scales}) + 1)), 0.0) AS ds, coalesce(p.up_long * exp(-q.time / (0.2 * (SELECT hi FROM {scales}) + 1)), 0.0) AS dl,
  coalesce(p.mean_gap, 0.0) AS mean_gap, coalesce(p.std_gap, 0.0) AS std_gap,
  CASE WHEN m.mid_time IS NULL THEN 1.0 ELSE (CAST(p.n - floor(p.n / 2) AS DOUBLE) / (q.time - m.mid_time + 1)) / (CAST(floor(p.n / 2) AS DOUBLE) / (m.mid_time - p.first_time + 1) + 1e-9) END AS trend,
  coalesce(s.degree, 0) AS sn, coalesce(s.unique_dst, 0) AS su, CAST(s.first_time AS DOUBLE) AS s_first, CAST(s.last_time AS DOUBLE) AS s_last, coalesce(e.entropy, 0.0) AS entropy,
  coalesce(d.degree, 0) AS dn, coalesce(d.unique_src, 0) AS du, CAST(d.first_time AS DOUBLE) AS d_first, CAST(d.last_time AS DOUBLE) AS d_last,
  coalesce(d.unique_src, 0) AS pop, coalesce(n.common, 0) AS common, coalesce(n.common20, 0) AS common20, coalesce(n.adamic, 0.0) AS adamic, coalesce(n.allocation, 0.0) AS allocation,
  coalesce(a.n, 0) AS near_s, coalesce(b.n, 0) AS near_d, coalesce(b.n20, 0) AS near_d20, coalesce(l.in_last10, 0) AS in10, coalesce(k.pctile, 0.0) AS pctile
FROM {queries} q LEFT JOIN {static_pairs} p ON p.src = q.src AND p.dst = q.cand LEFT JOIN {static_middles} m ON m.src = q.src AND m.dst = q.cand
LEFT JOIN {src_counts} s ON s.src = q.src LEFT JOIN {static_entropy} e ON e.src = q.src LEFT JOIN {dst_counts} d ON d.dst = q.cand
LEFT JOIN {static_near} n ON n.src = q.src AND n.cand = q.cand LEFT JOIN {static_src_size} a ON a.src = q.src LEFT JOIN {static_dst_size} b ON b.dst = q.cand
LEFT JOIN {static_src_last} l ON l.src = q.src AND l.node = q.cand LEFT JOIN {static_ranked} k ON k.src = q.src AND k.dst = q.cand
""")
define("tree_features_static", f"SELECT qid, pos, cand, label, {TREE_COLUMNS} FROM {{static_raw}}")
define("temporal_precondition", "SELECT CAST((SELECT max(time) FROM {history}) AS DOUBLE) AS last_event, CAST(min(time) AS DOUBLE) AS first_query, CAST(sum(CASE WHEN time <= (SELECT max(time) FROM {history}) THEN 1 ELSE 0 END) AS BIGINT) AS n_early FROM {queries}")
# How often a candidate is offered: overall, its place within the query, its distance to the query's commonest.
define("candidate_distribution", """
SELECT q.qid, q.pos, q.cand, f.frequency, CAST(row_number() OVER (PARTITION BY q.qid ORDER BY f.frequency DESC, q.pos) AS BIGINT) AS place,
       max(f.frequency) OVER (PARTITION BY q.qid) - f.frequency AS gap, round(ln(1 + f.frequency) - ln(1 + coalesce(d.degree, 0)), 6) AS offset_to_history
FROM {queries} q JOIN {candidate_frequency} f ON f.cand = q.cand LEFT JOIN {dst_counts} d ON d.dst = q.cand
""")

# --- how Spark gets there: contexts and events of a destination in one order of time, with running counts ---
# A context stands before the events of its own time, and so do the lower ends of its windows (marks 1 and 2).
define_spark("dst_events", """
SELECT dst, src, time, row_number() OVER (PARTITION BY dst ORDER BY time, src) - 1 AS k,
       CASE WHEN row_number() OVER (PARTITION BY dst, src ORDER BY time) = 1 THEN 1 ELSE 0 END AS newcomer
FROM (SELECT src, dst, time FROM {history} DISTRIBUTE BY dst) h
""")


def define_steps(name: str, marks: dict[int, str]) -> None:
    """Per context: events before it, distinct sources, first and last time, and n_1, n_2: events before the other marks."""
    probes = "\nUNION ALL ".join(f"SELECT cand AS dst, CAST({at} AS DOUBLE) AS at, 0 AS kind, NULL AS time, 0 AS newcomer, time AS q_time, {m} AS mark FROM {{dst_contexts}}" for m, at in marks.items())
    columns = ", ".join(f"max(CASE WHEN mark = {m} THEN {c} END) AS {n}" for m, c, n in [(0, "n", "degree"), (0, "u", "unique_src"), (0, "lo", "first_time"), (0, "hi", "last_time")] + [(m, "n", f"n_{m}") for m in marks if m])
    define_spark(name, f"""
SELECT * FROM (SELECT cand, q_time, {columns} FROM (
  SELECT dst AS cand, q_time, mark, kind, CAST(sum(kind) OVER w AS BIGINT) AS n, CAST(sum(newcomer) OVER w AS BIGINT) AS u, min(time) OVER w AS lo, max(time) OVER w AS hi FROM (
    SELECT dst, CAST(time AS DOUBLE) AS at, 1 AS kind, time, newcomer, NULL AS q_time, NULL AS mark FROM {{dst_events}}
    UNION ALL {probes}) a
  WINDOW w AS (PARTITION BY dst ORDER BY at, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) b
WHERE kind = 0 GROUP BY cand, q_time) c WHERE degree > 0
""")


define_steps("dst_steps", {0: "time"})
define_steps("dst_window_steps", {0: "time", 1: "time - (SELECT short_w FROM {scales})", 2: "time - (SELECT long_w FROM {scales})"})


def define_chunks(name: str, item: str, width: int, events: str = "dst_events") -> None:
    """Events of a destination in chunks of width, each with the one before, so that the last width events of a context lie in one row."""
    define_spark(name, f"""
SELECT dst, chunk, own, lag(own) OVER (PARTITION BY dst ORDER BY chunk) AS prior FROM (
  SELECT dst, CAST(floor(k / {width}) AS BIGINT) AS chunk, sort_array(collect_list({item})) AS own FROM {{{events}}} GROUP BY dst, CAST(floor(k / {width}) AS BIGINT)) c
""")


def last_events(width: int) -> str:
    """The last width events of a context s in the chunk c of its last event, oldest first."""
    here = f"CAST(s.degree - {width} * c.chunk AS INT)"
    return f"CASE WHEN c.prior IS NULL THEN slice(c.own, 1, {here}) ELSE concat(slice(c.prior, {here} + 1, {width} - {here}), slice(c.own, 1, {here})) END"


def of_chunk(width: int) -> str:
    return f"c.dst = s.cand AND c.chunk = CAST(floor((s.degree - 1) / {width}) AS BIGINT)"


define_chunks("dst_time_chunks", "time", 100)
# Sources that are destinations as well are the only ones that can be neighbours of both sides.
define_spark("dst_known_events", "SELECT e.dst, e.src, e.time, e.k, d.dst IS NOT NULL AS known FROM {dst_events} e LEFT JOIN (SELECT DISTINCT dst FROM {history}) d ON d.dst = e.src")
define_chunks("dst_src_chunks", "struct(time, src, known)", 50, "dst_known_events")
define_chunks("dst_last_chunks", "struct(time, src)", 1)
_decays = ", ".join(f"aggregate(past, CAST(0 AS DOUBLE), (a, t) -> a + exp(-(q_time - t) / (SELECT tau_{x} FROM {{scales}}))) AS hawkes_{x}" for x in "fms")
define_spark("dst_context", f"""
SELECT cand, q_time, degree, unique_src, first_time, last_time, degree - n_1 AS recent_short, degree - n_2 AS recent_long, {_decays}
FROM (SELECT s.*, {last_events(100)} AS past FROM {{dst_window_steps}} s JOIN {{dst_time_chunks}} c ON {of_chunk(100)}) p
""")
define_spark("windowed_popularity", """
SELECT cand, CAST(q_time AS DOUBLE) AS q_time, degree - n_1 AS recent_short, degree - n_2 AS recent_long,
       round(CAST(degree - n_1 AS DOUBLE) / greatest(degree - n_2, 1), 6) AS recent_ratio FROM {dst_window_steps}
""")
define_spark("recent_dst_neighbor", f"""
SELECT s.cand, CAST(s.q_time AS DOUBLE) AS q_time, c.own[0].src AS neighbor, CAST(c.own[0].time AS DOUBLE) AS time FROM {{dst_steps}} s JOIN {{dst_last_chunks}} c ON {of_chunk(1)}
""")
define_spark("dst_near_lists", f"SELECT s.cand, s.q_time, reverse({last_events(50)}) AS near FROM {{dst_steps}} s JOIN {{dst_src_chunks}} c ON {of_chunk(50)}")
define_spark("dst_near_size", """
SELECT cand, q_time, CAST(size(array_distinct(transform(near, x -> x.src))) AS BIGINT) AS n, CAST(size(array_distinct(transform(slice(near, 1, 20), x -> x.src))) AS BIGINT) AS n20 FROM {dst_near_lists}
""")
define_spark("dst_near_known", """
SELECT cand, q_time, node, min(rn) AS latest FROM (
  SELECT cand, q_time, inline(filter(transform(near, (x, i) -> struct(x.src AS node, i + 1 AS rn, x.known AS known)), x -> x.known)) FROM {dst_near_lists}) l GROUP BY cand, q_time, node
""")
define_spark("near_context", CATALOG["near_context"].sql.replace("{dst_near}", "{dst_near_known}"))
# Queries and events of a source in one order of time: the last event before a query is a running maximum, not a join of
# each query with all events before it. A query stands before the events of its own time. Times within one second share
# a qid, and with it the latest of what they find.
define_spark("asof_src", """
SELECT qid, pos, cand, q_time, max(pair_at) OVER (PARTITION BY src, qid, cand) AS pair_last, max(src_at) OVER (PARTITION BY src, qid) AS src_last FROM (
  SELECT src, qid, pos, cand, q_time, kind, max(CASE WHEN cand IS NOT NULL THEN time END) OVER (PARTITION BY src, cand ORDER BY at, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pair_at,
         max(time) OVER (PARTITION BY src ORDER BY at, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS src_at FROM (
    SELECT * FROM (
      SELECT src, qid, pos, cand, time AS q_time, time AS at, 0 AS kind, NULL AS time FROM {queries}
      UNION ALL SELECT src, NULL AS qid, NULL AS pos, dst AS cand, NULL AS q_time, time AS at, 1 AS kind, time FROM {history} WHERE src IS NOT NULL AND time IS NOT NULL) u DISTRIBUTE BY src) a) b
WHERE kind = 0
""")
define_spark("asof_recency", """
SELECT q.qid, q.pos, q.cand, CAST(q.pair_last AS DOUBLE) AS pair_last, CAST(q.src_last AS DOUBLE) AS src_last, CAST(d.last_time AS DOUBLE) AS dst_last
FROM {asof_src} q LEFT JOIN {dst_steps} d ON d.cand = q.cand AND d.q_time = q.q_time
""")
define_spark("tree_raw", CATALOG["tree_raw"].sql.replace("{dst_context}", "{dst_steps}"))
# Windows that also name the join's keys take its rows where they lie; what is kept of them is small before it moves.
define_spark("src_past", """
SELECT q.qid, q.src, q.time AS q_time, e.dst, e.time, row_number() OVER (PARTITION BY q.src, q.qid ORDER BY e.time DESC, e.dst DESC) AS rn
FROM {src_contexts} q JOIN {history} e ON e.src = q.src AND e.time < q.time
""")
define_spark("pair_past", """
SELECT q.qid, q.cand, q.time AS q_time, e.time,
       row_number() OVER (PARTITION BY q.src, q.cand, q.qid ORDER BY e.time DESC) AS rn,
       row_number() OVER (PARTITION BY q.src, q.cand, q.qid ORDER BY e.time) AS rn_up,
       CAST(e.time - lag(e.time) OVER (PARTITION BY q.src, q.cand, q.qid ORDER BY e.time) AS DOUBLE) AS gap,
       count(*) OVER (PARTITION BY q.src, q.cand, q.qid) AS past_n, min(e.time) OVER (PARTITION BY q.src, q.cand, q.qid) AS past_first,
       max(q.time) OVER (PARTITION BY q.src, q.cand, q.qid) AS past_q
FROM {queries} q JOIN {history} e ON e.src = q.src AND e.dst = q.cand AND e.time < q.time
""")
define_spark("pair_trend", """
SELECT qid, cand, (CAST(past_n - floor(past_n / 2) AS DOUBLE) / (past_q - time + 1)) / (CAST(floor(past_n / 2) AS DOUBLE) / (time - past_first + 1) + 1e-9) AS trend
FROM {pair_past} WHERE past_n >= 4 AND rn_up = floor(past_n / 2) + 1
""")
define_spark("past_pair_counts", """
SELECT qid, dst, count(*) AS n, min(rn) AS latest, count(CASE WHEN rn <= 10 THEN 1 END) AS in_last10, min(time) AS first_time, max(time) AS last_time FROM {src_past} GROUP BY qid, dst
""")
define_spark("src_context", """
SELECT qid, CAST(sum(n) AS BIGINT) AS degree, count(*) AS unique_dst, min(first_time) AS first_time, max(last_time) AS last_time FROM {past_pair_counts} GROUP BY qid
""")
# Recent items are counted before candidates join them, so that repeated ones join once.
define_spark("recent_counts", "SELECT qid, dst, count(*) AS times, min(rn) AS latest FROM {src_past} WHERE rn <= 20 GROUP BY qid, dst")
define_spark("recent_mass", "SELECT p.qid, CAST(sum(m.mass * p.times) AS BIGINT) AS mass FROM {recent_counts} p JOIN {transition_mass} m ON m.left_item = p.dst GROUP BY p.qid")
define_spark("transition_context", """
SELECT q.qid, q.cand, CAST(sum(CASE WHEN p.latest = 1 THEN t.n ELSE 0 END) AS BIGINT) AS last_n, CAST(sum(t.n * p.times) AS BIGINT) AS recent_n
FROM {queries} q JOIN {recent_counts} p ON p.qid = q.qid JOIN {transitions} t ON t.left_item = p.dst AND t.right_item = q.cand
GROUP BY q.qid, q.cand
""")

# --- how Spark gets the 30 temporal features: lists by query and by item instead of rows of candidates that move once per join ---
# An item's recent users and its successors lie in one row, which meets the queries that ask for it with all their
# candidates; what has no link makes no row. Items with more than FOLLOWERS distinct successors go by rows, as stated.
FOLLOWERS = 1000
define_stored("tf_history", "SELECT src, dst, time FROM {history}")
define_stored("tf_queries", "SELECT qid, pos, src, time, cand, label FROM {queries}")


def inlined(name: str, leaves: dict[str, str]) -> str:
    """A relation's statement with those it reads written out in it, down to leaves."""
    return re.sub(r"\{(\w+)\}", lambda m: leaves.get(m[1]) or f"({inlined(m[1], leaves)})", SPARK.get(name) or CATALOG[name].sql)


_whole = {"history": "{tf_history}", "queries": "{tf_queries}", "scales": "{scales}"}
_slice = {
    "history": "(SELECT src, dst, time FROM {tf_history} WHERE $SLICE(dst))",
    "dst_contexts": "(SELECT DISTINCT cand, time FROM {tf_queries} WHERE $SLICE(cand))",
    "scales": "{scales}",
}
define_stored("tf_dst", f"""
SELECT q.qid, q.pos, q.src, q.time, q.cand, q.label, q.freq, u.dst IS NOT NULL AS seen, u.unique_src, d.degree, d.last_time, d.recent_short, d.recent_long, d.hawkes_f, d.hawkes_m, d.hawkes_s
FROM (SELECT *, count(cand) OVER (PARTITION BY cand) AS freq FROM {{tf_queries}} WHERE $SLICE(cand)) q
LEFT JOIN ({inlined("dst_counts", _slice)}) u ON u.dst = q.cand
LEFT JOIN ({inlined("dst_context", _slice)}) d ON d.cand = q.cand AND d.q_time = q.time
""", by="tf_queries", fan=12)
define_stored("tf_pairs", inlined("pair_context", _whole))
define_stored("tf_src", f"""
SELECT qid, src, CAST(sum(n) AS BIGINT) AS degree, count(*) AS unique_dst, collect_list(CASE WHEN latest <= 20 THEN struct(dst AS item, latest, times, times_10) END) AS recent FROM (
  SELECT src, qid, dst, count(*) AS n, min(rn) AS latest, count(CASE WHEN rn <= 20 THEN 1 END) AS times, count(CASE WHEN rn <= 10 THEN 1 END) AS times_10
  FROM ({inlined("src_past", _whole)}) p GROUP BY src, qid, dst) c GROUP BY src, qid
""")
define_stored("tf_asked", """
SELECT s.qid, s.src, s.recent, a.cands FROM {tf_src} s JOIN (SELECT qid, collect_set(cand) AS cands FROM {tf_queries} GROUP BY qid) a ON a.qid = s.qid
""")
define_stored("tf_lists", """
SELECT usr, max(degree) AS degree, CAST(sum(n) AS BIGINT) AS size, collect_list(CASE WHEN cand IS NOT NULL THEN struct(cand, n) END) AS items FROM (
  SELECT src AS usr, dst AS cand, max(degree) AS degree, CAST(count(*) AS INT) AS n FROM (
    SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree, row_number() OVER (PARTITION BY src ORDER BY time DESC, dst DESC) AS rn FROM (SELECT * FROM {tf_history} DISTRIBUTE BY src) h) r
  WHERE rn <= 20 GROUP BY src, dst) c GROUP BY usr
""")
define_stored("tf_top", """
SELECT dst AS item, src AS usr, unique_src FROM (
  SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY last_time DESC, src DESC) AS rn, count(src) OVER (PARTITION BY dst) AS unique_src FROM (
    SELECT dst, src, max(time) AS last_time FROM (SELECT * FROM {tf_history} DISTRIBUTE BY dst) h GROUP BY dst, src) g) i
WHERE rn <= 50
""")
define_stored("tf_follow", f"""
SELECT left_item, right_item, n, CAST(sum(n) OVER (PARTITION BY left_item) AS BIGINT) AS mass, count(*) OVER (PARTITION BY left_item) > {FOLLOWERS} AS wide FROM (
  SELECT prev AS left_item, nxt AS right_item, count(*) AS n FROM (
    SELECT prev, nxt FROM (SELECT dst AS prev, lead(dst) OVER (PARTITION BY src ORDER BY time, dst) AS nxt FROM {{tf_history}}) s WHERE prev IS NOT NULL AND nxt IS NOT NULL DISTRIBUTE BY prev) d
  GROUP BY prev, nxt) t
""")
_others = "filter(users, u -> u.usr <> src)"
_lent = "aggregate(others, CAST(0 AS DOUBLE), (s, u) -> s + u.w * coalesce(get(filter(u.items, e -> e.cand = c), 0).n, 0))"
# A source's own share is left out, not taken off.
define_stored("tf_items", f"""
SELECT qid, times * mass AS mass, times_10 * aggregate(others, CAST(0 AS DOUBLE), (s, u) -> s + u.w * u.size) AS cf_mass,
       transform(filter(next, e -> array_contains(cands, e.right_item)), e -> struct(e.right_item AS cand, CASE WHEN latest = 1 THEN e.n ELSE CAST(0 AS BIGINT) END AS last_n, e.n * times AS recent_n)) AS follows,
       CASE WHEN times_10 > 0 THEN transform(array_intersect(flatten(transform(others, u -> u.items.cand)), cands), c -> struct(c AS cand, times_10 * {_lent} AS support)) END AS lent,
       CASE WHEN wide THEN struct(item, latest, times, cands) END AS rest
FROM (
  SELECT a.*, CASE WHEN a.times_10 > 0 THEN {_others} END AS others, t.mass, t.wide, t.next
  FROM (SELECT qid, src, cands, inline(recent) AS (item, latest, times, times_10) FROM {{tf_asked}}) a
  LEFT JOIN (
    SELECT item, collect_list(struct(usr, w, size, items)) AS users FROM (
      SELECT i.item, l.usr, 1.0 / (sqrt(CAST(greatest(i.unique_src, 1) AS DOUBLE)) * sqrt(CAST(greatest(l.degree, 1) AS DOUBLE))) AS w, l.size, l.items
      FROM (SELECT * FROM {{tf_top}} WHERE $SLICE(item)) i JOIN {{tf_lists}} l ON l.usr = i.usr DISTRIBUTE BY item) u GROUP BY item) c ON c.item = a.item
  LEFT JOIN (
    SELECT left_item, max(mass) AS mass, max(wide) AS wide, collect_list(CASE WHEN NOT wide THEN struct(right_item, n) END) AS next FROM (
      SELECT * FROM {{tf_follow}} WHERE $SLICE(left_item) DISTRIBUTE BY left_item) f GROUP BY left_item) t ON t.left_item = a.item
  WHERE $SLICE(a.item)) j
""", by="tf_top", fan=10, drops=("tf_lists", "tf_top", "tf_asked"))
define_spark("tf_links", """
SELECT qid, CAST(sum(mass) AS BIGINT) AS mass, sum(cf_mass) AS cf_mass, flatten(collect_list(follows)) AS follows, flatten(collect_list(lent)) AS lent FROM (
  SELECT qid, mass, cf_mass, follows, lent FROM {tf_items}
  UNION ALL SELECT r.qid, NULL AS mass, NULL AS cf_mass, collect_list(struct(r.cand, CASE WHEN r.latest = 1 THEN t.n ELSE CAST(0 AS BIGINT) END AS last_n, t.n * r.times AS recent_n)) AS follows, NULL AS lent
  FROM (SELECT qid, rest.item, rest.latest, rest.times, explode(rest.cands) AS cand FROM {tf_items} WHERE rest IS NOT NULL) r
  JOIN (SELECT left_item, right_item, n FROM {tf_follow} WHERE wide) t ON t.left_item = r.item AND t.right_item = r.cand GROUP BY r.qid) l
GROUP BY qid
""")
_of = lambda rows, column, zero: f"aggregate(filter({rows}, e -> e.cand = d.cand), CAST(0 AS {zero}), (s, e) -> s + e.{column})"
_same = "size(filter(asked, e -> e.cand = d.cand))"  # queries of times within one second share a qid, and each repeats what it links
define_spark("temporal_raw", f"""
SELECT qid, d.pos, d.src, d.time, d.cand, d.label, coalesce(p.n, 0) AS pair_count,
  CASE WHEN p.last_time IS NULL THEN (SELECT span FROM {{scales}}) ELSE greatest(CAST(d.time - p.last_time AS DOUBLE), 0.0) END AS pair_age,
  coalesce(p.hawkes_f, 0.0) AS pair_hf, coalesce(p.hawkes_m, 0.0) AS pair_hm, coalesce(p.hawkes_s, 0.0) AS pair_hs, p.gap_median,
  coalesce(src_degree, 0) AS src_degree, coalesce(src_unique, 0) AS src_unique, coalesce(d.degree, 0) AS dst_degree, coalesce(d.unique_src, 0) AS dst_unique,
  CASE WHEN d.last_time IS NULL THEN (SELECT span FROM {{scales}}) ELSE greatest(CAST(d.time - d.last_time AS DOUBLE), 0.0) END AS dst_age,
  coalesce(d.recent_short, 0) AS rs, coalesce(d.recent_long, 0) AS rl, coalesce(d.hawkes_f, 0.0) AS dst_hf, coalesce(d.hawkes_m, 0.0) AS dst_hm, coalesce(d.hawkes_s, 0.0) AS dst_hs,
  CASE WHEN d.seen THEN 1 ELSE 0 END AS seen, coalesce(last_n, 0) AS last_n, coalesce(recent_n, 0) AS recent_n, coalesce(mass, 0) AS mass,
  CASE WHEN support > 1e-9 THEN support ELSE 0.0 END AS cf, CASE WHEN cf_mass > 1e-9 THEN cf_mass ELSE 0.0 END AS cf_mass, d.freq, (SELECT span FROM {{scales}}) AS span
FROM (
  SELECT qid, src_degree, src_unique, mass, cf_mass, inline(transform(asked, d -> struct(d AS d, get(filter(pairs, e -> e.cand = d.cand), 0) AS p,
    {_same} * {_of("follows", "last_n", "BIGINT")} AS last_n, {_same} * {_of("follows", "recent_n", "BIGINT")} AS recent_n, {_same} * {_of("lent", "support", "DOUBLE")} AS support)))
  FROM (
    SELECT q.qid, q.asked, s.degree AS src_degree, s.unique_dst AS src_unique, p.pairs, l.mass, l.cf_mass, l.follows, l.lent
    FROM (SELECT qid, collect_list(struct(pos, src, time, cand, label, freq, seen, unique_src, degree, last_time, recent_short, recent_long, hawkes_f, hawkes_m, hawkes_s)) AS asked FROM {{tf_dst}} GROUP BY qid) q
    LEFT JOIN {{tf_src}} s ON s.qid = q.qid
    LEFT JOIN (SELECT qid, collect_list(struct(cand, n, last_time, hawkes_f, hawkes_m, hawkes_s, gap_median)) AS pairs FROM {{tf_pairs}} GROUP BY qid) p ON p.qid = q.qid
    LEFT JOIN {{tf_links}} l ON l.qid = q.qid) j) x
""")
