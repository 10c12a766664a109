"""History operators: profiles of sources, destinations and pairs, transitions, gaps, dictionaries."""

from __future__ import annotations

from chronolink.plans.relational import define, define_numbered

# Spans and decay scales of the history; times are rebased to begin at 0.
define("bounds", """
SELECT min(time) AS lo, max(time) AS hi, greatest(max(time) - min(time), 1) AS span FROM {history}
""")
define("scales", """
SELECT CAST(hi AS DOUBLE) AS hi, CAST(span AS DOUBLE) AS span,
       greatest(0.005 * CAST(span AS DOUBLE), 1.0) AS short_w,
       greatest(0.05 * CAST(span AS DOUBLE), greatest(0.005 * CAST(span AS DOUBLE), 1.0)) AS long_w,
       greatest(0.002 * CAST(span AS DOUBLE), 1.0) AS tau_f,
       greatest(0.02 * CAST(span AS DOUBLE), greatest(0.002 * CAST(span AS DOUBLE), 1.0)) AS tau_m,
       greatest(0.2 * CAST(span AS DOUBLE), greatest(0.02 * CAST(span AS DOUBLE), greatest(0.002 * CAST(span AS DOUBLE), 1.0))) AS tau_s
FROM {bounds}
""")
define("src_counts", "SELECT src, count(*) AS degree, count(DISTINCT dst) AS unique_dst, min(time) AS first_time, max(time) AS last_time FROM {history} GROUP BY src")
define("dst_counts", "SELECT dst, count(*) AS degree, count(DISTINCT src) AS unique_src, min(time) AS first_time, max(time) AS last_time FROM {history} GROUP BY dst")
define("pair_counts", "SELECT src, dst, count(*) AS n, min(time) AS first_time, max(time) AS last_time FROM {history} GROUP BY src, dst")
define("src_profile", """
SELECT c.src, c.degree, c.unique_dst, CAST(c.first_time AS DOUBLE) AS first_time, CAST(c.last_time AS DOUBLE) AS last_time, round(e.entropy, 6) AS entropy
FROM {src_counts} c JOIN (
  SELECT p.src, -sum(CAST(p.n AS DOUBLE) / c.degree * log2(CAST(p.n AS DOUBLE) / c.degree + 1e-12)) AS entropy
  FROM {pair_counts} p JOIN {src_counts} c ON p.src = c.src GROUP BY p.src) e ON c.src = e.src
""")
define("dst_profile", """
SELECT dst, degree, unique_src, CAST(first_time AS DOUBLE) AS first_time, CAST(last_time AS DOUBLE) AS last_time, round(ln(1 + unique_src), 6) AS popularity FROM {dst_counts}
""")
define("pair_profile", """
SELECT p.src, p.dst, p.n AS pair_count, CAST(p.last_time AS DOUBLE) AS last_time,
       round(CAST(p.n AS DOUBLE) / c.degree, 6) AS share,
       round(cume_dist() OVER (PARTITION BY p.src ORDER BY p.n), 6) AS count_pctile
FROM {pair_counts} p JOIN {src_counts} c ON p.src = c.src
""")
# Bigrams of each source's sequence in order of time, then destination.
define("transitions", """
SELECT prev AS left_item, nxt AS right_item, count(*) AS n FROM (
  SELECT dst AS prev, lead(dst) OVER (PARTITION BY src ORDER BY time, dst) AS nxt FROM {history}) s
WHERE nxt IS NOT NULL GROUP BY prev, nxt
""")
define("transition_mass", "SELECT left_item, CAST(sum(n) AS BIGINT) AS mass FROM {transitions} GROUP BY left_item")
define("item_transitions", """
SELECT t.left_item, t.right_item, t.n, m.mass, round(CAST(t.n AS DOUBLE) / m.mass, 6) AS share
FROM {transitions} t JOIN {transition_mass} m ON t.left_item = m.left_item
""")
define("inter_event_gaps", """
SELECT src, dst, count(gap) AS n_gaps, round(avg(gap), 6) AS mean_gap, round(stddev_pop(gap), 6) AS std_gap, round(median(gap), 6) AS median_gap
FROM (SELECT src, dst, CAST(time - lag(time) OVER (PARTITION BY src, dst ORDER BY time) AS DOUBLE) AS gap FROM {history}) g
WHERE gap IS NOT NULL GROUP BY src, dst
""")
# Dictionary encoding: dense ids over the training domain; -1 for what it lacks.
define_numbered("src_domain", "raw", "(SELECT DISTINCT src AS raw FROM {history}) d", "CAST(floor(raw / 4096) AS BIGINT)", "raw", "idx")
define_numbered("dst_domain", "raw", "(SELECT DISTINCT dst AS raw FROM {history}) d", "CAST(floor(raw / 4096) AS BIGINT)", "raw", "idx")
define("id_compaction", """
SELECT e.src, e.dst, e.time, coalesce(s.idx, -1) AS src_idx, coalesce(d.idx, -1) AS dst_idx
FROM {edges} e LEFT JOIN {src_domain} s ON e.src = s.raw LEFT JOIN {dst_domain} d ON e.dst = d.raw
""")
define("unseen_counts", """
SELECT CAST(sum(CASE WHEN src_idx < 0 THEN 1 ELSE 0 END) AS BIGINT) AS unseen_src, CAST(sum(CASE WHEN dst_idx < 0 THEN 1 ELSE 0 END) AS BIGINT) AS unseen_dst, count(*) AS n FROM {id_compaction}
""")
define("id_maxima", "SELECT max(src) AS max_src, max(dst) AS max_dst, count(*) AS n_edges, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM {edges}")
define("candidate_frequency", "SELECT cand, count(*) AS frequency FROM {queries} GROUP BY cand")
# Prefix by share of rows after a stable sort; equal rows are interchangeable.
define_numbered("rows_in_time", "src, dst, time", "{edges} e", "CAST(floor(time / 604800) AS BIGINT)", "time, src, dst", "k")
define("edge_count", "SELECT count(*) AS n FROM {edges}")
define("row_prefix", "SELECT src, dst, time, k, CASE WHEN k < CAST(floor(0.8 * (SELECT n FROM {edge_count})) AS BIGINT) THEN 0 ELSE 1 END AS split FROM {rows_in_time}")
define("split_boundary", "SELECT CAST(min(k) AS BIGINT) AS first_valid_row FROM {row_prefix} WHERE split = 1")
