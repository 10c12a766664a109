"""Query sampling and candidate groups. Draws are ranks by integer arithmetic on ids, so reruns agree on any engine."""

from __future__ import annotations

from chronolink.plans.relational import define, define_numbered

# Links after the cutoff between known ends whose pair is new.
define("new_links", """
SELECT e.src, e.dst, CAST(e.time AS DOUBLE) AS time FROM {future} e
SEMI JOIN {src_counts} s ON s.src = e.src SEMI JOIN {dst_counts} d ON d.dst = e.dst
ANTI JOIN {pair_counts} p ON p.src = e.src AND p.dst = e.dst
""")
# Positives of groups: one per new (src, dst).
define("positives", "SELECT src, dst AS positive, min(time) AS time FROM {new_links} GROUP BY src, dst")
# A fixed number drawn without replacement, by a scattered key; the number is the feature.
define("sample_queries", "SELECT src, positive, time FROM {positives} ORDER BY (src * 7919 + positive * 104729) % 1000003, src, positive LIMIT 1000")
# Offered slots, so that a draw follows how often a candidate is offered; numbered in a scattered order.
define("slots_marked", """
SELECT q.cand, q.qid, q.pos, CASE WHEN d.dst IS NULL THEN 0 ELSE 1 END AS seen, ((q.qid % 10007) * 7919 + q.pos * 104729 + q.cand * 31) % 10007 AS scatter
FROM {queries} q LEFT JOIN {dst_counts} d ON d.dst = q.cand
""")
# Destinations that the history lacks: every offered id above the known ones.
for kind, seen in (("unseen", 0), ("seen", 1)):
    define_numbered(f"pool_{kind}", "cand, qid, pos, scatter", f"{{slots_marked}} p WHERE seen = {seen}", "CAST(floor(scatter / 16) AS BIGINT)", "scatter, qid, pos", "k")
define("pool_sizes", "SELECT CAST(sum(seen) AS BIGINT) AS n_seen, CAST(sum(1 - seen) AS BIGINT) AS n_unseen FROM {slots_marked}")
define("slot_count", "SELECT count(*) AS n FROM {queries}")
define("draws", " UNION ALL ".join(f"SELECT {i} AS i" for i in range(40)))
define("many_draws", "SELECT a.i * 40 + b.i AS i FROM {draws} a CROSS JOIN {draws} b")


def group_quotas(width: int) -> tuple[int, int]:
    """Unseen and historical negatives in a group of so many candidates, one of them positive; seen ones fill the rest."""
    unseen = min(round(width * 0.536), width - 1)
    return unseen, min(max(1, round(width * 0.02)), width - 1 - unseen)


def define_groups(width: int, suffix: str) -> None:
    """competition_groups + suffix: groups of width candidates; draws repeat until they are distinct, eight for each place."""
    unseen, past = group_quotas(width)
    define(f"drawn_unseen{suffix}", f"""
SELECT src, positive, cand, 0 AS kind, i FROM (
  SELECT src, positive, cand, i, row_number() OVER (PARTITION BY src, positive ORDER BY i, cand) AS rn FROM (
    SELECT s.src, s.positive, u.cand, min(s.i) AS i FROM (
      SELECT q.src, q.positive, d.i, (q.src * 31 + q.positive * 17 + d.i) % greatest((SELECT n_unseen FROM {{pool_sizes}}), 1) AS k
      FROM {{sample_queries}} q CROSS JOIN {{many_draws}} d WHERE d.i < {8 * unseen + 8}) s
    JOIN {{pool_unseen}} u ON u.k = s.k WHERE u.cand <> s.positive GROUP BY s.src, s.positive, u.cand) a) b WHERE rn <= {unseen}
""")
    define(f"drawn_history{suffix}", f"""
SELECT src, positive, cand, 1 AS kind, 0 AS i FROM (
  SELECT s.src, s.positive, p.dst AS cand, row_number() OVER (PARTITION BY s.src, s.positive ORDER BY (p.dst * 7919 + s.positive) % 10007, p.dst) AS rn
  FROM {{sample_queries}} s JOIN {{pair_counts}} p ON p.src = s.src WHERE p.dst <> s.positive) r WHERE rn <= {past}
""")
    # pairs of the past come last: they only fill groups that nothing else fills
    define(f"drawn_seen{suffix}", f"""
SELECT r.src, r.positive, r.cand, CASE WHEN p.src IS NULL THEN 2 ELSE 3 END AS kind, r.i FROM (
  SELECT s.src, s.positive, u.cand, s.i FROM (
    SELECT q.src, q.positive, d.i, (q.src * 31 + q.positive * 17 + d.i * 101) % greatest((SELECT n_seen FROM {{pool_sizes}}), 1) AS k
    FROM {{sample_queries}} q CROSS JOIN {{many_draws}} d WHERE d.i < {8 * width}) s
  JOIN {{pool_seen}} u ON u.k = s.k WHERE u.cand <> s.positive) r
LEFT JOIN {{pair_counts}} p ON p.src = r.src AND p.dst = r.cand
""")
    define(f"drawn_negatives{suffix}", f"""
SELECT src, positive, cand, kind, row_number() OVER (PARTITION BY src, positive ORDER BY kind, i, cand) AS rn FROM (
  SELECT src, positive, cand, min(kind) AS kind, min(i) AS i FROM (
    SELECT src, positive, cand, kind, i FROM {{drawn_unseen{suffix}}} UNION ALL SELECT src, positive, cand, kind, i FROM {{drawn_history{suffix}}}
    UNION ALL SELECT src, positive, cand, kind, i FROM {{drawn_seen{suffix}}}) a GROUP BY src, positive, cand) b
""")
    define(f"competition_groups{suffix}", f"""
SELECT src, positive, cand, label, kind, CAST(row_number() OVER (PARTITION BY src, positive ORDER BY (cand * 7919) % 10007, cand) - 1 AS BIGINT) AS pos FROM (
  SELECT src, positive, cand, 0 AS label, kind FROM {{drawn_negatives{suffix}}} WHERE rn <= {width - 1}
  UNION ALL SELECT src, positive, positive AS cand, 1 AS label, 4 AS kind FROM {{sample_queries}}) g
""")


define_groups(20, "")
define_groups(100, "_100")
define_groups(5, "_5")
# Distinct draws from the candidate slots, weighted by frequency.
define_numbered("slots", "cand, qid, pos", "{queries} q", "CAST(floor(qid / 100000000000) AS BIGINT)", "qid, pos", "k")
define("simple_groups", """
SELECT src, positive, cand, label FROM (
  SELECT src, positive, cand, 0 AS label, row_number() OVER (PARTITION BY src, positive ORDER BY i, cand) AS rn FROM (
    SELECT s.src, s.positive, u.cand, min(s.i) AS i FROM (
      SELECT q.src, q.positive, d.i, (q.src * 131 + q.positive * 17 + d.i * 7919) % (SELECT n FROM {slot_count}) AS k FROM {sample_queries} q CROSS JOIN {draws} d) s
    JOIN {slots} u ON u.k = s.k WHERE u.cand <> s.positive GROUP BY s.src, s.positive, u.cand) a) b
WHERE rn <= 9
UNION ALL SELECT src, positive, positive AS cand, 1 AS label FROM {sample_queries}
""")
define("uniform_negatives", """
SELECT src, positive, CAST(d.i AS BIGINT) AS draw,
       CASE WHEN (src * 31 + positive * 17 + d.i * 97) % (m.max_dst + 1) = positive THEN (positive + 1) % (m.max_dst + 1) ELSE (src * 31 + positive * 17 + d.i * 97) % (m.max_dst + 1) END AS cand
FROM {positives} p CROSS JOIN {draws} d CROSS JOIN {id_maxima} m WHERE d.i < 5
""")
define_numbered("edge_slots", "dst, src, time", "{history} h", "CAST(floor(time / 604800) AS BIGINT)", "time, src, dst", "k")
define("edge_slot_count", "SELECT count(*) AS n FROM {history}")
define("popularity_draws", "SELECT p.src, p.positive, d.i, (p.src * 7919 + p.positive * 104729 + d.i * 31337) % (SELECT n FROM {edge_slot_count}) AS k FROM {positives} p CROSS JOIN {draws} d WHERE d.i < 10")
define("popularity_negatives", "SELECT d.src, d.positive, CAST(d.i AS BIGINT) AS draw, e.dst AS cand FROM {popularity_draws} d JOIN {edge_slots} e ON e.k = d.k")
