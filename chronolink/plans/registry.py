"""Named queries over a folder of tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import chronolink.operators.features
import chronolink.operators.graph
import chronolink.operators.history
import chronolink.operators.ranking
import chronolink.operators.sampling  # noqa: F401
from chronolink.operators import learn
from chronolink.plans.relational import CATALOG, Operator, Plan, as_sql
from chronolink.plans.stored import store
from chronolink.sources import tables

for _name, _sql in tables.RELATIONS.items():
    CATALOG[_name] = Operator(_name, _sql.strip())

#: Operators over purchases; those over events begin with evt_.
BUY = """
src_profile dst_profile pair_profile item_transitions inter_event_gaps id_compaction unseen_counts id_maxima candidate_frequency row_prefix split_boundary
asof_recency windowed_popularity hawkes_intensity pair_due transition_support bipartite_cf common_neighbors pair_count_pctile freq_trend
temporal_features_30 tree_features_35 tree_features_static temporal_precondition stat_score candidate_distribution recent_neighbors recent_dst_neighbor
new_links sample_queries competition_groups competition_groups_100 competition_groups_5 simple_groups uniform_negatives popularity_negatives
minmax_rows masked_minmax hard_rules rank_scores blend_weighted blend_rank blend_final score_files_joined score_validation
ap_and_auc ranking_metrics metrics_by_bin model_comparison baseline_mrr pair_history
embedding_dot lightgcn_propagate lightgcn_scores item_cosine_cf decayed_item_cf user_cf_votes basket_cooccurrence reciprocal_links
candidate_window_freq query_group_stats oof_folds rolling_windows ppr sketch_collaborative
""".split()
EVENTS = """
src_profile pair_profile inter_event_gaps item_transitions asof_recency hawkes_intensity pair_due freq_trend pair_count_pctile temporal_features_30 tree_features_35 ranking_metrics
""".split()


#: Where queries are those of the tables, what is distinct of them needs no grouping of what is offered before.
OFFERED = {"asked_pairs": "SELECT DISTINCT src, cand FROM {offered}", "dst_contexts": "SELECT DISTINCT cand, time FROM {offered}"}
#: Over events, with queries inside history.
INSIDE = "asof_recency pair_due windowed_popularity temporal_features_30 tree_features_35".split()


#: These read the edges so often that their tables are joined once and what comes of it is kept.
EDGES_STORED = {"temporal_features_30", "baseline_mrr"}


def plan(spark: SparkSession, sf_dir: str, events: bool = False, inside: bool = False, stored: bool = False) -> Plan:
    edges = (tables.edges_evt if events else tables.edges_buy)(spark, sf_dir)
    if stored:
        edges = store(spark, "edges", [edges])
    base = Plan(spark, edges=edges, vectors=tables.vectors(spark, sf_dir))
    return base.replaced(OFFERED | (tables.INSIDE if inside else {}))


def judged(src: Column) -> Column:
    """One fifth of the sources, by hash; the rankers learn on the others."""
    return F.pmod(F.xxhash64(src), F.lit(5)) == 0


def learned(scorer: str) -> Callable[[SparkSession, str], DataFrame]:
    """A scorer trained on the queries of four fifths of the sources, scoring the others'."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = plan(spark, sf_dir, stored=scorer in ("gbt", "pairwise"))
        if scorer == "als":
            return learn.als_factors(p["history"], p["queries"])
        if scorer == "ease":
            return learn.ease_scores(p["history"], p["queries"])
        of = p["queries"].select("qid", "src").distinct()
        features = p["temporal_features_30"].join(of, "qid").withColumn("__asked", judged(F.col("src"))).drop("src").persist()
        part = F.col("__asked")
        return {"gbt": learn.gbt_ranker, "pairwise": learn.pairwise_ranker}[scorer](features.where(~part).drop("__asked"), features.where(part).drop("__asked"))

    return query


#: Without SQL: models.
LEARNED = {"gbt_ranker": "gbt", "pairwise_lr": "pairwise", "als_graph_mf": "als", "ease_cf": "ease"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def query(name: str, events: bool, inside: bool = False):
        return lambda spark, sf_dir: plan(spark, sf_dir, events, inside, name in EDGES_STORED)[name]

    found = {"edges_buy": tables.edges_buy, "edges_evt": tables.edges_evt, "candidates": query("queries", False)}
    found |= {n: query(n, False) for n in BUY}
    found |= {n: learned(s) for n, s in LEARNED.items()}
    found |= {f"inside_{n}": query(n, True, True) for n in INSIDE}
    return found | {f"evt_{n}": query(n, True) for n in EVENTS}


def oracle_sql() -> dict[str, str]:
    buy = {"edges": tables.SQL_EDGES_BUY, "vectors": tables.SQL_VECTORS}
    evt = {"edges": tables.SQL_EDGES_EVT, "vectors": tables.SQL_VECTORS}
    found = {"edges_buy": tables.SQL_EDGES_BUY, "edges_evt": tables.SQL_EDGES_EVT, "candidates": as_sql("queries", buy)}
    found |= {n: as_sql(n, buy) for n in BUY}
    found |= {f"inside_{n}": as_sql(n, evt | tables.INSIDE) for n in INSIDE}
    return found | {f"evt_{n}": as_sql(n, evt) for n in EVENTS}
