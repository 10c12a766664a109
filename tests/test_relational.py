"""Feature operators on a hand-sized edge log with values worked out by hand, and properties of whole plans."""

import math

import pytest

from chronolink.plans.registry import BUY, EVENTS, oracle_sql, queries
from chronolink.plans.relational import CATALOG, Plan, as_sql

EDGES = [(1, 10, 0), (1, 11, 10), (2, 10, 15), (1, 10, 30), (2, 12, 35), (3, 11, 40), (3, 10, 45), (1, 12, 50), (1, 10, 70), (2, 11, 80), (3, 12, 90), (1, 10, 100)]
ASKED = [(1, 10, 120), (1, 11, 120), (3, 12, 120), (2, 99, 120), (1, 10, 70), (1, 10, 101)]
EDGE = "src long, dst long, time long"


def plan(spark, edges=EDGES, asked=ASKED):
    history = spark.createDataFrame(edges, EDGE)
    rows = [(s * 1000 + t, s, t, c, 0, n) for n, (s, c, t) in enumerate(asked)]
    return Plan(spark, history=history, edges=history, queries=spark.createDataFrame(rows, "qid long, src long, time long, cand long, label int, pos long"))


@pytest.fixture(scope="module")
def temporal(spark):
    p = plan(spark)
    return {r.pos: r for r in p["temporal_raw"].collect()}, {r.pos: r for r in p["temporal_features_30"].collect()}


def test_temporal_features(temporal):
    raw, log = temporal
    want = {  # pair count, recency, slow decay, due ratio, due error, degree, unique, dst count, last, recent, mass, cf, cf mass
        0: (4, 3.044522, 0.463552, 0.510826, 2.397895, 6, 3, 6, 1, 7, 24, 4.0, 12.0),
        1: (1, 4.709530, 0.004087, 0, 4.615121, 6, 3, 3, 1, 5, 24, 4.0, 12.0),
        2: (1, 3.433987, 0.223130, 0, 4.615121, 3, 3, 3, 0, 3, 9, 1.707107, 7.242641),
        3: (0, 4.615121, 0, 0, 4.615121, 3, 3, 0, 0, 0, 9, 0, 7.242641),
        4: (2, 3.713572, 0.165533, 0.847298, 2.397895, 4, 3, 4, 1, 5, 14, 2.666667, 8.0),
    }
    for pos, w in want.items():
        r, f = raw[pos], log[pos]
        got = (f.pair_count, f.pair_recency_log, f.pair_hawkes_slow, f.pair_due_ratio_log, f.pair_due_error_log, r.src_degree, r.src_unique, r.dst_degree, r.last_n, r.recent_n, r.mass, r.cf, r.cf_mass)
        assert got == pytest.approx(w, abs=2e-6), pos
    # the window's lower bound counts, the query's own time doesn't
    assert (log[5].dst_recent_short, log[5].dst_recent_long) == (1, 1)
    assert log[3].is_seen_dst == 0 and log[0].is_seen_dst == 1


def test_tree_features(spark):
    got = {r.pos: r for r in plan(spark)["tree_features_35"].collect()}
    want = {
        0: (0.001273, 0.495346, 71 / 51, 1.251629, 1), 1: (0, 0.005310, 1, 1.251629, 2 / 3), 2: (0.000045, 0.239651, 1, 1.584963, 1),
        3: (0, 0, 1, 1.584963, 0), 4: (0.000002, 0.184532, 1, 1.5, 1),
    }
    for pos, w in want.items():
        r = got[pos]
        assert (r.pair_decay_short, r.pair_decay_long, r.pair_freq_trend, r.src_entropy, r.pair_count_pctile) == pytest.approx(w, abs=2e-6), pos
    assert len([c for c in got[0].asDict() if c not in ("qid", "pos", "cand", "label")]) == 35


def test_static_path_agrees_with_the_general_one(spark):
    import random

    rng = random.Random(1)
    edges = [(rng.randint(1, 8), rng.randint(1, 9), rng.randint(0, 500)) for _ in range(400)]
    asked = [(s, c, t) for s in range(1, 10) for c in range(1, 11) for t in (600, 900)]
    p = plan(spark, edges, asked)
    a, b = ({(r.qid, r.cand): r for r in p[n].collect()} for n in ("tree_features_35", "tree_features_static"))
    assert a.keys() == b.keys() and len(a) == len(asked)
    for k in a:
        assert tuple(a[k]) == pytest.approx(tuple(b[k]), abs=2e-6), k


def test_late_edges_change_nothing_before_them(spark):
    """Query-time aggregates don't see what comes after the query."""
    late = EDGES + [(1, 10, 200), (5, 10, 210), (1, 99, 220)]
    for name in ("pair_past", "src_context", "pair_count_pctile"):
        a, b = (sorted(map(str, plan(spark, e)[name].collect())) for e in (EDGES, late))
        assert a == b, name


def test_short_histories_keep_their_items(spark):
    p = plan(spark, [(1, 10, 5)], [(1, 10, 9)])
    assert p["recent_neighbors"].count() == 1 and p["temporal_features_30"].count() == 1


def test_ties_go_to_the_smaller_position(spark):
    p = Plan(spark, scores=spark.createDataFrame([(1, 0, 0, 0.2), (1, 1, 0, 0.9), (1, 2, 0, 0.9), (1, 3, 1, 0.1), (2, 0, 0, 5.0), (2, 1, 1, 5.0), (2, 2, 0, 5.0)], "qid long, pos long, label int, s1 double").selectExpr("*", "pos as cand", "s1 as s2", "s1 as s3", "1 as seen", "0 as known", "0L as src"))
    ranks = {(r.qid, r.pos): r["rank"] for r in p["rank_scores"].collect()}
    assert [ranks[1, k] for k in range(4)] == [3, 1, 2, 4] and [ranks[2, k] for k in range(3)] == [1, 2, 3]
    flat = [r for r in p["minmax_rows"].collect() if r.qid == 2]
    assert all(r.n1 == 0 and r.n2 == 0 for r in flat)
    m = p["ranking_metrics"].first()
    assert m.mrr == pytest.approx((1 / 4 + 1 / 2) / 2) and m.ndcg_10 == pytest.approx((1 / math.log2(5) + 1 / math.log2(3)) / 2, abs=1e-6)


def test_every_query_has_sql_and_every_input_is_known():
    assert set(queries()) - set(oracle_sql()) == {"gbt_ranker", "pairwise_lr", "als_graph_mf", "ease_cf"}
    for op in CATALOG.values():
        assert all(i in CATALOG or i in ("edges", "vectors") for i in op.inputs), op.name
    assert len(BUY) == len(set(BUY)) and set(EVENTS) <= set(BUY)


@pytest.mark.parametrize("name", ["pair_history", "src_profile", "stat_score", "competition_groups", "competition_groups_100", "competition_groups_5", "baseline_mrr", "blend_final", "lightgcn_scores", "evt_hawkes_intensity"])
def test_agrees_with_duckdb(spark, name):
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in ("orders", "lineitem", "events", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.sql(oracle_sql()[name])
    got = queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    tidy = lambda rows: sorted(str([round(x, 5) + 0.0 if isinstance(x, float) else x for x in r]) for r in rows)
    assert tidy(tuple(r[c] for c in columns) for r in got.collect()) == tidy(want.select(*columns).fetchall())


def test_group_quotas():
    from chronolink.operators.sampling import group_quotas

    assert [group_quotas(n) for n in (100, 50, 20, 5)] == [(54, 2), (27, 1), (11, 1), (3, 1)]


def test_groups_follow_their_quotas_and_draw_by_frequency(spark):
    """Groups of 20 over a log of 60 destinations, 30 of them with a past, and offers of which one unseen id has most."""
    import random
    from collections import Counter, defaultdict

    rng = random.Random(4)
    history = [(s, rng.randint(1, 30), t) for t in range(300) for s in [rng.randint(1, 12)]]
    known = {(s, d) for s, d, _ in history}
    offers = [(s, c, 400 + k) for k in range(40) for s in range(1, 13) for c in (31, 31, 31, rng.randint(32, 60), rng.randint(1, 30))]
    rows = [(k, s, t, k % 5, c, 0) for k, (s, c, t) in enumerate(offers)]
    wanted = [(s, d) for s in range(1, 13) for d in range(1, 31) if (s, d) not in known][:20]
    p = Plan(
        spark, history=spark.createDataFrame(history, EDGE), edges=spark.createDataFrame(history, EDGE),
        queries=spark.createDataFrame(rows, "qid long, src long, time long, pos long, cand long, label int"),
        sample_queries=spark.createDataFrame([(s, d, 350) for s, d in wanted], "src long, positive long, time long"),
    )
    groups, often = defaultdict(list), Counter()
    for r in p["competition_groups"].collect():
        groups[r.src, r.positive].append(r)
    assert set(groups) == set(wanted)
    for (src, positive), rs in groups.items():
        assert len(rs) == 20 == len({r.cand for r in rs}) and [r.cand for r in rs if r.label] == [positive]
        kinds = Counter(r.kind for r in rs)
        assert (kinds[0], kinds[1], kinds[2] + kinds[3], kinds[4]) == (11, 1, 7, 1)
        assert all((r.cand > 30) == (r.kind == 0) and ((src, r.cand) in known) == (r.kind in (1, 3)) for r in rs if not r.label)
        often.update(r.cand for r in rs if r.kind == 0)
    assert often[31] == max(often.values()) > 0.9 * len(wanted)


def test_baselines_rank_single_features(spark):
    features = [(1, 0, 0, 5.0), (1, 1, 1, 5.0), (1, 2, 0, 7.0), (2, 0, 1, 1.0), (2, 1, 1, 9.0), (2, 2, 0, 0.0)]
    names = ("pair_count", "dst_degree_log", "recent_item_transition_norm", "bipartite_cf_support", "candidate_frequency_log")
    given = spark.createDataFrame(features, "qid long, pos long, label int, x double").selectExpr("qid", "pos", "label", *[f"{'-' if n == 'dst_degree_log' else ''}x AS {n}" for n in names])
    got = {r.feature: r.mrr for r in Plan(spark, temporal_features_30=given)["baseline_mrr"].collect()}
    assert got == pytest.approx({"pair_count": (1 / 3 + 1 / 2) / 2, "dst_degree": (1 / 2 + 1 / 2) / 2, "transition": 5 / 12, "bipartite_cf": 5 / 12, "candidate_frequency": 5 / 12}, abs=1e-6)


def test_score_files_of_different_rows_stop_the_join(spark):
    scores = "qid long, pos long, score double"
    a, b = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.0), (1, 2, 1.0)], scores), spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0), (1, 2, 1.0)], scores)
    assert [r.score for r in Plan(spark, blend_weighted=a, blend_rank=b)["blend_final"].orderBy("pos").collect()] == pytest.approx([0.0, (0.45 - 0.275) / 0.725, 1.0], abs=1e-6)
    for x, y in ((a, b.where("pos < 2")), (a.where("pos < 2"), b)):
        with pytest.raises(Exception, match="row for query"):
            Plan(spark, blend_weighted=x, blend_rank=y)["score_files_joined"].collect()


def test_lightgcn_uses_whole_vectors(spark):
    import random
    from collections import Counter

    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(20)] for _ in range(4)]
    n = Counter((s, d) for s, d, _ in EDGES)
    out, into = Counter(s for s, _, _ in EDGES), Counter(d for _, d, _ in EDGES)
    w = {(s, d): k / math.sqrt(out[s] * into[d]) for (s, d), k in n.items()}
    layers = [({s: vectors[s % 4] for s in out}, {d: vectors[d % 4] for d in into})]
    for _ in range(2):
        a, b = layers[-1]
        layers.append((
            {s: [sum(w[s, d] * b[d][i] for d in into if (s, d) in w) for i in range(20)] for s in out},
            {d: [sum(w[s, d] * a[s][i] for s in out if (s, d) in w) for i in range(20)] for d in into},
        ))
    mean = [{k: [sum(x[side][k][i] for x in layers) / 3 for i in range(20)] for k in layers[0][side]} for side in (0, 1)]
    history = spark.createDataFrame(EDGES, EDGE)
    queries_ = spark.createDataFrame([(s, d) for s in out for d in into], "src long, cand long")
    rows = [(k, i, x) for k, v in enumerate(vectors) for i, x in enumerate(v)]
    p = Plan(spark, history=history, edges=history, queries=queries_, vectors=spark.createDataFrame(rows, "id long, dim long, x double"))
    got = {(r.side, r.id, r.dim): r.x for r in p["lightgcn_propagate"].collect()}
    assert got == pytest.approx({(name, k, i): x for name, m in zip(("src", "dst"), mean) for k, v in m.items() for i, x in enumerate(v)}, abs=2e-5)
    scores = {(r.src, r.cand): r.score for r in p["lightgcn_scores"].collect()}
    assert scores == pytest.approx({(s, d): sum(x * y for x, y in zip(mean[0][s], mean[1][d])) + 0.01 * into[d] for s in out for d in into}, abs=2e-5)


@pytest.mark.parametrize("name", ["gbt_ranker", "pairwise_lr"])
def test_registered_rankers_learn_on_other_sources(spark, monkeypatch, name):
    import os

    from chronolink.operators import learn

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    parts = []
    monkeypatch.setattr(learn, {"gbt_ranker": "gbt_ranker", "pairwise_lr": "pairwise_ranker"}[name], lambda train, test: parts.append((train, test)))
    queries()[name](spark, sf)
    sources = [{r.qid // 1000000000 for r in x.select("qid").distinct().collect()} for x in parts[0]]
    assert len(sources[0]) > len(sources[1]) > 0 and not sources[0] & sources[1]
    assert parts[0][0].columns == parts[0][1].columns == queries()["temporal_features_30"](spark, sf).columns


def test_sql_names_every_relation_once():
    text = as_sql("temporal_features_30", {"edges": "SELECT 1 AS src, 2 AS dst, 3 AS time", "vectors": "SELECT 1"})
    assert text.count("src_past AS (") == 1 and "{" not in text


def test_rounds_are_those_of_the_binary_value(spark):
    """Decimal ties whose binary value lies below the half, as blend_final and the medians of two microsecond gaps meet."""
    import duckdb

    xs = [(k + 0.5) / 1e6 for k in range(1, 3000, 7)] + [-0.0000015, 1234567.8901235, 68651.0329445, None]
    want = [r[0] for r in duckdb.sql(f"SELECT round(x, 6) FROM (SELECT unnest(CAST({xs[:-1]} AS DOUBLE[])) AS x)").fetchall()] + [None]
    given = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double")
    got = Plan(spark, xs=given).replaced({"rounded": "SELECT i, round((x + 0.0), 6) AS y, round(ln(1), 6) AS z FROM {xs}"})["rounded"].orderBy("i").collect()
    assert [r.y for r in got] == want and all(r.z == 0 for r in got)


def test_median_gaps_of_microseconds(spark):
    """the median of an even number of gaps is a tie of the sixth place."""
    import random

    import duckdb

    rng = random.Random(5)
    times = {s: [rng.randint(0, 3 * 10**11) / 1e6 for _ in range(3)] for s in range(1, 300)}
    edges = [(s, 10, t) for s, ts in times.items() for t in ts]
    asked = [(s * 1000, s, 400000.0, 10) for s in times]
    values = lambda rows: "VALUES " + ", ".join(str(r) for r in rows)
    base = {"history": f"SELECT col0 AS src, col1 AS dst, CAST(col2 AS DOUBLE) AS time FROM ({values(edges)})", "queries": f"SELECT col0 AS qid, col1 AS src, CAST(col2 AS DOUBLE) AS time, col3 AS cand FROM ({values(asked)})"}
    want = duckdb.sql(as_sql("pair_due", base | {"edges": base["history"]})).fetchall()
    history = spark.createDataFrame(edges, "src long, dst long, time double")
    got = Plan(spark, history=history, edges=history, queries=spark.createDataFrame(asked, "qid long, src long, time double, cand long"))["pair_due"].collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_what_spark_runs_agrees_with_the_statements(spark):
    """Destinations with more events than a chunk holds, ties in time, queries between events; no join of all events with all contexts."""
    import random

    from chronolink.plans.relational import SPARK

    rng = random.Random(2)
    edges = [(rng.randint(1, 12), rng.choice((3, 3, 3, 4, 20)), rng.randint(0, 300)) for _ in range(700)]
    asked = sorted({(s, c, t) for s in range(1, 14) for c in (3, 4, 20, 99) for t in (0, 1, rng.randint(2, 250), 301)})
    history = spark.createDataFrame(edges, EDGE)
    rows = [(s * 1000 + t, s, t, c, 0, n) for n, (s, c, t) in enumerate(asked)]
    vectors = spark.createDataFrame([(k, i, rng.gauss(0, 1)) for k in range(5) for i in range(3)], "id long, dim long, x double")
    p = Plan(spark, history=history, edges=history, vectors=vectors, queries=spark.createDataFrame(rows, "qid long, src long, time long, cand long, label int, pos long"))
    stated = p.replaced({n: CATALOG[n].sql for n in SPARK if n in CATALOG})
    tidy = lambda rows, columns: sorted(str([round(r[c], 6) + 0.0 if isinstance(r[c], float) else r[c] for c in columns]) for r in rows)
    for name in sorted(n for n in SPARK if n in CATALOG):
        want = stated[name]
        assert set(want.columns) <= set(p[name].columns), name
        got = tidy(p[name].collect(), want.columns)
        assert len(got) > 1 and got == tidy(want.collect(), want.columns), name
    assert "dst_context" in p._known and "dst_past" not in p._known and "dst_past" in stated._known
    assert tidy(p["common_neighbors"].collect(), ["qid", "cand", "common", "jaccard"]) == tidy(stated["common_neighbors"].collect(), ["qid", "cand", "common", "jaccard"])


def oracle_rows(name, edges, asked, vectors=()):
    """Rows of DuckDB for an operator's statement over the given rows."""
    import duckdb

    values = lambda rows, names, types: "SELECT " + ", ".join(f"CAST(col{i} AS {t}) AS {n}" for i, (n, t) in enumerate(zip(names, types))) + " FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows) + ")"
    base = {"history": values(edges, ("src", "dst", "time"), ("BIGINT",) * 3), "queries": values(asked, ("qid", "src", "time", "cand", "label", "pos"), ("BIGINT",) * 6)}
    base |= {"edges": base["history"], "vectors": values(vectors or [(0, 0, 1.0)], ("id", "dim", "x"), ("BIGINT", "BIGINT", "DOUBLE"))}
    return duckdb.sql(as_sql(name, base)).fetchall()


def spark_plan(spark, edges, asked, vectors=()):
    history = spark.createDataFrame(edges, EDGE)
    queries = spark.createDataFrame(asked, "qid long, src long, time long, cand long, label int, pos long")
    return Plan(spark, history=history, edges=history, queries=queries, vectors=spark.createDataFrame(vectors or [(0, 0, 1.0)], "id long, dim long, x double"))


def same_rows(got, want):
    assert len(got) == len(want) > 0
    key = lambda r: tuple((v is None, v) for v in r if not isinstance(v, float))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a == pytest.approx(b, abs=2e-5, nan_ok=True)


def test_embedding_dot_of_uneven_vectors(spark):
    """a pair is one row, not one per dimension; shorter, repeated and null components count as in the statement."""
    vectors = [(0, 0, 1.5), (0, 1, -2.0), (0, 2, 0.25), (1, 0, 3.0), (1, 1, None), (1, 2, 4.0), (2, 1, 0.5), (3, 0, 2.0), (3, 0, 1.0), (3, 2, 7.0), (4, 1, None)]
    asked = [(s * 1000, s, 9, c, 0, c) for s in range(1, 7) for c in range(1, 9)]
    p = spark_plan(spark, EDGES, asked, vectors)
    same_rows(p["embedding_dot"].collect(), oracle_rows("embedding_dot", EDGES, asked, vectors))
    assert "vector_lists" in p._known


def random_log(seed):
    import random

    rng = random.Random(seed)
    edges = [(rng.randint(1, 14), rng.randint(1, 16), rng.randint(0, 300)) for _ in range(500)]
    asked = [(s * 1000 + t, s, t, c, int(c == 3), c) for s in range(1, 17) for t in (301, 400) for c in range(1, 19)]
    vectors = [(k, i, rng.gauss(0, 1)) for k in range(5) for i in range(19)]
    return edges, asked, vectors


@pytest.mark.parametrize("name,table", [("item_cosine_cf", "cf_scores"), ("decayed_item_cf", "cf_scores"), ("user_cf_votes", "cf_votes")])
def test_relations_made_in_slices(spark, monkeypatch, name, table):
    """pairs of items are made and asked for slice by slice, in as many slices as the rows need, with the statement's rows."""
    from chronolink.plans import relational

    monkeypatch.setattr(relational, "SLICE_ROWS", 1200)
    edges, asked, vectors = random_log(8)
    p = spark_plan(spark, edges, asked, vectors)
    same_rows(p[name].collect(), oracle_rows(name, edges, asked, vectors))
    assert len(p._sliced(table, relational.SPARK[table])) > 1


def test_event_types_do_not_shuffle_events(spark, tmp_path, monkeypatch):
    """Events meet their few types where they lie, whatever Spark thinks of their size; many types are shuffled, with the same rows."""
    from chronolink.sources import tables

    spark.sql("SELECT CAST(TIMESTAMP'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS TIMESTAMP) AS ts, id % 7 AS user_id, concat('t', id % 3) AS event_type FROM range(60)").write.parquet(str(tmp_path / "events.parquet"))
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = tables.edges_evt(spark, str(tmp_path))
        assert "BroadcastHashJoin" in plan_of(few) and "SortMergeJoin" not in plan_of(few)
        monkeypatch.setattr(tables, "TYPES_BROADCAST", 2)
        many = tables.edges_evt(spark, str(tmp_path))
        assert "SortMergeJoin" in plan_of(many)
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() == 60
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_asof_recency_needs_no_join_of_queries_with_all_events(spark):
    """equal times, times within one second that share a qid, sources and candidates without events."""
    edges, asked, _ = random_log(3)
    asked = [(s * 1000 + t // 2, s, t, c, 0, 20 * (t % 2) + c) for s in range(1, 17) for t in (0, 80, 81, 150, 151, 400) for c in range(1, 19)]
    p = spark_plan(spark, edges, asked)
    want = sorted(oracle_rows("asof_recency", edges, asked), key=str)
    assert sorted(map(tuple, p["asof_recency"].collect()), key=str) == want and any(r[3] is None for r in want)
    assert "pair_past" not in p._known and "src_past" not in p._known


@pytest.mark.parametrize("name", ["lightgcn_propagate", "lightgcn_scores"])
@pytest.mark.parametrize("ragged", [False, True])
def test_propagation_by_lists_in_slices(spark, monkeypatch, name, ragged):
    """a layer makes a row per link instead of one per link and dim, slice by slice; missing, repeated and null components count as in the statement."""
    from chronolink.plans import relational

    monkeypatch.setattr(relational, "SLICE_ROWS", 1200)
    edges, asked, vectors = random_log(4)
    edges += [(None, 3, 5), (4, None, 6), (None, None, 7), (40, 41, 8)]
    if ragged:  # dim 2 lacks a value in vector 1, dim 5 a row in vector 3, dim 19 is only in vector 2; id 7 leaves gaps in the ids
        vectors = [v for v in vectors if v[:2] != (3, 5)] + [(2, 19, 0.5), (0, 1, 2.0), (7, 0, 1.0), (2, 20, None)]
        vectors = [(k, i, None) if (k, i) == (1, 2) else (k, i, x) for k, i, x in vectors]
    p = spark_plan(spark, edges, asked, vectors)
    same_rows(p[name].collect(), oracle_rows(name, edges, asked, vectors))
    assert len(p._sliced("gcn_src_mean", relational.SPARK["gcn_src_mean"])) > 1
    assert "gcn_src" not in p._known and "src_1" not in p._known


def test_rows_of_propagation_are_planned_for_uneven_vectors_only(spark, tmp_path):
    """where every vector has every dim, no plan by rows stays beside the lists, also where vectors are exploded from a table."""
    edges, asked, vectors = random_log(4)
    p = spark_plan(spark, edges, asked)
    lists = spark.createDataFrame([(k, [x for j, _, x in vectors if j == k]) for k in range(5)], "id long, xs array<double>")
    lists.write.parquet(str(tmp_path / "v"))
    exploded = spark.read.parquet(str(tmp_path / "v")).selectExpr("id", "posexplode(xs) AS (dim, x)").selectExpr("id", "CAST(dim AS BIGINT) AS dim", "x")
    p = Plan(spark, **{**p._given, "vectors": exploded})
    assert "Join Inner" not in p["lightgcn_scores"]._jdf.queryExecution().optimizedPlan().toString()
    same_rows(p["lightgcn_scores"].collect(), oracle_rows("lightgcn_scores", edges, asked, vectors))


@pytest.mark.parametrize("width", [1000, 3])
def test_temporal_features_by_lists_in_slices(spark, monkeypatch, width):
    """collaborative support and transitions meet asked candidates as lists, slice by slice, and items with many successors by rows; neither makes all pairs."""
    from chronolink.operators import features
    from chronolink.plans import relational

    monkeypatch.setattr(relational, "SLICE_ROWS", 600)
    monkeypatch.setitem(relational.SPARK, "tf_follow", relational.SPARK["tf_follow"].replace(f"> {features.FOLLOWERS} ", f"> {width} "))
    edges, asked, _ = random_log(6)
    asked += [(1301, 1, 302, c, 0, c + 40) for c in (3, 5, 99)]  # another time under the same qid
    p = spark_plan(spark, edges, asked)
    rows = p["temporal_features_30"].collect()
    same_rows(rows, oracle_rows("temporal_features_30", edges, asked))
    assert len({r.bipartite_cf_support for r in rows}) > 20
    assert len(p._sliced("tf_dst", relational.SPARK["tf_dst"])) > 1
    assert not {"item_support", "collaborative_context", "transition_context"} & p._known.keys()


def test_baselines_rank_their_features_once(spark):
    """features are read once, not once per baseline and once more for the first positives."""
    edges, asked, _ = random_log(7)
    p = spark_plan(spark, edges, asked)
    same_rows(p["baseline_mrr"].collect(), oracle_rows("baseline_mrr", edges, asked))
    assert p["baseline_mrr"]._jdf.queryExecution().optimizedPlan().toString().count("Window") == 0


@pytest.mark.parametrize("name", ["cf_asked", "cf_scores"])
def test_lists_and_what_is_exploded_of_them_are_not_broadcast(spark, name):
    """Spark takes the size of exploded lists from their file, and would send all asked pairs of items through the driver."""
    from chronolink.plans import relational

    edges, asked, _ = random_log(8)
    p = spark_plan(spark, edges, asked)
    p[name], p["cf_sizes"]
    (sql,) = p._sliced(name, relational.SPARK[name])
    df = spark.sql(sql, **{i: p[i] for i in relational._INPUT.findall(relational.SPARK[name])})
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text
    assert not any("explode" in side or "cf_lists" in side for side in broadcast_sides(text))


def broadcast_sides(plan):
    """The parts of a printed plan below each broadcast."""
    lines = plan.split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = [x for x in lines[i + 1 :]]
            end = next((j for j, x in enumerate(below) if depth(x) <= depth(line)), len(below))
            yield "\n".join(below[:end])


@pytest.mark.parametrize("users,owned", [(1000, 500), (6, 3), (0, 500)])
def test_votes_count_all_users_and_items(spark, monkeypatch, users, owned):
    """items of more than 50 users and sources of more than 20 events vote whole; wide items and sources in several rows give the same."""
    from chronolink.operators import graph
    from chronolink.plans import relational

    monkeypatch.setitem(relational.SPARK, "vote_users", relational.SPARK["vote_users"].replace(f"> {graph.USERS} ", f"> {users} "))
    monkeypatch.setitem(relational.SPARK, "cf_votes", relational.SPARK["cf_votes"].replace(f"/ {graph.OWNED})", f"/ {owned})").replace(f"/ {graph.WANTED})", f"/ {owned})"))
    import random

    rng = random.Random(9)
    edges = [(s, 1, s) for s in range(1, 71)] + [(s, 2, s + 1) for s in range(1, 71)] + [(71, i, i) for i in range(1, 41)]
    edges += [(rng.randint(1, 20), rng.randint(3, 40), rng.randint(0, 300)) for _ in range(150)] + [(None, 3, 5), (4, None, 6)]
    asked = [(s * 1000, s, 900, c, 0, c) for s in (1, 2, 5, 30, 70, 71, 99) for c in range(1, 43)]
    got = {(r.src, r.cand): r.votes for r in spark_plan(spark, edges, asked)["user_cf_votes"].collect()}
    assert got == {(s, c): v for s, c, v in oracle_rows("user_cf_votes", edges, asked)}
    assert got[70, 1] == 2 * 69 + 2  # both items with 69 others and with source 71
