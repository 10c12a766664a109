"""CSV sources and sinks, stages, learned scorers and streaming ingestion."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from chronolink.operators import learn
from chronolink.plans.stages import Stage, append_experiment, package, run_stages
from chronolink.sources import csv
from chronolink.streaming import ingest


def test_headers_and_queries(spark, tmp_path):
    d = csv.Dataset("one", "bipartite")
    (tmp_path / "one").mkdir()
    (tmp_path / "one/train.csv").write_text("src,dst,time,split\n1,2,3.5,0\n1,2,3.5,0\n4,5,6,1\n")
    (tmp_path / "one/test.csv").write_text("src,time,c1,c2\n1,9,7,8\n2,9,8,8\n")
    csv.check_headers(spark, d, str(tmp_path), width=2)
    with pytest.raises(ValueError):
        csv.check_headers(spark, d, str(tmp_path), width=3)
    edges = csv.read_edges(spark, d.train_path(str(tmp_path)))
    assert edges.count() == 3 and csv.count_rows(spark, d.train_path(str(tmp_path))) == 3
    rows = [tuple(r) for r in csv.read_queries(spark, d.test_path(str(tmp_path)), 2).orderBy("qid", "pos").select("src", "pos", "cand").collect()]
    assert rows == [(1, 0, 7), (1, 1, 8), (2, 0, 8), (2, 1, 8)]
    with pytest.raises(ValueError):
        csv.Registry(d)["two"]
    with pytest.raises(ValueError):
        csv.require_order(edges, edges)


def test_scores_round_trip(spark, tmp_path):
    scores = spark.createDataFrame([(q, p, (q + p) / 10) for q in range(5) for p in range(3)], "qid long, pos long, score double")
    csv.write_scores(scores, str(tmp_path / "s"))
    back = csv.read_scores(spark, str(tmp_path / "s"))
    assert csv.validate_scores(back, 5, 3) == (0.0, 0.6)
    assert [r[0][1] for r in back.orderBy("line").select("values").collect()] == pytest.approx([0.1, 0.2, 0.3, 0.4, 0.5])
    with pytest.raises(ValueError):
        csv.validate_scores(back, 6, 3)
    with pytest.raises(ValueError):
        csv.validate_scores(back.withColumn("values", F.transform("values", lambda x: x * 9)), 5, 3)


def test_stages_are_skipped_until_something_changes(spark, tmp_path):
    ran = []

    def double(s, inputs):
        ran.append("double")
        return inputs["numbers"].selectExpr("2 * id AS id")

    stages = [Stage("double", double, ("numbers",))]
    for _ in range(2):
        out = run_stages(spark, stages, str(tmp_path), {"numbers": spark.range(5)})
    assert out["double"].agg(F.sum("id")).first()[0] == 20 and ran == ["double"]
    run_stages(spark, stages, str(tmp_path), {"numbers": spark.range(5)}, force=("double",))
    assert ran == ["double", "double"]


def test_package_and_experiments(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2\n")
    digests = package({"a.csv": str(tmp_path / "a.csv")}, str(tmp_path / "out.zip"))
    assert zipfile.ZipFile(tmp_path / "out.zip").namelist() == ["a.csv"]
    assert json.loads((tmp_path / "out.manifest.json").read_text())["files"] == digests
    (tmp_path / "m.txt").write_text(f"{digests['a.csv']}  d/a.csv\n{'0' * 64}  d/b.csv\n")
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.csv").write_text("1,2\n")
    assert [r.path for r in csv.verify_manifest(spark, str(tmp_path / "m.txt"), str(tmp_path / "d")).collect()] == ["d/b.csv"]
    append_experiment(spark, str(tmp_path / "log"), {"mrr": 0.5})
    append_experiment(spark, str(tmp_path / "log"), {"mrr": 0.6})
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_learned_scorers_find_a_plain_signal(spark):
    rows = [(q, p, p, int(p == q % 5), float(p == q % 5) + 0.1 * ((q * 7 + p * 3) % 5), float(p)) for q in range(60) for p in range(5)]
    df = spark.createDataFrame(rows, "qid long, pos long, cand long, label int, a double, b double")
    for scorer in (learn.gbt_ranker, learn.pairwise_ranker):
        out = scorer(df.where("qid % 5 <> 0"), df.where("qid % 5 = 0"))
        assert learn.mean_reciprocal_rank(out).first().mrr > 0.9
    history = spark.createDataFrame([(s, d, 0) for s in range(20) for d in range(20) if (s + d) % 2 == 0 and s != d], "src long, dst long, time long")
    asked = spark.createDataFrame([(s, 0, s, s, 0) for s in range(20)] + [(99, 0, 99, 1, 0)], "qid long, pos long, src long, cand long, label int")
    assert learn.als_factors(history, asked).where("score is null").count() == 0
    parity = spark.createDataFrame([(s, 0, s, c, int((s + c) % 2 == 0)) for s in range(20) for c in range(20)], "qid long, pos long, src long, cand long, label int")
    means = {r.label: r.m for r in learn.ease_scores(history, parity, ridge=5.0).groupBy("label").agg(F.avg("score").alias("m")).collect()}
    assert means[1] > means[0]


def test_stream_matches_batch(spark, tmp_path):
    edges = [spark.createDataFrame([(i % 3, i % 2, float(i + k)) for i in range(10)], ingest.EDGE) for k in (0, 5)]
    for k, e in enumerate(edges):
        e.write.mode("append").parquet(str(tmp_path / "in"))
        ingest.follow_edges(spark, str(tmp_path / "in"), str(tmp_path / "profile"), str(tmp_path / "ck")).awaitTermination()
    got = sorted(map(tuple, ingest.pair_profile(spark, str(tmp_path / "profile")).collect()))
    assert got == sorted(map(tuple, ingest.deltas(edges[0].union(edges[1])).collect()))
