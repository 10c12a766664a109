"""Edge logs, wide queries and score files as CSV, with their checks."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Literal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 100


@dataclass(frozen=True)
class Dataset:
    """A named pair of training edges and test queries."""

    name: str
    graph: Literal["homogeneous", "bipartite"]
    has_split: bool = True

    def train_path(self, root: str) -> str:
        return f"{root.rstrip('/')}/{self.name}/train.csv"

    def test_path(self, root: str) -> str:
        return f"{root.rstrip('/')}/{self.name}/test.csv"


class Registry:
    """Datasets by name."""

    def __init__(self, *datasets: Dataset):
        self._known = {d.name: d for d in datasets}

    def __getitem__(self, name: str) -> Dataset:
        if name not in self._known:
            raise ValueError(f"unknown dataset {name!r}; known: {', '.join(sorted(self._known))}")
        return self._known[name]


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, without reading its rows."""
    first = spark.read.text(path).limit(1).collect()
    return [c.strip() for c in first[0][0].split(",")] if first else []


def check_headers(spark: SparkSession, dataset: Dataset, root: str, width: int = WIDTH, exact_names: bool = True) -> None:
    """Raises ValueError on a wrong header: src, dst, time[, split] and src, time, then width candidates."""
    train, test = header(spark, dataset.train_path(root)), header(spark, dataset.test_path(root))
    want = ["src", "dst", "time"] + (["split"] if dataset.has_split else [])
    if train[: len(want)] != want:
        raise ValueError(f"{dataset.name}: training columns are {train}, not {want}")
    if test[:2] != ["src", "time"] or len(test) != width + 2:
        raise ValueError(f"{dataset.name}: {len(test)} test columns, not src, time and {width} candidates")
    if exact_names and test[2:] != [f"c{i + 1}" for i in range(width)]:
        raise ValueError(f"{dataset.name}: candidates are not named c1 to c{width}")


def read_edges(spark: SparkSession, path: str, split: bool = True) -> DataFrame:
    """src, dst, time[, split]; duplicates are events of their own."""
    fields = [("src", T.LongType()), ("dst", T.LongType()), ("time", T.DoubleType())] + ([("split", T.IntegerType())] if split else [])
    return spark.read.schema(T.StructType([T.StructField(n, t) for n, t in fields])).csv(path, header=True)


def read_queries(spark: SparkSession, path: str, width: int = WIDTH) -> DataFrame:
    """qid, src, time, pos, cand in long form; candidates go by place, not name. qid follows the order of rows."""
    names = ["src", "time", *(f"c{i + 1}" for i in range(width))]
    wide = spark.read.schema(", ".join(f"{n} {'double' if n == 'time' else 'long'}" for n in names)).csv(path, header=True)
    wide = wide.withColumn("qid", F.monotonically_increasing_id())
    return to_long(wide, names[2:])


def to_long(wide: DataFrame, candidates: list[str]) -> DataFrame:
    long = wide.select("qid", "src", "time", F.posexplode(F.array(*candidates)).alias("pos", "cand"))
    return long.withColumn("pos", F.col("pos").cast("long"))


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a CSV file without its header, columns unparsed."""
    return max(0, spark.read.text(path).where("value <> ''").count() - 1)


def score_lines(scores: DataFrame, score: str = "score") -> DataFrame:
    """qid, value: the scores of a query in order of pos, eight decimals each, joined by commas."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", score)))
    return scores.groupBy("qid").agg(F.concat_ws(",", F.transform(ordered, lambda x: F.format_string("%.8f", x[score]))).alias("value"))


def write_scores(scores: DataFrame, path: str, score: str = "score") -> None:
    """A headerless file per partition; files and lines follow qid."""
    score_lines(scores, score).repartitionByRange("qid").sortWithinPartitions("qid").select("value").write.mode("overwrite").text(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """line, values of a headerless score file."""
    rows = spark.read.text(path).where("value <> ''")
    return rows.select(F.monotonically_increasing_id().alias("line"), F.split("value", ",").cast("array<double>").alias("values"))


def validate_scores(scores: DataFrame, rows: int, width: int = WIDTH) -> tuple[float, float]:
    """Smallest and largest score; raises ValueError unless there are rows lines of width finite numbers from 0 to 1."""
    bad = F.exists("values", lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    n, low, high, least, most, wrong = scores.agg(
        F.count(F.lit(1)), F.min(F.size("values")), F.max(F.size("values")), F.min(F.array_min("values")), F.max(F.array_max("values")), F.count_if(bad)
    ).first()
    if n != rows:
        raise ValueError(f"{n} score rows, not {rows}")
    if (low, high) != (width, width):
        raise ValueError(f"widths from {low} to {high}, not {width}")
    if wrong:
        raise ValueError(f"{wrong} rows with scores that are no finite numbers from 0 to 1")
    return least, most


def require_order(history: DataFrame, queries: DataFrame, strict: bool = True) -> None:
    """Raises ValueError unless all queries come after all history (strict), or not before it."""
    last, first = history.agg(F.max("time")).first()[0], queries.agg(F.min("time")).first()[0]
    if last is not None and first is not None and (last >= first if strict else last > first):
        raise ValueError(f"history reaches {last}, queries begin at {first}")


def verify_manifest(spark: SparkSession, manifest: str, root: str) -> DataFrame:
    """path, expected, actual of files whose SHA-256 differs from a manifest of lines "digest path", or that are missing."""
    listed = spark.read.text(manifest).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+", 2).alias("x"))
    listed = listed.select(F.col("x")[0].alias("expected"), F.col("x")[1].alias("path"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    actual = files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("actual"))
    joined = listed.join(actual, F.expr("endswith(file, concat('/', path))"), "left")
    return joined.where(~F.col("expected").eqNullSafe(F.col("actual"))).select("path", "expected", "actual")
