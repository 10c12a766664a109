"""A list of named stages, each a DataFrame written as a table, skipped while what it depends on is unchanged."""

from __future__ import annotations

import hashlib
import inspect
import json
import os
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    name: str
    build: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()

    def fingerprint(self, inputs: dict[str, str]) -> str:
        source = inspect.getsource(self.build) if inspect.isfunction(self.build) else repr(self.build)
        return hashlib.sha256(json.dumps([self.name, source, sorted(inputs.items())]).encode()).hexdigest()


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> dict | None:
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    with_text = spark.read.text(path, wholetext=True).first()
    return json.loads(with_text[0])


def _write(spark: SparkSession, path: str, value: dict) -> None:
    fs, p = _at(spark, path)
    out = fs.create(p, True)
    out.write(json.dumps(value, indent=2).encode())
    out.close()


def run_stages(spark: SparkSession, stages: list[Stage], root: str, inputs: dict[str, DataFrame], force: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """All stages in order; a stage is skipped if its table and a state with the same fingerprint are there."""
    known, prints = dict(inputs), {n: "given" for n in inputs}
    for stage in stages:
        path, state_path = f"{root}/{stage.name}.parquet", f"{root}/{stage.name}.state.json"
        own = stage.fingerprint({n: prints[n] for n in stage.needs})
        state = _read(spark, state_path)
        fs, p = _at(spark, f"{path}/_SUCCESS")
        if stage.name in force or not state or state["fingerprint"] != own or not fs.exists(p):
            stage.build(spark, {n: known[n] for n in stage.needs}).write.mode("overwrite").parquet(path)
            _write(spark, state_path, {"stage": stage.name, "fingerprint": own, "completed_at": datetime.now(UTC).isoformat()})
        known[stage.name], prints[stage.name] = spark.read.parquet(path), own
    return known


def package(files: dict[str, str], archive: str) -> dict[str, str]:
    """Puts local files (name in the archive: path) into a ZIP file; returns and writes beside it their SHA-256."""
    digests = {}
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as out:
        for name, path in files.items():
            h = hashlib.sha256()
            with open(path, "rb") as f:
                while block := f.read(1 << 20):
                    h.update(block)
            digests[name] = h.hexdigest()
            out.write(path, name)
    with open(os.path.splitext(archive)[0] + ".manifest.json", "w") as f:
        json.dump({"files": digests, "created_at": datetime.now(UTC).isoformat()}, f, indent=2)
    return digests


def append_experiment(spark: SparkSession, path: str, record: dict) -> None:
    """One JSON line more, with the time unless it is given."""
    record = {"timestamp": datetime.now(UTC).isoformat(), **record}
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("append").text(path)
