"""Files beside collections: the folder that all executors share, and small JSON records."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import SparkSession

from .catalog import _fs, _path, read_text, write_once


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where unset, a temporary folder in local mode only."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        d = spark.sparkContext.getCheckpointDir()
    return d.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    _fs(spark, path).rename(_path(spark, path), _path(spark, to))


def children(spark: SparkSession, path: str) -> list[str]:
    if not exists(spark, path):
        return []
    return sorted(s.getPath().getName() for s in _fs(spark, path).listStatus(_path(spark, path)) if s.isDirectory())


def files(spark: SparkSession, path: str) -> list[str]:
    if not exists(spark, path):
        return []
    return sorted(s.getPath().getName() for s in _fs(spark, path).listStatus(_path(spark, path)) if s.isFile())


def size(spark: SparkSession, path: str) -> int:
    return _fs(spark, path).getContentSummary(_path(spark, path)).getLength()


def fingerprint(spark: SparkSession, path: str) -> str:
    """Changes when the files of a table do: names, lengths and times of change."""
    fs, p = _fs(spark, path), _path(spark, path)
    return "|".join(sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in fs.listStatus(p)))


def save(spark: SparkSession, path: str, value) -> bool:
    return write_once(spark, path, json.dumps(value))


def load(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))
