"""Versions of a set of tables, published by one small file.

A writer puts its tables into new folders, which nobody reads until a manifest of the next number names them. A
manifest is created once and never replaced: of two writers that start from one version the second fails, and a
writer that fails midway leaves the version before as it was. A reader takes the highest manifest, so it sees all tables
of one version.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_MANIFESTS = "_manifests"


class Conflict(RuntimeError):
    """Another writer has published a version since this one began."""


@dataclass(frozen=True)
class Version:
    """A published version: its number (0: none yet) and what its manifest says."""

    number: int = 0
    content: dict = field(default_factory=dict)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    at, fs = _hadoop(spark, f"{path}/{_MANIFESTS}")
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())


def _read(spark: SparkSession, path: str, number: int) -> Version:
    at, fs = _hadoop(spark, f"{path}/{_MANIFESTS}/{number:012d}.json")
    source = fs.open(at)
    try:
        raw = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
    return Version(number, json.loads(raw))


def latest(spark: SparkSession, path: str) -> Version:
    """The version that readers see now."""
    numbers = _numbers(spark, path)
    return _read(spark, path, numbers[-1]) if numbers else Version()


def commit(spark: SparkSession, path: str, base: Version, content: dict) -> Version:
    """Publish ``content`` as the version after ``base``; a ``Conflict`` if there is one already.

    The manifest is written under another name and renamed, which fails where the name is taken.
    """
    number = base.number + 1
    target, fs = _hadoop(spark, f"{path}/{_MANIFESTS}/{number:012d}.json")
    draft, _ = _hadoop(spark, f"{path}/{_MANIFESTS}/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(json.dumps(content, sort_keys=True).encode())
    finally:
        out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(draft), fs.makeQualified(target), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(target):
            raise Conflict(f"version {number} of {path} is there already") from e
        raise
    return Version(number, content)


def new_name(prefix: str = "v") -> str:
    return f"{prefix}{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], **about) -> Version:
    """Write all ``tables`` as Parquet and publish them together; ``about`` is kept beside them in the manifest.

    Tables may be derived from the version that they replace, whose files stay until ``vacuum``.
    """
    base, folder = latest(spark, path), new_name()
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}")
    return commit(spark, path, base, {"tables": {name: f"{folder}/{name}" for name in tables}, **about})


def opened(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the latest version; none are published: an empty dict."""
    return {name: spark.read.parquet(f"{path}/{folder}") for name, folder in latest(spark, path).content.get("tables", {}).items()}


def _named(content) -> set[str]:
    """Every string of a manifest that may be a folder below the path, by its first component."""
    if isinstance(content, dict):
        content = list(content.values())
    if isinstance(content, list):
        return set().union(*map(_named, content))
    return {content.split("/")[0]} if isinstance(content, str) else set()


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove manifests but the last ``keep``, and folders that none of these name; the number of folders removed.

    Readers of the versions kept lose nothing. Run it when no writer is at work: what a writer has not published yet goes too.
    """
    numbers = _numbers(spark, path)
    kept = set().union(*(_named(_read(spark, path, n).content) for n in numbers[-keep:]))
    for n in numbers[:-keep]:
        at, fs = _hadoop(spark, f"{path}/{_MANIFESTS}/{n:012d}.json")
        fs.delete(at, False)
    at, fs = _hadoop(spark, path)
    gone = [f.getPath() for f in fs.listStatus(at) if f.isDirectory() and f.getPath().getName() not in kept | {_MANIFESTS}] if fs.exists(at) else []
    for p in gone:
        fs.delete(p, True)
    return len(gone)
