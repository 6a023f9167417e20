"""Publishing results: data first, statistics next, the manifest last, which alone makes a set complete."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StaleArtifactError(ValueError):
    """A set with another identity stands where one would be written."""


def canonical_json(value: Any) -> str:
    """Sorted keys, no blanks, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fingerprint(value: Any) -> str:
    """Of the settings that change an output: never times, paths or counters."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def check_json(value: Any) -> None:
    """String keys and finite numbers all the way down."""
    if isinstance(value, dict):
        for k, v in value.items():
            if not isinstance(k, str):
                raise ValueError(f"not a text: {k!r}")
            check_json(v)
    elif isinstance(value, (list, tuple)):
        for v in value:
            check_json(v)
    elif isinstance(value, float) and not math.isfinite(value):
        raise ValueError("a number is not finite")


class Folder:
    """A folder in any store that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def read(self, name: str) -> str:
        return "\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect())

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: written beside, and swapped in."""
        beside = self.at(f".{name}.new")
        out = self.fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.replace(f".{name}.new", name)

    def rename(self, old: str, new: str) -> None:
        self.fs.mkdirs(self.at(new).getParent())
        if not self.fs.rename(self.at(old), self.at(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def replace(self, old: str, new: str) -> None:
        """old takes new's place; what stood there is set aside until it does, and comes back if it does not."""
        aside = f".{new.replace('/', '_')}.old"
        if self.exists(new):
            self.delete(aside)
            self.rename(new, aside)
        try:
            self.rename(old, new)
        except Exception:
            if self.exists(aside):
                self.rename(aside, new)
            raise
        self.delete(aside)

    def mark(self, name: str, text: str) -> None:
        """A file that nothing reads before it is whole."""
        out = self.fs.create(self.at(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self._path(self.path))) if self.fs.exists(self._path(self.path)) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def read_json(spark: SparkSession, path: str, name: str) -> Any:
    return json.loads(Folder(spark, path).read(name))


def manifest(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The manifest of a complete set, or None."""
    folder = Folder(spark, path)
    recover(folder)
    return json.loads(folder.read("manifest.json")) if folder.exists("manifest.json") else None


BACKUP, STAGED = ".backup", ".staged"


def recover(folder: Folder) -> None:
    """After a publication that died half way: the set that stood there before is put back.

    The backup's mark stands from before the first old part is set aside until the new set is whole. Old parts are in the
    backup or still in their place; parts that had no predecessor go.
    """
    if folder.exists(f"{BACKUP}/mark"):
        mark = json.loads(folder.read(f"{BACKUP}/mark"))
        for name in mark["names"]:
            if folder.exists(f"{BACKUP}/{name}"):
                folder.delete(name)
                folder.rename(f"{BACKUP}/{name}", name)
            elif name not in mark["existed"]:
                folder.delete(name)
        folder.delete(f"{BACKUP}/mark")


def swap(folder: Folder, names: list[str]) -> None:
    """The staged parts take the places of the old ones, the last named last; any failure puts the old ones back."""
    existed = [name for name in names if folder.exists(name)]
    folder.delete(BACKUP)
    folder.mark(f"{BACKUP}/mark", json.dumps({"names": names, "existed": existed}))
    try:
        for name in existed:
            folder.rename(name, f"{BACKUP}/{name}")
        for name in names:
            folder.rename(f"{STAGED}/{name}", name)
    except Exception:
        recover(folder)
        raise
    folder.delete(f"{BACKUP}/mark")
    folder.delete(BACKUP)


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], identity: dict[str, Any], statistics: dict[str, Any] | None = None, replace: bool = False) -> dict[str, Any]:
    """Write tables as Parquet, then stats.json, then manifest.json, all or nothing.

    Everything is staged first, so that a failed job leaves the set that stood there; then the parts are swapped in, and a
    failure between two of them puts the old set back. A set of another identity is not replaced unless asked.
    """
    folder = Folder(spark, path)
    own = fingerprint(identity)
    standing = manifest(spark, path)
    if standing and standing["fingerprint"] != own and not replace:
        raise StaleArtifactError(path)
    check_json(statistics or {})
    folder.delete(STAGED)
    counts = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.path}/{STAGED}/{name}.parquet")
        counts[name] = spark.read.parquet(f"{folder.path}/{STAGED}/{name}.parquet").count()
    out = {"fingerprint": own, "identity": identity, "counts": counts}
    folder.mark(f"{STAGED}/stats.json", json.dumps(statistics or {}, indent=2, sort_keys=True))
    folder.mark(f"{STAGED}/manifest.json", json.dumps(out, indent=2, sort_keys=True))
    swap(folder, [*[f"{name}.parquet" for name in tables], "stats.json", "manifest.json"])
    folder.delete(STAGED)
    return out


def load(spark: SparkSession, path: str, name: str, identity: dict[str, Any] | None = None, unique: list[str] | None = None, single: str | None = None) -> DataFrame:
    """A table of a complete set, whose count must be the manifest's.

    identity: what the set must have been made from; unique: columns that must tell the rows apart; single: a column that
    must hold one value.
    """
    found = manifest(spark, path)
    if found is None:
        raise StaleArtifactError(f"{path} has no manifest")
    if identity is not None and found["fingerprint"] != fingerprint(identity):
        raise StaleArtifactError(f"{path} was made from something else")
    df = spark.read.parquet(f"{path}/{name}.parquet")
    if df.count() != found["counts"][name]:
        raise StaleArtifactError(f"{name} does not have {found['counts'][name]} rows")
    if unique and not df.groupBy(*unique).count().where("count > 1").isEmpty():
        raise StaleArtifactError(f"{name} has rows of one {', '.join(unique)}")
    if single and df.select(single).distinct().limit(2).count() > 1:
        raise StaleArtifactError(f"{name} has several values of {single}")
    return df


def contents_sha256(df: DataFrame) -> str:
    """A fingerprint of the rows, whatever their order: hashes of the rows' canonical lines, added up part by part."""
    lines = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    part = lambda i: F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")
    total = lines.agg(F.count("*"), *[F.sum(part(i)) for i in range(5)]).first()
    return hashlib.sha256(canonical_json([str(x) for x in total]).encode()).hexdigest()


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, sha256) of every file below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return raw.select("path", "length", F.sha2("content", 256).alias("sha256"))


def json_lines_of(df: DataFrame, order: list[str]) -> DataFrame:
    """One column, `value`: rows as compact JSON with sorted keys, nulls kept, in the given order."""
    keys = sorted(df.columns)
    ordered = df.orderBy(*order).select(*keys)
    return ordered.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("value"))


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; a larger one is refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no report")
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in df.columns) + " |" for r in rows])
