"""Requests to providers and what they were answered, kept in a folder so that no request is asked twice.

A store belongs to one identity (settings, and whatever else an answer depends on), written before the first request is
asked; another identity is refused. One writer at a time holds the store's lease: a file created exclusively, renewed with
every batch, and checked before each commit. Requests that the store lacks are dealt into batches by a hash of their key;
a batch is asked by all tasks, written beside the store and renamed into it, so that a run that breaks off loses one batch
at most. A batch has a folder of its own to read its requests from, and there are BATCHES at most: neither what a batch reads
nor the number of Spark jobs grows with the number of requests. Whatever reads answers, failures or counts reads these files: no plan that is executed twice asks twice.

A request is asked again only if a task dies, or its executor is lost, before the request's batch is committed, or if it
failed: failures are kept with their reason, and a later run tries them once more.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import artifacts

ROWS = "key string, request string, answer string, problem string"
#: Requests in a batch, on average: what a run that breaks off may have to ask again.
BATCH_REQUESTS = 2000
#: Batches at most: of more requests than fit them, each takes a hundredth.
BATCHES = 100
#: Seconds without a renewal after which a lease counts as abandoned.
PATIENCE = 3600.0

#: Fills answer and problem (one of them null) beside key and request.
Solver = Callable[[DataFrame], DataFrame]


class BusyError(RuntimeError):
    """Another writer holds the store."""


def each(ask: Callable[[str], str], errors: tuple[type[Exception], ...] = (ValueError, RuntimeError, OSError)) -> Solver:
    """A solver of a function from a request's text to an answer. What it raises of `errors` fails that request alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers: list[str | None] = []
            problems: list[str | None] = []
            for request in batch.column(1).to_pylist():
                try:
                    answers.append(ask(request))
                    problems.append(None if answers[-1] is not None else "no answer")
                except errors as e:
                    answers.append(None)
                    problems.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(answers, pa.string()), pa.array(problems, pa.string())], ["key", "request", "answer", "problem"])

    return lambda rows: rows.select("key", "request").mapInArrow(run, ROWS)


def by_column(provider: Callable[[Column], Column]) -> Solver:
    """A solver of a Column of the request; null is a failure."""

    def solve(rows: DataFrame) -> DataFrame:
        got = rows.select("key", "request", provider(F.col("request")).cast("string").alias("answer"))
        return got.withColumn("problem", F.when(F.col("answer").isNull(), F.lit("no answer")))

    return solve


@dataclass
class Counts:
    """Of the distinct requests of one fill: found in the store, answered, failed."""

    reused: int
    answered: int
    failed: int


class AnswerStore:
    """Answers of one identity below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, identity: dict[str, Any], patience: float = PATIENCE):
        self.spark, self.path, self.patience = spark, path.rstrip("/"), patience
        self.folder = artifacts.Folder(spark, path)
        self.identity = artifacts.fingerprint(identity)
        self.token: str | None = None
        standing = self._text("identity.json")
        if standing is None:
            with self.lease():
                if self._text("identity.json") is None:
                    self.folder.write("identity.json", artifacts.canonical_json({"fingerprint": self.identity, "identity": identity}))
            standing = self._text("identity.json")
        if f'"{self.identity}"' not in (standing or ""):
            raise artifacts.StaleArtifactError(f"{path} holds answers of another identity")

    def _text(self, name: str) -> str | None:
        return self.folder.read(name) if self.folder.exists(name) else None

    # --- one writer

    def _create(self, name: str, text: str) -> bool:
        """Create a file that nobody else has created."""
        at = self.folder.at(name)
        self.folder.fs.mkdirs(at.getParent())
        if self.folder.fs.getScheme() == "file":
            try:
                f = os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                return False
            with os.fdopen(f, "w") as out:
                out.write(text)
            return True
        try:
            out = self.folder.fs.create(at, False)
        except Exception as e:  # of the JVM: FileAlreadyExistsException, and its kin in other stores
            if "exist" in str(e).lower():
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    @contextmanager
    def lease(self) -> Iterator[None]:
        """Hold the store; BusyError if another does. An abandoned lease is set aside first: of several that try, only one
        succeeds in renaming it."""
        if self.token is not None:
            yield
            return
        token = uuid.uuid4().hex
        if self.folder.exists("lease"):
            age = time.time() - self.folder.fs.getFileStatus(self.folder.at("lease")).getModificationTime() / 1000
            if age < self.patience:
                raise BusyError(f"{self.path} is held by another writer")
            self.folder.rename("lease", f".abandoned-{token}")
            self.folder.delete(f".abandoned-{token}")
        if not self._create("lease", token):
            raise BusyError(f"{self.path} is held by another writer")
        self.token = token
        try:
            yield
        finally:
            self.token = None
            if self._text("lease") == token:
                self.folder.delete("lease")

    def _renew(self) -> None:
        """Still ours? Then it is as new."""
        if self._text("lease") != self.token:
            raise BusyError(f"{self.path} was taken over by another writer")
        now = int(time.time() * 1000)
        self.folder.fs.setTimes(self.folder.at("lease"), now, -1)

    # --- what was answered

    def rows(self) -> DataFrame:
        """(key, request, answer, problem) of all committed batches."""
        if not any(n.startswith("batch-") for n in artifacts.Folder(self.spark, f"{self.path}/answers").names()):
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/answers/batch-*")

    def answers(self) -> DataFrame:
        """(key, request, answer): one row for each request that has one."""
        return self.rows().where("answer is not null").select("key", "request", "answer")

    def failures(self) -> DataFrame:
        """(key, request, problem): requests without an answer, with the reason that was given last."""
        bad = self.rows().where("answer is null").groupBy("key").agg(F.min("request").alias("request"), F.max("problem").alias("problem"))
        return bad.join(self.answers().select("key"), "key", "left_anti")

    def _commit(self, rows: DataFrame) -> None:
        name = f"batch-{uuid.uuid4().hex}"
        rows.select("key", "request", "answer", "problem").write.mode("overwrite").parquet(f"{self.path}/answers/.{name}")
        self._renew()
        self.folder.rename(f"answers/.{name}", f"answers/{name}")

    def lacking(self, requests: DataFrame) -> DataFrame:
        """(key, request): each distinct request that has no answer yet. A key of another request is an error."""
        unique = requests.groupBy("key").agg(F.min("request").alias("request"), F.max("request").alias("last"))
        met = unique.join(self.answers().select("key", F.col("request").alias("stored")), "key", "left")
        clash = (F.col("request") != F.col("last")) | (F.col("stored") != F.col("request"))
        fresh = F.when(clash, F.raise_error(F.lit("a key belongs to another request")).cast("boolean")).otherwise(F.col("stored").isNull())
        return met.where(fresh).select("key", "request")

    def seed(self, answers: DataFrame, requests: DataFrame) -> None:
        """Take over answers (key, request, answer) that were given elsewhere to some of the requests."""
        with self.lease():
            given = answers.select("key", F.col("request").alias("stored"), "answer").where("answer is not null")
            met = self.lacking(requests).join(given, "key")
            checked = F.when(F.col("stored") != F.col("request"), F.raise_error(F.lit("a key belongs to another request")).cast("string")).otherwise(F.col("request"))
            self._commit(met.select("key", checked.alias("request"), "answer", F.lit(None).cast("string").alias("problem")))

    def fill(self, requests: DataFrame, solve: Solver, batch_requests: int = BATCH_REQUESTS) -> Counts:
        """Ask what the store lacks of requests (key, request), and commit it batch by batch."""
        with self.lease():
            folder = artifacts.Folder(self.spark, f"{self.path}/answers")
            for left in folder.names():
                if left.startswith(".batch-"):  # of a run that died
                    folder.delete(left)
            asked = f"{self.path}/asked-{uuid.uuid4().hex}"
            every = requests.select("key").distinct().count()
            self.lacking(requests).write.parquet(asked)
            fresh = self.spark.read.parquet(asked)
            count = fresh.count()
            batches = min(BATCHES, -(-count // batch_requests))
            tasks = self.spark.sparkContext.defaultParallelism
            before = self.rows().where("answer is null").count()
            if batches > 1:
                fresh.withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(batches))).repartition("batch").write.partitionBy("batch").parquet(f"{asked}/dealt")
            for b in range(batches):
                own = f"{asked}/dealt/batch={b}" if batches > 1 else asked
                if self.folder.exists(own.removeprefix(f"{self.path}/")):  # a hash may leave a batch without requests
                    part = self.spark.read.schema("key string, request string").parquet(own)
                    self._commit(solve(part.repartition(tasks, "key")))
            self.folder.delete(asked.rsplit("/", 1)[1])
            failed = self.rows().where("answer is null").count() - before
            return Counts(every - count, count - failed, failed)
