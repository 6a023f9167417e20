"""Whole benchmarks, composed of operators, with the checks of what they were made from."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import answers, evidence, metrics, retrieval, statistics
from tessera.sources import artifacts
from tessera.sources.files import refuse, repeated

# --- evidence --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Protocols:
    """How hits are selected: the first top_k, or what fits a budget of tokens, each from candidate_k."""

    top_k: int = 10
    candidate_k: int = 50
    budget: int = 2048


def selections(hits: DataFrame, protocols: Protocols) -> tuple[DataFrame, DataFrame]:
    """((protocol, query_id, strategy, chunk_id, rank), the budget's account for each query and strategy)."""
    top = retrieval.same_top_k(hits, protocols.top_k, protocols.candidate_k).select(F.lit("same_top_k").alias("protocol"), "query_id", "strategy", F.col("chunk_id").cast("string").alias("chunk_id"), F.col("rank").cast("int").alias("rank"))
    folded = retrieval.same_token_budget(hits, protocols.budget, protocols.candidate_k)
    fits = folded.select(F.lit("same_token_budget").alias("protocol"), "query_id", "strategy", F.explode("selected").alias("s")).select("protocol", "query_id", "strategy", "s.chunk_id", "s.rank")
    return top.unionByName(fits), folded


def evidence_benchmark(hits: DataFrame, matches: DataFrame, units: DataFrame, strategies: list[str], protocols: Protocols = Protocols()) -> DataFrame:
    """(protocol, strategy, query_id, units, covered_units, evidence_coverage, all_covered, first_rank).

    hits: (query_id, strategy, rank, chunk_id, token_count); matches: evidence.best_matches of the chunks of all strategies;
    units: (query_id, evidence_id). Units that no selected chunk covers count as 0, and so do queries without hits.
    """
    chosen, _ = selections(hits, protocols)
    run = F.struct("protocol", "strategy", "query_id")
    own = units.select("query_id", "evidence_id").distinct()
    # a query's selection is held against its own evidence only
    wanted = matches.join(own, "evidence_id").withColumnRenamed("query_id", "asks")
    met = chosen.withColumn("run", run).join(wanted, "chunk_id").where(F.col("query_id") == F.col("asks"))
    whole = matches.groupBy("evidence_id").agg(F.max("end").alias("high"))
    parts = met.select("run", "evidence_id", "start", "end", F.lit(0).alias("low")).join(whole, "evidence_id")
    covered = evidence.coverage(parts, ["run", "evidence_id"]).join(whole, "evidence_id")
    got = covered.select("run.*", "evidence_id", F.least(F.lit(1.0), F.col("covered") / F.col("high")).alias("coverage"))
    names = [F.struct(F.lit(p).alias("protocol"), F.lit(s).alias("strategy")) for p in ("same_top_k", "same_token_budget") for s in strategies]
    asked = own.withColumn("r", F.explode(F.array(*names))).select("r.*", "query_id", "evidence_id")
    key = ["protocol", "strategy", "query_id"]
    all_units = asked.join(got, [*key, "evidence_id"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    first = met.groupBy(*key).agg(F.min("rank").alias("first_rank"))
    return evidence.evidence_metrics(all_units, key).join(first, key, "left")


def evidence_summary(rows: DataFrame) -> DataFrame:
    """Means by protocol and strategy."""
    return rows.groupBy("protocol", "strategy").agg(
        F.count("*").alias("queries"), F.avg("evidence_coverage").alias("evidence_coverage"), F.avg("all_covered").alias("all_evidence_rate"), F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr")
    )


def fragmentation(matches: DataFrame) -> DataFrame:
    """(evidence_id, chunks, in_one): how few chunks hold an evidence, taking those that reach furthest, as far as they go.

    matches: evidence.best_matches. Intervals on a line are covered with the fewest of them greedily; a gap ends the count
    of what can be covered. An evidence's matches are few, so they are folded in one row.
    """
    rows = matches.groupBy("evidence_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("m"), F.max("length").alias("length"))
    # at: covered so far; reach: furthest end of what starts by then
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("reach"), F.lit(0).alias("n"))

    def step(acc, x):
        late = x["start"] > acc["at"]
        jumped = F.struct(acc["reach"].alias("at"), F.greatest(acc["reach"], x["end"]).alias("reach"), (acc["n"] + 1).alias("n"))
        fits = late & (x["start"] <= acc["reach"]) & (acc["reach"] > acc["at"])
        return F.when(~late, acc.withField("reach", F.greatest(acc["reach"], x["end"]))).when(fits, jumped).otherwise(acc)

    folded = F.aggregate("m", start, step, lambda acc: acc["n"] + F.when(acc["reach"] > acc["at"], 1).otherwise(0))
    one = F.exists("m", lambda x: (x["start"] <= 0) & (x["end"] >= F.col("length")))
    return rows.select("evidence_id", folded.alias("chunks"), one.alias("in_one"))


# --- lineage ---------------------------------------------------------------------------------------------------------


def load_generation(spark: SparkSession, path: str, identity: dict[str, Any], questions: DataFrame, strategy: str | None = None) -> DataFrame:
    """Answers of a complete run that was made with these settings, exactly one for each question (question_id)."""
    answers_ = artifacts.load(spark, path, "answers", identity, unique=["query_id", "strategy"])
    own = answers_ if strategy is None else answers_.where(F.col("strategy") == strategy)
    ids = questions.select(F.col("question_id").alias("query_id")).distinct()
    refuse(ids.join(own, "query_id", "left_anti"), "questions without an answer")
    refuse(own.join(ids, "query_id", "left_anti").select("query_id"), "answers to unknown questions")
    return own


def load_prepared(spark: SparkSession, path: str, questions: DataFrame, strategies: list[str]) -> DataFrame:
    """Contexts of a complete preparation: one for every question and strategy, and no others."""
    rows = artifacts.load(spark, path, "contexts", unique=["query_id", "strategy"])
    wanted = metrics.asked_of(questions.select(F.col("question_id").alias("query_id")).distinct(), strategies)
    refuse(wanted.join(rows, ["query_id", "strategy"], "left_anti").select("query_id"), "questions without a context")
    refuse(rows.join(wanted, ["query_id", "strategy"], "left_anti").select("query_id"), "contexts that nothing asks for")
    return rows


def context_differences(prepared: DataFrame, requests: DataFrame) -> DataFrame:
    """(query_id, strategy): requests whose context is not the one prepared, on either side."""
    a, b = (df.select("query_id", "strategy", F.sha2("context", 256).alias("h")) for df in (prepared, requests))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("query_id", "strategy").distinct()


def handoff_errors(selected: DataFrame, candidates: DataFrame, accounts: DataFrame) -> DataFrame:
    """(query_id, strategy, problem): selections that are no subset of their candidates, or whose count or tokens are not
    those of the account (query_id, strategy, selected_chunk_count, actual_selected_tokens)."""
    key = ["query_id", "strategy"]
    foreign = selected.join(candidates.select(*key, F.col("chunk_id").cast("string").alias("chunk_id")), [*key, "chunk_id"], "left_anti").select(*key, F.lit("not a candidate").alias("problem"))
    sums = selected.groupBy(*key).agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.count_distinct("chunk_id").alias("d"))
    met = accounts.join(sums, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    problem = F.when(zero("n") != F.col("selected_chunk_count"), "count").when(zero("t") != F.col("actual_selected_tokens"), "tokens").when(zero("n") != zero("d"), "repeated chunk")
    return foreign.distinct().unionByName(met.select(*key, problem.alias("problem")).where("problem is not null"))


def context_fingerprints(hits: DataFrame) -> DataFrame:
    """(query_id, strategy, fingerprint): of ranks, chunks and texts in order; scores do not count."""
    rows = hits.groupBy("query_id", "strategy").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("chunk_id"), F.sha2("text", 256).alias("text_sha256")))).alias("h"))
    return rows.select("query_id", "strategy", F.sha2(F.to_json("h"), 256).alias("fingerprint"))


# --- answers ---------------------------------------------------------------------------------------------------------


def metric_names(wanted: list[str]) -> list[str]:
    """token_f1 brings its precision and recall; each name once, in order."""
    known = {"exact": ["exact"], "containment": ["containment"], "token_f1": ["f1", "precision", "recall"]}
    if not wanted or set(wanted) - known.keys():
        raise ValueError(f"metrics are of {sorted(known)}")
    return list(dict.fromkeys(n for w in wanted for n in known[w]))


def answer_benchmark(questions: DataFrame, given: DataFrame, failures: DataFrame, strategies: list[str], normal=answers.canonical_form) -> dict[str, DataFrame]:
    """Tables of a benchmark of answers: records, by strategy, by strategy and type, pairs.

    questions: (question_id, reference, question_type); given: (question_id, strategy, prediction); failures: (question_id,
    strategy, failure). Every question counts for every strategy.
    """
    refuse(repeated(given, ["question_id", "strategy"]), "answers to one question")
    expected = questions.select("question_id", "question_type", F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy"))
    known = answers.evaluate(given.join(questions.select("question_id", "reference"), "question_id"), normal).drop("reference", "prediction")
    records = answers.statuses(expected, known, failures)
    rates = [F.avg(F.when(F.col("status") == s, 1.0).otherwise(0.0)).alias(f"{s}_rate") for s in ("success", "failed", "missing")]
    by = lambda keys: answers.summary(records, keys).join(records.groupBy(*keys).agg(*rates), keys)
    return {"records": records, "by_strategy": by(["strategy"]), "by_type": by(["strategy", "question_type"]), "pairs": answers.paired(records, strategies)}


def score_matrix(paired: DataFrame, strategies: list[str]) -> np.ndarray:
    """(strategies, questions) of complete rows, by question."""
    rows = paired.select("question_id", *strategies).dropna().orderBy("question_id").collect()
    return np.array([[r[s] for r in rows] for s in strategies], float).reshape(len(strategies), -1)


def guarded(values: list[float] | np.ndarray, name: str = "values") -> np.ndarray:
    """One row of finite numbers, or an error."""
    x = np.asarray(values, float)
    if x.ndim != 1 or not len(x) or not np.isfinite(x).all():
        raise ValueError(f"{name} must be one row of finite numbers")
    return x


def retrieval_uncertainty(rows: DataFrame, samples: int = 5_000, seed: int = 20260811) -> DataFrame:
    """(strategy, metric, mean, low, high) of Hit@5 and the reciprocal rank: intervals by the standard library's generator.

    rows: metrics.per_query; a group is one strategy's queries.
    """

    def compute(group) -> dict[str, Any]:
        values = group.sort_values("query_id")["value"].tolist()
        low, high = statistics.paired_bootstrap(values, samples, seed)
        return {"mean": sum(values) / len(values), "low": low, "high": high}

    long = rows.select("query_id", "strategy", F.explode(F.array(F.struct(F.lit("hit_5").alias("metric"), F.col("hit_5").cast("double").alias("value")), F.struct(F.lit("mrr").alias("metric"), F.col("reciprocal_rank").alias("value")))).alias("m")).select("query_id", "strategy", "m.*")
    return statistics.on_group(long, ["strategy", "metric"], compute, "strategy string, metric string, mean double, low double, high double")


# --- publication -----------------------------------------------------------------------------------------------------


def publish_depths(spark: SparkSession, path: str, hits: DataFrame, relevance: DataFrame, strategies: list[str], depths: list[int], identity: dict[str, Any]) -> dict[str, Any]:
    """Metrics, pairs and overlap of candidates for every depth; hits were retrieved once, at the largest."""
    asked = metrics.asked_of(relevance.select("query_id").distinct(), strategies)
    tables: dict[str, DataFrame] = {}
    for d in depths:
        rows = metrics.depth_metrics(hits, relevance, d, asked=asked)
        tables[f"per_query_{d}"] = rows
        tables[f"pairs_{d}"] = metrics.pairwise(rows, strategies)
        for i, a in enumerate(strategies):
            for b in strategies[i + 1 :]:
                tables[f"overlap_{d}_{a}_{b}"] = metrics.source_overlap(hits, a, b, d)
    return artifacts.publish(spark, path, tables, identity | {"depths": depths, "strategies": strategies})


def publish_rewrites(spark: SparkSession, path: str, variants: dict[str, DataFrame], original: DataFrame, relevance: DataFrame, identity: dict[str, Any]) -> dict[str, Any]:
    """Metrics of the variants of experiments.rewrite_variants, and what changed against the original queries."""
    base = metrics.per_query(original.withColumn("strategy", F.lit("run")), relevance)
    tables = {}
    for name, hits in variants.items():
        rows = metrics.per_query(hits.withColumn("strategy", F.lit("run")), relevance)
        tables |= {f"per_query_{name}": rows, f"comparison_{name}": metrics.compared(rows, base)}
    return artifacts.publish(spark, path, tables, identity)


def build_index(spark: SparkSession, path: str, chunks: DataFrame, vectors: DataFrame, settings: dict[str, Any], dimension: int) -> dict[str, Any]:
    """Publish (index_id, vector, payload...) of chunks (chunk_id, strategy, doc_id, source, token_count) and their vectors
    (chunk_id, vector): every chunk has one vector of the dimension, finite, and no vector is without a chunk."""
    from tessera.functions.vector import is_valid

    refuse(repeated(vectors, ["chunk_id"]), "vectors of one chunk")
    refuse(chunks.join(vectors, "chunk_id", "left_anti").select("chunk_id"), "chunks without a vector")
    refuse(vectors.join(chunks, "chunk_id", "left_anti").select("chunk_id"), "vectors without a chunk")
    refuse(vectors.where(~is_valid(F.col("vector"), dimension)).select("chunk_id"), "vectors of another form")
    name = F.sha2(F.concat_ws("|", F.col("chunk_id").cast("string"), F.lit(artifacts.fingerprint(settings))), 256)
    rows = chunks.join(vectors, "chunk_id").withColumn("index_id", name)
    return artifacts.publish(spark, path, {"index": rows}, settings | {"dimension": dimension})


def load_index(spark: SparkSession, path: str, settings: dict[str, Any], dimension: int) -> DataFrame:
    """An index that was built with these settings."""
    return artifacts.load(spark, path, "index", settings | {"dimension": dimension}, unique=["index_id"])


# --- readiness and freezing ------------------------------------------------------------------------------------------


def preflight(spark: SparkSession, documents: DataFrame, chunks: DataFrame, vectors: DataFrame, questions: DataFrame, evidence_rows: DataFrame, dimension: int) -> DataFrame:
    """(check, status): whether a benchmark can run. BLOCKED checks must pass, WARNINGs may not.

    documents: (doc_id, text); chunks: (chunk_id, strategy, doc_id, text); vectors: (chunk_id, vector); questions:
    (question_id, question); evidence_rows: (evidence_id, doc_id, text).
    """
    from tessera.functions.vector import is_valid
    from tessera.operators import audit

    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    texts = documents.select("doc_id", "text")
    checks = {
        "documents have ids of their own": (repeated(documents, ["doc_id"]), "BLOCKED"),
        "chunks have ids of their own": (repeated(chunks, ["chunk_id"]), "BLOCKED"),
        "chunks belong to documents": (chunks.join(texts, "doc_id", "left_anti"), "BLOCKED"),
        "documents have chunks": (texts.where(~blank("text")).join(chunks, "doc_id", "left_anti"), "WARNING"),
        "chunks have vectors": (chunks.join(vectors, "chunk_id", "left_anti"), "BLOCKED"),
        "vectors are finite and of the dimension": (vectors.where(~is_valid(F.col("vector"), dimension)), "BLOCKED"),
        "questions have ids of their own": (repeated(questions, ["question_id"]), "BLOCKED"),
        "questions are not blank": (questions.where(blank("question")), "BLOCKED"),
        "evidence is of known documents": (evidence_rows.join(texts, "doc_id", "left_anti"), "BLOCKED"),
        "documents hold their evidence": (audit.semantic_warnings(evidence_rows, texts), "WARNING"),
    }
    return audit.readiness(checks, spark)


def readiness_verdict(checks: DataFrame) -> str:
    """READY, READY_WITH_WARNINGS or BLOCKED."""
    found = {r["status"] for r in checks.select("status").distinct().collect()}
    return "BLOCKED" if "BLOCKED" in found else "READY_WITH_WARNINGS" if "WARNING" in found else "READY"


class FreezeError(ValueError):
    """A benchmark that does not reproduce its pinned values."""


def freeze_manifest(errors: DataFrame, identity: dict[str, Any], inventory: list[dict[str, Any]], now: datetime | None = None) -> dict[str, Any]:
    """A manifest, only if nothing deviates (experiments.freeze_errors); its fingerprint does not depend on the time."""
    if not errors.isEmpty():
        raise FreezeError(f"{errors.count()} pinned values are not reproduced")
    body = {"identity": identity, "artifacts": sorted(inventory, key=lambda x: x["path"])}
    return body | {"fingerprint": artifacts.fingerprint(body), "created_at": (now or datetime.now(UTC)).isoformat()}


def check_retrieval_manifest(manifest: dict[str, Any] | None, identity: dict[str, Any], pinned: dict[str, Any]) -> None:
    """Raise unless a retrieval run's manifest has the identity's fingerprint and the pinned settings."""
    if not manifest or manifest.get("fingerprint") != artifacts.fingerprint(identity):
        raise FreezeError("the retrieval run was made from something else")
    wrong = {k: manifest.get("identity", {}).get(k) for k, v in pinned.items() if manifest.get("identity", {}).get(k) != v}
    if wrong:
        raise FreezeError(f"settings that are not the pinned ones: {wrong}")
