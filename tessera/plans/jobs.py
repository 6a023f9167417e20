"""Jobs for the command line: python -m tessera.plans.jobs JOB --option value ...

Each job reads and writes complete artifact sets (see tessera.sources.artifacts), so that jobs can be chained:
preprocess, chunk, embed, retrieve, lexical, fuse, evaluate, answer, evaluate-answers, analyse.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import answers, chunking, context, metrics, parsing, retrieval
from tessera.plans import experiments
from tessera.session import local_session, ship
from tessera.sources import artifacts, files

JOBS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], object], tuple[str, ...]]] = {}


def job(name: str, *options: str):
    """Register a job with its options; one that ends with ? may be left out."""

    def keep(f):
        JOBS[name] = (f, options)
        return f

    return keep


def saved(spark: SparkSession, a: argparse.Namespace, name: str, df: DataFrame, **identity) -> None:
    """Publish under an identity that names the settings and the sets it was made from; a set of another identity that
    stands there is refused, unless --replace true."""
    options = {k: v for k, v in vars(a).items() if v is not None and k not in ("output", "replace", "job")}
    made_from = {k: found["fingerprint"] for k, v in options.items() if (found := artifacts.manifest(spark, v))}
    made_from |= {k: artifacts.contents_sha256(artifacts.inventory(spark, options[k]).select("length", "sha256")) for k in FILES if k in options}
    settings = {k: v for k, v in options.items() if k not in made_from}
    artifacts.publish(spark, a.output, {name: df}, {"job": a.job, "settings": settings, "inputs": made_from} | identity, replace=a.replace == "true")


#: Options that name plain files, which count by their contents.
FILES = ("input", "queries", "relevance", "references")


@job("preprocess", "input", "source", "output", "fail-fast?")
def preprocess(spark, a):
    """A tree of Markdown files to parsed documents; problems are printed. A file that cannot be parsed is left out and
    printed too, or, with --fail-fast true, fails the job."""
    docs = parsing.parse_documents(files.markdown_files(spark, a.input, a.source), fail_fast=a.fail_fast == "true")
    if "parse_error" in docs.columns:
        failed = docs.where("parse_error is not null").select("relative_path", "parse_error")
        if not failed.isEmpty():
            print(artifacts.markdown_table(failed))
        docs = docs.where("parse_error is null").drop("parse_error")
    saved(spark, a, "documents", docs)
    errors = parsing.corpus_errors(artifacts.load(spark, a.output, "documents"))
    print(artifacts.markdown_table(errors) if not errors.isEmpty() else "no problems")


@job("chunk", "documents", "strategy", "output", "size?", "overlap?")
def chunk(spark, a):
    """Chunks by one strategy; chunks that break their contract are not written."""
    docs = artifacts.load(spark, a.documents, "documents", unique=["doc_id"])
    if a.strategy == "fixed":
        linear = docs.select("doc_id", parsing.linear_text(F.col("blocks")).alias("text"))
        chunks = chunking.fixed_chunks(linear, int(a.size or 512), int(a.overlap or 64)).withColumn("strategy", F.lit("fixed"))
    else:
        chunks = chunking.chunk_documents(docs, a.strategy)
    wrong = chunking.window_gaps(chunks) if a.strategy == "fixed" else chunking.contract_errors(chunks)
    if not wrong.isEmpty():
        raise ValueError("the chunks are not contiguous, or their links are not mutual")
    saved(spark, a, "chunks", chunks)
    print(artifacts.markdown_table(chunking.chunk_statistics(artifacts.load(spark, a.output, "chunks"))))


@job("embed", "chunks", "output", "dimension?")
def embed(spark, a):
    """Vectors by the offline provider; callers with a model use tessera.operators.context.embed."""
    rows = context.embed(artifacts.load(spark, a.chunks, "chunks"), int(a.dimension or 64))
    saved(spark, a, "vectors", rows.select("chunk_id", "doc_id", "strategy", "text_sha256", "vector"))


@job("retrieve", "vectors", "queries", "output", "k?")
def retrieve(spark, a):
    """queries: JSON lines (query_id, query)."""
    vectors = artifacts.load(spark, a.vectors, "vectors")
    size = vectors.select(F.size("vector").alias("n")).first()["n"]
    asked = context.embed(files.json_lines(spark, a.queries, "query_id string, query string"), size, "query")
    hits = retrieval.cosine_search(asked, vectors, int(a.k or 50))
    saved(spark, a, "hits", hits.join(vectors.select("chunk_id", "doc_id", "strategy"), "chunk_id"))


@job("lexical", "chunks", "queries", "output", "k?")
def lexical(spark, a):
    chunks = artifacts.load(spark, a.chunks, "chunks")
    hits = retrieval.bm25_search(files.json_lines(spark, a.queries, "query_id string, query string"), chunks, int(a.k or 50))
    saved(spark, a, "hits", hits.join(chunks.select("chunk_id", "doc_id", "strategy"), "chunk_id"))


@job("fuse", "first", "second", "output", "k?")
def fuse(spark, a):
    runs = [artifacts.load(spark, p, "hits") for p in (a.first, a.second)]
    fused = retrieval.reciprocal_rank_fusion(runs, int(a.k or 50))
    names = runs[0].select("chunk_id", "doc_id", "strategy").union(runs[1].select("chunk_id", "doc_id", "strategy")).distinct()
    saved(spark, a, "hits", fused.join(names, "chunk_id"))


@job("evaluate", "hits", "relevance", "output")
def evaluate(spark, a):
    """relevance: JSON lines (query_id, source, category), where source is a document's id."""
    wanted = files.json_lines(spark, a.relevance, "query_id string, source string, category string")
    hits = artifacts.load(spark, a.hits, "hits").withColumn("source", F.col("doc_id").cast("string"))
    experiment = experiments.Experiment("evaluate", "E0", 50, "ranked")
    experiments.publish_ranked(spark, a.output, experiment, hits, wanted.select("query_id", "source"), wanted.select("query_id", "category").distinct())
    print(artifacts.markdown_table(artifacts.load(spark, a.output, "aggregate")))


@job("answer", "hits", "chunks", "queries", "output", "budget?")
def answer(spark, a):
    """Contexts within a token budget, prompts, and answers by the offline provider; resumes what broke off."""
    chunks = artifacts.load(spark, a.chunks, "chunks").select("chunk_id", "text", "token_count")
    hits, budget = artifacts.load(spark, a.hits, "hits").join(chunks, "chunk_id"), int(a.budget or 2048)
    taken = retrieval.same_token_budget(hits, budget, 50).select("query_id", "strategy", F.explode("selected.chunk_id").alias("chunk_id"))
    contexts = context.render_contexts(hits.join(taken, ["query_id", "strategy", "chunk_id"]))
    questions = files.json_lines(spark, a.queries, "query_id string, query string").withColumnRenamed("query", "question")
    ready, failed = context.prompts(contexts, questions, "Answer from the context.", 128_000, 2048)
    done = experiments.run_generation(spark, a.output, ready, {"job": "answer", "budget": budget})
    print("complete" if done and failed.isEmpty() else artifacts.markdown_table(failed))


@job("evaluate-answers", "answers", "references", "output")
def evaluate_answers(spark, a):
    """references: JSON lines (question_id, reference)."""
    given = artifacts.load(spark, a.answers, "answers").select(F.col("query_id").alias("question_id"), "strategy", F.col("answer").alias("prediction"))
    wanted = files.json_lines(spark, a.references, "question_id string, reference string")
    saved(spark, a, "scores", answers.evaluate(given.join(wanted, "question_id")))
    print(artifacts.markdown_table(answers.summary(artifacts.load(spark, a.output, "scores"), ["strategy"])))


@job("analyse", "scores", "output")
def analyse(spark, a):
    scores = artifacts.load(spark, a.scores, "scores")
    strategies = [r[0] for r in scores.select("strategy").distinct().orderBy("strategy").collect()]
    found = experiments.paired_analysis(spark, scores, strategies)
    saved(spark, a, "analysis", found)
    found = artifacts.load(spark, a.output, "analysis")
    print(artifacts.markdown_table(found) + "\n\n" + experiments.conclusion(found))


@job("budget-metrics", "hits", "relevance", "k?")
def budget_metrics(spark, a):
    """Ranking metrics of the first k hits, printed."""
    wanted = files.json_lines(spark, a.relevance, "query_id string, source string, category string").select("query_id", "source")
    hits = retrieval.same_top_k(artifacts.load(spark, a.hits, "hits"), int(a.k or 10), 50).withColumn("source", F.col("doc_id").cast("string"))
    print(artifacts.markdown_table(metrics.macro(metrics.per_query(hits, wanted), ["strategy"])))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    kinds = parser.add_subparsers(dest="job", required=True)
    for name, (f, options) in JOBS.items():
        one = kinds.add_parser(name, help=f.__doc__)
        for o in (*options, *(("replace?",) if "output" in options else ())):
            one.add_argument(f"--{o.rstrip('?')}", required=not o.endswith("?"))
    chosen = parser.parse_args(args)
    spark = spark or SparkSession.getActiveSession() or local_session()
    ship(spark)
    JOBS[chosen.job][0](spark, chosen)


if __name__ == "__main__":
    main()
