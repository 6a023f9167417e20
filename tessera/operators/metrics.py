"""Ranking metrics and their aggregates, over hits (query_id, strategy, rank, source) and relevance (query_id, source).

`asked` (query_id, strategy) names what was asked: a query that a strategy finds nothing for then has a row of zeros, as
it must have for means over queries. Without it only queries with hits are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HIT_AT, RECALL_AT = (1, 3, 5, 10), (5, 10)
#: Stands for "no relevant hit" where ranks are compared.
NEVER = 1_000_000_000


def judged(hits: DataFrame, relevance: DataFrame) -> DataFrame:
    """hits with a flag, and the number of relevant sources of the query."""
    wanted = relevance.select("query_id", "source").distinct()
    totals = wanted.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    marked = hits.join(wanted.withColumn("relevant", F.lit(True)), ["query_id", "source"], "left")
    return marked.withColumn("relevant", F.coalesce("relevant", F.lit(False))).join(totals, "query_id", "left")


def expected(hits: DataFrame, asked: DataFrame | None) -> DataFrame:
    """hits, and for everything asked that has none a row without rank and source."""
    return hits if asked is None else asked.select("query_id", "strategy").distinct().join(hits, ["query_id", "strategy"], "left")


def asked_of(queries: DataFrame, strategies: list[str]) -> DataFrame:
    """(query_id, strategy) of every query and every strategy."""
    return queries.select("query_id", F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy"))


def per_query(hits: DataFrame, relevance: DataFrame, keep: tuple[str, ...] = (), asked: DataFrame | None = None) -> DataFrame:
    """First relevant rank, Hit@k, Recall@k and reciprocal rank for each (query, strategy).

    Ranks count hits, repeated sources included; recall counts distinct relevant sources.
    """
    rows = judged(expected(hits, asked), relevance)
    hit = lambda k: F.max(F.when(F.col("relevant") & (F.col("rank") <= k), 1).otherwise(0))
    found = lambda k: F.count_distinct(F.when(F.col("relevant") & (F.col("rank") <= k), F.col("source")))
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    return rows.groupBy("query_id", "strategy", *keep).agg(
        first.alias("first_rank"),
        *[hit(k).alias(f"hit_{k}") for k in HIT_AT],
        *[(found(k) / F.max("n_relevant")).alias(f"recall_{k}") for k in RECALL_AT],
        F.coalesce(1 / first, F.lit(0.0)).alias("reciprocal_rank"),
    )


def macro(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Means over queries."""
    names = [f"hit_{k}" for k in HIT_AT] + [f"recall_{k}" for k in RECALL_AT]
    return metrics.groupBy(*by).agg(F.count("*").alias("queries"), *[F.avg(n).alias(n) for n in names], F.avg("reciprocal_rank").alias("mrr"))


def macro_by_category(metrics: DataFrame, category: str) -> DataFrame:
    """Means for each strategy over all queries (category null) and for each category."""
    names = [f"hit_{k}" for k in HIT_AT] + [f"recall_{k}" for k in RECALL_AT]
    rolled = metrics.rollup("strategy", category).agg(F.count("*").alias("queries"), *[F.avg(n).alias(n) for n in names], F.avg("reciprocal_rank").alias("mrr"))
    return rolled.where(F.col("strategy").isNotNull())


def depth_metrics(hits: DataFrame, relevance: DataFrame, depth: int, hit_at=(1, 3, 5, 10, 20), recall_at=(5, 10, 20, 50), asked: DataFrame | None = None) -> DataFrame:
    """As per_query within a depth: cut-offs beyond it are null; and how many sources repeat."""
    rows = judged(expected(hits.where(F.col("rank") <= depth), asked), relevance)
    own = rows.groupBy("query_id", "strategy", "source").agg(
        F.count("rank").alias("n"), F.min("rank").alias("rank"), F.max("relevant").alias("relevant"), F.max("n_relevant").alias("n_relevant")
    )
    hit = lambda k: (F.max(F.when(F.col("relevant") & (F.col("rank") <= k), 1).otherwise(0)) if k <= depth else F.lit(None).cast("int")).alias(f"hit_{k}")
    recall = lambda k: (F.sum(F.when(F.col("relevant") & (F.col("rank") <= k), 1).otherwise(0)) / F.max("n_relevant") if k <= depth else F.lit(None).cast("double")).alias(f"recall_{k}")
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    return own.groupBy("query_id", "strategy").agg(
        first.alias("first_rank"),
        *[hit(k) for k in hit_at],
        *[recall(k) for k in recall_at],
        F.coalesce(1 / first, F.lit(0.0)).alias("reciprocal_rank"),
        F.count("source").alias("unique_sources"),
        (F.max("n") / F.greatest(F.sum("n"), F.lit(1))).alias("concentration"),
        (F.sum("n") - F.count("source")).alias("duplicates"),
    )


def pairwise(metrics: DataFrame, strategies: list[str]) -> DataFrame:
    """Wins, ties and losses of the first relevant rank for every pair of strategies, in their declared order; finding
    nothing, or having no row, comes behind every rank."""
    ranks = metrics.groupBy("query_id").pivot("strategy", strategies).agg(F.first(F.coalesce("first_rank", F.lit(NEVER))))
    pairs = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.coalesce(a, F.lit(NEVER)).alias("l"), F.coalesce(b, F.lit(NEVER)).alias("r")) for i, a in enumerate(strategies) for b in strategies[i + 1 :]]
    met = ranks.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return met.groupBy("left", "right").agg(count(F.col("l") < F.col("r")).alias("wins"), count(F.col("l") == F.col("r")).alias("ties"), count(F.col("l") > F.col("r")).alias("losses"))


def source_overlap(hits: DataFrame, left: str, right: str, depth: int) -> DataFrame:
    """Jaccard share of common sources of two strategies for each query; two empty sets are alike."""
    sets = hits.where(F.col("rank") <= depth).groupBy("query_id").agg(
        F.collect_set(F.when(F.col("strategy") == left, F.col("source"))).alias("l"), F.collect_set(F.when(F.col("strategy") == right, F.col("source"))).alias("r")
    )
    union = F.size(F.array_union("l", "r"))
    return sets.select("query_id", F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("l", "r")) / union).alias("jaccard"), F.size(F.array_except("l", "r")).alias("only_left"), F.size(F.array_except("r", "l")).alias("only_right"))


def misses(metrics: DataFrame, k: int) -> DataFrame:
    return metrics.where(F.col(f"hit_{k}") == 0)


def disagreements(metrics: DataFrame) -> DataFrame:
    """Queries whose strategies differ in the first relevant rank; finding nothing is a rank of its own."""
    ranks = metrics.groupBy("query_id").agg(F.count_distinct(F.coalesce("first_rank", F.lit(NEVER))).alias("n"))
    return ranks.where(F.col("n") > 1).select("query_id")


def compared(run: DataFrame, reference: DataFrame) -> DataFrame:
    """For each strategy how many queries improved, stayed and degraded against a reference run."""
    key = ["query_id", "strategy"]
    met = run.select(*key, F.col("first_rank").alias("now")).join(reference.select(*key, F.col("first_rank").alias("then")), key, "full")
    met = met.select(*key, *[F.coalesce(c, F.lit(NEVER)).alias(c) for c in ("now", "then")])
    kind = F.when(F.col("now") < F.col("then"), "improved").when(F.col("now") > F.col("then"), "degraded").otherwise("unchanged")
    return met.withColumn("change", kind).groupBy("strategy", "change").agg(F.count("*").alias("queries"))


def nearest_rank(values: str, p: float):
    """The element at ceil(p n) of the sorted values, as an aggregate."""
    rows = F.array_sort(F.collect_list(values))
    return F.element_at(rows, F.ceil(F.lit(p) * F.count(values)).cast("int"))


def budget_summary(selections: DataFrame) -> DataFrame:
    """Token use by strategy: mean, median, nearest-rank 95th percentile. A group is as large as the set of queries."""
    order = Window.partitionBy("strategy").orderBy("actual_selected_tokens", "query_id")
    ranked = selections.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("strategy")))
    return ranked.groupBy("strategy").agg(
        F.avg("actual_selected_tokens").alias("mean_tokens"),
        F.percentile("actual_selected_tokens", F.lit(0.5)).alias("median_tokens"),
        F.max(F.when(F.col("place") == F.ceil(F.col("n") * 0.95), F.col("actual_selected_tokens"))).alias("p95_tokens"),
        F.avg("selected_chunk_count").alias("mean_chunks"),
        F.avg("budget_utilization").alias("mean_utilization"),
    )


def relevance_audit(hits: DataFrame, strategies: list[str], texts: DataFrame, decisions: DataFrame | None = None, excerpt: int = 600) -> DataFrame:
    """(query, source) candidates of all strategies: the best rank of each, a few excerpts, and a decision if there is one."""
    ranks = hits.groupBy("query_id", "source").pivot("strategy", strategies).agg(F.min("rank"))
    shown = hits.join(texts, "chunk_id").groupBy("query_id", "source").agg(F.array_sort(F.collect_set(F.substring("text", 1, excerpt))).alias("excerpts"))
    out = ranks.join(shown, ["query_id", "source"])
    return out if decisions is None else out.join(decisions, ["query_id", "source"], "left")


def revised_relevance(relevance: DataFrame, decisions: DataFrame) -> DataFrame:
    """Relevance with the audited additions, without the audited removals. decisions: (query_id, source, action)."""
    added = decisions.where(F.col("action") == "add").select("query_id", "source")
    removed = decisions.where(F.col("action") == "remove").select("query_id", "source")
    return relevance.select("query_id", "source").union(added).distinct().join(removed, ["query_id", "source"], "left_anti")


def spot_checks(paired: DataFrame, strategies: list[str], most: int = 5) -> DataFrame:
    """For each strategy the questions it leads by the widest margin, and the questions nearest to a tie."""
    best = F.greatest(*strategies)
    kinds = []
    for s in strategies:
        others = [x for x in strategies if x != s]
        margin = F.col(s) - (F.greatest(*others) if len(others) > 1 else F.col(others[0]))
        kinds.append(paired.select(F.lit(s).alias("kind"), "question_id", margin.alias("margin")).where(margin > 0).orderBy(F.col("margin").desc(), "question_id").limit(most))
    spread = best - F.least(*strategies)
    kinds.append(paired.select(F.lit("tie").alias("kind"), "question_id", spread.alias("margin")).orderBy("margin", "question_id").limit(most))
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out
