"""The queries of the engine's own operators, by name, and the SQL that must return the same rows.

Every query runs over whole tables. Searches ask with every row whose id is divisible by 50, against all rows. Scores are
rounded, since sums of floating-point numbers depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.vector import hashed_embedding
from tessera.operators import answers, audit, chunking, context, evidence, metrics, normality, parsing, resampling, retrieval, statistics
from tessera.plans import experiments
from tessera.session import spread
from tessera.session import table as scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DEPTH = 20
#: Resamples of the registered bootstraps and draws of the permutation tests: the operators' own number; and of strata, grids
#: and winners, those of `experiments.strata`.
RESAMPLES, FEWER = resampling.RESAMPLES, 5_000


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is some."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; those of texts are spread over the cores where they have few splits."""
    df = scan(spark, sf_dir, name)
    return spread(df) if name in ("documents", "conversations") else df


def r6(c) -> F.Column:
    return F.round(c if not isinstance(c, str) else F.col(c), 6)


# --- dense retrieval over embeddings ---------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str, half: bool = False) -> DataFrame:
    v = F.slice("embedding", 1, 32) if half else F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), v.alias("vector"), F.col("label").cast("string").alias("source"))


def hits(spark: SparkSession, sf_dir: str, strategies: tuple[str, ...] = ("full", "half"), k: int = DEPTH) -> DataFrame:
    """(query_id, strategy, rank, score, chunk_id, source, token_count): all components, and the first half of them."""
    out = None
    for s in strategies:
        rows = vectors(spark, sf_dir, s == "half")
        asked = rows.where(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), "vector")
        found = retrieval.cosine_search(asked, rows, k, exclude_same=True).withColumn("strategy", F.lit(s))
        out = found if out is None else out.unionByName(found)
    payload = vectors(spark, sf_dir).select("chunk_id", "source")
    return out.join(payload, "chunk_id").withColumn("token_count", 40 + F.pmod(F.col("chunk_id") * 37, F.lit(400)))


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), "source")


HITS = """
v AS (SELECT vec_id, label::VARCHAR AS source, embedding::DOUBLE[] AS e FROM embeddings),
scored AS (
  SELECT q.vec_id AS query_id, 'full' AS strategy, c.vec_id AS chunk_id, c.source, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
  UNION ALL
  SELECT q.vec_id, 'half', c.vec_id, c.source, list_cosine_similarity(q.e[1:32], c.e[1:32]) FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
hits AS (
  SELECT *, 40 + (chunk_id * 37) % 400 AS token_count FROM (SELECT *, row_number() OVER (PARTITION BY query_id, strategy ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 20),
relevance AS (SELECT vec_id AS query_id, source FROM v WHERE vec_id % 50 = 0),
judged AS (SELECT h.*, r.source IS NOT NULL AS relevant FROM hits h LEFT JOIN relevance r USING (query_id, source)),
per_query AS (
  SELECT query_id, strategy, min(rank) FILTER (relevant) AS first_rank,
    max((relevant AND rank <= 1)::INT) AS hit_1, max((relevant AND rank <= 3)::INT) AS hit_3, max((relevant AND rank <= 5)::INT) AS hit_5, max((relevant AND rank <= 10)::INT) AS hit_10,
    count(DISTINCT source) FILTER (relevant AND rank <= 5) / 1.0 AS recall_5, count(DISTINCT source) FILTER (relevant AND rank <= 10) / 1.0 AS recall_10,
    coalesce(1.0 / min(rank) FILTER (relevant), 0) AS reciprocal_rank
  FROM judged GROUP BY ALL)"""


@query(f"WITH {HITS} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM hits WHERE strategy = 'full'")
def cosine_topk(spark, sf_dir):
    return hits(spark, sf_dir, ("full",)).select("query_id", "rank", "chunk_id", r6("score").alias("score"))


@query("""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.label = 3 AND q.vec_id <> c.vec_id)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, round(score, 6) AS score FROM s) WHERE rank <= 5""")
def cosine_topk_filtered(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    asked = rows.where(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), "vector")
    found = retrieval.cosine_search(asked, retrieval.with_filters(rows, {"source": "3"}), 5, exclude_same=True)
    return found.select("query_id", "rank", "chunk_id", r6("score").alias("score"))


@query(f"WITH {HITS} SELECT query_id, strategy, rank, chunk_id FROM hits WHERE rank <= 5")
def same_top_k(spark, sf_dir):
    return retrieval.same_top_k(hits(spark, sf_dir), 5, 10).select("query_id", "strategy", "rank", "chunk_id")


BUDGET = f"""WITH RECURSIVE {HITS},
fold AS (
  SELECT DISTINCT query_id, strategy, 0 AS i, 0::BIGINT AS used, 0 AS n, false AS overflow, '' AS ranks FROM hits
  UNION ALL
  SELECT query_id, strategy, i + 1, used + CASE WHEN take THEN token_count ELSE 0 END, n + take::INT, overflow OR (n = 0 AND token_count > 1024), ranks || CASE WHEN take THEN rank || ' ' ELSE '' END
  FROM (SELECT f.*, h.rank, h.token_count, NOT f.overflow AND (f.n = 0 OR f.used + h.token_count <= 1024) AS take FROM fold f JOIN hits h ON h.query_id = f.query_id AND h.strategy = f.strategy AND h.rank = f.i + 1)),
selections AS (SELECT query_id, strategy, 20 AS candidate_count, n AS selected_chunk_count, used AS actual_selected_tokens, used / 1024.0 AS budget_utilization, overflow AS budget_overflow, trim(ranks) AS ranks FROM fold WHERE i = 20)"""


def selections(spark, sf_dir):
    return retrieval.same_token_budget(hits(spark, sf_dir), 1024, DEPTH)


@query(f"{BUDGET} SELECT query_id, strategy, candidate_count, selected_chunk_count, actual_selected_tokens, round(budget_utilization, 6) AS budget_utilization, budget_overflow, ranks FROM selections")
def same_token_budget(spark, sf_dir):
    ranks = F.array_join(F.transform("selected", lambda h: h["rank"].cast("string")), " ")
    return selections(spark, sf_dir).select("query_id", "strategy", "candidate_count", "selected_chunk_count", "actual_selected_tokens", r6("budget_utilization").alias("budget_utilization"), "budget_overflow", ranks.alias("ranks"))


@query(f"{BUDGET} SELECT strategy, round(avg(actual_selected_tokens), 6) AS mean_tokens, quantile_cont(actual_selected_tokens, 0.5) AS median_tokens, list_sort(list(actual_selected_tokens))[ceil(0.95 * count(*))::INT] AS p95_tokens, round(avg(selected_chunk_count), 6) AS mean_chunks, round(avg(budget_utilization), 6) AS mean_utilization FROM selections GROUP BY strategy")
def budget_summary(spark, sf_dir):
    s = metrics.budget_summary(selections(spark, sf_dir))
    return s.select("strategy", r6("mean_tokens").alias("mean_tokens"), "median_tokens", "p95_tokens", r6("mean_chunks").alias("mean_chunks"), r6("mean_utilization").alias("mean_utilization"))


@query(f"""WITH {HITS}, f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM hits GROUP BY ALL)
SELECT query_id, rank, chunk_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM f) WHERE rank <= 10""")
def rrf_fusion(spark, sf_dir):
    all_hits = hits(spark, sf_dir)
    fused = retrieval.reciprocal_rank_fusion([all_hits.where(F.col("strategy") == s) for s in ("full", "half")], 2 * DEPTH)
    again = retrieval.top(fused.withColumn("score", F.round("score", 12)), 10)  # sums in either order rank alike
    return again.select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"))


@query(f"""WITH {HITS}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS own FROM hits WHERE strategy = 'full')
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, chunk_id, source FROM c WHERE own <= 2) WHERE rank <= 8""")
def source_cap(spark, sf_dir):
    return retrieval.source_cap(hits(spark, sf_dir, ("full",)), 2, 8).select("query_id", "rank", "chunk_id", "source")


@query(f"""WITH {HITS}, p AS (SELECT query_id, strategy, rank, '[CONTEXT ' || row_number() OVER (PARTITION BY query_id, strategy ORDER BY rank) || ']' || chr(10) || 'vector ' || chunk_id || ' of class ' || source AS piece FROM hits WHERE rank <= 3)
SELECT query_id, strategy, string_agg(piece, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS pieces FROM p GROUP BY ALL""")
def context_render(spark, sf_dir):
    some = retrieval.same_top_k(hits(spark, sf_dir), 3, DEPTH).withColumn("text", F.format_string("vector %d of class %s", "chunk_id", "source"))
    return context.render_contexts(some, 2048).select("query_id", "strategy", "context", "pieces")


# --- ranking metrics -------------------------------------------------------------------------------------------------


def judged(spark, sf_dir):
    return metrics.per_query(hits(spark, sf_dir), relevance(spark, sf_dir))


@query(f"WITH {HITS} SELECT query_id, strategy, first_rank, hit_1, hit_3, hit_5, hit_10, recall_5, recall_10, round(reciprocal_rank, 6) AS reciprocal_rank FROM per_query")
def ranking_metrics(spark, sf_dir):
    return judged(spark, sf_dir).withColumn("reciprocal_rank", r6("reciprocal_rank"))


MEANS = "count(*) AS queries, round(avg(hit_1), 6) AS hit_1, round(avg(hit_3), 6) AS hit_3, round(avg(hit_5), 6) AS hit_5, round(avg(hit_10), 6) AS hit_10, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(reciprocal_rank), 6) AS mrr"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else c for c, t in df.dtypes])


@query(f"WITH {HITS} SELECT strategy, source AS category, {MEANS} FROM per_query JOIN relevance USING (query_id) GROUP BY GROUPING SETS ((strategy), (strategy, source))")
def metrics_by_category(spark, sf_dir):
    rows = judged(spark, sf_dir).join(relevance(spark, sf_dir).withColumnRenamed("source", "category"), "query_id")
    return rounded(metrics.macro_by_category(rows, "category"))


@query(f"""WITH {HITS}, own AS (SELECT query_id, strategy, source, count(*) AS n, min(rank) AS rank, bool_or(relevant) AS relevant FROM judged WHERE rank <= 10 GROUP BY ALL)
SELECT query_id, strategy, min(rank) FILTER (relevant) AS first_rank, max((relevant AND rank <= 1)::INT) AS hit_1, max((relevant AND rank <= 3)::INT) AS hit_3, max((relevant AND rank <= 5)::INT) AS hit_5, max((relevant AND rank <= 10)::INT) AS hit_10, NULL::INT AS hit_20,
  sum((relevant AND rank <= 5)::INT) / 1.0 AS recall_5, sum((relevant AND rank <= 10)::INT) / 1.0 AS recall_10, NULL::DOUBLE AS recall_20, NULL::DOUBLE AS recall_50, round(coalesce(1.0 / min(rank) FILTER (relevant), 0), 6) AS reciprocal_rank,
  count(*) AS unique_sources, round(max(n) / sum(n), 6) AS concentration, (sum(n) - count(*))::BIGINT AS duplicates FROM own GROUP BY ALL""")
def depth_metrics(spark, sf_dir):
    return rounded(metrics.depth_metrics(hits(spark, sf_dir), relevance(spark, sf_dir), 10))


@query(f"""WITH {HITS}, d AS (SELECT unnest([5, 10, 20]) AS depth)
SELECT depth, strategy, count(*) AS hits, count(DISTINCT source) AS sources FROM hits, d WHERE rank <= depth GROUP BY ALL""")
def depth_sweep(spark, sf_dir):
    return retrieval.depth_sweep(hits(spark, sf_dir), [5, 10, 20]).groupBy("depth", "strategy").agg(F.count("*").alias("hits"), F.count_distinct("source").alias("sources"))


@query(f"""WITH {HITS}, r AS (SELECT query_id, strategy, coalesce(first_rank, 1000000000) AS r FROM per_query)
SELECT 'full' AS "left", 'half' AS "right", sum((a.r < b.r)::INT)::BIGINT AS wins, sum((a.r = b.r)::INT)::BIGINT AS ties, sum((a.r > b.r)::INT)::BIGINT AS losses FROM r a JOIN r b ON a.query_id = b.query_id AND a.strategy = 'full' AND b.strategy = 'half'""")
def pairwise_wins(spark, sf_dir):
    return metrics.pairwise(judged(spark, sf_dir), ["full", "half"])


@query(f"""WITH {HITS}, s AS (SELECT query_id, list(DISTINCT source) FILTER (strategy = 'full') AS l, list(DISTINCT source) FILTER (strategy = 'half') AS r FROM hits GROUP BY 1)
SELECT query_id, round(len(list_intersect(l, r)) / len(list_distinct(l || r)), 6) AS jaccard, len(l) - len(list_intersect(l, r)) AS only_left, len(r) - len(list_intersect(l, r)) AS only_right FROM s""")
def source_jaccard(spark, sf_dir):
    return rounded(metrics.source_overlap(hits(spark, sf_dir), "full", "half", DEPTH))


@query(f"WITH {HITS} SELECT query_id, strategy FROM per_query WHERE hit_1 = 0")
def miss_at_1(spark, sf_dir):
    return metrics.misses(judged(spark, sf_dir), 1).select("query_id", "strategy")


@query(f"WITH {HITS} SELECT query_id FROM per_query GROUP BY 1 HAVING count(DISTINCT coalesce(first_rank, 1000000000)) > 1")
def strategy_disagreements(spark, sf_dir):
    return metrics.disagreements(judged(spark, sf_dir))


@query(f"""WITH {HITS}, m AS (SELECT a.query_id, CASE WHEN coalesce(a.first_rank, 1000000000) < coalesce(b.first_rank, 1000000000) THEN 'improved' WHEN coalesce(a.first_rank, 1000000000) > coalesce(b.first_rank, 1000000000) THEN 'degraded' ELSE 'unchanged' END AS change FROM per_query a JOIN per_query b USING (query_id) WHERE a.strategy = 'half' AND b.strategy = 'full')
SELECT 'half' AS strategy, change, count(*) AS queries FROM m GROUP BY change""")
def compared_runs(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return metrics.compared(rows.where("strategy = 'half'"), rows.where("strategy = 'full'").withColumn("strategy", F.lit("half")))


@query(f"""WITH {HITS} SELECT query_id, source, min(rank) FILTER (strategy = 'full') AS "full", min(rank) FILTER (strategy = 'half') AS half FROM hits GROUP BY ALL""")
def relevance_audit(spark, sf_dir):
    texts = vectors(spark, sf_dir).select("chunk_id", F.concat(F.lit("vector "), F.col("chunk_id")).alias("text"))
    return metrics.relevance_audit(hits(spark, sf_dir), ["full", "half"], texts).drop("excerpts")


# --- lexical retrieval: benchmark passages ask, documents answer -----------------------------------------------------


def corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def passages(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


TOKENS = r"list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+|[@#$][\p{L}\p{N}_]+|===|!==|=>|\[\(|\)\]|[.():{}\[\]<>/+*-]'), lambda t: lower(replace(replace(t, 'ß', 'ss'), 'ẞ', 'ss')))"
BM25 = f"""
t AS (SELECT doc_id AS chunk_id, {TOKENS} AS tokens FROM documents),
n AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM t),
tf AS (SELECT chunk_id, length, term, count(*) AS tf FROM (SELECT chunk_id, len(tokens) AS length, unnest(tokens) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) * qtf) AS score FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL),
every AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(coalesce(score, 0), 6) AS score FROM benchmark, documents LEFT JOIN bm ON bm.query_id = item_id AND bm.chunk_id = doc_id),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM every) WHERE rank <= 20)"""


@query(f"SELECT doc_id AS chunk_id, len(tokens) AS tokens, len(list_distinct(tokens)) AS distinct_tokens FROM (SELECT doc_id, {TOKENS} AS tokens FROM documents)")
def bm25_tokens(spark, sf_dir):
    t = corpus(spark, sf_dir).select("chunk_id", tx.lexical_tokens(F.col("text")).alias("t"))
    return t.select("chunk_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"))


def lexical(spark, sf_dir, k=DEPTH):
    """Scores are rounded before ranking: near-copies tie, and ties go by id."""
    return retrieval.bm25_search(passages(spark, sf_dir), corpus(spark, sf_dir), k, decimals=6)


@query(f"WITH {BM25} SELECT query_id, rank, chunk_id, score FROM lexical WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return lexical(spark, sf_dir, 10).select("query_id", "rank", "chunk_id", "score")


EMBED = "list_transform(range(0, 32), lambda i: (('0x' || substr(sha256(text), (2 * (i % 32) + 1)::INT, 2))::INT / 255.0::DOUBLE * 2 - 1))"
DENSE = f"""
qe AS (SELECT item_id AS query_id, {EMBED} AS e FROM benchmark), de AS (SELECT doc_id AS chunk_id, {EMBED} AS e FROM documents),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(list_cosine_similarity(qe.e, de.e), 6) AS score FROM qe, de)) WHERE rank <= 20)"""


def dense(spark, sf_dir, k=DEPTH):
    ask = passages(spark, sf_dir).select("query_id", hashed_embedding(F.col("query"), 32).alias("vector"))
    rows = corpus(spark, sf_dir).select("chunk_id", hashed_embedding(F.col("text"), 32).alias("vector"))
    return retrieval.cosine_search(ask, rows, k, decimals=6)


@query(f"WITH {BM25}, {DENSE}, p AS (SELECT query_id, chunk_id, every.score FROM dense JOIN every USING (query_id, chunk_id)) SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM p) WHERE rank <= 5")
def bm25_rerank(spark, sf_dir):
    out = retrieval.bm25_rerank(passages(spark, sf_dir), corpus(spark, sf_dir), dense(spark, sf_dir), 5, decimals=6)
    return out.select("query_id", "rank", "chunk_id", "score")


@query(f"""WITH {BM25}, {DENSE}, f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT query_id, chunk_id, rank FROM lexical UNION ALL SELECT query_id, chunk_id, rank FROM dense) GROUP BY ALL)
SELECT query_id, rank, chunk_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 10""")
def hybrid_rrf(spark, sf_dir):
    fused = retrieval.reciprocal_rank_fusion([lexical(spark, sf_dir), dense(spark, sf_dir)], 2 * DEPTH)
    return retrieval.top(fused.withColumn("score", F.round("score", 12)), 10).select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"))


@query(f"SELECT doc_id, list_transform(e, lambda x: round(x / sqrt(list_sum(list_transform(e, lambda y: y * y))), 6)) AS vector FROM (SELECT doc_id, {EMBED.replace('range(0, 32)', 'range(0, 8)')} AS e FROM documents)")
def hashed_embeddings(spark, sf_dir):
    rows = context.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return rows.select("doc_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("SELECT sha256(text) AS text_sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1")
def content_hashes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))


# --- chunking --------------------------------------------------------------------------------------------------------

WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
CHUNKS = f"""
t AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS tokens FROM documents),
w AS (SELECT doc_id, tokens, len(tokens) AS n, unnest(range(0, CASE WHEN len(tokens) = 0 THEN 0 WHEN len(tokens) <= 128 THEN 1 ELSE 1 + ceil((len(tokens) - 128) / 112.0)::INT END)) AS chunk_index FROM t),
chunks AS (SELECT doc_id, chunk_index, chunk_index * 112 AS token_start, least(chunk_index * 112 + 128, n) AS token_end, array_to_string(tokens[chunk_index * 112 + 1 : least(chunk_index * 112 + 128, n)], ' ') AS text FROM w)"""


def chunks(spark, sf_dir):
    return chunking.fixed_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), 128, 16)


@query(f"""WITH {CHUNKS}, c AS (SELECT doc_id, token_end - token_start AS n FROM chunks)
SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, sum(n)::BIGINT AS tokens, min(n) AS min_tokens, round(avg(n), 6) AS mean_tokens, max(n) AS max_tokens, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75, quantile_cont(n, 0.95) AS p95 FROM c""")
def chunk_stats(spark, sf_dir):
    return rounded(chunking.chunk_statistics(chunks(spark, sf_dir)))


@query(f"WITH {CHUNKS} SELECT doc_id, count(*) AS chunks, sum(token_end - token_start)::BIGINT AS tokens FROM chunks GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10")
def most_chunked_documents(spark, sf_dir):
    return chunking.most_chunked(chunks(spark, sf_dir))


@query(f"WITH {CHUNKS} SELECT count(*) AS gaps FROM (SELECT token_start, max(token_end) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM chunks) WHERE token_start > coalesce(reached, 0)")
def chunk_gap_check(spark, sf_dir):
    return chunking.window_gaps(chunks(spark, sf_dir)).agg(F.count("*").alias("gaps"))


@query(r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
s AS (SELECT doc_id, i, list_filter(list_transform(string_split(regexp_replace(line, '([.!?])[ \t]+(["''`(\[]*[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM lines)
SELECT doc_id, sum(len(s))::BIGINT AS sentences, md5(coalesce(string_agg(array_to_string(s, '|'), '|' ORDER BY i) FILTER (len(s) > 0), '')) AS sentences_md5 FROM s GROUP BY doc_id""")
def sentences(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


@query()
def parse_blocks(spark, sf_dir):
    return parsing.corpus_statistics(parsing.parse_documents(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query()
def structure_chunks(spark, sf_dir):
    docs = parsing.parse_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return chunking.chunk_documents(docs, "structure").select("chunk_id", "doc_id", "chunk_index", "token_count", "level", "parent_id", F.sha2("text", 256).alias("text_sha256"), F.size("fragments").alias("fragments"))


@query()
def planned_chunks(spark, sf_dir):
    docs = parsing.parse_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return chunking.chunk_documents(docs, "prompt").select("chunk_id", "doc_id", "chunk_index", "token_count", F.sha2("text", 256).alias("text_sha256"))


# --- evidence: benchmark passages in documents -----------------------------------------------------------------------


def passage_evidence(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("evidence_id"), "text")


def texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def spans(spark, sf_dir):
    places = evidence.find_everywhere(passage_evidence(spark, sf_dir), texts(spark, sf_dir))
    return evidence.evidence_spans(places.join(passage_evidence(spark, sf_dir), "evidence_id"), texts(spark, sf_dir))


def char_windows(spark, sf_dir):
    """Windows of 250 characters, 200 apart: (chunk_id, doc_id, c_start, c_end)."""
    n = F.length("text")
    rows = texts(spark, sf_dir).where(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(200))).alias("c_start"))
    return rows.select(F.concat_ws("::", "doc_id", "c_start").alias("chunk_id"), "doc_id", "c_start", F.least(F.col("c_start") + 250, F.col("n")).alias("c_end"))


SPANS = """
found AS (SELECT item_id AS evidence_id, doc_id, b.text AS needle, d.text AS body FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
pieces AS (SELECT evidence_id, doc_id, length(needle) AS l, string_split(body, needle) AS parts FROM found),
spans AS (SELECT evidence_id, doc_id, span, (list_sum(list_transform(parts[1 : span + 1], lambda p: length(p))) + span * l)::INT AS "start", (list_sum(list_transform(parts[1 : span + 1], lambda p: length(p))) + (span + 1) * l)::INT AS "end" FROM (SELECT *, unnest(range(0, len(parts) - 1)) AS span FROM pieces)),
windows AS (SELECT doc_id || '::' || c_start AS chunk_id, doc_id, c_start, least(c_start + 250, n) AS c_end FROM (SELECT doc_id, length(text) AS n, unnest(range(0, length(text), 200)) AS c_start FROM documents)),
matches AS (SELECT evidence_id, doc_id, span, chunk_id, greatest(c_start, "start") - "start" AS s, least(c_end, "end") - "start" AS e, "end" - "start" AS length FROM spans JOIN windows USING (doc_id) WHERE c_start < "end" AND "start" < c_end)"""


@query("SELECT item_id AS evidence_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def evidence_places(spark, sf_dir):
    return evidence.find_everywhere(passage_evidence(spark, sf_dir), texts(spark, sf_dir))


@query(f'WITH {SPANS} SELECT evidence_id, doc_id, span, "start", "end" FROM spans')
def evidence_spans(spark, sf_dir):
    return spans(spark, sf_dir)


def matched(spark, sf_dir):
    """Evidence ids are made one for each document, so that a passage is covered within one document."""
    one = spans(spark, sf_dir).withColumn("evidence_id", F.concat_ws("@", "evidence_id", "doc_id"))
    return evidence.chunk_matches(one, char_windows(spark, sf_dir))


@query(f"""WITH {SPANS} SELECT evidence_id || '@' || doc_id AS evidence_id, span, chunk_id, round((e - s) / length, 6) AS coverage, s AS "start", e AS "end" FROM matches""")
def evidence_chunk_map(spark, sf_dir):
    return matched(spark, sf_dir).select("evidence_id", "span", "chunk_id", r6("coverage").alias("coverage"), "start", "end")


@query(f"""WITH {SPANS}, b AS (SELECT evidence_id || '@' || doc_id AS evidence_id, span, s, e, length, coalesce(max(e) OVER (PARTITION BY evidence_id, doc_id, span ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM matches),
u AS (SELECT evidence_id, span, sum(greatest(0, e - greatest(s, reached))) / max(length) AS c FROM b GROUP BY ALL)
SELECT evidence_id, round(least(1.0, max(c)), 6) AS coverage FROM u GROUP BY 1""")
def interval_coverage(spark, sf_dir):
    return rounded(evidence.unit_coverage(matched(spark, sf_dir)))


RETRIEVED = f"""{SPANS},
best AS (SELECT evidence_id || '@' || doc_id AS evidence_id, chunk_id, arg_max({{'s': s, 'e': e, 'length': length}}, struct_pack(c := (e - s) / length, f := -span)) AS m FROM matches GROUP BY ALL),
picked AS (SELECT evidence_id, m.s AS s, m.e AS e, max(m.e) OVER (PARTITION BY evidence_id) AS high, string_split(chunk_id, '::')[2]::INT % 400 = 0 AS own FROM best),
b AS (SELECT *, coalesce(max(e) OVER (PARTITION BY evidence_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM picked WHERE own),
got AS (SELECT evidence_id, least(1.0, sum(greatest(0, e - greatest(s, reached))) / max(high)) AS coverage FROM b GROUP BY 1)"""


def retrieved(spark, sf_dir):
    """Every other window is taken as retrieved."""
    best = evidence.best_matches(matched(spark, sf_dir))
    chosen = char_windows(spark, sf_dir).where(F.col("c_start") % 400 == 0).select(F.lit(1).alias("query_id"), "chunk_id")
    return evidence.retrieved_coverage(best, chosen)


@query(f"WITH {RETRIEVED} SELECT 1 AS query_id, evidence_id, round(coverage, 6) AS coverage FROM got")
def retrieved_evidence(spark, sf_dir):
    return rounded(retrieved(spark, sf_dir))


@query(f"WITH {RETRIEVED} SELECT 1 AS query_id, count(*) AS units, sum((coverage >= 1)::INT)::BIGINT AS covered_units, round(avg(coverage), 6) AS evidence_coverage, min((coverage >= 1)::INT) AS all_covered FROM got")
def evidence_metrics(spark, sf_dir):
    return rounded(evidence.evidence_metrics(retrieved(spark, sf_dir), ["query_id"]))


# --- answers: a turn of a conversation against the turns that follow -------------------------------------------------


def turns(spark, sf_dir):
    """(question_id, strategy, role, prediction, reference): the next turn, and the one after it, as references."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").withColumn("i", F.row_number().over(w)).withColumn("next", F.lead("text").over(w)).withColumn("after", F.lead("text", 2).over(w))
    pairs = F.array(F.struct(F.lit("next").alias("strategy"), F.col("next").alias("reference")), F.struct(F.lit("after").alias("strategy"), F.col("after").alias("reference")))
    out = rows.select(F.concat_ws(":", "conv_id", "i").alias("question_id"), "role", F.col("text").alias("prediction"), F.explode(pairs).alias("p"))
    return out.select("question_id", "p.strategy", "role", "prediction", "p.reference").where(F.col("reference").isNotNull() & F.col("prediction").isNotNull())


def evaluated(spark, sf_dir):
    return answers.evaluate(turns(spark, sf_dir), tx.plain_form)


TURNS = rf"""
c AS (SELECT conv_id, role, text, row_number() OVER w AS i, lead(text) OVER w AS nxt, lead(text, 2) OVER w AS aft FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
turns AS (SELECT * FROM (SELECT conv_id || ':' || i AS question_id, 'next' AS strategy, role, text AS prediction, nxt AS reference FROM c UNION ALL SELECT conv_id || ':' || i, 'after', role, text, aft FROM c) WHERE reference IS NOT NULL AND prediction IS NOT NULL),
normal AS (SELECT *, lower(trim(regexp_replace(prediction, '\s+', ' ', 'g'))) AS p, lower(trim(regexp_replace(reference, '\s+', ' ', 'g'))) AS r FROM turns),
tok AS (SELECT *, regexp_extract_all(p, '{WORD}') AS pt, regexp_extract_all(r, '{WORD}') AS rt FROM normal),
pc AS (SELECT question_id, strategy, t, count(*) AS n FROM (SELECT question_id, strategy, unnest(pt) AS t FROM tok) GROUP BY ALL),
rc AS (SELECT question_id, strategy, t, count(*) AS n FROM (SELECT question_id, strategy, unnest(rt) AS t FROM tok) GROUP BY ALL),
both_ AS (SELECT question_id, strategy, sum(least(pc.n, rc.n)) AS b FROM pc JOIN rc USING (question_id, strategy, t) GROUP BY ALL),
pr AS (SELECT tok.*, CASE WHEN len(pt) = 0 AND len(rt) = 0 THEN 1 WHEN len(pt) = 0 OR len(rt) = 0 THEN 0 ELSE coalesce(b, 0) / len(pt) END AS precision, CASE WHEN len(pt) = 0 AND len(rt) = 0 THEN 1 WHEN len(pt) = 0 OR len(rt) = 0 THEN 0 ELSE coalesce(b, 0) / len(rt) END AS recall FROM tok LEFT JOIN both_ USING (question_id, strategy)),
evaluated AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, (p = r)::INT::DOUBLE AS exact, CASE WHEN len(rt) = 0 THEN (len(pt) = 0)::INT ELSE contains(' ' || array_to_string(pt, ' ') || ' ', ' ' || array_to_string(rt, ' ') || ' ')::INT END::DOUBLE AS containment FROM pr)"""


@query(f"WITH {TURNS} SELECT question_id, strategy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, exact, containment FROM evaluated")
def token_prf(spark, sf_dir):
    return rounded(evaluated(spark, sf_dir).drop("role", "prediction", "reference"))


@query(f"""WITH {TURNS} SELECT strategy, role, count(*) AS expected, count(f1) AS answered, round(avg(precision), 6) AS precision, round(avg(precision), 6) AS success_aware_precision, round(avg(recall), 6) AS recall, round(avg(recall), 6) AS success_aware_recall,
  round(avg(f1), 6) AS f1, round(avg(f1), 6) AS success_aware_f1, round(avg(exact), 6) AS exact, round(avg(exact), 6) AS success_aware_exact, round(avg(containment), 6) AS containment, round(avg(containment), 6) AS success_aware_containment FROM evaluated GROUP BY ALL""")
def answer_summary(spark, sf_dir):
    return rounded(answers.summary(evaluated(spark, sf_dir), ["strategy", "role"]))


@query(f"WITH {TURNS} SELECT strategy, role, count(*) AS questions, round(avg(f1), 6) AS f1, round(avg(exact), 6) AS exact FROM evaluated GROUP BY GROUPING SETS ((strategy), (strategy, role))")
def answer_rollup(spark, sf_dir):
    return rounded(answers.rolled_summary(evaluated(spark, sf_dir), "role"))


PAIRED = f"""{TURNS}, paired AS (SELECT question_id, max(f1) FILTER (strategy = 'next') AS nxt, max(f1) FILTER (strategy = 'after') AS aft FROM evaluated GROUP BY 1),
deltas AS (SELECT question_id, role, round(nxt - aft, 9) AS d FROM paired JOIN (SELECT DISTINCT question_id, role FROM turns) USING (question_id) WHERE nxt IS NOT NULL AND aft IS NOT NULL)"""


def paired(spark, sf_dir):
    return answers.paired(evaluated(spark, sf_dir), ["next", "after"])


def deltas(spark, sf_dir):
    roles = turns(spark, sf_dir).select("question_id", "role").distinct()
    return paired(spark, sf_dir).join(roles, "question_id").select("question_id", "role", F.round("next_minus_after", 9).alias("d")).where("d is not null")


@query(f"""WITH {PAIRED} SELECT question_id, round(nxt, 6) AS "next", round(aft, 6) AS after, round(nxt - aft, 6) AS next_minus_after FROM paired""")
def paired_table(spark, sf_dir):
    return rounded(paired(spark, sf_dir))


# --- statistics of the paired differences ----------------------------------------------------------------------------


@query(f"""WITH {PAIRED} SELECT role, count(d) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.25), 6) AS q1, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.75), 6) AS q3, round(coalesce(stddev_samp(d), 0), 6) AS sd, round(coalesce(var_samp(d), 0), 6) AS variance, round(min(d), 6) AS min, round(max(d), 6) AS max, round(quantile_cont(d, 0.75) - quantile_cont(d, 0.25), 6) AS iqr FROM deltas GROUP BY 1""")
def describe(spark, sf_dir):
    return rounded(statistics.describe(deltas(spark, sf_dir), "d", ["role"]))


@query(f"""WITH {PAIRED} SELECT role, count(d) AS n, round(avg(d), 6) AS mean, sum((d > 0)::INT)::BIGINT AS positive, sum((d = 0)::INT)::BIGINT AS zero, sum((d < 0)::INT)::BIGINT AS negative, round(sum(greatest(d, 0)), 6) AS sum_positive, round(sum(least(d, 0)), 6) AS sum_negative, round(avg(abs(d)), 6) AS mean_magnitude FROM deltas GROUP BY 1""")
def paired_delta(spark, sf_dir):
    return rounded(statistics.paired_summary(deltas(spark, sf_dir), "d", ["role"]))


@query(f"WITH {PAIRED} SELECT role, round(CASE WHEN count(d) < 2 THEN NULL WHEN stddev_samp(d) = 0 THEN CASE WHEN avg(d) = 0 THEN 0 END ELSE avg(d) / stddev_samp(d) END, 6) AS dz FROM deltas GROUP BY 1")
def cohens_dz(spark, sf_dir):
    return rounded(statistics.cohens_dz(deltas(spark, sf_dir), "d", ["role"]))


RANKS = f"""{PAIRED}, g AS (SELECT role, d, rank() OVER (PARTITION BY role ORDER BY abs(d)) + (count(*) OVER (PARTITION BY role, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY role, abs(d)) AS t FROM deltas WHERE d <> 0),
s AS (SELECT role, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS plus, coalesce(sum(r) FILTER (d < 0), 0) AS minus, sum(t * t - 1) AS ties FROM g GROUP BY 1)"""


@query(f"WITH {RANKS} SELECT role, round((plus - minus) / (plus + minus), 6) AS rank_biserial FROM s")
def rank_biserial(spark, sf_dir):
    return rounded(statistics.rank_biserial(deltas(spark, sf_dir), "d", ["role"]))


@query(f"WITH {RANKS} SELECT role, n, least(plus, minus) AS statistic, round((least(plus, minus) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24), 6) AS z FROM s")
def wilcoxon(spark, sf_dir):
    return statistics.wilcoxon(deltas(spark, sf_dir), "d", ["role"]).select("role", "n", "statistic", r6("z").alias("z"))


@query("""WITH t AS (SELECT label AS idx, round(avg(abs(embedding[1]::DOUBLE)), 6) AS p FROM embeddings GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p, idx) AS k, count(*) OVER () AS m FROM t)
SELECT idx, p, round(max(least(1, (m - k + 1) * p)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM k""")
def holm(spark, sf_dir):
    tests = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("idx")).agg(r6(F.avg(F.abs(F.col("embedding")[0].cast("double")))).alias("p"))
    return rounded(statistics.holm(tests))


@query("""WITH x AS (SELECT lang, n_chars, len(string_split(text, ' ')) AS n FROM documents),
r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS a, rank() OVER (PARTITION BY lang ORDER BY n) + (count(*) OVER (PARTITION BY lang, n) - 1) / 2 AS b FROM x)
SELECT lang, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def spearman(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", "n_chars", F.size(F.split("text", " ")).alias("n"))
    return rounded(statistics.spearman(rows, "n_chars", "n", ["lang"]))


@query("""WITH m AS (SELECT lang, count(*)::DOUBLE AS n, avg(n_chars) AS mu FROM documents GROUP BY 1),
c AS (SELECT lang, any_value(n) AS n, avg(pow(n_chars - mu, 2)) AS m2, avg(pow(n_chars - mu, 3)) AS m3, avg(pow(n_chars - mu, 4)) AS m4 FROM documents JOIN m USING (lang) GROUP BY 1)
SELECT lang, round(sqrt(n * (n - 1)) / (n - 2) * m3 / pow(m2, 1.5), 4) AS skewness, round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6), 4) AS kurtosis FROM c""")
def shape_diagnostics(spark, sf_dir):
    s = statistics.shape(table(spark, sf_dir, "documents"), "n_chars", ["lang"])
    return s.select("lang", F.round("skewness", 4).alias("skewness"), F.round("kurtosis", 4).alias("kurtosis"))


def power_sql(coefficients, x: str) -> str:
    out = repr(float(coefficients[-1])) + "::DOUBLE"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {float(c)!r}::DOUBLE)"
    return out


def fraction_sql(c, x: str) -> str:
    return f"({power_sql(c[0], x)} / {power_sql(c[1], x)})"


def quantile_sql(p: str) -> str:
    """The normal quantile."""
    tail = f"(CASE WHEN sqrt(-ln(least({p}, 1 - {p}))) <= 5 THEN {fraction_sql(normality.TAIL, f'(sqrt(-ln(least({p}, 1 - {p}))) - 1.6)')} ELSE {fraction_sql(normality.FAR, f'(sqrt(-ln(least({p}, 1 - {p}))) - 5)')} END)"
    return f"(CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {fraction_sql(normality.MIDDLE, f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))')} ELSE sign({p} - 0.5) * {tail} END)"


@query(f"""WITH r AS (SELECT lang, n_chars::DOUBLE AS x, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars IS NOT NULL),
q AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM r), m AS (SELECT lang, x, i, n, {quantile_sql("p")} AS m FROM q),
s AS (SELECT lang, n, sum(m * m) AS size, sum(m * x) AS mx, var_pop(x) * n AS spread, max(m) AS m1, max(m) FILTER (i = n - 1) AS m2, max(x) - min(x) AS wide, max(x) FILTER (i = n - 1) - max(x) FILTER (i = 2) AS near FROM m GROUP BY lang, n),
a AS (SELECT *, {power_sql(statistics.ROYSTON_LAST, "(1 / sqrt(n))")} + m1 / sqrt(size) AS a1, {power_sql(statistics.ROYSTON_SECOND, "(1 / sqrt(n))")} + m2 / sqrt(size) AS a2 FROM s WHERE n > 5)
SELECT lang, n, round(pow(a1 * wide + a2 * near + (mx - m1 * wide - m2 * near) / sqrt((size - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) / spread, 6) AS w FROM a""")
def shapiro_wilk(spark, sf_dir):
    """W of the lengths of all documents of each language (in the test tables each has over five)."""
    found = normality.shapiro_wilk(table(spark, sf_dir, "documents"), "n_chars", ["lang"])
    return found.select("lang", "n", F.round("w", 6).alias("w"))


def resampled_sql(source: str, by: str, values: list[str], resamples: int = RESAMPLES, seeds: tuple[int, ...] = (2026,), signs: bool = False) -> str:
    """sums: (by..., seed, r, n, values...) of every resample, values as whole numbers; source is a table with question_id."""
    counts = "x % 2 * 2 - 1" if signs else " + ".join(f"(x >= {t})::INT" for t in resampling.POISSON)
    hexed = lambda i: f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT % {resampling.PRIME}"
    return f"""whole AS (SELECT {by}{", ".join(f"round({v} * 1000000000)::BIGINT AS {v}" for v in values)}, seed, md5(seed || '|' || question_id) AS h FROM {source}, (SELECT unnest([{", ".join(map(str, seeds))}]) AS seed)),
elements AS (SELECT {by}seed, r, {", ".join(values)}, ((({hexed(0)}) * r + {hexed(1)}) % {resampling.PRIME} * r + {hexed(2)}) % {resampling.PRIME} AS x FROM whole, range(0, {resamples}) t(r)),
sums AS (SELECT {by}seed, r, {"count(*)" if signs else f"sum({counts})"} AS n, {", ".join(f"sum(({counts}) * {v}) AS {v}" for v in values)} FROM elements GROUP BY ALL HAVING n > 0)"""


@query(f"""WITH {PAIRED}, p AS (SELECT question_id, nxt, aft FROM paired WHERE nxt IS NOT NULL AND aft IS NOT NULL), {resampled_sql("p", "", ["nxt", "aft"])},
m AS (SELECT 'next' AS strategy, nxt / n / 1e9 AS m, (nxt > aft)::INT AS won FROM sums UNION ALL SELECT 'after', aft / n / 1e9, (aft > nxt)::INT FROM sums)
SELECT strategy, (SELECT count(*) FROM p) AS questions, round(CASE strategy WHEN 'next' THEN (SELECT avg(nxt) FROM p) ELSE (SELECT avg(aft) FROM p) END, 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(stddev_samp(m), 6) AS se, round(avg(won), 6) AS sole_wins FROM m GROUP BY strategy""")
def bootstrap_ci(spark, sf_dir):
    return rounded(resampling.intervals(paired(spark, sf_dir), ["next", "after"]).drop("seed"))


@query(f"""WITH {PAIRED}, {resampled_sql("deltas", "role, ", ["d"], signs=True)}, o AS (SELECT role, count(*) AS questions, avg(d) AS mean, abs(sum(round(d * 1000000000)::BIGINT)) AS observed FROM deltas GROUP BY 1)
SELECT role, questions, round(mean, 6) AS mean, sum((abs(d) >= observed)::INT)::BIGINT AS extreme, (sum((abs(d) >= observed)::INT) + 1) / ({RESAMPLES} + 1) AS p FROM o JOIN sums ON o.role IS NOT DISTINCT FROM sums.role GROUP BY o.role, sums.role, questions, mean""".replace("SELECT role, questions", "SELECT o.role, questions"))
def permutation_test(spark, sf_dir):
    return resampling.sign_flips(deltas(spark, sf_dir), "d", ["role"]).withColumn("mean", r6("mean"))


@query(f"""WITH {PAIRED}, {resampled_sql("deltas", "role, ", ["d"], resamples=FEWER, seeds=(1, 2, 3))}, m AS (SELECT *, d / n / 1e9 AS m FROM sums), grid AS (SELECT role, seed, size, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m, (SELECT unnest([1000, {FEWER}]) AS size) WHERE r < size GROUP BY ALL)
SELECT role, round(min(low), 6) AS low_min, round(max(low), 6) AS low_max, round(min(high), 6) AS high_min, round(max(high), 6) AS high_max, min((low <= 0 AND high >= 0)::INT) = max((low <= 0 AND high >= 0)::INT) AS stable FROM grid GROUP BY 1""")
def sensitivity_grid(spark, sf_dir):
    """Intervals of the difference in every role, over three seeds and two numbers of resamples, in one aggregation."""
    return rounded(resampling.sensitivity(deltas(spark, sf_dir), "d", [1, 2, 3], [1000, FEWER], ["role"]))


@query(f"""WITH {PAIRED}, strata AS (SELECT question_id, len(text) // 200 AS stratum, nxt - aft AS d FROM paired JOIN (SELECT DISTINCT question_id, first(prediction) OVER (PARTITION BY question_id) AS text FROM turns) USING (question_id) WHERE nxt IS NOT NULL AND aft IS NOT NULL), {resampled_sql("strata", "stratum, ", ["d"], resamples=FEWER)}
SELECT stratum, s.n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, s.n < 10 AS small FROM (SELECT stratum, count(*) AS n, avg(d) AS mean FROM strata GROUP BY 1) s JOIN (SELECT stratum, quantile_cont(d / n / 1e9, 0.025) AS low, quantile_cont(d / n / 1e9, 0.975) AS high FROM sums GROUP BY 1) USING (stratum)""")
def strata_intervals(spark, sf_dir):
    """The difference within strata of the answers' length."""
    length = turns(spark, sf_dir).groupBy("question_id").agg(F.first("prediction").alias("text")).select("question_id", F.floor(F.length("text") / 200).cast("long").alias("stratum"))
    return rounded(experiments.strata(paired(spark, sf_dir).join(length, "question_id"), "stratum", "next", "after", FEWER))


@query(f"""WITH {PAIRED}, p AS (SELECT question_id, role, nxt, aft FROM paired JOIN (SELECT DISTINCT question_id, role FROM turns) USING (question_id) WHERE nxt IS NOT NULL AND aft IS NOT NULL), {resampled_sql("p", "role, ", ["nxt", "aft"], resamples=FEWER)}, w AS (SELECT role, avg((nxt > aft)::INT) AS nxt, avg((aft > nxt)::INT) AS aft FROM sums GROUP BY 1)
SELECT role, 'next' AS strategy, round(nxt, 6) AS wins, CASE WHEN nxt > aft THEN 1 ELSE 2 END AS rank FROM w UNION ALL SELECT role, 'after', round(aft, 6), CASE WHEN nxt > aft THEN 2 ELSE 1 END FROM w""")
def winner_frequency(spark, sf_dir):
    roles = turns(spark, sf_dir).select("question_id", "role").distinct()
    return rounded(resampling.winners(paired(spark, sf_dir).join(roles, "question_id"), ["next", "after"], ["role"], FEWER))


# --- audits ----------------------------------------------------------------------------------------------------------


@query("""SELECT 'role' AS field, count(role) AS present, coalesce(sum((trim(role) = '')::INT), 0)::BIGINT AS empty, count(DISTINCT role) AS "distinct" FROM conversations
UNION ALL SELECT 'text', count(text), coalesce(sum((trim(text) = '')::INT), 0)::BIGINT, count(DISTINCT text) FROM conversations""")
def dataset_profile(spark, sf_dir):
    return audit.dataset_profile(table(spark, sf_dir, "conversations"), ["role", "text"])


@query("""WITH q AS (SELECT doc_id, lang, source, n_chars < 200 AS failed FROM documents)
SELECT 'lang' AS dimension, lang AS value, count(*) AS total, sum((NOT failed)::INT)::BIGINT AS compatible FROM q GROUP BY lang
UNION ALL SELECT 'source', source, count(*), sum((NOT failed)::INT)::BIGINT FROM q GROUP BY source""")
def compatibility_breakdown(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "question_id")
    return audit.breakdown(docs.select("question_id", "lang", "source"), docs.where("n_chars < 200"), ["lang", "source"])


@query("SELECT doc_id, CASE WHEN d.doc_id IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def coverage_difference(spark, sf_dir):
    return audit.set_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT text, count(*) AS count FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_report(spark, sf_dir):
    return audit.duplicates(table(spark, sf_dir, "documents"), "text")


# --- experiments -----------------------------------------------------------------------------------------------------


@query(f"""WITH {HITS}, d AS (SELECT unnest([5, 20]) AS depth),
own AS (SELECT depth, query_id, strategy, source, count(*) AS n, min(rank) AS rank, bool_or(relevant) AS relevant FROM judged, d WHERE judged.rank <= depth GROUP BY ALL),
q AS (SELECT depth, query_id, strategy, coalesce(1.0 / min(rank) FILTER (relevant), 0) AS rr, count(*) AS u FROM own GROUP BY ALL)
SELECT depth, strategy, round(avg(rr), 6) AS reciprocal_rank, round(avg(u), 6) AS unique_sources FROM q GROUP BY ALL""")
def depth_ablation(spark, sf_dir):
    return rounded(experiments.depth_ablation(hits(spark, sf_dir), relevance(spark, sf_dir), [5, 20]).select("depth", "strategy", "reciprocal_rank", "unique_sources"))


@query(f"""WITH {HITS}, caps AS (SELECT unnest([3, 2, 1]) AS cap),
own AS (SELECT *, row_number() OVER (PARTITION BY cap, query_id, strategy, source ORDER BY rank) AS k FROM judged, caps),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cap, query_id, strategy ORDER BY rank) AS r FROM own WHERE k <= cap),
q AS (SELECT cap, query_id, strategy, min(r) FILTER (relevant) AS f, count(DISTINCT source) AS u, max((relevant AND r <= 5)::INT) AS recall_5 FROM ranked WHERE r <= 10 GROUP BY ALL),
b AS (SELECT query_id, strategy, min(rank) FILTER (relevant AND rank <= 10) AS f FROM judged GROUP BY ALL)
SELECT cap, strategy, round(avg(coalesce(1.0 / q.f, 0)), 6) AS mrr, round(avg(recall_5), 6) AS recall_5, round(avg(u), 6) AS unique_sources,
  sum((coalesce(q.f, 1000000000) < coalesce(b.f, 1000000000))::INT)::BIGINT AS improved, sum((coalesce(q.f, 1000000000) > coalesce(b.f, 1000000000))::INT)::BIGINT AS degraded, count(*) AS queries FROM q JOIN b USING (query_id, strategy) GROUP BY ALL""")
def diversity_ablation(spark, sf_dir):
    return rounded(experiments.diversity_ablation(hits(spark, sf_dir), relevance(spark, sf_dir), [3, 2, 1], 10))


@query(f"""WITH {PAIRED}, w AS (SELECT question_id, round(nxt - aft, 12) AS d FROM paired WHERE nxt IS NOT NULL AND aft IS NOT NULL), {resampled_sql("w", "", ["d"])}, flips AS (WITH {resampled_sql("w", "", ["d"], signs=True)} SELECT abs(d) AS d FROM sums),
o AS (SELECT count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd, abs(sum(round(d * 1000000000)::BIGINT)) AS observed FROM w), i AS (SELECT quantile_cont(d / n / 1e9, 0.025) AS low, quantile_cont(d / n / 1e9, 0.975) AS high FROM sums), f AS (SELECT (sum((flips.d >= observed)::INT) + 1) / ({RESAMPLES} + 1) AS p FROM flips, o)
SELECT 'next-after' AS pair, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, round(p, 6) AS holm_p, round(mean / sd, 6) AS dz, (low > 0 OR high < 0) AND p < 0.05 AS supported FROM o, i, f""")
def paired_analysis(spark, sf_dir):
    """Wilcoxon's test and the rank-biserial correlation have queries of their own."""
    return rounded(experiments.paired_analysis(spark, evaluated(spark, sf_dir), ["next", "after"]).drop("wilcoxon_p", "rank_biserial"))
