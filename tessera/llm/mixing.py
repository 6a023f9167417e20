"""Mixing sources to target weights, with DataFrame and SQL functions only.

Source shares p of the tokens are exponentiated: weights w = p^a / sum p^a. Lower exponents even the sources out. The
exponent is bisected in [0, 1]: the largest one whose weights have the target entropy, raised if a source would be
repeated more often than allowed; with a limit on repetition alone, the least exponent within that limit. Five levels of the bisection are evaluated in one aggregation over the sources, so
that nothing but a few sums reaches the driver, however many sources there are.

The weights are realised within a token budget as block permutations. Every source is cut by a hash of the id into
blocks (4096 at most, so that what is ordered within a source stays bounded); each epoch runs through the blocks in an
order of its own and through a block's documents in an order of its own. A source gets its whole epochs and, of one more,
the longest run of blocks and then of documents that its quota still pays for. What is taken is fixed by one small row
for each block and epoch, so the texts themselves are never shuffled while the rows of that plan fit a broadcast.

Defined results: a null source counts as the source ''; a null text has no tokens; documents without tokens cost nothing
and are taken wherever they stand in front of the cut; null ids hash as the text 'null'; rows of equal id are taken or left together; an
empty table gives an empty result. Columns other than those named are passed through by `mix` and not read otherwise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read, small

WORDS = r"[^\x20\x09-\x0D]+"
MOST_BLOCKS = 4096
#: Rows of a plan that may be broadcast: at about 60 bytes each, 12 MB.
BROADCAST_ROWS = 200_000
LEVELS, ROUNDS = 5, 8


@dataclass(frozen=True)
class Mix:
    """target_entropy: as a share of the entropy of equal weights. budget: in tokens, as a share of all there are; None
    gives each document one epoch at least and repeats the smaller sources up to max_repetition."""

    target_entropy: float | None = None
    max_repetition: float | None = None
    budget: float | None = None
    block_tokens: int = 65536
    seed: str = "mix"


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORDS), F.lit(0))), F.lit(0)).cast("long")


def key(*parts: Column | str | int) -> Column:
    """60 bits of the md5 of the parts, as a long."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_totals(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum("tokens").alias("total"))


def exponent(sources: DataFrame, mix: Mix) -> float:
    """The bisected exponent, to nine decimals; 1 where nothing limits it."""
    some = sources.where("total > 0")
    n, total, least, most = some.agg(F.count("*"), F.sum("total"), F.min("total"), F.max("total")).first()
    if not n:
        return 1.0
    share = F.log(F.col("total") / F.lit(float(total)))

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        """(entropy, largest repetition) of each exponent."""
        row = some.agg(*[x for a in exponents for x in (F.sum(F.exp(a * share)), F.sum(F.exp(a * share) * share))]).first()
        out = []
        for a, z, s in zip(exponents, row[::2], row[1::2], strict=True):
            if mix.budget is None:
                repetition = (least / most) ** (a - 1)
            else:
                repetition = mix.budget * (least / total) ** (a - 1) / z
            out.append((math.log(z) - a * s / z, repetition))
        return out

    def bisect(enough) -> float:
        """The boundary of a predicate that holds from some exponent down to 0, or 1 if it holds there."""
        if enough(*sums([1.0])[0]):
            return 1.0
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            width = (hi - lo) / (1 << LEVELS)
            tried = [lo + i * width for i in range(1, 1 << LEVELS)]
            found = dict(zip(tried, sums(tried), strict=True))
            for level in range(LEVELS - 1, -1, -1):
                middle = lo + width * (1 << level)
                middle = min(tried, key=lambda x, m=middle: abs(x - m))
                lo, hi = (middle, hi) if enough(*found[middle]) else (lo, middle)
        return lo

    chosen = 1.0
    if mix.target_entropy is not None:
        target = mix.target_entropy * math.log(n)
        chosen = bisect(lambda h, _: h >= target)
    if mix.max_repetition is not None:
        floor = bisect(lambda _, r: r > mix.max_repetition)
        chosen = floor if mix.target_entropy is None else max(chosen, floor)
    return round(chosen, 9)


def quotas(sources: DataFrame, mix: Mix) -> DataFrame:
    """(source, total, weight, epochs, rest, blocks): whole epochs, and the tokens left for one more."""
    a = exponent(sources, mix)
    total, z, most = sources.agg(F.sum("total"), F.sum(F.when(F.col("total") > 0, F.pow(F.col("total").cast("double"), F.lit(a)))), F.max("total")).first()
    z, total = z or 1.0, total or 0
    weight = F.when(F.col("total") > 0, F.pow(F.col("total").cast("double"), F.lit(a)) / F.lit(z)).otherwise(0.0)
    if mix.budget is None:
        # the largest source needs the largest budget for one epoch
        budget = (most or 0) / ((most or 1) ** a / z)
        quota = F.greatest(F.floor(weight * F.lit(float(budget))), F.col("total"))
    else:
        quota = F.floor(weight * F.lit(mix.budget * float(total)))
    epochs = F.when(F.col("total") > 0, F.floor(quota / F.col("total"))).otherwise(F.lit(1 if mix.budget is None else 0)).cast("long")
    blocks = F.least(F.greatest(F.ceil(F.col("total") / mix.block_tokens), F.lit(1)), F.lit(MOST_BLOCKS)).cast("long")
    return sources.withColumn("weight", weight).withColumn("quota", quota.cast("long")).withColumn("epochs", epochs).withColumn("rest", F.col("quota") - F.col("epochs") * F.col("total")).withColumn("blocks", blocks)


def with_block(docs: DataFrame, sources: DataFrame, mix: Mix, id_col: str) -> DataFrame:
    """docs (that have `source`) with the number of their block."""
    return docs.join(small(sources.select("source", "blocks"), BROADCAST_ROWS), "source").withColumn("block", F.pmod(key(mix.seed, F.col(id_col)), F.col("blocks"))).drop("blocks")


def plan(sized: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """(source, block, epoch, block_rank, upto): of a block, an epoch takes the documents whose key is at most upto."""
    placed = with_block(sized, sources, mix, "doc_id")
    sums = placed.groupBy("source", "block").agg(F.sum("tokens").alias("held"))
    order = Window.partitionBy("source", "epoch").orderBy(key(mix.seed, F.col("source"), F.col("epoch"), F.col("block")), "block")
    ranked = (
        sums.join(small(sources.select("source", "epochs", "rest"), BROADCAST_ROWS), "source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))))
        .withColumn("block_rank", F.row_number().over(order))
        .withColumn("before", F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held"))
        .where("epoch < epochs or before <= rest")
    )
    ranked = cut(ranked.withColumn("whole", F.expr("epoch < epochs or before + held <= rest")))
    whole = ranked.where("whole").select("source", "block", "epoch", "block_rank", F.lit((1 << 60) - 1).alias("upto"))
    # at most one block of a source is cut
    split = ranked.where("not whole").join(placed, ["source", "block"]).withColumn("key", key(mix.seed, F.col("epoch"), F.col("doc_id")))
    paid = F.sum("tokens").over(Window.partitionBy("source", "block", "epoch", "block_rank").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    part = split.withColumn("paid", paid).where("before + paid <= rest").groupBy("source", "block", "epoch", "block_rank").agg(F.max("key").alias("upto"))
    return whole.unionByName(part)


def mix(docs: DataFrame, how: Mix, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs as the mix takes them, a row for each epoch that takes it, and __epoch, __block, __block_rank, __key, __tokens.

    A stream in the order of __epoch, __block_rank and __key runs through every source's blocks in permuted order.
    """
    needed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).cast("string").alias("text"))
    sized = cut(needed.select("doc_id", "source", token_count().alias("tokens")))
    sources = cut(quotas(cut(source_totals(sized)), how))
    chosen = cut(plan(sized, sources, how))
    named = chosen.select(F.col("source").alias("__source"), F.col("block").alias("__block"), F.col("epoch").alias("__epoch"), F.col("block_rank").alias("__block_rank"), F.col("upto").alias("__upto"))
    blocks = sources.select(F.col("source").alias("__source"), F.col("blocks").alias("__blocks"))
    rows = docs.withColumn("__source", F.coalesce(F.col(source_col).cast("string"), F.lit(""))).join(small(blocks, BROADCAST_ROWS), "__source")
    rows = rows.withColumn("__block", F.pmod(key(how.seed, F.col(id_col)), F.col("__blocks")))
    taken = rows.join(small(named, BROADCAST_ROWS), ["__source", "__block"]).withColumn("__key", key(how.seed, F.col("__epoch"), F.col(id_col)))
    return taken.where("__key <= __upto").select(*[docs[c] for c in docs.columns], F.col("__source"), F.col("__epoch"), F.col("__block"), F.col("__block_rank"), F.col("__key"))


#: op1's parameters: nearly even sources within as many tokens as there are, no document more than four times.
PRODUCTION = Mix(target_entropy=0.98, max_repetition=4.0, budget=1.0)


def op1(spark, sf_dir: str) -> DataFrame:
    got = mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), PRODUCTION)
    return got.select("doc_id", F.col("__source").alias("source"), F.col("__epoch").alias("epoch"), F.col("__block").alias("block"), F.col("__block_rank").cast("long").alias("block_rank"), F.col("__key").alias("order_key"))


ORACLE = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens FROM documents),
totals AS (SELECT source, sum(tokens)::BIGINT AS total FROM sized GROUP BY source),
facts AS (SELECT count(*) AS n, sum(total)::DOUBLE AS t, min(total)::DOUBLE AS least FROM totals WHERE total > 0),
shares AS (SELECT ln(total / t) AS lp FROM totals, facts WHERE total > 0),
entropy(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
      ln(sum(exp((lo + hi) / 2 * lp))) - (lo + hi) / 2 * sum(exp((lo + hi) / 2 * lp) * lp) / sum(exp((lo + hi) / 2 * lp)) >= 0.98 * any_value(ln(n)) AS ok
    FROM entropy, shares, facts WHERE i < 40 GROUP BY i, lo, hi)),
repetition(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, pow(any_value(least / t), (lo + hi) / 2 - 1) / sum(exp((lo + hi) / 2 * lp)) > 4.0 AS ok
    FROM repetition, shares, facts WHERE i < 40 GROUP BY i, lo, hi)),
chosen AS (SELECT round(greatest(
  CASE WHEN (SELECT -sum(exp(lp) * lp) FROM shares) >= 0.98 * (SELECT ln(n) FROM facts) THEN 1.0 ELSE (SELECT lo FROM entropy WHERE i = 40) END,
  (SELECT lo FROM repetition WHERE i = 40)), 9) AS a),
weighted AS (SELECT source, total, CASE WHEN total > 0 THEN pow(total::DOUBLE, a) ELSE 0 END AS x FROM totals, chosen),
quota AS (
  SELECT source, total, floor(x / (SELECT sum(x) FROM weighted) * (SELECT t FROM facts))::BIGINT AS quota,
    least(greatest(ceil(total / 65536), 1), 4096)::BIGINT AS blocks FROM weighted),
paid AS (
  SELECT *, CASE WHEN total > 0 THEN quota // total ELSE 0 END AS epochs, quota - CASE WHEN total > 0 THEN quota // total ELSE 0 END * total AS rest FROM quota),
placed AS (
  SELECT s.*, p.epochs, p.rest, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % p.blocks AS block FROM sized s JOIN paid p USING (source)),
sums AS (SELECT source, block, epochs, rest, sum(tokens) AS held FROM placed GROUP BY ALL),
ranked AS (
  SELECT source, block, epoch, epochs, rest, held,
    row_number() OVER (PARTITION BY source, epoch ORDER BY ('0x' || substr(md5('mix:' || source || ':' || epoch || ':' || block), 1, 15))::BIGINT, block) AS block_rank,
    sum(held) OVER (PARTITION BY source, epoch ORDER BY ('0x' || substr(md5('mix:' || source || ':' || epoch || ':' || block), 1, 15))::BIGINT, block ROWS UNBOUNDED PRECEDING) - held AS before
  FROM (SELECT *, unnest(range(0, epochs + 1)) AS epoch FROM sums)),
keyed AS (
  SELECT p.doc_id, p.source, r.epoch, p.block, r.block_rank, p.tokens, r.before, r.held, r.epochs, r.rest,
    ('0x' || substr(md5('mix:' || r.epoch || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS order_key
  FROM placed p JOIN ranked r ON p.source = r.source AND p.block = r.block),
counted AS (SELECT *, sum(tokens) OVER (PARTITION BY source, block, epoch ORDER BY order_key RANGE UNBOUNDED PRECEDING) AS paid FROM keyed)
SELECT doc_id, source, epoch, block, block_rank, order_key FROM counted WHERE epoch < epochs OR before + held <= rest OR before + paid <= rest
"""
