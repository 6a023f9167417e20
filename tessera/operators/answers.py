"""Answer metrics: overlap of an answer's tokens with reference answers, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import answer_tokens, canonical_form


def numbered(tokens: Column) -> Column:
    """Each token of a sorted array with the number of equal ones before it, so that sets of them are multisets."""
    return F.transform(tokens, lambda t, i: F.concat(t, F.lit(" "), (i - F.array_position(tokens, t)).cast("string")))


def evaluate(answers: DataFrame, normal=canonical_form) -> DataFrame:
    """answers (question_id, strategy, prediction, reference) with precision, recall, f1, exact and containment of the
    normal forms. Two empty answers agree.

    The work for a row is large for its size, so rows are dealt out before it."""
    answers = answers.repartition(int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions")), "question_id")
    rows = answers.withColumn("__p", normal(F.col("prediction"))).withColumn("__r", normal(F.col("reference")))
    p, r = answer_tokens(F.col("__p")), answer_tokens(F.col("__r"))
    tokens = F.struct(p.alias("p"), r.alias("r"), F.sort_array(p).alias("ps"), F.sort_array(r).alias("rs"), (F.col("__p") == F.col("__r")).cast("double").alias("exact"))
    # the generator keeps the tokens from being computed anew wherever they are used
    rows = rows.select(*answers.columns, F.explode(F.array(tokens)).alias("t"))
    np_, nr = F.size("t.p"), F.size("t.r")
    both = F.size(F.array_intersect(numbered(F.col("t.ps")), numbered(F.col("t.rs"))))
    part = lambda n: F.when((np_ == 0) & (nr == 0), 1.0).when((np_ == 0) | (nr == 0), 0.0).otherwise(both / n)
    spaced = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    inside = F.when(nr == 0, (np_ == 0).cast("double")).otherwise(F.contains(spaced(F.col("t.p")), spaced(F.col("t.r"))).cast("double"))
    rows = rows.select(*answers.columns, part(np_).alias("precision"), part(nr).alias("recall"), F.col("t.exact").alias("exact"), inside.alias("containment"))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return rows.select(*answers.columns, "precision", "recall", f1.alias("f1"), "exact", "containment")


def evaluate_references(answers: DataFrame, references: DataFrame, normal=canonical_form) -> DataFrame:
    """The best reference for each metric, the first among equals; precision and recall are those of F1's reference.

    references: (question_id, reference_index, reference). Metrics that agree to twelve places are equal: the F1 of 12 of 56
    and 44 tokens and that of 15 of 56 and 69 are both 0.24, but differ in their last bit.
    """
    met = evaluate(answers.select("question_id", "strategy", "prediction").join(references, "question_id"), normal)
    best = lambda m: F.max_by(F.struct(m, "reference_index", "precision", "recall"), F.struct(F.round(m, 12), -F.col("reference_index")))
    rows = met.groupBy("question_id", "strategy").agg(best("f1").alias("f"), F.max("exact").alias("exact"), F.max("containment").alias("containment"))
    return rows.select("question_id", "strategy", "f.f1", "f.precision", "f.recall", F.col("f.reference_index").alias("f1_reference"), "exact", "containment")


def statuses(questions: DataFrame, answers: DataFrame, failures: DataFrame) -> DataFrame:
    """Every expected (question_id, strategy) with its answer, or the failure, or 'missing'."""
    key = ["question_id", "strategy"]
    rows = questions.join(answers.withColumn("__a", F.lit(True)), key, "left").join(failures.select(*key, "failure").withColumn("__f", F.lit(True)), key, "left")
    return rows.withColumn("status", F.when(F.col("__a"), "success").when(F.col("__f"), "failed").otherwise("missing")).drop("__a", "__f")


def summary(evaluated: DataFrame, by: list[str]) -> DataFrame:
    """Means over answered questions, and over all expected ones with nothing for the rest; rates of the statuses."""
    out = [F.count("*").alias("expected"), F.count("f1").alias("answered")]
    for m in ("precision", "recall", "f1", "exact", "containment"):
        out += [F.avg(m).alias(m), (F.sum(F.coalesce(m, F.lit(0.0))) / F.count("*")).alias(f"success_aware_{m}")]
    return evaluated.groupBy(*by).agg(*out)


def rolled_summary(evaluated: DataFrame, category: str) -> DataFrame:
    """f1 by strategy, over all questions (category null) and for each category."""
    return evaluated.rollup("strategy", category).agg(F.count("*").alias("questions"), F.avg("f1").alias("f1"), F.avg("exact").alias("exact")).where(F.col("strategy").isNotNull())


def paired(evaluated: DataFrame, strategies: list[str], metric: str = "f1") -> DataFrame:
    """One row for each question, a column for each strategy, and their differences in declared order."""
    wide = evaluated.groupBy("question_id").pivot("strategy", strategies).agg(F.first(metric))
    pairs = [(a, b) for i, a in enumerate(strategies) for b in strategies[i + 1 :]]
    return wide.select("question_id", *strategies, *[(F.col(a) - F.col(b)).alias(f"{a}_minus_{b}") for a, b in pairs])
