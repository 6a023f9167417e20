"""Document fingerprints from closed syncmers, with DataFrame and SQL functions only.

The letters of a text are its words; a run of more than LONG code points without a blank (a sentence of a script without
blanks, say) counts as so many words of one code point. Of the k-mers (k = 5 consecutive words) those are kept whose least hashed inner
substring of s = 2 words stands first or last: whether a k-mer is kept depends on its own words alone, so equal passages
give equal anchors wherever they stand, and any few k-mers in a row hold one. `anchors` returns them with their word
positions, `matches` pairs the equal anchors of two given texts. A document's fingerprint is all its anchors with their
positions; beside it, as a short form, stands a sketch: the SKETCH smallest of their hashes (48 bits each, in hex,
ascending). The likeness of two texts is Dice's share 2 m / (|A| + |B|) with m their matches, of all anchors.

Defined results: a null text is the empty one; without words there are no anchors and the sketch is '', alike (1) to
another empty one and unlike (0) all others; a text of too few words to hold a syncmer has one anchor, the whole sequence
of its words. Rows without an id come behind all others in `edited`; rows equal in id and text each get a row, and have the
same next document; rows of one id with different texts are ordered by a hash of the text. A table of one document is its own next. Columns other
than id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read

K, S, SKETCH, LONG = 5, 2, 64, 24
BLANKS = " \t\n\x0b\x0c\r"
#: Stands for no id within `edited`; a document with this very id comes back without one.
NO_ID = -(1 << 63)
#: Ranges of ids for each shuffle partition.
RANGES = 2


def parts(text: str) -> Column:
    """What stands between blanks. One character is split at, as Java does that without a regular expression."""
    bare = F.coalesce(F.col(text), F.lit(""))
    for blank in BLANKS[1:]:
        bare = F.replace(bare, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(bare, " "), "")


def letters(split: Column, text: str) -> Column:
    """The parts of a text as words: where some are long, these letter by letter."""
    letter = r"[^\x20\x09-\x0D]"
    single = F.regexp_extract_all(F.col(text), F.lit(f"(?<!{letter}){letter}{{1,{LONG}}}(?!{letter})|{letter}"), F.lit(0))
    return F.when(F.exists(split, lambda x: F.length(x) > LONG), single).otherwise(split)


def words(text: str) -> Column:
    return letters(parts(text), text)


def pairs(column: str) -> Column:
    """Hashes of every two neighbouring words, the inner substrings, and behind them one of the last word alone."""
    return F.transform(column, lambda a, i: F.xxhash64(a, F.get(F.col(column), i + 1)))


def chosen(column: str) -> Column:
    """(position, anchor) of the closed syncmers in order of their places; of fewer than k words none."""
    at = lambda i: F.get(F.col(column), i)
    n = F.greatest(F.size(column) - (K - 1), F.lit(0))

    def keep(a: Column, i: Column) -> Column:
        anchor = F.shiftrightunsigned(F.xxhash64(F.xxhash64(a, at(i + 3)), F.xxhash64(at(i + 1), at(i + 2))), 16)
        return F.when(F.least(a, at(i + 3)) <= F.least(at(i + 1), at(i + 2)), F.struct(i.alias("position"), anchor.alias("anchor")))

    return F.array_compact(F.transform(F.slice(column, 1, n), keep))


def once(column: Column) -> Column:
    """The column, which a filter above (that of a generator, say) is not moved past: moved, it would put a copy of the
    expression into the lambdas that name the column, to be evaluated for each element."""
    return F.when(F.spark_partition_id() >= 0, column)


def with_words(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the hashes of pairs of words as out_g and the words as out_w. Every step is a column that the next one names
    more than once, so that none is worked out again for each element."""
    w, g = f"{out}_w", f"{out}_g"
    return df.withColumn(w, parts(text)).withColumn(w, letters(F.col(w), text)).withColumn(g, once(pairs(w)))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with all anchors of a text, (position, anchor) in order of their places."""
    w, g = f"__{out}_w", f"__{out}_g"
    df = with_words(df, text, f"__{out}").withColumn(out, chosen(g))
    whole = F.shiftrightunsigned(F.xxhash64(F.array_join(F.col(w), " ")), 16)
    alone = F.array(F.struct(F.lit(0).alias("position"), whole.alias("anchor")))
    return df.withColumn(out, F.when((F.size(out) == 0) & (F.size(w) > 0), alone).otherwise(F.col(out))).drop(w, g)


def spelled(hashes: Column) -> Column:
    """The sketch: at most SKETCH hashes, ascending."""
    least = F.slice(F.array_distinct(F.sort_array(hashes)), 1, SKETCH)
    return F.lower(F.array_join(F.transform(least, lambda h: F.lpad(F.hex(h), 12, "0")), ""))


def repeats(hashes: Column) -> Column:
    """The hashes without one of each: those equal to the one before in ascending order."""
    ordered, n = F.sort_array(hashes), F.size(hashes) - 1
    return F.array_compact(F.zip_with(F.slice(ordered, 1, n), F.slice(ordered, 2, n), lambda a, b: F.when(a == b, a)))


def common(a: Column, b: Column) -> Column:
    """How many hashes of a meet an equal one of b, each one only: the hashes of both are sorted together, those of a before
    equal ones of b, and counted in one pass."""
    side = lambda c, odd: F.transform(c, lambda h: h * 2 + odd)
    start = F.struct(F.lit(-1).cast("long").alias("anchor"), F.lit(0).alias("free"), F.lit(0).alias("met"))

    def step(state: Column, x: Column) -> Column:
        anchor, right = F.shiftright(x, 1), x.bitwiseAND(F.lit(1)) == 1
        free = F.when(state["anchor"] == anchor, state["free"]).otherwise(F.lit(0))
        return F.struct(
            anchor.alias("anchor"),
            F.when(right, F.greatest(free - 1, F.lit(0))).otherwise(free + 1).alias("free"),
            (state["met"] + F.when(right & (free > 0), F.lit(1)).otherwise(F.lit(0))).alias("met"),
        )

    return F.aggregate(F.sort_array(F.concat(side(a, 0), side(b, 1))), start, step, lambda state: state["met"])


def likeness(a: str, b: str) -> Column:
    """Dice's share from all hashes of two texts: the n-th place of an anchor in one meets its n-th place in the other.

    First places meet where a hash stands in both; further places are counted only if both texts repeat a hash.
    """
    x, y = F.col(a), F.col(b)
    repeated = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    met = F.size(F.array_intersect(x, y)) + F.when(repeated(x) & repeated(y), common(repeats(x), repeats(y))).otherwise(F.lit(0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2 * met.cast("double") / (F.size(a) + F.size(b)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, anchors) of every whole text: its sketch, and all its anchors with their positions."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_anchors(rows, "text", "anchors").select("doc_id", spelled(F.col("anchors")["anchor"]).alias("fingerprint"), "anchors")


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position, anchor): every closed syncmer with the number of its first word, from 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_words(rows, "text", "x").withColumn("c", once(chosen("x_g"))).select("doc_id", F.inline("c"))


def matches(pairs_of_texts: DataFrame, left: str = "left", right: str = "right", id_col: str = "pair_id") -> DataFrame:
    """(pair_id, anchor, left_position, right_position) for every row's two texts: the n-th place of an anchor in the
    left text meets its n-th place in the right one. Texts are met within their own row's pair only."""

    def numbered(text: str, name: str) -> DataFrame:
        found = anchors(pairs_of_texts, id_col, text)
        nth = F.row_number().over(Window.partitionBy("doc_id", "anchor").orderBy("position"))
        return found.select(F.col("doc_id").alias("pair_id"), "anchor", nth.alias("nth"), F.col("position").alias(name))

    both = numbered(left, "left_position").join(numbered(right, "right_position"), ["pair_id", "anchor", "nth"])
    return both.select("pair_id", "anchor", "left_position", "right_position")


def within(start: str, after: str) -> Column:
    """Whether (doc_id, h), in descending order, stands at start or behind it, and before the start that comes after."""
    reached = lambda key: (F.col("doc_id") < F.col(f"{key}.doc_id")) | ((F.col("doc_id") == F.col(f"{key}.doc_id")) & (F.col("h") <= F.col(f"{key}.h")))
    return reached(start) & (F.col(after).isNull() | ~reached(after))


def bounds(ids: DataFrame, ranges: int) -> DataFrame:
    """(range, group, start, after, before): at most so many ranges of (doc_id, h) in descending order, with the first
    row of each, the first row after it and the number of the range before it, round the end. Groups are runs of ranges."""
    ranged = ids.repartitionByRange(ranges, F.col("doc_id").desc(), F.col("h").desc()).withColumn("range", F.spark_partition_id())
    starts = cut(ranged.groupBy("range").agg(F.max(F.struct("doc_id", "h")).alias("start")))
    line = Window.orderBy("range")  # a row for each range
    round_ = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("range").over(line), F.last("range").over(round_))
    group = F.floor(F.col("range") / math.isqrt(ranges))
    return cut(starts.select("range", group.alias("group"), "start", F.lead("start").over(line).alias("after"), before.alias("before")))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document against its text with the second half replaced by the start of the next document.

    Texts are shuffled once, into ranges of descending ids; the first document of a range is also sent to the range
    before, as a visitor behind all others. So each meets the next one within its range, in order, with the anchors that
    this one has already.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("h", F.xxhash64("text"))
    ids = cut(base.groupBy("doc_id", "h").agg(F.count("*").alias("copies")))
    edges = bounds(ids.select("doc_id", "h"), RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = edges.groupBy("group").agg(F.max("start").alias("from"), F.max_by("after", "range").alias("to"))
    # a row meets one group, then one range: each side has about the root of the number of ranges to look through
    placed = base.join(F.broadcast(groups), within("from", "to")).join(F.broadcast(edges), ["group"]).where(within("start", "after"))
    first = (F.col("doc_id") == F.col("start.doc_id")) & (F.col("h") == F.col("start.h"))
    own, visit = F.struct("range", F.lit(False).alias("visitor")), F.struct(F.col("before").alias("range"), F.lit(True).alias("visitor"))
    rows = placed.select("doc_id", "h", "text", F.inline(F.when(first, F.array(own, visit)).otherwise(F.array(own)))).repartitionByRange("range")
    repeated = not ids.where("copies > 1").isEmpty()
    if repeated:
        rows = rows.groupBy("range", "visitor", "doc_id", "h").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    order = ["visitor", F.col("doc_id").desc(), F.col("h").desc()]
    rows = with_anchors(rows.sortWithinPartitions("range", *order), "text", "anchors").withColumn("hashes", F.col("anchors")["anchor"])
    following = Window.partitionBy("range").orderBy(*order)
    met = rows.withColumn("next_text", F.lead("text").over(following)).withColumn("next_hashes", F.lead("hashes").over(following))
    met = met.where(~F.col("visitor")).withColumn("n", F.length("text"))
    met = met.withColumn("edit", F.expr("concat(left(text, n - cast(floor(n / 2) as int)), left(next_text, cast(floor(n / 2) as int)))"))
    met = with_anchors(met, "edit", "edited_anchors").withColumn("edited_hashes", F.col("edited_anchors")["anchor"])
    if repeated:
        met = met.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return met.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edit"), 256).alias("edited_sha256"),
        spelled(F.col("hashes")).alias("fingerprint"),
        spelled(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness("hashes", "edited_hashes").alias("near_edited"),
        likeness("hashes", "next_hashes").alias("near_next"),
        "anchors",
        "edited_anchors",
    )


def op5(spark, sf_dir: str) -> DataFrame:
    return edited(read(spark, sf_dir, "documents"))
