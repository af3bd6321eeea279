"""Mixing sources to target weights.

Every row gets a hash-random key. Within a source the rows are range-sorted by
that key, word counts are summed up as a distributed prefix sum, and the source
is cut at its exact budget; budgets above the source's size repeat it in epochs.

Keys are uniform, so their leading hex digits are range partitions with known
bounds: a hot source spreads over 16**digits ranges, no range needs sampling,
and the prefix sum is (sum per range) + (running sum of at most 16**digits
ranges per source) + (running sum inside one range).

Defined cases: a null text has size 0; a null source is a source of its own and
last; a null doc_id is hashed like an empty id; rows that are equal in id and
text are interchangeable; an empty table gives an empty plan. The plan has a row
per document, with row_key to tell documents of one id apart; other columns of the input
stay with the documents, and materialise() returns them, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import row_key, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = 3  # 1, 2, 3, repeating
MAX_EPOCHS = 3
RANGE_DIGITS = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: weight, target and whole-word budget, from (source, source_size).

    Sources stop at max_epochs times their size and the excess goes to the
    others by weight. Sorted by size/weight the stopped ones come first, so the
    level of the others follows from running sums. One row per source: this is
    the pre-aggregated table, whose size is the number of sources.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", ((F.col("rank") - 1) % WEIGHTS + 1).cast("long"))
    # size/weight as a whole number: 6 is divisible by each weight
    level = Window.orderBy(F.col("source_size") * F.expr("6 div weight"), "rank")
    before, everything = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("num", F.sum("source_size").over(everything) - F.coalesce(max_epochs * F.sum("source_size").over(before), F.lit(0)))
        .withColumn("den", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("stops", max_epochs * big("source_size") * big("den") < big("num") * big("weight"))
        .withColumn("open", F.first(F.when(~F.col("stops"), F.struct("num", "den")), ignorenulls=True).over(everything))
    )
    share = F.col("weight") * F.col("open.num")
    return filled.select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("stops"), (max_epochs * F.col("source_size")).cast("double")).otherwise(share.cast("double") / F.col("open.den").cast("double")).alias("target"),
        F.when(F.col("stops"), max_epochs * F.col("source_size")).otherwise(F.expr("(weight * open.num) div open.den")).alias("budget"),
    )


def mix_sources(docs: DataFrame, *, seed: str = SEED, max_epochs: int = MAX_EPOCHS, range_digits: int = RANGE_DIGITS) -> DataFrame:
    """One row per document: doc_id, row_key, source, size, source_size, target, taken.

    `taken` counts the words the mix takes of the document, repeats counted: as
    many whole epochs as fit into the budget, then the rest of the budget along
    the key order, the last document in part.
    """
    sized = staged(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
            row_key().alias("row_key"),
        ),
        "sizes",
    )
    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias("source_key")
    rows = sized.select("*", named, F.substring("key", 1, range_digits).alias("range"))
    sums = staged(rows.groupBy("source", "source_key", "range").agg(F.sum("size").alias("range_size")), "range-sizes")
    targets = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), max_epochs)
    before = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sums.withColumn("range_start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
        .join(targets.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")))
        .select("source_key", "range", "range_start", "source_size", "target", "budget")
    )
    inside = Window.partitionBy("source_key", "range").orderBy("key", "doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.expr("coalesce(budget div nullif(source_size, 0), 0)")
    rest = F.col("budget") - epochs * F.col("source_size") - F.col("start")
    return (
        rows.join(starts, ["source_key", "range"])
        .withColumn("start", F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .select("doc_id", "row_key", "source", "size", "source_size", "target", (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long").alias("taken"))
    )


def materialise(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mixed documents with all their columns: each as often as the plan takes it, the last copy cut to its words.

    Rows of equal id and text are told apart by a number; which of them gets
    which of their shares is open, since their texts are the same.
    """
    same = Window.partitionBy("_row")
    shares = plan.where("taken > 0").select(F.col("row_key").alias("_row"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    shares = shares.withColumn("_n", F.row_number().over(same.orderBy(F.desc("_taken"))))
    numbered = docs.withColumn("_row", row_key()).withColumn("_n", F.row_number().over(same.orderBy("_row")))
    copies = numbered.join(shares, ["_row", "_n"]).withColumn("_epoch", F.explode(F.expr("sequence(0L, (_taken - 1) div _size)")))
    words = F.least(F.col("_size"), F.col("_taken") - F.col("_epoch") * F.col("_size"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, words.cast("int")), " ")
    return copies.select(*[F.when(words < F.col("_size"), cut).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rnk FROM per),
weighted AS (SELECT *, (rnk - 1) % 3 + 1 AS w FROM ranked),
lev AS (
  SELECT *, (sum(source_size) OVER ())::HUGEINT - coalesce(3 * sum(source_size) OVER o, 0)::HUGEINT AS num,
         (sum(w) OVER ())::HUGEINT - coalesce(sum(w) OVER o, 0)::HUGEINT AS den
  FROM weighted WINDOW o AS (ORDER BY source_size * (6 // w), rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (SELECT *, 3 * source_size * den < num * w AS stops FROM lev),
opened AS (SELECT num AS onum, den AS oden FROM flagged WHERE NOT stops ORDER BY source_size * (6 // w), rnk LIMIT 1),
target AS (
  SELECT source, source_size,
         CASE WHEN stops THEN (3 * source_size)::DOUBLE ELSE (w * onum)::DOUBLE / oden::DOUBLE END AS target,
         CASE WHEN stops THEN 3 * source_size ELSE (w * onum) // oden END AS budget
  FROM flagged LEFT JOIN opened ON true),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (coalesce(budget // nullif(source_size, 0), 0) * size
        + greatest(0, least(size, budget - coalesce(budget // nullif(source_size, 0), 0) * source_size - start)))::BIGINT AS taken
FROM placed
"""
