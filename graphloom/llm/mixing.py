"""Mixes sources to target weights by capped water-filling.

A source's size is the number of words of its documents. Targets share the whole size by weight; a source whose target
would exceed ``max_epochs`` times its size is clamped there and its excess goes to the others by weight, until none is
above. With sources in ascending order of cap over weight, that fixed point has a closed form: the first k are clamped, the
rest share what is left.

A source with target r times its size takes each document floor(r) whole times, and the fraction of r once more in a
seeded random order of its documents: whole documents as long as they fit, and of the one that reaches the target the
words that are missing, a fractional repetition. So what is taken meets the target to a word. ``copies`` rounds that one
repetition to a whole document or none, whichever is nearer, for those who write whole rows. The order's running sums are
prefix sums of seeded buckets, then of documents within a bucket, so a source with most rows is spread over many tasks.

Null text has size 0 and is never taken; null sources are one source, after all others; sources of size 0 have target
0. Repeated rows each count. An empty table gives no rows. Reruns agree: the order depends on seed, id and text alone. A very
long text is one document, which the quota may take in part. Extra columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import common

WORDS = r"[^\x20\x09-\x0D]+"
#: Rows that a bucket of the seeded order holds, about.
BUCKET_ROWS = 4096
SEED = 17


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    # Runs of white space become one byte and the rest goes, so only counts are held.
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def order_key(seed: int, row_id: Column, text: Column) -> Column:
    """A row's place in the seeded order, as a text; equal for rows equal in id and text only."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), row_id.cast("string"), F.md5(text.cast("binary"))))


def targets(sizes: DataFrame, max_epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """sizes (source, source_size) with a row per source; adds weight and target. Windows over sources, not rows."""
    by_source = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * max_epochs)
    # Exact: integer products decide the order and who is clamped.
    by_level = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), F.col("source").cast("binary"))
    before, all_rows = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    filled = weighed.withColumns({"left": left, "share": share}).withColumn("open", F.col("left") * F.col("weight") <= F.col("cap") * F.col("share"))
    # The first source that is not clamped sets the level for itself and those after it.
    filled = filled.withColumn("n", F.row_number().over(by_level))
    filled = filled.withColumn("first", F.min(F.when(F.col("open"), F.col("n"))).over(all_rows))
    level = {f"level_{c}": F.max(F.when(F.col("n") == F.col("first"), F.col(c))).over(all_rows) for c in ("left", "share")}
    share_of = F.col("level_left").cast("double") * F.col("weight") / F.col("level_share")
    target = F.when(F.col("n") >= F.col("first"), share_of).otherwise(F.col("cap").cast("double"))
    filled = filled.withColumns(level)
    return filled.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, seed: int = SEED, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken, order) for every row of docs.

    Three small shuffles: sums by source, sums by (source, bucket), and the buckets' rows; texts stay where they are.
    """
    kept = common.materialize(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order_key(seed, F.col(id_col), F.col(text_col)).alias("order")),
        "sizes",
    )
    sizes = kept.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aimed = targets(sizes.drop("n"), max_epochs, weights).join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    aimed = common.materialize(aimed.withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS)), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # The leading hex digits rise with the seeded order, so buckets follow each other in it.
    rank = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    aimed = aimed.withColumnRenamed("source", "of")
    rows = kept.join(aimed, F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", F.floor(rank * F.col("buckets") / F.lit(1 << 32)))
    whole = F.floor(ratio)
    rows = rows.withColumns({"whole": whole, "quota": F.col("target") - whole * F.col("source_size")})
    sums = rows.groupBy("of", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("of").alias("of2"), F.col("bucket").alias("bucket2"), F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("base"))
    rows = rows.join(sums, F.col("of").eqNullSafe(F.col("of2")) & (F.col("bucket") == F.col("bucket2")))
    within = Window.partitionBy("of", "bucket").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))
    rows = rows.withColumn("left", F.round(F.col("quota")).cast("long") - start)
    part = F.greatest(F.lit(0), F.least(F.col("left"), F.col("size")))
    taken = (F.col("whole") * F.col("size") + part).cast("long")
    copies = F.when(F.col("size") > 0, F.col("whole") + (2 * part > F.col("size")).cast("long")).otherwise(F.lit(0))
    rows = rows.withColumns({"taken": taken, "copies": copies})
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", "taken", "order")
