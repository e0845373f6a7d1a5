"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks (DataFrame operations only).

1. Every source gets a target number of words: its share by weight, but at most ``max_epochs`` times what it has.
2. Its documents are put into a hashed order, which depends on ``doc_id`` and ``seed`` alone, and their words are
   cut into blocks of ``block_words``.
3. Slot t of the schedule holds the fractional part of t times the golden ratio. Mapped through the cumulative
   weights this names a source; the n-th slot of a source takes its n-th block, starting over after the last one.
4. Slots and pieces of documents meet in a join on (source, block).

Defined results: a null text or one without words has size 0 and nothing is taken from it; a null source is a
source of its own, the last; documents with null or repeated ids are kept row by row; equal rows are
interchangeable; an empty table gives an empty mix. Other columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repurchase.llm.storage import WORD, stored, with_start

WEIGHTS = (5, 2, 1)
# Cells into which the unit interval is cut to find the source of a point by an equi-join.
CELLS = 1024
GOLDEN = "0.618033988749894848"


@dataclass(frozen=True)
class Mix:
    """documents: doc_id, size, source_id, start, source_size, target; schedule: slot, source_id, block, take;
    pieces: start, source_id, block, first and last word of the block that the document fills."""

    documents: DataFrame
    sources: DataFrame
    schedule: DataFrame
    pieces: DataFrame


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """source, source_size -> source_id, weight, cap, target (double).

    Shares by weight that exceed a cap are cut to it and the excess is shared again. The final level is found at
    once: with sources by cap per weight, the first one whose cap is not below the level that is left over.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    named = sizes.withColumn("source_id", F.row_number().over(by_name) - 1)
    ratings = F.array(*[F.lit(float(w)) for w in weights])
    rated = named.withColumn("weight", F.element_at(ratings, F.pmod("source_id", F.lit(len(weights))) + 1))
    rated = rated.withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_id")
    every = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(every)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    found = rated.withColumn("level", level).withColumn("rank", F.row_number().over(by_ratio))
    fits = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct("rank", "level"))
    return (
        found.withColumn("level", F.min(fits).over(every)["level"])
        .withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
        .drop("rank", "level")
    )


def plan_blocks(sources: DataFrame, block_words: int) -> DataFrame:
    """Add goal (whole words), n_blocks and n_slots of every source."""
    size = F.col("source_size")
    goal = F.floor(F.col("target") + 0.5)
    blocks = F.ceil(size / block_words).cast("long")
    epochs = F.when(size > 0, F.floor(F.col("goal") / size)).otherwise(0).cast("long")
    return (
        sources.withColumn("goal", goal.cast("long"))
        .withColumn("n_blocks", blocks)
        .withColumn("n_slots", epochs * F.col("n_blocks") + F.ceil((F.col("goal") - epochs * size) / block_words).cast("long"))
    )


def schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """slot, source_id, rank, block, take (words of the block that the slot takes)."""
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    upto = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = (
        sources.where("n_slots > 0")
        .withColumn("high", F.sum("n_slots").over(upto).cast("decimal(20,0)"))
        .withColumn("low", F.col("high") - F.col("n_slots"))
    )
    cell_of = lambda c: F.floor(c * CELLS / F.lit(max(total, 1))).cast("long")
    cells = bounds.select(
        "source_id", "low", "high", F.explode(F.sequence(cell_of(F.col("low")), cell_of(F.col("high")))).alias("cell")
    )
    point = (F.col("id").cast("decimal(18,0)") * F.lit(GOLDEN).cast("decimal(18,18)")) % F.lit(1).cast("decimal(1,0)")
    points = spark.range(total).select(F.col("id").alias("slot"), (point * F.lit(total).cast("decimal(18,0)")).alias("at"))
    drawn = (
        points.withColumn("cell", cell_of(F.col("at")))
        .join(cells, "cell")
        .where("at >= low and at < high")
        .select("slot", "source_id", F.shiftright("slot", 14).alias("chunk"), F.lit(1).alias("one"))
    )
    ranked = with_start(drawn, ["source_id"], "chunk", ["slot"], "one", "rank").select("slot", "source_id", "rank")
    # The points of a source differ from its share by a few; what is missing follows at the end.
    counts = ranked.groupBy("source_id").agg(F.count("*").alias("n"))
    late = (
        sources.where("n_slots > 0")
        .join(counts, "source_id", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .where("n < n_slots")
        .select(F.explode(F.sequence(F.col("n"), F.col("n_slots") - 1)).alias("rank"), "source_id")
        .select((F.lit(total) + F.col("rank")).alias("slot"), "source_id", "rank")
    )
    block = F.pmod("rank", "n_blocks")
    epoch = F.floor(F.col("rank") / F.col("n_blocks")).cast("long")
    start = epoch * F.col("source_size") + F.col("block") * block_words
    length = F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words)
    return (
        ranked.unionByName(late)
        .join(sources, "source_id")
        .where("rank < n_slots")
        .withColumn("block", block)
        .withColumn("take", F.least(length, F.col("goal") - start))
        .select("slot", "source_id", "rank", "block", "take")
    )


def mix(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, block_words: int = 256,
    seed: int = 17, bucket_digits: int = 2, carry: tuple[str, ...] = (),
) -> Mix:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = stored(
        documents.select("doc_id", "source", *carry, word_count().alias("size"))
        .withColumn("order", F.md5(F.concat(name, F.lit(f":{seed}"))))
        .withColumn("bucket", F.substring("order", 1, bucket_digits))
    )
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(plan_blocks(targets(sizes, weights, max_epochs), block_words))
    keyed = docs.join(
        sources.select(F.col("source").alias("s"), "source_id", "source_size", "target"),
        F.col("source").eqNullSafe(F.col("s")),
    ).drop("s", "source")
    placed = stored(with_start(keyed, ["source_id"], "bucket", ["order", "doc_id", "size"], "size", "start"))
    end = F.col("start") + F.col("size")
    blocks = F.sequence(
        F.floor(F.col("start") / block_words).cast("long"), F.floor((end - 1) / block_words).cast("long")
    )
    pieces = (
        placed.where("size > 0")
        .withColumn("block", F.explode(blocks))
        .withColumn("first", F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0)))
        .withColumn("last", F.least(end - F.col("block") * block_words, F.lit(block_words)))
    )
    return Mix(placed, sources, schedule(sources, block_words), pieces)


def taken(mixed: Mix, block_words: int = 256, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies (how often the first word of the document is taken)."""
    keys = ["source_id", "start", "doc_id", "size", "source_size", "target", *carry]
    slots = mixed.schedule.select("source_id", "block", "take")
    words = F.greatest(F.least(F.col("last"), F.coalesce("take", F.lit(0))) - F.col("first"), F.lit(0))
    begins = (F.col("block") * block_words + F.col("first") == F.col("start")) & (F.col("take") > F.col("first"))
    sums = (
        mixed.pieces.join(slots, ["source_id", "block"], "left")
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken"),
            F.count(F.when(begins, 1)).alias("copies"),
        )
    )
    empty = mixed.documents.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"), F.lit(1).cast("long").alias("copies"))
    return sums.unionByName(empty).drop("source_id", "start")


def mixed_documents(documents: DataFrame) -> DataFrame:
    """Every document as often as the mix takes its first word (up to three times, or not at all); empty ones once."""
    packed = documents.select(F.struct(*documents.columns).alias("_document"))
    rows = stored(packed.withColumn("_row", F.monotonically_increasing_id()), "rows")
    named = rows.select("_row", "_document.doc_id", "_document.source", "_document.text")
    copies = taken(mix(named, carry=("_row",)), carry=("_row",)).select("_row", "copies").where("copies > 0")
    repeated = rows.join(copies, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select("_document.*")
