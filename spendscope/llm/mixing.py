"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spendscope.llm.texts import WORD
from spendscope.session import settle

BLOCK_WORDS = 32
REPEATS = 3  # a target stops at so many times its source's size
SEED = "mix"
PARTS = 1024  # parts of a source's shuffled line; only their sums are looked at together
RUN = 4096  # consecutive slots that are ranked together; only their counts are looked at across runs
SPARE_SLOTS = 8  # more slots per source than needed, as a schedule strays by a few

# The points are multiples of the golden ratio, in whole numbers modulo a prime.
PRIME = 2147483647
GOLDEN = 1327217885


def size_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), 0)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size`` (one row per source) with ``place, weight, target``.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. They share all words by weight; a
    target stops at ``repeats`` times its source's size and the rest is shared again until none is above.
    Each round fixes the sources that the current share carries over their limit: a few sums, no rows.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())  # one row per source
    ranked = settle(
        sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", (F.col("place") - 1) % 3 + 1), "sources"
    )
    cap = repeats * F.col("source_size")
    weight = F.col("weight").cast("long")  # a total below 2^31 is an int for Spark, but twice or three times it may not be
    total, weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    left, sharing = total or 0, weights or 0
    while sharing:
        over = cap * F.lit(sharing) <= weight * F.lit(left)
        capped, heavy = ranked.where(over).agg(F.sum(cap), F.sum("weight")).first()
        now = ((total or 0) - (capped or 0), weights - (heavy or 0))
        if now == (left, sharing):
            break
        left, sharing = now
    if not sharing:
        return ranked.withColumn("target", cap.cast("double"))
    share = (weight * F.lit(left)).cast("double") / F.lit(float(sharing))
    return ranked.withColumn("target", F.when(cap * F.lit(sharing) <= weight * F.lit(left), cap.cast("double")).otherwise(share))


def schedule(shares: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The slots of the mix in order: ``slot, place, turn`` (how many slots the source had before).

    Slot ``t`` is the point ``t * golden ratio`` modulo 1; the source whose stretch of the cumulative
    targets holds the point fills it. Stretches are cut at cells so that points find them by equality; a
    cell holds 17/16 stretches on average whatever the targets. Turns are counted within runs of slots,
    then across the counts of the runs. A source whose blocks are short, as those of tiny sources are, needs
    more slots than its share of points: after the last point each source gets the turns that it lacks.
    """
    spark = shares.sparkSession
    total, sources = shares.agg(F.sum("target"), F.count("*")).first()
    slots = int((total or 0) // block_words) + 1 + SPARE_SLOTS * sources if total else 0
    cell = max(1, PRIME // (16 * max(1, sources)))
    upto = W.orderBy("place").rowsBetween(W.unboundedPreceding, 0)  # one row per source
    ends = shares.withColumn("_end", F.round(F.sum("target").over(upto) / F.lit(total or 1.0) * PRIME).cast("long"))
    stretches = (
        ends.withColumn("_start", F.lag("_end", 1, 0).over(W.orderBy("place")))
        .where("_end > _start")
        .select("place", "_start", "_end", F.explode(F.sequence(F.floor(F.col("_start") / cell), F.floor((F.col("_end") - 1) / cell))).alias("_cell"))
    )
    parts = max(1, min(10_000, slots // 100_000 + 1))
    point = spark.range(0, slots, 1, parts).select(
        F.col("id").alias("slot"), (F.col("id") % PRIME * GOLDEN % PRIME).alias("_point")
    )
    filled = (
        point.withColumn("_cell", F.floor(F.col("_point") / cell))
        .join(stretches, "_cell")
        .where("_point >= _start and _point < _end")
        .select("slot", "place", F.floor(F.col("slot") / RUN).alias("_run"))
    )
    counts = filled.groupBy("place", "_run").agg(F.count("*").alias("_n"))
    before = W.partitionBy("place").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("place", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("place", "_run").orderBy("slot"))
    given = (
        filled.withColumn("_within", within)
        .join(counts, ["place", "_run"])
        .select("slot", "place", (F.col("_before") + F.col("_within") - 1).alias("turn"))
    )
    goal, size = F.floor("target").cast("long"), F.col("source_size")
    needed = F.floor(goal / size) * F.ceil(size / block_words) + F.ceil(goal % size / block_words)
    had = filled.groupBy(F.col("place").alias("_p")).agg(F.count("*").alias("_had"))
    short = (
        shares.where("source_size > 0")
        .join(had, F.col("place") == F.col("_p"), "left")
        .select("place", F.coalesce("_had", F.lit(0)).alias("_had"), needed.alias("_needed"))
        .where("_needed > _had")
    )
    earlier = W.orderBy("place").rowsBetween(W.unboundedPreceding, -1)  # one row per source
    first = F.lit(slots) + F.coalesce(F.sum(F.col("_needed") - F.col("_had")).over(earlier), F.lit(0)) - F.col("_had")
    lacking = short.withColumn("_first", first).select(
        "place", "_first", F.explode(F.sequence(F.col("_had"), F.col("_needed") - 1)).alias("turn")
    )
    return given.unionByName(lacking.select((F.col("_first") + F.col("turn")).alias("slot"), "place", "turn"))


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` with ``start``: where the document begins on its source's shuffled line of words.

    The order is by a seeded digest of the id, then id and size, so reruns agree and rows that tie in all
    of them are interchangeable.
    """
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    shuffled = docs.withColumn("_digest", digest).withColumn("_part", F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long") % PARTS)
    sums = shuffled.groupBy("source", "_part").agg(F.sum("size").alias("_sum"))
    before = W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = W.partitionBy("source", "_part").orderBy("_digest", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    return (
        shuffled.withColumn("_within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        .join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
        .select("doc_id", "source", "size", (F.col("_base") + F.col("_within")).alias("start"))
    )


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, source, size, source_size, target, taken``.

    ``taken`` is how many words the mix takes of the document, repeats counted. The shuffled line of each
    source is cut into blocks of ``block_words``; the source's ``n``-th slot takes block ``n`` and the
    line starts again at its end; the slot that reaches the target is cut. Documents without words take
    part with 0, a null source is a source, repeated rows are separate documents, and an empty table gives
    an empty result. Only ``doc_id, text, source`` are read.
    """
    sized = settle(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    shares = settle(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "shares")
    goal, size, turn = F.floor("target").cast("long"), F.col("source_size"), F.col("turn")
    per_round = F.ceil(size / block_words)
    slots = (
        schedule(shares, block_words)
        .join(F.broadcast(shares) if shares.count() <= 100_000 else shares, "place")
        .withColumn("block", turn % per_round)
        .withColumn("_before", F.floor(turn / per_round) * size + F.col("block") * block_words)
        .withColumn("_left", goal - F.col("_before"))
        .withColumn("_length", F.least(F.lit(block_words), size - F.col("block") * block_words))
        .where("_left > 0")
    )
    whole = F.col("_left") >= F.col("_length")
    takes = slots.groupBy("place", "block").agg(
        F.sum(whole.cast("long")).alias("_times"), F.coalesce(F.max(F.when(~whole, F.col("_left"))), F.lit(0)).alias("_cut")
    )

    shared = shares.select(F.col("source").alias("_s"), "place", "source_size", "target")
    placed = lines(sized).join(shared, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    end = F.col("start") + F.col("size")
    spoken = placed.where("size > 0")
    pieces = spoken.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words)))
    )
    base = F.col("block") * block_words
    low = F.greatest(F.col("start"), base) - base
    high = F.least(end, base + block_words) - base
    words = F.coalesce(F.col("_times") * (high - low) + F.greatest(F.lit(0), F.least(high, F.col("_cut")) - low), F.lit(0))
    results = ["doc_id", "source", "size", "source_size", "target"]
    taken = (
        pieces.join(takes, ["place", "block"], "left")
        .withColumn("_words", words)
        .groupBy("start", *results)
        .agg(F.sum("_words").alias("taken"))
        .select(*results, "taken")
    )
    return taken.unionByName(placed.where("size = 0").select(*results, F.lit(0).cast("long").alias("taken")))
