"""Benchmark decontamination by whole windows of words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.llm.texts import fixed, spare, text_key
from spendscope.session import settle

WINDOW = 10
BITS = 18  # the sieve in the plan has 2**18 values at most, whatever the benchmark
BROADCAST_WINDOWS = 300_000  # a window takes some 150 bytes, so 45 MB at most; beyond, Spark chooses the join

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of digits, letters and all that is not ASCII; null has none."""
    plain = F.coalesce(text, F.lit(""))
    low = F.when(plain.rlike(r"[^\x00-\x7F]"), F.translate(plain, UPPER, LOWER)).otherwise(F.lower(plain))
    return F.array_remove(F.split(low, BREAK), "")


@dataclass(frozen=True)
class Windows:
    """The windows of a benchmark (``window``, ``length``, ``items``) and what the sieve needs of them."""

    rows: DataFrame
    count: int
    sieve: dict[int, tuple[list[int], list[int]]]  # by length: low bits of the first pair's hash, of the window's


def _low(expression: str) -> str:
    return f"({expression} & {2**BITS - 1}L)"


def _head(i: str, length: int) -> str:
    return f"xxhash64(_w[{i}])" if length == 1 else f"xxhash64(_w[{i}], _w[{i} + 1])"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> Windows:
    """All windows of ``window`` consecutive words of each item; a shorter item is one window.

    Items without words have none. Items that repeat share their windows; a null ``item_id`` is
    written ``null``.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), fixed(tokens(F.col("text"))).alias("_w")
    ).where(F.size("_w") > 0)
    cut = (
        items.withColumn("length", F.least(F.size("_w"), F.lit(window)))
        .withColumn("at", F.explode(F.expr("sequence(0, size(_w) - length)")))
        .select("item", "length", F.expr("slice(_w, at + 1, length)").alias("_w"))
        .groupBy("length", F.array_join("_w", " ").alias("window"))
        .agg(F.array_sort(F.collect_set("item")).alias("items"), F.first("_w").alias("_w"))
    )
    rows = settle(cut, "benchmark-windows")
    sieve: dict[int, tuple[list[int], list[int]]] = {}
    for (length,) in sorted(rows.select("length").distinct().collect()):
        own = rows.where(F.col("length") == length)
        sieve[length] = tuple(
            sorted(r[0] for r in own.select(F.expr(_low(hashed)).alias("h")).distinct().collect())
            for hashed in (_head("0", length), "xxhash64(_w)")
        )
    return Windows(rows.select("window", "length", "items"), rows.count(), sieve)


def _candidates(found: Windows) -> Column:
    """Places in ``_w`` whose window passes the sieve: all true hits and a few others."""
    parts = [F.expr("cast(array() as array<struct<at:int,length:int>>)")]
    for length, (heads, wholes) in found.sieve.items():
        listed = [", ".join(f"{h}L" for h in own) for own in (heads, wholes)]
        parts.append(
            F.expr(
                f"transform(filter(filter(if(size(_w) >= {length}, sequence(0, size(_w) - {length}), cast(array() as array<int>)),"
                f" i -> {_low(_head('i', length))} in ({listed[0]})),"
                f" i -> {_low(f'xxhash64(slice(_w, i + 1, {length}))')} in ({listed[1]})),"
                f" i -> named_struct('at', i, 'length', {length}))"
            )
        )
    return F.concat(*parts)


def _matched(rows: DataFrame, found: Windows) -> DataFrame:
    """One row per candidate place (documents without one keep a row), with the items of its window.

    The window is compared word by word: its joined words are the key of the join.
    """
    placed = (
        rows.withColumn("_c", fixed(_candidates(found)))
        .withColumn("_p", F.explode_outer("_c"))
        .withColumn("window", F.array_join(F.expr("slice(_w, _p.at + 1, _p.length)"), " "))
        .drop("_w", "_c")
    )
    known = F.broadcast(found.rows) if found.count <= BROADCAST_WINDOWS else found.rows
    return placed.join(known.drop("length"), "window", "left")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, spans, items``.

    ``spans`` are the covered word ranges (first word, end) in order, ``n_hit`` the words they cover,
    ``items`` the ids of the items of which a window occurs, sorted as strings. One scan: each text is
    sieved in its row, only places that pass are joined, and one small row per place is shuffled. Null
    texts have no words; repeated rows each get their own result; an empty benchmark hits nothing.
    """
    found = benchmark_windows(benchmark, window)
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", fixed(tokens(F.col("text"))).alias("_w")
    ).withColumn("n_words", F.size("_w").cast("long"))
    hit = F.col("items").isNotNull()
    merged = F.expr(
        "aggregate(spans, named_struct('n', 0L, 'reach', 0), (a, s) -> named_struct("
        "'n', a.n + greatest(0, s.end - greatest(s.start, a.reach)), 'reach', greatest(a.reach, s.end)), a -> a.n)"
    )
    return (
        _matched(rows, found)
        .groupBy("_row", "doc_id", "n_words")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.when(hit, F.struct(F.col("_p.at").alias("start"), (F.col("_p.at") + F.col("_p.length")).alias("end")))
                )
            ).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .select("doc_id", "n_words", merged.alias("n_hit"), "spans", "items")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents in which a window of the benchmark occurs; all columns stay.

    Whether a document goes depends on its text alone, so contaminated texts are found once, by digest,
    and taken out by an anti join. Rows with a null text stay.
    """
    found = benchmark_windows(benchmark, window)
    rows = docs.where(F.col("text").isNotNull()).select(
        *text_key(F.col("text")), fixed(tokens(F.col("text"))).alias("_w")
    )
    dirty = settle(
        _matched(rows, found).where(F.col("items").isNotNull()).select("_t1", "_t2").distinct(), "contaminated"
    )
    one, two = spare(docs, "_t1", "_t2")
    first, second = text_key(F.col("text"))
    keyed = docs.withColumns({one: first, two: second})
    return keyed.join(dirty.toDF(one, two), [one, two], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
