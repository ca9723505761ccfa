"""Repeated passages: content-defined chunks and windows of lines, compared byte by byte."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm.texts import fixed, slices, spare, text_key
from spendscope.session import settle

LOOKS_BACK = 2  # lines that the rolling hash covers
ONE_IN = 2  # a boundary follows one line in so many
MIN_LINES = 2  # but no chunk ends before it has so many, unless a long line follows
LONG_WORDS = 50  # a line this long is a chunk of its own, lines that have so many together are a window
MIN_WORDS = 12  # nor so many words: shorter chunks are headings and greetings rather than passages

_BITS = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_LEAVES = pow(_BASE, LOOKS_BACK, 1 << 64)

CHUNK = "doc_id bigint, _t1 bigint, _t2 bigint, at int, first int, last int, name bigint, name2 bigint"


def chunks(text: bytes) -> list[tuple[int, int, bytes]]:
    """First line, end line and bytes of the runs of lines of a text that may be repeated passages.

    These are the content-defined chunks and the windows, in order and each place once. A passage that
    stands in two texts has its windows in both, whatever surrounds it.
    """
    lines = text.split(b"\n")
    places = sorted({*_content_defined(lines), *_windows(lines)})
    return [(first, end, b"\n".join(lines[first:end])) for first, end in places]


def _windows(lines: list[bytes]) -> set[tuple[int, int]]:
    """First and end line of the shortest runs of ``LONG_WORDS`` from each line on and up to each line.

    Together they cover any run of so many words to its first and last line with words.
    """
    spoken = [(k, n) for k, n in enumerate(len(line.split()) for line in lines) if n]
    found = set()
    low = words = 0
    for k, n in spoken:
        words += n
        while words - spoken[low][1] >= LONG_WORDS:
            found.add((spoken[low][0], k + 1))
            words -= spoken[low][1]
            low += 1
        if words >= LONG_WORDS:
            found.add((spoken[low][0], k + 1))
    return found


def _content_defined(lines: list[bytes]) -> list[tuple[int, int]]:
    """First and end line of the chunks whose boundaries follow from their lines.

    A rolling hash over the hashes of the last lines ends a chunk where its high bits are a multiple of
    ``ONE_IN``, once it has ``MIN_LINES`` lines and ``MIN_WORDS`` words; a line of ``LONG_WORDS`` stands
    alone. Boundaries depend on the lines around them, so a passage is cut alike wherever it stands, but
    for its first lines. What is too short at the end of the text joins the chunk before it, unless that
    is a long line; too short a rest before a long line is no chunk. Lines without words belong to the
    chunk around them and are not hashed.
    """
    found: list[tuple[int, int]] = []
    start = words = spoken = rolled = 0
    alone = True  # whether the last chunk is a long line
    recent = [0] * LOOKS_BACK

    def enough() -> bool:
        return words >= LONG_WORDS or (spoken >= MIN_LINES and words >= MIN_WORDS)

    def close(end: int) -> None:
        nonlocal start, words, spoken, alone
        if enough():
            found.append((start, end))
            alone = spoken == 1
        start, words, spoken = end, 0, 0

    for k, line in enumerate(lines):
        count = len(line.split())
        if not count:
            continue
        if count >= LONG_WORDS:
            close(k)
        words, spoken = words + count, spoken + 1
        new = xxhash.xxh3_64_intdigest(line)
        rolled = (rolled * _BASE + new - recent[0] * _LEAVES) & _BITS
        recent = [*recent[1:], new]
        if count >= LONG_WORDS or (spoken >= MIN_LINES and words >= MIN_WORDS and (rolled >> 40) % ONE_IN == 0):
            close(k + 1)
    if found and not alone and not enough() and found[-1][1] == start:
        start = found.pop()[0]
        words = LONG_WORDS
    close(len(lines))
    return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in CHUNK.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.int64()] * 2
    for batch in batches:
        texts = [t.encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()]
        keys = list(zip(*(batch[c].to_pylist() for c in names[:3])))
        for start, end in slices(texts):
            rows = []
            for k in range(start, end):
                for at, (first, last, chunk) in enumerate(chunks(texts[k])):
                    name = np.array([xxhash.xxh3_64_intdigest(chunk, seed) for seed in (0, 1)], dtype=np.uint64)
                    rows.append((*keys[k], at, first, last, *name.view(np.int64).tolist()))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


REST = "struct<text:string,n_lines:bigint,n_removed_lines:bigint,n_removed_words:bigint,n_left_words:bigint>"


def _without(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
    rows = []
    for text, first, last in zip(texts, firsts, lasts):
        lines = text.split("\n")
        stays = np.ones(len(lines), dtype=bool)
        for low, high in zip(first, last):
            stays[low:high] = False
        size = np.array([len(line.encode("utf-8", "surrogatepass").split()) for line in lines])
        kept = "\n".join(line for line, stay in zip(lines, stays) if stay)
        rows.append((kept, len(lines), int((~stays).sum()), int(size[~stays].sum()), int(size[stays].sum())))
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed_lines", "n_removed_words", "n_left_words"])


def without_repeats(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with one more struct column, and the name of that column.

    The struct has ``text, n_lines, n_removed_lines, n_removed_words, n_left_words``: the text without the
    chunks that stand somewhere before it, and what that took away. The first place of a chunk - smallest
    ``doc_id`` (null first), then text digest, then place in the text - stays. Rows with the same id and
    text are one document and fare alike. A null text stays null, with 0 for all counts; texts of one
    short line have no chunk. All columns are kept, whatever their names.

    Chunks are counted by 128-bit names, of which only small rows move; names that occur once are done
    with. The bytes of the other chunks are then compared: the smallest and the largest text under a name
    must be equal, which needs one text per task and name, however often a passage occurs. Names under
    which texts differ are settled by the texts themselves.
    """
    one, two, cuts, result = spare(docs, "_t1", "_t2", "_cuts", "_result")
    first, second = text_key(F.col("text"))
    keyed = docs.withColumns({one: first, two: second})
    plain = docs.where(F.col("text").isNotNull()).select("doc_id", *text_key(F.col("text")), "text")
    found = settle(plain.mapInArrow(_cut, CHUNK), "chunks")
    place = F.struct("doc_id", "_t1", "_t2", "at")
    repeated = found.groupBy("name", "name2").agg(F.count("*").alias("_n"), F.min(place).alias("_head")).where("_n > 1")
    marked = found.join(repeated.drop("_n"), ["name", "name2"]).select(
        "doc_id", "_t1", "_t2", F.struct("name", "name2", "first", "last", "at", (place == F.col("_head")).alias("head")).alias("_cut")
    )
    listed = marked.groupBy("doc_id", "_t1", "_t2").agg(F.collect_set("_cut").alias(cuts))
    id_, k1, k2 = spare(keyed, "_id", "_k1", "_k2")
    listed = settle(listed.toDF(id_, k1, k2, cuts), "cuts")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(one) == F.col(k1)) & (F.col(two) == F.col(k2))
    # The texts meet their cuts once: what is compared below and the result read the same files.
    held = keyed.join(listed, same, "left").drop(id_, k1, k2)
    names = held.columns  # which files may not hold as they are, if they differ in case only
    held = settle(held.toDF(*[f"_{k}" for k in range(len(names))]), "held").toDF(*names)

    repeating = held.where(F.col(cuts).isNotNull())
    texts = repeating.select("doc_id", one, two, F.split("text", "\n").alias("_lines"), F.explode(cuts).alias("_c")).select(
        "_c.name", "_c.name2", "_c.at", F.expr("array_join(slice(_lines, _c.first + 1, _c.last - _c.first), '\n')").alias("_chunk"),
        "doc_id", F.col(one).alias("_t1"), F.col(two).alias("_t2"),
    )
    lowest, highest = F.min("_chunk").alias("_low"), F.max("_chunk").alias("_high")
    clashing = settle(texts.groupBy("name", "name2").agg(lowest, highest).where("_low != _high").select("name", "name2"), "clashing")
    if clashing.isEmpty():
        gone = F.filter(cuts, lambda c: ~c["head"])
    else:
        disputed = texts.join(clashing, ["name", "name2"], "left_semi")
        heads = disputed.groupBy("name", "name2", "_chunk").agg(F.min(place).alias("_head"))
        judged = disputed.join(heads, ["name", "name2", "_chunk"]).select(
            "doc_id", "_t1", "_t2", F.struct("name", "name2", "at", (place == F.col("_head")).alias("head")).alias("_judged")
        )
        verdicts = judged.groupBy("doc_id", "_t1", "_t2").agg(F.collect_set("_judged").alias("_verdicts"))
        new, j0, j1, j2 = spare(held, "_verdicts", "_j0", "_j1", "_j2")
        verdicts = verdicts.toDF(j0, j1, j2, new)
        same = F.col("doc_id").eqNullSafe(F.col(j0)) & (F.col(one) == F.col(j1)) & (F.col(two) == F.col(j2))
        held = held.join(verdicts, same, "left").drop(j0, j1, j2)

        def stays(c):
            mine = F.filter(F.coalesce(F.col(new), F.array()), lambda v: v["at"] == c["at"])
            return F.coalesce(F.get(mine, F.lit(0))["head"], c["head"])

        gone = F.filter(cuts, lambda c: ~stays(c))
    gone = F.coalesce(gone, F.expr("cast(array() as array<struct<name:bigint,name2:bigint,first:int,last:int,at:int,head:boolean>>)"))
    low, high = spare(held, "_low", "_high")
    held = held.withColumns(
        {low: fixed(F.transform(gone, lambda c: c["first"])), high: fixed(F.transform(gone, lambda c: c["last"]))}
    )
    done = F.pandas_udf(_without, REST)(F.coalesce(F.col("text"), F.lit("")), F.col(low), F.col(high))
    none = F.struct(
        F.lit(None).cast("string").alias("text"),
        *[F.lit(0).cast("long").alias(c) for c in ("n_lines", "n_removed_lines", "n_removed_words", "n_left_words")],
    )
    given = held.withColumn(result, done)
    given = given.withColumn(result, F.when(F.col("text").isNull(), none).otherwise(F.col(result)))
    return given.select(*[F.col(f"`{c}`") for c in docs.columns], result), result


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the cleaned texts; documents of which no word is left go.

    Documents from which nothing was cut all stay, those without words included.
    """
    given, result = without_repeats(docs)
    kept = given.where((F.col(result)["n_removed_words"] == 0) | (F.col(result)["n_left_words"] > 0))
    return kept.withColumn("text", F.col(result)["text"]).select(*[F.col(f"`{c}`") for c in docs.columns])
