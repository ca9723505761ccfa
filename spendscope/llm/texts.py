"""Words, names and byte-level helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"  # what separates words
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 19  # bytes of text that one vectorised step looks at

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that clash with no column of ``df`` (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text that is not null."""
    return F.array_remove(F.split(text, SPACE), "")


def fixed(column: Column) -> Column:
    """``column``, made once per row.

    Filters move down to the scan and take copies of what they refer to along; inside a lambda such a
    copy runs once per element. A value that counts as non-deterministic is left where it is.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a whole text; null counts as a text of its own."""
    return [F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(1), text, F.length(text)).alias("_t2")]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose texts have some ``SLICE_BYTES`` together, at least one each."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > SLICE_BYTES:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values[start:end]`` for each pair, empty segments included."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[starts]


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, and where each text's words begin and end.

    The second array has one entry more than there are texts.
    """
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    solid = ~BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    letters = data[solid]
    begin = np.flatnonzero(first[solid])
    size = np.diff(np.append(begin, len(letters)))
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    edges = np.concatenate([[0], np.cumsum(sizes + 1)])
    seen = np.concatenate([[0], np.cumsum(first)])
    bounds = seen[np.minimum(edges, len(data))]
    if not len(begin):
        return np.zeros(0, dtype=np.uint64), bounds
    with np.errstate(over="ignore"):
        power = np.full(int(size.max()), _STEP, dtype=np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        place = np.arange(len(letters)) - np.repeat(begin, size)
        hashes = np.add.reduceat(_BYTE[letters] * power[place], begin)
        return mixed(hashes + size.astype(np.uint64)), bounds
