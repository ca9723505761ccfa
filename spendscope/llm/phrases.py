"""Phrase collocations: an index of word ids per shard, grown phrase by phrase in both directions, summed across shards."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendscope.llm.texts import mixed
from spendscope.session import settle

MIN_COUNT = 100  # occurrences that make a phrase a candidate
MAX_WORDS = 5
TOP = 2000  # phrases reported per language
SHARD_BYTES = 4 << 20  # text under one index; only the last text of a shard may pass it
STEP_BYTES = 1 << 20  # bytes of words hashed at once
HELD_KEYS = 1 << 22  # of several shards that a task sums before they leave it
HELD_PHRASES = 1 << 20  # likewise of phrases, which are several numbers each
LIKELY_WORDS = 3  # phrases of up to so many words are sifted by narrow keys before they are counted
RUN_BITS, WORDS_OF_A_RUN = 12, 19  # keys leave by 2**12 ranges at least, more where 2**19 words a range would be passed
PHRASE_RUN_BITS, WORDS_OF_A_PHRASE_RUN = 6, 21  # likewise the fewer phrases that are counted exactly
RUNS = "range bigint, width int, size int, words binary, counts binary"
BATCH_ROWS = 1 << 16  # phrases that leave a task at once
SIEVE_BITS = 26  # the largest bitmap that is sent to the shards has 2**26 places, 8 MB
PROBES = 3  # places of a key in it
KEY_BITS, NAME_BITS = 62, 63
UNKNOWN = "und"

# What ends a piece, and what separates words within one.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
WORD_ENDS = b" \t"

_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(PIECE_ENDS)] = True
_SOLID = ~_ENDS
_SOLID[list(WORD_ENDS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = [mixed(np.arange(k, k + 256, dtype=np.uint64)) for k in (1, 1001)]
_STEPS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]

INDEX = (
    "langs array<string>, lang_words array<bigint>, word_langs array<int>, words array<string>, counts array<int>,"
    " size int, forward binary, backward binary"
)


def _word_hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each word, made of some words at a time."""
    longest = int(size.max())
    powers = []
    for step in _STEPS:
        power = np.full(longest, step, dtype=np.uint64)
        power[0] = 1
        powers.append(np.cumprod(power, dtype=np.uint64))
    hashes = [np.empty(len(begin), dtype=np.uint64) for _ in _STEPS]
    total = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(begin):
        until = max(at + 1, int(np.searchsorted(total, total[at] + STEP_BYTES, side="right")) - 1)
        some = size[at:until]
        starts = total[at:until] - total[at]
        place = np.arange(total[until] - total[at]) - np.repeat(starts, some)
        letters = data[np.repeat(begin[at:until], some) + place]
        for out, values, power in zip(hashes, _VALUES, powers):
            sums = np.add.reduceat(values[letters] * power[place], starts)
            out[at:until] = mixed(sums + some.astype(np.uint64))
        at = until
    return hashes


def _seeds(langs: list[str]) -> np.ndarray:
    digests = (hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest() for lang in langs)
    return np.frombuffer(b"".join(digests), dtype=np.uint64)


def word_names(langs: list[str], spoken: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray):
    """Two names of ``NAME_BITS`` bits of each word ``data[begin:begin + size]`` of language ``langs[spoken]``."""
    return [mixed(h ^ _seeds(langs)[spoken]) >> np.uint64(64 - NAME_BITS) for h in _word_hashes(data, begin, size)]


def _pad(values: np.ndarray, step: int) -> np.ndarray:
    return np.concatenate([values[step:], np.zeros(min(step, len(values)), dtype=values.dtype)])


def transform(ids: np.ndarray, depth: int) -> np.ndarray:
    """The Burrows-Wheeler transform of ``ids`` with suffixes sorted by their first ``depth`` ids.

    Ranks of twice the reach are ranks of pairs of ranks. Backward steps that stay within ``depth`` ids give
    right intervals, as they count suffixes that are smaller in so many ids only.
    """
    rank, reach = ids.astype(np.int64), 1
    while reach < depth:
        step = min(reach, depth - reach)
        pairs = rank * (int(rank.max()) + 1) + _pad(rank, step)
        reach += step
        rank = np.unique(pairs, return_inverse=True)[1] if reach < depth else pairs
    return ids[np.argsort(rank, kind="stable") - 1]


def packed(ids: np.ndarray, kind: str = "<u4") -> bytes:
    """Small numbers as compressed planes of bytes; the upper ones are nearly all zero."""
    planes = ids.astype(kind).view(np.uint8).reshape(len(ids), -1).T
    return pa.Codec("zstd").compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def unpacked(planes: bytes, size: int, kind: str = "<u4") -> np.ndarray:
    width = np.dtype(kind).itemsize
    data = pa.Codec("zstd").decompress(planes, decompressed_size=width * size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, size).T).view(kind).reshape(-1)


@dataclass
class Tokens:
    """The words of some texts in a row: where they stand, in which piece, and two names of each."""

    data: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    piece: np.ndarray
    langs: list[str]
    spoken: np.ndarray
    names: np.ndarray
    second: np.ndarray


def tokens_of(texts: list[bytes], langs: list[str]) -> Tokens | None:
    """All words of some texts in any languages, A-Z lower-cased; None without a word."""
    data = _LOWER[np.frombuffer(b"\n".join(texts), dtype=np.uint8)]
    solid = np.concatenate([[False], _SOLID[data], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    begin, size = edges[::2], edges[1::2] - edges[::2]
    if not len(begin):
        return None
    known = sorted(set(langs))
    place = {lang: k for k, lang in enumerate(known)}
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    spoken = np.array([place[lang] for lang in langs])[np.searchsorted(starts, begin, side="right") - 1]
    piece = np.cumsum(_ENDS[data], dtype=np.int32)[begin]
    return Tokens(data, begin, size, piece, known, spoken, *word_names(known, spoken, data, begin, size))


def index_row(texts: list[bytes], langs: list[str], depth: int, passes: Callable | None = None) -> dict | None:
    """The index of some texts, or None without a word.

    Id 0 separates pieces and texts and stands for words that ``passes`` sifts out by their names; the other ids
    are the distinct words of the shard, frequent ones first, where words of different languages differ.
    """
    t = tokens_of(texts, langs)
    if t is None:
        return None
    kept = np.flatnonzero(passes(t.names[:, None].view(np.int64))) if passes else np.arange(len(t.names))
    names, second, piece = t.names[kept], t.second[kept], t.piece[kept]
    _, first, ids, counts = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
    if (second[first][ids] != second).any():  # two words of one hash
        pairs = np.stack([names, second], axis=1)
        _, first, ids, counts = np.unique(pairs, axis=0, return_index=True, return_inverse=True, return_counts=True)
        ids = ids.reshape(-1)
    order = np.argsort(-counts, kind="stable")
    first, counts = kept[first[order]], counts[order]
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(1, len(order) + 1)
    fresh = np.ones(len(kept), dtype=np.int64)
    fresh[1:] = (piece[1:] != piece[:-1]) | (kept[1:] != kept[:-1] + 1)
    text = np.zeros(len(ids) + int(fresh.sum()) + 1, dtype=np.int32)
    text[np.arange(len(ids)) + np.cumsum(fresh)] = rank[ids]
    at = zip(t.begin[first], t.size[first])
    return {
        "langs": t.langs,
        "lang_words": np.bincount(t.spoken, minlength=len(t.langs)),
        "word_langs": t.spoken[first].astype(np.int32),
        "words": [t.data[b : b + s].tobytes().decode("utf-8", "surrogatepass") for b, s in at],
        "counts": counts.astype(np.int32),
        "size": len(text),
        "forward": packed(transform(text, depth)),
        "backward": packed(transform(text[::-1], depth)),
    }


def _arrow(kind: str) -> pa.DataType:
    simple = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.list_(simple[kind[6:-1]]) if kind.startswith("array<") else simple[kind]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts and languages of ``SHARD_BYTES`` and a text at most."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"]):
            texts.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
            langs.append(lang.as_py())
            size += len(texts[-1])
            if size >= SHARD_BYTES:
                yield texts, langs
                texts, langs, size = [], [], 0
    if texts:
        yield texts, langs


def _said(docs: DataFrame) -> DataFrame:
    lang = F.coalesce("lang", F.lit(UNKNOWN)).alias("lang")
    return docs.where(F.col("text").isNotNull()).select("text", lang)


def _sums_by_key(shards: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ascending keys and their sums over shards of one task, ``HELD_KEYS`` or somewhat more at once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def run() -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(c) for c in zip(*held))
        held.clear()
        return _summed_keys(keys, counts)

    for keys, counts in shards:
        if len(keys):
            held.append((keys, counts))
        if sum(len(k) for k, _ in held) >= HELD_KEYS:
            yield run()
    if held:
        yield run()


def _summed_keys(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begin], np.add.reduceat(counts, begin)


def _runs_of_keys(shards: Iterator[tuple[np.ndarray, np.ndarray]], low: int) -> Iterator[pa.RecordBatch]:
    """A row per range of keys, told by the bits above the ``low`` ones: steps between its keys, and their sums, packed."""
    for keys, counts in _sums_by_key(shards):
        ranges = keys >> low
        begin = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))
        steps = np.diff(keys, prepend=0)
        steps[begin] = keys[begin] & ((1 << low) - 1)
        ends = np.append(begin[1:], len(keys))
        spans = [slice(b, e) for b, e in zip(begin, ends)]
        columns = [pa.array(ranges[begin]), pa.array((ends - begin).astype(np.int32))]
        columns += [pa.array([packed(steps[span]) for span in spans], pa.binary())]
        columns += [pa.array([packed(counts[span], "<u8") for span in spans], pa.binary())]
        yield from _in_batches(pa.RecordBatch.from_arrays(columns, ["range", "size", "steps", "counts"]))


def _frequent_in_runs(runs: DataFrame, low: int, min_count: int) -> DataFrame:
    """The keys whose sums over all runs come to ``min_count``. A range is a bounded share of the keys, which are hashes."""

    def run(some: pa.Table) -> pa.Table:
        sizes = some["size"].to_pylist()
        above = some["range"][0].as_py() << low
        keys = [above + np.cumsum(unpacked(s.as_py(), n), dtype=np.int64) for s, n in zip(some["steps"], sizes)]
        counts = [unpacked(c.as_py(), n, "<u8").view(np.int64) for c, n in zip(some["counts"], sizes)]
        summed, n = _summed_keys(np.concatenate(keys), np.concatenate(counts))
        return pa.table([pa.array(summed[n >= min_count])], ["key"])

    return runs.groupBy("range").applyInArrow(run, "key bigint")


def _merged(words: np.ndarray, counts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of words in this order, equal neighbours summed."""
    words = words[order]
    begin = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)]))
    return words[begin], np.add.reduceat(counts[order], begin)


def _sums_by_phrase(shards: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases, a row of words each, and their sums over shards of one task, by length.

    What the shards share is summed whenever ``HELD_PHRASES`` are held; all leave if more than half of that is left.
    """
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    n = 0

    def merge() -> int:
        for width, parts in held.items():
            words, counts = (np.concatenate(c) for c in zip(*parts))
            held[width] = [_merged(words, counts, np.argsort(keys_of(words, KEY_BITS)))]
        return sum(len(counts) for [(_, counts)] in held.values())

    for words, counts in shards:
        if len(counts):
            held.setdefault(words.shape[1], []).append((words, counts))
            n += len(counts)
        if n >= HELD_PHRASES:
            n = merge()
            if n > HELD_PHRASES // 2:
                yield from (part for [part] in held.values())
                held.clear()
                n = 0
    merge()
    yield from (part for [part] in held.values())


def _runs_of_phrases(shards: Iterator[tuple[np.ndarray, np.ndarray]], range_of: Callable) -> Iterator[pa.RecordBatch]:
    """A row per range and length, told by ``range_of`` rows of words: sorted phrases of a task and their sums, packed."""
    for words, counts in _sums_by_phrase(shards):
        ranges = range_of(words)
        order = np.lexsort((words[:, 1], words[:, 0], ranges))  # alike neighbours pack well
        ranges, words, counts = ranges[order], words[order], counts[order]
        begin = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))
        ends = np.append(begin[1:], len(ranges))
        heads = words[begin, 0]
        words[1:, 0] -= words[:-1, 0].copy()
        words[begin, 0] = heads
        spans = [slice(b, e) for b, e in zip(begin, ends)]
        columns = [pa.array(ranges[begin]), pa.array(np.full(len(begin), words.shape[1], dtype=np.int32))]
        columns += [pa.array((ends - begin).astype(np.int32))]
        columns += [pa.array([packed(words[span].T.reshape(-1), "<u8") for span in spans], pa.binary())]
        columns += [pa.array([packed(counts[span], "<u8") for span in spans], pa.binary())]
        yield from _in_batches(pa.RecordBatch.from_arrays(columns, ["range", "width", "size", "words", "counts"]))


def _phrases_of_runs(some: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of one range and length, a row of words each, sorted, and their sums over all runs."""
    words, counts = [], []
    for width, size, w, c in zip(*(some[name].to_pylist() for name in ("width", "size", "words", "counts"))):
        rows = unpacked(w, width * size, "<u8").view(np.int64).reshape(width, size).T.copy()
        rows[:, 0] = np.cumsum(rows[:, 0])
        words.append(rows)
        counts.append(unpacked(c, size, "<u8").view(np.int64))
    words, counts = np.concatenate(words), np.concatenate(counts)
    return _merged(words, counts, np.lexsort(words.T[::-1]))


def word_counts(docs: DataFrame, min_count: int) -> DataFrame:
    """Names that stand ``min_count`` times or more: ``name, f, shared``, the last of names that different words share.

    Of w distinct words w * w / 2**64 pairs share a name: none below billions.
    """
    low = NAME_BITS - RUN_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted():
            for texts, langs in _shards(batches):
                found = tokens_of(texts, langs)
                if found:
                    apart = found.second >> np.uint64(32)  # enough to tell words of one name apart
                    each = np.stack([found.names, apart], axis=1).view(np.int64)
                    yield _merged(each, np.ones(len(each), dtype=np.int64), np.argsort(found.names, kind="stable"))

        return _runs_of_phrases(counted(), lambda words: words[:, 0] >> low)

    def summed(some: pa.Table) -> pa.Table:
        words, counts = _phrases_of_runs(some)
        begin = np.flatnonzero(np.concatenate([[True], words[1:, 0] != words[:-1, 0]]))
        f, kinds = np.add.reduceat(counts, begin), np.diff(np.append(begin, len(words)))
        keep = f >= min_count
        return pa.table([words[begin, 0][keep], f[keep], (kinds > 1)[keep]], ["name", "f", "shared"])

    runs = _said(docs).mapInArrow(run, RUNS)
    return runs.groupBy("range").applyInArrow(summed, "name bigint, f bigint, shared boolean")


def build_index(docs: DataFrame, depth: int = MAX_WORDS, words=None) -> DataFrame:
    """One index per ``SHARD_BYTES`` of text; texts are taken where they lie, none is moved.

    ``words`` is a broadcast sieve of the words that are worth an id.
    """
    schema = pa.schema([(name, _arrow(kind)) for name, kind in (part.strip().split(" ") for part in INDEX.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in _shards(batches):
            row = index_row(texts, langs, depth, words.value.passes if words else None)
            if row:
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

    return _said(docs).mapInArrow(run, INDEX)


@dataclass
class Phrases:
    """Phrases of one length in one shard: where their intervals start in both orders, and how long these are."""

    ahead: np.ndarray
    back: np.ndarray
    size: np.ndarray
    ids: np.ndarray  # one row per phrase

    def only(self, keep: np.ndarray | slice) -> Phrases:
        return Phrases(self.ahead[keep], self.back[keep], self.size[keep], self.ids[keep])


class Index:
    """A shard's two transforms, ready for steps in both directions; the second one is unpacked when it is needed."""

    def __init__(self, row: dict):
        self.row, self.counts = row, row["counts"].values.to_numpy().astype(np.int64)
        self.size = row["size"].as_py()
        self.starts = np.concatenate([[0], self.size - np.cumsum(self.counts[::-1])[::-1]])

    def _order(self, column: str) -> tuple[np.ndarray, np.ndarray]:
        ids = unpacked(self.row[column].as_py(), self.size)
        rows = np.empty(self.size, dtype=np.int32)
        rows[np.argsort(ids, kind="stable")] = np.arange(self.size, dtype=np.int32)
        return ids, rows

    @cached_property
    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        """The id before each suffix, and the row of the suffix that begins with it."""
        return self._order("forward")

    @cached_property
    def backward(self) -> tuple[np.ndarray, np.ndarray]:
        return self._order("backward")

    def words(self, wanted: np.ndarray) -> Phrases:
        """The single words of which ``wanted[id]`` is true."""
        ids = np.flatnonzero(wanted)
        return Phrases(self.starts[ids], self.starts[ids], self.counts[ids - 1], ids[:, None])

    def _children(self, ids, rows, own, other, size, wanted):
        """Steps by one id: parent, id, start of the own interval, start of the other one, size.

        The own order is the one whose transform is read: its rows lead to the child's interval. In the other
        order the child's interval lies within its parent's, after those of all smaller ids.
        """
        ends = np.cumsum(size)
        parent = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(parent)) + np.repeat(own - (ends - size), size)
        code = parent * (len(self.counts) + 1) + ids[at]
        order = np.argsort(code)
        code = code[order]
        begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        child = np.diff(np.append(begin, len(code)))
        parent, found = np.divmod(code[begin], len(self.counts) + 1)
        first = np.minimum.reduceat(rows[at][order], begin) if len(begin) else np.zeros(0, np.int64)
        beside = other[parent] + begin - (ends - size)[parent]
        keep = wanted[found]
        return parent[keep], found[keep], first[keep], beside[keep], child[keep]

    def longer(self, some: Phrases, wanted: np.ndarray) -> Phrases:
        """All phrases one word longer whose first and last part are both in ``some``.

        A step to the left from the last part and a step to the right from the first part must meet in
        one interval.
        """
        parent, word, ahead, back, size = self._children(
            *self.forward, some.ahead, some.back, some.size, wanted
        )
        found = Phrases(ahead, back, size, np.concatenate([word[:, None], some.ids[parent]], axis=1))
        if some.ids.shape[1] == 1:
            return found
        _, _, _, met, _ = self._children(*self.backward, some.back, some.ahead, some.size, wanted)
        return found.only(np.isin(found.ahead, met))


def keys_of(names: np.ndarray, bits: int) -> np.ndarray:
    """A number of so many bits for each row of names; its lower bits are the number of fewer bits."""
    joined = np.full(len(names), names.shape[1], dtype=np.uint64)
    for column in names.T:
        joined = mixed(joined + column.view(np.uint64))
    return (joined & np.uint64((1 << bits) - 1)).astype(np.int64)


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The ``PROBES`` places of each key among 2 to the power of ``bits``."""
    spread = mixed(keys.view(np.uint64))
    step = (spread >> np.uint64(32)) | np.uint64(1)
    for _ in range(PROBES):
        yield (spread & np.uint64((1 << bits) - 1)).astype(np.int64)
        spread = spread + step


class Sieve:
    """A bitmap of phrases by their keys of ``key_bits`` bits: all that were put in pass, and some others."""

    def __init__(self, key_bits: int, bits: int, filled: np.ndarray):
        self.key_bits, self.bits, self.filled = key_bits, bits, filled

    def passes(self, names: np.ndarray) -> np.ndarray:
        out = np.ones(len(names), dtype=bool)
        for place in _places(keys_of(names, self.key_bits), self.bits):
            out &= (self.filled[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out


def sieve(keys: DataFrame, key_bits: int, most_bits: int = SIEVE_BITS) -> Sieve:
    """A sieve of the phrases with these ``key`` values of ``key_bits`` bits, or of the words with these ``name`` values.

    It has 16 to 32 places per key up to 2 to the power of ``most_bits``, and lets 0.1 to 0.5 per cent of others
    pass; beyond, more phrases pass that are not frequent, and the sums across shards take them out.
    """
    bits = min(most_bits, max(16, (16 * keys.count()).bit_length()))
    [column] = keys.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.ascontiguousarray(batch[column].to_numpy(zero_copy_only=False))
            some = values if column == "key" else keys_of(values[:, None], key_bits)
            place = np.concatenate(list(_places(some, bits)))
            sets = np.left_shift(np.uint64(1), (place & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(sets)], ["at", "set"])

    words = (
        keys.mapInArrow(run, "at bigint, set bigint")
        .groupBy("at")
        .agg(F.bit_or("set").alias("set"))
        .toPandas()
    )
    filled = np.zeros(1 << (bits - 6), dtype=np.int64)
    filled[words["at"].to_numpy(dtype=np.int64)] = words["set"].to_numpy(dtype=np.int64)
    return Sieve(key_bits, bits, filled.view(np.uint64))


def _shard_names(row: dict) -> list[np.ndarray]:
    """Both names of the words of one shard, made again from their spelling."""
    words = row["words"].values.cast(pa.binary())
    ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)
    spoken = row["word_langs"].values.to_numpy()
    names = word_names(row["langs"].as_py(), spoken, data, ends[:-1], np.diff(ends))
    return [n.view(np.int64) for n in names]


def _own_names(row: dict, clashing: np.ndarray) -> np.ndarray:
    """The name of each word: its first, or its second where different words share the first."""
    names, second = _shard_names(row)
    return np.where(np.isin(names, clashing), second, names)  # both have NAME_BITS bits


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The shards that have words."""
    for batch in batches:
        for k in range(batch.num_rows):
            if len(batch["words"][k].values):
                yield {name: batch[name][k] for name in batch.schema.names}


def _phrases(row: dict, sieves: list, clashing: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, Phrases]]:
    """The phrases of one shard, length after length from two words on, and the names of its words by id.

    ``sieves`` are broadcast sieves of the words, the pairs, ...; a phrase must pass that of its length.
    """
    names = np.concatenate([[0], _own_names(row, clashing)])
    wanted = sieves[0].value.passes(names[:, None])
    wanted[0] = False
    shard = Index(row)
    some = shard.words(wanted)
    for width in range(2, longest + 1):
        some = shard.longer(some, wanted)
        if width - 1 < len(sieves):
            some = some.only(sieves[width - 1].value.passes(names[some.ids]))
        yield names, some


def _in_batches(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (whole.slice(at, BATCH_ROWS) for at in range(0, whole.num_rows, BATCH_ROWS))


def _unread(longest: int) -> list[str]:
    return ["lang_words"] if longest > 2 else ["lang_words", "backward"]


def _likely(index: DataFrame, sieves: list, clashing: np.ndarray, width: int, bits: int, low: int, min_count: int) -> DataFrame:
    """Keys of ``bits`` bits under which phrases of ``width`` words stand ``min_count`` times or more together.

    All frequent ones are under these; a narrow key is all that is summed here, and exact counts follow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = (list(_phrases(row, sieves, clashing, width))[-1] for row in _rows(batches))
        return _runs_of_keys(((keys_of(names[some.ids], bits), some.size) for names, some in shards), low)

    runs = index.drop(*_unread(width)).mapInArrow(run, "range bigint, size int, steps binary, counts binary")
    return _frequent_in_runs(runs, low, min_count)


def _summed(index: DataFrame, sieves: list, clashing: np.ndarray, longest: int, ranges: int, min_count: int) -> DataFrame:
    """Exact counts of at least ``min_count`` of all phrases of two words or more, as ``names, f``.

    Those longer than the sieves reach are grown from what the shard has. Phrases meet by 2 to the power of ``ranges``
    ranges of their hashes, so none is hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = (found for row in _rows(batches) for found in _phrases(row, sieves, clashing, longest))
        named = ((names[some.ids], some.size.astype(np.int64)) for names, some in shards)
        return _runs_of_phrases(named, lambda words: keys_of(words, ranges))

    def summed(some: pa.Table) -> pa.Table:
        words, counts = _phrases_of_runs(some)
        words, counts = words[counts >= min_count], counts[counts >= min_count]
        ends = np.arange(len(words) + 1, dtype=np.int32) * words.shape[1]
        return pa.table([pa.ListArray.from_arrays(ends, words.reshape(-1)), pa.array(counts)], ["names", "f"])

    runs = index.drop(*_unread(longest)).mapInArrow(run, RUNS)
    return runs.groupBy("range", "width").applyInArrow(summed, "names array<bigint>, f bigint")


def _second_words(index: DataFrame, clashing: np.ndarray, min_count: int) -> DataFrame:
    """Frequent words that share their name with others, by their second names, as ``name, f``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            names, second = _shard_names(row)
            at = pa.array(np.flatnonzero(np.isin(names, clashing)))
            yield pa.RecordBatch.from_arrays([pa.array(second).take(at), row["counts"].values.take(at)], ["name", "n"])

    each = index.select("langs", "word_langs", "words", "counts").mapInArrow(run, "name bigint, n int")
    return each.groupBy("name").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)


def _spelled(index: DataFrame, words, clashing: np.ndarray) -> DataFrame:
    """``name, lang, word`` of the words that pass the sieve ``words``; few leave a task twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros(0, dtype=np.int64)
        for row in _rows(batches):
            names = _own_names(row, clashing)
            fresh = words.value.passes(names[:, None]) & ~np.isin(names, told)
            told = np.union1d(told if len(told) < HELD_PHRASES else told[:0], names[fresh])
            at = pa.array(np.flatnonzero(fresh))
            langs = row["langs"].values.take(row["word_langs"].values.take(at))
            found = [pa.array(names).take(at), langs, row["words"].values.take(at)]
            yield pa.RecordBatch.from_arrays(found, ["name", "lang", "word"])

    found = index.select("langs", "word_langs", "words").mapInArrow(run, "name bigint, lang string, word string")
    return found.groupBy("name").agg(F.min("lang").alias("lang"), F.min("word").alias("word"))


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS):
    """Counts of all phrases of up to ``max_words`` words that stand ``min_count`` times or more in a language.

    Returns three tables: ``names array<bigint>, f``; the spelling of the words of the longer phrases, ``name, lang,
    word``; and the number of words per language, ``lang, n``. Every language of ``docs (lang, text)`` is counted by
    itself; a null language is ``und``, a null text has no words. Repeated rows count as often as they stand.
    """
    spark = docs.sparkSession
    words = settle(word_counts(docs, min_count), "words")
    sieves = [spark.sparkContext.broadcast(sieve(words.select("name"), KEY_BITS))]
    index = settle(build_index(docs, max(2, max_words), sieves[0]), "phrase-index")
    spoken = index.select(F.explode(F.arrays_zip("langs", "lang_words")).alias("s"))
    totals = settle(spoken.groupBy(F.col("s.langs").alias("lang")).agg(F.sum("s.lang_words").alias("n")), "totals")
    clashing = np.array([r[0] for r in words.where("shared").select("name").collect()], dtype=np.int64)
    words = words.where("not shared").select("name", "f")
    if len(clashing):  # words of such names go by their second name from here on
        words = settle(words.unionByName(_second_words(index, clashing, min_count)), "words-apart")
        sieves = [spark.sparkContext.broadcast(sieve(words.select("name"), KEY_BITS))]
    counts = words.select(F.array("name").alias("names"), "f")
    if max_words >= 2:
        # Some 32 times as many keys as there are words in all, so few pairs share one.
        n = totals.agg(F.sum("n")).first()[0] or 0
        bits = min(KEY_BITS, max(32, n.bit_length() + 5))
        low = bits - max(RUN_BITS, (n >> WORDS_OF_A_RUN).bit_length())
        for width in range(2, min(max_words, LIKELY_WORDS) + 1):
            some = settle(_likely(index, sieves, clashing, width, bits, low, min_count), f"likely-{width}")
            sieves.append(spark.sparkContext.broadcast(sieve(some, bits)))
        ranges = max(PHRASE_RUN_BITS, (n >> WORDS_OF_A_PHRASE_RUN).bit_length())
        counts = counts.unionByName(_summed(index, sieves, clashing, max_words, ranges, min_count))
    counts = settle(counts, "phrases")
    inside = counts.where(F.size("names") >= 2).select(F.explode("names").alias("name")).distinct()
    needed = settle(inside, "phrase-words")
    found = _spelled(index, spark.sparkContext.broadcast(sieve(needed, KEY_BITS)), clashing)
    spelled = settle(found.join(needed, "name", "left_semi"), "spelled")
    return counts, spelled, totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """The phrases of each language whose words stand together most beyond chance: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase of a occurrences, cut in two parts of l and r among n words, scores floor(1000 * a * n / (l * r));
    its lowest cut counts, of equal ones the first. Phrases that never stand outside one longer phrase
    are left out. Ties go by a, then by the bytes of the phrase. Without words the result is empty.
    """
    counts, spelled, totals = phrase_counts(docs, min_count, max_words)
    size = F.size("names")
    whole = counts.where(size >= 2).withColumnRenamed("f", "a")
    parts = F.array(F.expr("slice(names, 1, size(names) - 1)"), F.expr("slice(names, 2, size(names) - 1)"))
    inside = counts.where(size >= 3).select(F.explode(parts).alias("names"), "f")
    covers = inside.groupBy("names").agg(F.max("f").alias("longer"))
    free = whole.join(covers, "names", "left").where("longer is null or longer < a").drop("longer")
    cuts = free.select("names", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("slice(names, 1, k)").alias("_l"), F.expr("slice(names, k + 1, size(names))").alias("_r"))
    left = counts.select(F.col("names").alias("_l"), F.col("f").alias("l"))
    right = counts.select(F.col("names").alias("_r"), F.col("f").alias("r"))
    exact = {c: f"cast({c} as decimal(19, 0))" for c in "alrn"}
    score = F.expr(f"(1000 * {exact['a']} * {exact['n']}) div ({exact['l']} * {exact['r']})")
    firsts = spelled.join(totals, "lang").select(F.col("name").alias("_first"), "lang", "n")
    scored = (
        cuts.join(left, "_l")
        .join(right, "_r")
        .join(firsts, F.col("names")[0] == F.col("_first"))
        .groupBy("names", "a", "lang", "n")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    )
    at = scored.select("names", F.posexplode("names").alias("place", "name")).join(spelled.select("name", "word"), "name")
    texts = at.groupBy("names").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("said"))
    named = scored.join(texts, "names").select(
        "lang", F.array_join(F.col("said.word"), " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score"
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    columns = ["lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"]
    return ranked.select(*columns)
