"""Near-duplicate classes: MinHash bands propose, odd sketches sift, whole shingle sets decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.llm.texts import WORD, mixed, slices, spare, text_key, word_hashes
from spendscope.session import settle

SHINGLE_WORDS = 5
PERCENT = 80
BANDS, ROWS = 40, 6  # a pair of similarity 0.8 shares no band with probability 5e-6, one of 0.05 shares one with 6e-7
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
MARGIN = 0.17  # over six standard deviations of the estimate at 0.8
HEADS, TURNS = 3, 2  # of proposals within buckets, before all that is left is compared; later turns hardly merge
BLOCK = 256  # sketches that are compared with as many others at once
CHUNK = 2048  # shingles that one step of the sampling looks at

_RANDOM = np.random.default_rng(20240229)
_TIMES = (_RANDOM.integers(0, 2**32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_PLUS = _RANDOM.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]
_PLACE = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A shingle is ``size`` consecutive words, A-Z lower-cased; a text with fewer words has one, the whole
    sequence; a text without words has none.
    """
    hashes, bounds = word_hashes(texts, lower=True)
    count = max(0, len(hashes) - size + 1)
    joined = np.full(count, size, dtype=np.uint64)
    for k in range(size):
        joined = mixed(joined + hashes[k : k + count])
    for start, end in zip(bounds[:-1], bounds[1:]):
        if end - start >= size:
            yield np.unique(joined[start : end - size + 1])
        elif end > start:
            one = np.full(1, end - start, dtype=np.uint64)
            for h in hashes[start:end]:
                one = mixed(one + h)
            yield one
        else:
            yield hashes[:0]


def samples(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set: the least value under each of ``SAMPLES`` maps."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = None
    with np.errstate(over="ignore"):
        for at in range(0, len(low), CHUNK):
            some = (low[None, at : at + CHUNK] * _TIMES + _PLUS).min(axis=1)
            least = some if least is None else np.minimum(least, some)
    return least


def bands(sampled: np.ndarray) -> np.ndarray:
    """One bucket name per band."""
    name = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        name = mixed(name + sampled[k::ROWS].astype(np.uint64))
    return name.view(np.int64)


def parities(values: np.ndarray) -> np.ndarray:
    """Parities of how many values fall on each bit of a bitmap."""
    bit = mixed(values) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def odd_sketch(sampled: np.ndarray) -> np.ndarray:
    return parities(_PLACE + sampled.astype(np.uint64))


FEATURES = (
    "doc_id bigint, _t1 bigint, _t2 bigint, _set binary, n_shingles bigint,"
    " _bands array<bigint>, _sketch array<bigint>, _parity array<bigint>"
)


def _featured(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()]
            for start, end in slices(texts):
                names, counts, banded, sketched, whole = [], [], [], [], []
                for found in shingle_sets(texts[start:end], size):
                    counts.append(len(found))
                    if not len(found):
                        for column in (names, banded, sketched, whole):
                            column.append(None)
                        continue
                    names.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    sampled = samples(found)
                    banded.append(bands(sampled))
                    sketched.append(odd_sketch(sampled))
                    whole.append(parities(found))
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(start, end - start) for c in ("doc_id", "_t1", "_t2")),
                     pa.array(names, pa.binary()), pa.array(counts, pa.int64()),
                     *(pa.array(c, pa.list_(pa.int64())) for c in (banded, sketched, whole))],
                    ["doc_id", "_t1", "_t2", "_set", "n_shingles", "_bands", "_sketch", "_parity"],
                )

    return run


def _confirmed(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([t.encode("utf-8", "surrogatepass") for t in batch[c].to_pylist()] for c in ("_left", "_right"))
            linked = np.zeros(len(left), dtype=bool)
            for start, end in slices(left):
                for some, other in slices(right[start:end]):
                    at = start + some
                    pairs = zip(shingle_sets(left[at : start + other], size), shingle_sets(right[at : start + other], size))
                    for k, (one, two) in enumerate(pairs):
                        shared = len(np.intersect1d(one, two, assume_unique=True))
                        linked[at + k] = 100 * shared >= percent * (len(one) + len(two) - shared)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(linked)], ["a", "b", "linked"])

    return run


def _apart(one: str, two: str) -> Column:
    """In how many bits two bitmaps differ."""
    return sum((F.bit_count(F.col(one)[k].bitwiseXOR(F.col(two)[k])) for k in range(SKETCH_BITS // 64)), F.lit(0))


def _sifted(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that may be linked, with ``near``, their similarity by the odd sketches.

    The estimate has a wide margin. The parities of the whole sets give a bound without any: two sets
    differ in at least as many shingles as their bitmaps differ in bits.
    """
    one = nodes.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}1") for c in ("_sketch", "_parity", "n_shingles")])
    two = nodes.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}2") for c in ("_sketch", "_parity", "n_shingles")])
    left = F.greatest(1 - 2.0 * _apart("_sketch1", "_sketch2") / SKETCH_BITS, F.lit(1e-9))
    near = 1 + SKETCH_BITS / (4.0 * SAMPLES) * F.log(left)
    both = pairs.join(one, "a").join(two, "b")
    least = _apart("_parity1", "_parity2")
    possible = both.where((100 + percent) * least <= (100 - percent) * (F.col("n_shingles1") + F.col("n_shingles2")))
    return possible.select(*pairs.columns, near.alias("near")).where(F.col("near") >= percent / 100 - MARGIN)


def _packed(column: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Bounds of the lists and the nodes, groups, sizes, sketches and parities in them."""
    flat = column.flatten()
    bounds = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    plain = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "n_shingles")]
    maps = [flat.field(c).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SKETCH_BITS // 64) for c in ("_sketch", "_parity")]
    return bounds, *plain, *maps


def _compared(percent: int):
    """All pairs of two packed blocks at once; only those that may be linked leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, node, root, size, sketch, parity = _packed(batch["_some"])
            ends2, node2, root2, size2, sketch2, parity2 = _packed(batch["_all"])
            one, two = [], []
            for k in range(batch.num_rows):
                q, t = slice(ends[k], ends[k + 1]), slice(ends2[k], ends2[k + 1])
                least = np.bitwise_count(parity[q, None] ^ parity2[None, t]).sum(axis=2)
                sums = size[q, None] + size2[None, t]
                possible = ((100 + percent) * least <= (100 - percent) * sums) & (root[q, None] != root2[None, t])
                left, right = np.nonzero(possible)
                apart = np.bitwise_count(sketch[q][left] ^ sketch2[t][right]).sum(axis=1)
                near = 1 + SKETCH_BITS / (4.0 * SAMPLES) * np.log(np.maximum(1 - 2.0 * apart / SKETCH_BITS, 1e-9))
                kept = near >= percent / 100 - MARGIN
                one.append(node[q][left[kept]])
                two.append(node2[t][right[kept]])
            if one:
                low, high = np.concatenate(one), np.concatenate(two)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(low, high)), pa.array(np.maximum(low, high))], ["a", "b"])

    return run


def _remaining(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a < b`` across the groups of a bucket that may be linked: whatever they are, none is left out.

    In each bucket the nodes outside its largest group meet all nodes, in packed blocks of ``BLOCK``
    sketches: a group of copies is not compared with itself, and no block grows with its bucket.
    """
    counted = members.groupBy("bucket", "root").agg(F.count("*").alias("_n"))
    largest = counted.groupBy("bucket").agg(F.max(F.struct("_n", "root"))["root"].alias("_largest"), F.sum("_n").alias("_total"))
    full = members.join(largest, "bucket").join(nodes.select("node", "n_shingles", "_sketch", "_parity"), "node")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("_total") / BLOCK)).alias("_part")
    packed = F.collect_list(F.struct("node", "root", "n_shingles", "_sketch", "_parity"))
    all_nodes = full.groupBy("bucket", part).agg(packed.alias("_all")).drop("_part")
    some = full.where("root != _largest").groupBy("bucket", part).agg(packed.alias("_some")).drop("_part")
    met = some.join(all_nodes, "bucket").select("_some", "_all")
    return met.mapInArrow(_compared(percent), "a bigint, b bigint").distinct()


def _judged(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs with ``linked``: whether their whole shingle sets are similar enough."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("_left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("_right"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "_left", "_right")
    return both.mapInArrow(_confirmed(size, percent), "a bigint, b bigint, linked boolean")


def _across(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """``bucket, node, root`` of the buckets whose nodes are in several groups."""
    members = shared.join(groups, "node").select("bucket", "node", "root")
    split = members.groupBy("bucket").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low < _high")
    return settle(members.join(split.select("bucket"), "bucket", "left_semi"), "across-groups")


def _proposed(members: DataFrame, turn: int) -> DataFrame:
    """Pairs ``a < b`` of a node and a head of its bucket from another group, with the node's ``root``.

    Each bucket has ``HEADS`` heads, others in each turn, so pairs grow with the rows of the buckets.
    """
    ranked = [F.min(F.struct(F.xxhash64("node", F.lit(turn * HEADS + k)), "node", "root")) for k in range(HEADS)]
    heads = members.groupBy("bucket").agg(F.array_distinct(F.array(*ranked)).alias("_heads"))
    met = members.join(heads, "bucket").select("node", "root", F.explode("_heads").alias("_h")).where("root != _h.root")
    low, high = F.least("node", "_h.node").alias("a"), F.greatest("node", "_h.node").alias("b")
    return met.select(low, high, "root").distinct()


def _merged(groups: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """``groups`` (``node, root``) joined along links between nodes, and whether there were any."""
    one = groups.select(F.col("node").alias("a"), F.col("root").alias("_one"))
    two = groups.select(F.col("node").alias("b"), F.col("root").alias("_two"))
    met = links.join(one, "a").join(two, "b").select(F.col("_one").alias("a"), F.col("_two").alias("b")).distinct()
    met = settle(met, "links")
    if met.isEmpty():
        return groups, False
    wider = _components(met).select(F.col("node").alias("root"), F.col("parent").alias("_wider"))
    return settle(groups.join(wider, "root", "left").select("node", F.coalesce("_wider", "root").alias("root")), "groups"), True


def _rooted(parents: DataFrame) -> DataFrame:
    """Follow ``parent`` to the end for each ``node``: every step doubles the reach."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_next"))
        stepped = parents.join(above, "parent", "left").select(
            "node", F.coalesce("_next", "parent").alias("parent"), (F.col("_next") != F.col("parent")).alias("_moved")
        )
        stepped = settle(stepped, "roots")
        parents = stepped.select("node", "parent")
        if stepped.where("_moved").isEmpty():
            return parents


def _components(edges: DataFrame) -> DataFrame:
    """``node, parent`` with the smallest node of each component of ``edges`` (``a, b``).

    Rounds of hooking every node to the least root next to it and following roots to the end; each round
    at least halves the roots that still have a neighbour.
    """
    sides = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    labels = None
    while not sides.isEmpty():
        least = sides.groupBy("a").agg(F.min("b").alias("b"))
        hooked = least.select(F.col("a").alias("node"), F.least("a", "b").alias("parent"))
        roots = _rooted(hooked)
        if labels is None:
            labels = roots
        else:
            up = roots.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
            labels = labels.join(up, "parent", "left").select("node", F.coalesce("_up", "parent").alias("parent"))
        labels = settle(labels, "labels")
        for side in ("a", "b"):
            up = roots.select(F.col("node").alias(side), F.col("parent").alias("_up"))
            other = "b" if side == "a" else "a"
            sides = sides.join(up, side, "left").select(F.coalesce("_up", side).alias(side), other)
        sides = settle(sides.where("a != b").select("a", "b").distinct(), "contracted")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("parent")).limit(0)


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: ``doc_id, _t1, _t2, n_shingles, component_id``.

    Two documents are linked when ``100 * |A n B| >= percent * |A u B|`` over their sets of distinct
    shingles; ``component_id`` is the smallest ``doc_id`` that links lead to. Texts that are null or have
    no word are linked with nothing. Repeated rows and rows that share a ``doc_id`` each get their own
    result; null ids do not count for the smallest one. ``_t1, _t2`` stand for the text.

    Equal sets become one node first. Buckets of the MinHash bands are never expanded into their pairs: in
    a few turns each node meets some heads of its bucket, and each group made so far is compared along its
    most similar pair. What remains are buckets that span several groups; the sketches across groups are
    all compared, in blocks, and what may be linked is decided on the whole sets, so no link between
    nodes that share a bucket is lost.
    """
    keyed = docs.select("doc_id", *text_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    seen = settle(keyed.mapInArrow(_featured(shingle_words), FEATURES), "shingled")
    nodes = settle(
        seen.where(F.col("_set").isNotNull())
        .groupBy("_set")
        .agg(F.min("doc_id").alias("first_id"), F.min(F.struct("_t1", "_t2", "n_shingles", "_bands", "_sketch", "_parity")).alias("_x"))
        .select(F.monotonically_increasing_id().alias("node"), "_set", "first_id", "_x.*"),
        "nodes",
    )
    rows = nodes.select("node", F.explode("_bands").alias("bucket"))
    several = rows.groupBy("bucket").agg(F.min("node").alias("_one"), F.max("node").alias("_last")).where("_one < _last")
    shared = settle(rows.join(several.select("bucket"), "bucket"), "shared")

    needed = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "_t1", "_t2")
    one_each = keyed.join(needed, ["_t1", "_t2"]).groupBy("node").agg(F.first("text").alias("text"))
    texts = settle(one_each, "texts")

    groups = shared.select("node").distinct().withColumn("root", F.col("node"))
    tested = None
    for turn in range(TURNS):
        members = _across(shared, groups)
        pairs = _proposed(members, turn)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        chosen = _sifted(pairs, nodes, percent).groupBy("root").agg(F.max(F.struct("near", "a", "b")).alias("_x"))
        judged = settle(_judged(chosen.select("_x.a", "_x.b").distinct(), texts, shingle_words, percent), "judged")
        groups, met = _merged(groups, judged.where("linked"))
        tested = judged.select("a", "b") if tested is None else tested.union(judged.select("a", "b"))
        if not met:
            break

    members = _across(shared, groups)
    last = settle(_remaining(members, nodes, percent).join(tested, ["a", "b"], "left_anti"), "remaining")
    classes, _ = _merged(groups, _judged(last, texts, shingle_words, percent).where("linked"))
    classes = classes.withColumnRenamed("root", "class")

    placed = nodes.select("node", "_set", "first_id").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = placed.groupBy("class").agg(F.min("first_id").alias("component_id"))
    by_set = placed.join(least, "class").select("_set", "component_id", "class")
    own = F.when(F.col("_set").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return seen.join(by_set, "_set", "left").select("doc_id", "_t1", "_t2", "n_shingles", own.alias("component_id"), "class")


def one_of_each(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each near-duplicate class, all columns kept.

    The one with the smallest ``doc_id`` stays (null last); of rows that share that id the one with the
    smallest text digest, and of rows that also share the text one. Rows without words belong to no class
    and all stay.
    """
    found = near_duplicates(docs, shingle_words, percent)
    chosen = (
        found.where("n_shingles > 0")
        .groupBy("class")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_t1", "_t2")).alias("_x"))
        .select(F.col("_x.doc_id").alias("_id"), "_x._t1", "_x._t2")
    )
    one, two = spare(docs, "_t1", "_t2")
    first, second = text_key(F.col("text"))
    keyed = docs.withColumns({one: first, two: second})
    chosen = chosen.toDF(*spare(keyed, "_id", "_k1", "_k2"))
    key, k1, k2 = chosen.columns
    same = keyed["doc_id"].eqNullSafe(chosen[key]) & (keyed[one] == chosen[k1]) & (keyed[two] == chosen[k2])
    kept = keyed.join(chosen, same, "left_semi").dropDuplicates(["doc_id", one, two])
    spoken = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns).unionByName(docs.where(~spoken).select(*columns))
