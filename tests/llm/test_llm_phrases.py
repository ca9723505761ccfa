"""Phrase collocations against plain counts, and the index against its text."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nasty import empty, nasty, rows
from spendscope.llm import phrases

A_TO_Z = {i: i + 32 for i in range(65, 91)}


def plain(texts, least, longest, top):
    """``texts`` has language and text."""
    n, f = collections.Counter(), collections.Counter()
    for lang, text in texts:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(A_TO_Z)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f.update((lang or "und", *g) for g in zip(*(w[i:] for i in range(k))))
    f = {g: c for g, c in f.items() if c >= least}
    covered = {part for g, c in f.items() if len(g) > 3 for part in (g[:-1], (g[0], *g[2:])) if f[part] == c}
    out = collections.defaultdict(list)
    for (lang, *words), a in f.items():
        if len(words) < 2 or (lang, *words) in covered:
            continue
        cuts = [(f[(lang, *words[:k])], f[(lang, *words[k:])]) for k in range(1, len(words))]
        score, _, l, r = min((1000 * a * n[lang] // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
        out[lang].append((-score, -a, " ".join(words).encode(), l, r))
    return sorted(
        (lang, k + 1, p.decode(), -a, l, r, n[lang], -s)
        for lang, found in out.items()
        for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])
    )


def compare(docs, least, longest=5, top=2000):
    given = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    found = phrases.collocations(docs, least, longest, top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain(given, least, longest, top)


@pytest.mark.parametrize("least,longest,top", [(3, 5, 2000), (8, 5, 7), (2, 2, 50), (4, 3, 100)])
def test_same_as_plain_counts(spark, folder, least, longest, top):
    compare(spark.read.parquet(f"{folder}/documents.parquet"), least, longest, top)


def test_odd_rows(spark):
    docs = nasty(spark).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, "und").otherwise("en"))
    compare(docs.withColumn("names", F.lit(1)).withColumn("f", F.lit(1)), 2)


def test_many_shards_count_as_one(spark):
    lines = ["in the old mill by the river", "The old mill, the old MILL", "by the by the by the by", "x", ""]
    docs = spark.createDataFrame([(("en", "fr", None)[k % 3], lines[k * k % 5]) for k in range(300)], "lang string, text string")
    compare(docs.repartition(40), 5)
    compare(docs.coalesce(1), 5)


def test_nothing(spark):
    assert phrases.collocations(empty(spark)).count() == 0
    none = nasty(spark).withColumn("text", F.lit(None).cast("string"))
    assert phrases.collocations(none, 1).count() == 0
    assert len(rows()) and phrases.collocations(nasty(spark), 10**9).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), min_size=1, max_size=6), st.integers(2, 5))
def test_intervals_hold_all_occurrences(pieces, depth):
    row = phrases.index_row([". ".join(" ".join(p) for p in pieces).encode()], ["en"], depth)
    words = [w for p in pieces for w in p]
    if not words:
        assert row is None
        return
    index = phrases.Index({k: pa.array([v])[0] for k, v in row.items()})
    wanted = np.array([False] + [True] * len(row["words"]))
    some = index.words(wanted)
    for size in range(2, depth + 1):
        some = index.longer(some, wanted)
        found = {tuple(row["words"][i - 1] for i in ids): n for ids, n in zip(some.ids, some.size)}
        assert found == collections.Counter(g for p in pieces for g in zip(*(p[k:] for k in range(size))))


def test_words_of_one_hash_stay_apart():
    names = np.array([5, 7, 9], dtype=np.int64)
    row = {}
    first, second = phrases._shard_names, np.array([50, 70, 90], dtype=np.int64)
    phrases._shard_names = lambda _: [names, second]
    try:
        assert phrases._own_names(row, np.array([7], dtype=np.int64)).tolist() == [5, 70, 9]
    finally:
        phrases._shard_names = first


def test_each_task_emits_frequent_phrases_once(spark, monkeypatch):
    """Shards of one task share its rows, and phrases of frequent pairs that are not frequent themselves leave none."""
    kinds, texts = 30, 24
    said = np.random.default_rng(5).integers(0, kinds, (texts, 50_000))
    words = np.array([f"word{k:02d}" + "x" * 14 for k in range(kinds)])
    docs = spark.createDataFrame([("en", " ".join(words[ids])) for ids in said], "lang string, text string").coalesce(1)
    made, make = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda *a, **k: made.append(make(*a, **k)) or made[-1])
    counts, spelled, _ = phrases.phrase_counts(docs, 200, 5)
    spelling = {r["name"]: r["word"] for r in spelled.collect()}
    found = {tuple(spelling[name] for name in r["names"]): r["f"] for r in counts.collect()}
    pairs, n = np.unique(said[:, :-1] * kinds + said[:, 1:], return_counts=True)
    single, m = np.unique(said, return_counts=True)
    expected = {(words[p // kinds], words[p % kinds]): c for p, c in zip(pairs, n)} | {(words[w],): c for w, c in zip(single, m)}
    assert n.min() >= 200 and found == expected  # a phrase of three words stands some 44 times
    exact = [df for df in made if df.columns in (["_1", "_2", "_3", "_4", "_5", "n"], ["range", "width", "size", "words", "counts"])][-1]
    emitted = exact.agg(F.sum("size") if "size" in exact.columns else F.count("*")).first()[0]
    assert len(pairs) <= emitted <= 1.02 * len(pairs)


@pytest.mark.parametrize("low", [20, 27])
def test_packed_runs_sum_as_plain_keys(spark, low):
    some = np.random.default_rng(7).integers(0, 1 << 32, 5000)
    keys = np.concatenate([some, some[:3000], [0, 0, (1 << 32) - 1], some[:50]])
    sums = collections.Counter(keys.tolist())
    docs = spark.range(4).repartition(3)

    def run(batches):
        mine = sum(batch.num_rows for batch in batches)
        if mine:
            yield from phrases._runs_of_keys(iter([(keys, np.full(len(keys), mine))]), low)

    runs = docs.mapInArrow(run, "range bigint, size int, steps binary, counts binary")
    found = sorted(r["key"] for r in phrases._frequent_in_runs(runs, low, 8).collect())
    assert found == sorted(k for k, c in sums.items() if 4 * c >= 8)


def test_sieve_keeps_all_that_went_in(spark):
    names = phrases.mixed(np.arange(40_000, dtype=np.uint64)).view(np.int64) >> 1
    keys = phrases.keys_of(names[:4000, None], 40)
    sifted = phrases.sieve(spark.createDataFrame([(int(k),) for k in keys], "key bigint"), 40)
    assert sifted.passes(names[:4000, None]).all()
    assert sifted.passes(names[4000:, None]).mean() < 0.01


def test_words_that_share_a_name_are_told(spark):
    """Names are counted over all tasks, and a name of two different words is marked."""
    docs = spark.createDataFrame([("en", "one two two three three three")] * 12, "lang string, text string").repartition(4)
    found = {r["name"]: (r["f"], r["shared"]) for r in phrases.word_counts(docs, 24).collect()}
    t = phrases.tokens_of([b"one two three"], ["en"])
    assert found == {int(t.names[1]): (24, False), int(t.names[2]): (36, False)}
    words = np.array([[5, 1], [5, 2], [5, 1], [9, 3]], dtype=np.int64)
    runs = list(phrases._runs_of_phrases(iter([(words, np.arange(1, 5))] * 2), lambda w: w[:, 0] >> 3))
    both = [phrases._phrases_of_runs(phrases.pa.Table.from_batches(runs).slice(k, 1)) for k in range(2)]
    assert [(w.tolist(), n.tolist()) for w, n in both] == [([[5, 1], [5, 2]], [8, 4]), ([[9, 3]], [8])]


def test_shared_names_go_by_the_second(spark, monkeypatch):
    """Words whose names are listed as shared are counted by their second names, with the same result."""
    lines = ["in the old mill by the river", "by the by the by the by", "x"]
    docs = spark.createDataFrame([("en", lines[k % 3]) for k in range(60)], "lang string, text string")
    given = [(r["lang"], r["text"]) for r in docs.collect()]
    counts, the = phrases.word_counts, int(phrases.tokens_of([b"the"], ["en"]).names[0])
    mark = lambda *a: counts(*a).withColumn("shared", F.col("name") == the)
    monkeypatch.setattr(phrases, "word_counts", mark)
    assert sorted(map(tuple, phrases.collocations(docs, 5).collect())) == plain(given, 5, 5, 2000)
