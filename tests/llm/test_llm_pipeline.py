"""The pipeline stage by stage on a fixture with planted cases."""

import re
from functools import partial

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from spendscope.llm import mixing
from spendscope.session import settle


def planted(spark, folder, tmp_path):
    """Some given documents, with known bad, copied, leaking and clean ones among them."""
    given = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    item = max((r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()), key=len)
    rng = np.random.default_rng(11)
    syllables = ["ta", "ri", "mo", "ne", "lu", "ka", "so", "pe"]

    def prose(n):
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n)]
        return " ".join(w + ("." if k % 11 == 10 else "") for k, w in enumerate(words)) + "."

    clean = {10**6 + k: "\n".join(prose(30) for _ in range(4)) for k in range(5)}
    rows = [(i, t) for i, t in clean.items()]
    short = prose(44)  # one line that is too short to be a repeated passage
    rows += [(2 * 10**6, clean[10**6]), (10**6 + 9, short), (2 * 10**6 + 1, short + " Changed.")]
    clean[10**6 + 9] = short
    rows += [(3 * 10**6, prose(40) + "\n" + item + "\n" + prose(30))]
    rows += [(4 * 10**6, " ".join(f"{w.upper()}!!" for w in prose(60).split()))]
    more = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in rows], given.schema)
    out = str(tmp_path)
    given.unionByName(more).write.parquet(f"{out}/documents.parquet")
    labels.write.parquet(f"{out}/labels.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{out}/benchmark.parquet")
    return out, set(clean)


def test_stages(spark, folder, tmp_path):
    out, clean = planted(spark, folder, tmp_path)
    docs = spark.read.parquet(f"{out}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, out), name)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == columns
    bad, cut, near, leak, mix = (kept[name] for name, _ in corpus_pipeline.STAGES)
    for stage in kept.values():
        assert clean <= set(stage)
    assert 4 * 10**6 not in bad and 3 * 10**6 in near and 3 * 10**6 not in leak
    assert 2 * 10**6 not in cut
    assert 2 * 10**6 + 1 in cut and 2 * 10**6 + 1 not in near
    assert set(mix) == set(leak)
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in leak.items()}
    assert all(r["size"] == sizes[i] and r["taken"] <= 3 * r["size"] for i, r in mix.items())
    taken = {s: sum(r["taken"] for r in mix.values() if r["source"] == s) for s in {r["source"] for r in mix.values()}}
    for r in mix.values():
        assert abs(taken[r["source"]] - r["target"]) <= 1


def test_run(spark, folder):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    found = corpus_pipeline.run(spark, folder)
    assert found.count() > 100 and found.agg(F.sum("taken")).first()[0] > 0


def test_the_mix_of_a_billion_words(spark, monkeypatch):
    """Stage 5 between 2^31 / 3 and 2^31 words, where a total is an int for Spark and three times it is not."""
    monkeypatch.setattr(mixing, "size_of", lambda text: F.coalesce(text.cast("long"), F.lit(0)))  # texts are numbers of words
    monkeypatch.setattr(mixing, "mix", partial(mixing.mix, block_words=1 << 22))
    rows = [(k, str(10**8 + k), f"src{k % 3}") for k in range(10)] + [(10, "7", "src3"), (11, "0", "src3"), (12, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    name, stage = corpus_pipeline.STAGES[4]
    found = stage(spark, docs, "").collect()
    assert name == "mixing" and {r["doc_id"]: r["size"] for r in found} == {i: int(t or 0) for i, t, _ in rows}
    # src0, src1 and src2 share by 1 : 2 : 3 what the three times 7 words of src3 leave.
    left = 10**9 + sum(range(10)) + 7 - 21
    goals = {"src0": left / 6, "src1": 2 * left / 6, "src2": 3 * left / 6, "src3": 21.0, None: 0.0}
    assert {r["source"]: r["target"] for r in found} == goals
    assert {s: sum(r["taken"] for r in found if r["source"] == s) for s in goals} == {s: int(goal) for s, goal in goals.items()}
