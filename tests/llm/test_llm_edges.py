"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from nasty import empty, nasty, rows
from spendscope.llm import decontaminate, licenses, line_crf, line_dedup, mixing, near_dup, pii, quality_rules, url_filter

BENCHMARK = [(1, "the miller counted his sacks twice before the carts came down the hill"), (2, None), (3, ""), (None, "two words"), (4, "same")]


def benchmark(spark):
    return spark.createDataFrame(BENCHMARK, "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(20)] + [(1, None), (None, 1)], "doc_id long, quality int")


def field(spark, docs):
    return line_crf.train(docs, labels(spark))


PER_ROW = {
    "quality": lambda s, d: quality_rules.clean_lines(d),
    "mix": lambda s, d: mixing.mix(d),
    "pii": lambda s, d: pii.find_personal_data(d)[0],
    "repeats": lambda s, d: line_dedup.without_repeats(d)[0],
    "scores": lambda s, d: line_crf.score_documents(d, field(s, d)),
    "contamination": lambda s, d: decontaminate.contamination(d, benchmark(s)),
    "near": lambda s, d: near_dup.near_duplicates(d, 2),
    "licenses": lambda s, d: licenses.scan_licenses(d),
}
SAME_COLUMNS = {
    "deduplicated": lambda s, d: line_dedup.deduplicated(d),
    "good": lambda s, d: line_crf.good_documents(d, field(s, d)),
    "one": lambda s, d: near_dup.one_of_each(d),
    "clean": lambda s, d: decontaminate.decontaminated(d, benchmark(s)),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_result_per_row(name, spark):
    docs = nasty(spark)
    found = PER_ROW[name](spark, docs)
    got = sorted(str(r["doc_id"]) for r in found.select("doc_id").collect())
    assert got == sorted(str(r[0]) for r in rows())
    assert len(found.collect()) == len(rows())


@pytest.mark.parametrize("name", SAME_COLUMNS)
def test_columns_stay(name, spark):
    docs = nasty(spark)
    found = SAME_COLUMNS[name](spark, docs)
    assert found.columns == docs.columns
    assert 0 < len(found.collect()) <= len(rows())


@pytest.mark.parametrize("name", [*PER_ROW, *SAME_COLUMNS])
def test_empty_table(name, spark):
    assert {**PER_ROW, **SAME_COLUMNS}[name](spark, empty(spark)).count() == 0


def test_defined_results(spark):
    docs = nasty(spark)
    quality = {(r["doc_id"], r["n_words"]): r for r in quality_rules.clean_lines(docs).collect()}
    assert not quality[(3, 0)]["kept"] and quality[(3, 0)]["base_failed"] and quality[(4, 0)]["n_lines"] == 1
    assert quality[(11, 0)]["n_lines"] == 5001 and quality[(11, 0)]["n_dup_lines"] == 0
    assert quality[(14, 80)]["n_dup_lines"] == 39 and quality[(14, 80)]["n_repeat_words"] == 80
    assert quality[(16, 32)]["n_punctuation"] == 8 and quality[(15, 55)]["n_navigation"] == 5
    near = {r["doc_id"]: r for r in near_dup.near_duplicates(docs, 2).where("n_shingles > 0 and doc_id is not null").collect()}
    assert near[13]["component_id"] == 1 and near[6]["component_id"] == 6
    none = near_dup.near_duplicates(docs, 2).where("n_shingles = 0").collect()
    assert all(r["component_id"] == r["doc_id"] for r in none)
    kept = [r["doc_id"] for r in near_dup.one_of_each(docs).collect()]
    assert kept.count(1) == 1 and kept.count(2) == 1 and kept.count(3) == 1 and 13 not in kept
    hits = {r["doc_id"]: r for r in decontaminate.contamination(docs, benchmark(spark)).where("doc_id in (1, 7, 13, 14)").collect()}
    assert hits[1]["n_hit"] == 13 and hits[1]["items"] == ["1"] and hits[7]["items"] == ["null"]
    assert hits[13]["n_hit"] == 11 and hits[14]["items"] == ["4"] and hits[14]["n_hit"] == 40
    found = {r["doc_id"]: r["base"] for r in pii.find_personal_data(docs)[0].where("doc_id = 17").collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in found[17]] == [(0, 11, 17), (3, 21, 38)]


def test_scores_without_labels_or_words(spark):
    docs = nasty(spark)
    none = line_crf.train(docs, labels(spark).limit(0))
    scored = line_crf.score_documents(docs, none).collect()
    assert all(abs(r["score"] - 0.5) < 1e-6 and r["predicted"] == 1 for r in scored)
    one = line_crf.train(docs, labels(spark).where("quality = 1"))
    assert all(r["score"] > 0.9 for r in line_crf.score_documents(docs, one).collect())


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTPS://A.Example.ORG/es/x?q#f", "x://example.org", "x://example.org/en/123", "ftp://b.com/de/é🙂",
            "http://ads.q.net/?x", "http://q.net/" + "a" * 50_000 + "/ads/z", "a://b://c/d", "http://notorg/x", "http://org/x"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] * 2, "page_id long, url string, rule string")
    found = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    assert url_filter.judge_urls(pages).count() == 2 * len(urls)
    assert [found[i]["host"] for i in range(4)] == [""] * 4 and found[0]["verdict"] == "allow"
    assert (found[4]["host"], found[4]["path"], found[4]["rule"], found[4]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert found[5]["rule"] is None and found[6]["rule"] == "example.org/en/1" and found[7]["rule"] == "com/de/"
    assert found[8]["verdict"] == "block" and found[9]["verdict"] == "block" and found[10]["host"] == "b:"
    assert found[11]["rule"] is None and found[12]["rule"] == "org/"
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_mix_of_ties_and_null_sources(spark):
    docs = spark.createDataFrame([(1, "a b c", None)] * 3 + [(2, "d e", "x"), (3, None, "x"), (4, "", "y")], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == 6 and sum(r["size"] for r in got) == 11
    by = {r["source"]: (r["source_size"], r["target"]) for r in got}
    # x, y and null weigh 1, 2 and 3; y is empty, so x and null share by 1 : 3.
    assert by == {"x": (2, 2.75), "y": (0, 0.0), None: (9, 8.25)}
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert {s: sum(r["taken"] for r in got if r["source"] == s) for s in by} == {"x": 2, "y": 0, None: 8}


def test_filters_do_not_multiply_work(spark):
    """A filter on a result must not copy the word arrays into its lambdas."""
    docs = spark.createDataFrame([(1, "a b c d e f g " * 3000)], "doc_id long, text string")
    assert quality_rules.clean_lines(docs).where(F.col("n_repeat_words") > 0).count() == 1


@pytest.mark.parametrize(("lines", "words"), [(2, 30), (3, 20), (4, 15), (5, 12), (8, 10), (3, 40)])
def test_short_lines_of_a_passage_go(spark, lines, words):
    passage = "\n".join(" ".join(f"p{k}x{w}" for w in range(words)) for k in range(lines))
    rows = [(i, "\n".join([*(f"a{i}x{k} begins" for k in range(i)), passage, *(f"z{i}x{k} ends" for k in range(i))])) for i in range(1, 9)]
    given, result = line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in given.collect():
        assert r[result]["n_removed_lines"] == (0 if r["doc_id"] == 1 else lines)


def test_rows_without_ids_or_under_a_taken_id_stay(spark):
    texts = ["the first clean text of its own", "a second and wholly different one", "something else that nobody copied here"]
    rows = [(None, t) for t in texts] + [(5, texts[0].upper()), (5, "this id is taken by another text already"), (None, None), (None, ""), (7, " ")]
    kept = near_dup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    left = [r for r in rows if r != (None, texts[0])]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, left))


def test_numbers_without_hyphens_are_candidates(spark):
    numbers = ["415 555 0100", "415.555.0100", "(415) 555 0100"]
    docs = spark.createDataFrame([(k, f"phone {n} now") for k, n in enumerate(numbers)], "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"] if s["kind"] == 3] for r in pii.candidates(docs).collect()}
    assert found == {k: [(6, 6 + len(n))] for k, n in enumerate(numbers)}


def test_small_remainders_of_documents_stay(spark):
    passage = "\n".join(" ".join(f"p{k}x{w}" for w in range(60)) for k in range(5))
    own = "a clean text below a passage that is shared"
    rows = [(1, passage), (2, passage + "\n" + own), (3, passage)]
    kept = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {1: passage, 2: own}


def test_hosts_in_the_path_of_a_url(spark):
    urls = ["http://a.net/www.example.org/es/1", "http://a.net/x.org/y", "http://a.net/ads/x.org/y", "http://www.example.org/es/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages).collect()}
    assert found == {0: (None, "allow"), 1: (None, "allow"), 2: (None, "block"), 3: ("example.org/es/", "block")}


def test_tiny_sources_beside_a_huge_one(spark):
    rows = [(k, "w " * size, f"s{k:02}") for k, size in enumerate((10, 20, 33, 65, 100, 200))] + [(99, "w " * 300_000, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all(0 <= r["target"] - r["taken"] < 1 for r in mixing.mix(docs).collect())


@pytest.mark.parametrize("words", [10**8, 3 * 10**8, 7 * 10**8, 10**10])
def test_targets_of_very_many_words(spark, words):
    """Of totals below a third of 2^31, below 2^31 and above it."""
    sizes = spark.createDataFrame([("a", words), ("b", words), ("c", words), ("d", 5), (None, 0)], "source string, source_size long")
    left = 3 * words + 5 - 15  # what d, at three times its size, leaves
    wanted = {"a": left / 6, "b": 2 * left / 6, "c": 3 * left / 6, "d": 15.0, None: 0.0}
    assert {r["source"]: r["target"] for r in mixing.targets(sizes).collect()} == wanted
