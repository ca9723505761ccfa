"""Line-first cleaning: rules per line, then a verdict on what is left of the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.llm.texts import SPACE, fixed, words

WINDOW = 5
MIN_WORDS = 10
REPEATED_PERCENT = 20
LOST_PERCENT = 50  # a document that loses more than this share of its words to the line rules goes
SENTENCE_WORDS = 12  # a line this long must hold a sentence mark
MARKS_PERCENT = 30  # shouting and symbol runs per 100 words
LINKS_PERCENT = 30  # separators of menus per 100 words
BOILERPLATE_WORDS = 30  # longer lines are prose that happens to name such a thing

MARK = r"[.!?:;\x{2026}\x{3002}]"
NOISE = r"[#*$%&<>]+|[!?]{2,}"
SEPARATOR = r"[|\x{00BB}\x{2022}\x{203A}]"
# Phrases of page furniture.
PHRASES = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of service", "terms of use",
    "enable javascript", "click here", "read more", "sign up", "log in", "share this", "subscribe to", "powered by",
    "skip to content", "back to top", "lorem ipsum",
)


def _occurrences(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1))


def repeated_words(listed: str, window: int = WINDOW) -> list[tuple[str, Column]]:
    """Steps that count words inside windows which occur twice or more among the words in ``listed``.

    Windows are told apart by 64-bit hashes within one text. Only texts in which some window repeats
    sort theirs. Returns columns to be added one after the other; the last is ``n_repeat_words``.
    """
    empty = "cast(array() as array<struct<h:bigint,p:int>>)"
    return [
        (
            "_win",
            F.expr(
                f"if(size({listed}) >= {window}, transform(sequence(1, size({listed}) - {window - 1}),"
                f" i -> xxhash64(slice({listed}, i, {window}))), cast(array() as array<bigint>))"
            ),
        ),
        (
            "_sorted",
            F.expr(
                f"if(size(array_distinct(_win)) < size(_win), sort_array(transform(_win, (h, p) -> struct(h, p))), {empty})"
            ),
        ),
        (
            "_at",
            F.expr(
                "sort_array(transform(filter(_sorted, (x, i) -> coalesce(get(_sorted, i - 1).h = x.h, false)"
                " or coalesce(get(_sorted, i + 1).h = x.h, false)), x -> x.p))"
            ),
        ),
        (
            "n_repeat_words",
            F.expr(
                f"aggregate(transform(_at, (p, i) -> least({window}, coalesce(get(_at, i + 1) - p, {window}))),"
                " 0L, (a, x) -> a + x)"
            ),
        ),
    ]


def _judged(line: Column) -> Column:
    """A line with its number of words and the first rule that it breaks, if any."""
    size = F.size(F.array_remove(F.split(line, SPACE), ""))
    phrase = F.lower(line).rlike("|".join(PHRASES))
    return F.struct(line.alias("line"), size.alias("size"), _occurrences(line, NOISE).alias("noise"),
                    _occurrences(line, SEPARATOR).alias("links"), line.rlike(MARK).alias("mark"), phrase.alias("phrase"))


def _broken(x: Column) -> Column:
    size = x["size"]
    return (
        F.when(100 * x["noise"] > MARKS_PERCENT * size, "punctuation")
        .when((x["links"] >= 3) & (100 * x["links"] > LINKS_PERCENT * size), "navigation")
        .when((size >= SENTENCE_WORDS) & ~x["mark"], "punctuation")
        .when((size <= BOILERPLATE_WORDS) & x["phrase"], "boilerplate")
    )


def clean_lines(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its figures, the lines that break a rule, the cleaned text and the verdict.

    Columns: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_punctuation, n_navigation, n_boilerplate, lost_words, clean_text, base_failed, kept``. A line may
    break the punctuation rule (noise or no sentence mark in a long line), the navigation rule (menu
    separators) or the boilerplate rule (page furniture); such lines leave ``clean_text``. A document is
    kept unless the base rules fail it or its broken lines hold more than ``LOST_PERCENT`` of its words.
    Null and empty texts have no words and fail the base rules. Everything happens inside the row: no
    shuffle, whatever the sizes; repeated rows and other columns change nothing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"), fixed(words(text)).alias("_words"))
    rows = rows.withColumn("_lines", fixed(F.transform(F.split("_text", "\n"), _judged)))
    for name, step in repeated_words("_words"):
        rows = rows.withColumn(name, fixed(step))
    rows = rows.withColumn(
        "_ruled", fixed(F.transform("_lines", lambda x: F.struct(x["line"], x["size"], _broken(x).alias("rule"))))
    )
    solid = F.transform(F.filter("_lines", lambda x: x["size"] > 0), lambda x: x["line"])
    lost = F.aggregate(
        F.filter("_ruled", lambda x: x["rule"].isNotNull()), F.lit(0).cast("long"), lambda a, x: a + x["size"]
    )

    def broken(rule: str) -> Column:
        return F.size(F.filter("_ruled", lambda x: x["rule"] == rule)).cast("long")

    counted = rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size(solid) - F.size(F.array_distinct(solid))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").cast("long").alias("n_lines"),
        *[broken(rule).alias(f"n_{rule}") for rule in ("punctuation", "navigation", "boilerplate")],
        lost.alias("lost_words"),
        F.array_join(F.transform(F.filter("_ruled", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    lost_much = 100 * F.col("lost_words") > LOST_PERCENT * F.col("n_words")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost_much)
