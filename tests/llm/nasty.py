"""A small table with what usually goes wrong, and texts to plant."""

from pyspark.sql import functions as F

PROSE = (
    "The river ran past the old mill and the miller counted his sacks twice before the carts came down the hill.",
    "Nobody in the village could say when the bridge had been built, only that it had always carried the road.",
    "In spring the water rose to the second step, and the children measured it with a hazel stick every morning.",
    "When the letter arrived it was short: the surveyors would come in June, and the mill would be valued at once.",
)
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    prose = "\n".join(PROSE)
    texts = [
        (1, prose), (2, prose), (2, prose), (3, None), (4, ""), (5, " \t\n\r\x0b\x0c "), (6, "word"), (7, "two words"),
        (None, "a row without an id, but with a text that is long enough to be kept by all of the rules."),
        (None, None), (8, LONG), (9, "x" * 120_000), (10, "1" * 50_000), (11, "\n" * 5000), (12, "é" * 3000 + " Ünï çødé 数字 🙂"),
        (13, prose.replace("miller", "baker")), (14, "same line\n" * 40), (2, "another text under an id that is taken already."),
        (15, "| a | b | c | d | e |\n" * 5), (16, "BUY!! NOW!! BUY!! NOW!!\n" * 8), (17, "mail me at a@b.co or +1 (415) 555-0100 now"),
    ]
    return [(i, t, "en", None if k % 7 == 0 else f"s{k % 3}", None) for k, (i, t) in enumerate(texts)]


def nasty(spark):
    """The table with extra columns whose names clash with what the operators use inside."""
    clashing = ["_t1", "_T2", "_row", "_w", "_words", "_result", "_cuts", "score", "kept", "n_words", "size", "target", "_text", "items"]
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    return docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(clashing)])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
