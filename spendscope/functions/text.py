"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def tidy(text: Column) -> Column:
    """Lower case without white space at either end; nulls stay null."""
    return F.lower(F.btrim(text, F.lit(WHITE_SPACE)))


def stable_hash(text: Column) -> Column:
    """A 52-bit number from the text alone: the same on every engine and partitioning."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def fast_hash(*parts: Column) -> Column:
    """A 52-bit number from the parts, cheaper but Spark's own."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52))


HASH_SPAN = 2.0**52
