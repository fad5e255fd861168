"""Small column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of labels that mean benign traffic.
BENIGN = ("0", "0.0", "benign", "normal", "normal.", "benigntraffic")
#: Spellings that say nothing about a row.
EMPTY = ("", "unknown", "nan", "none")


def folded(c: Column) -> Column:
    """A text trimmed and in lower case."""
    return F.lower(F.trim(c))


def is_benign(c: Column) -> Column:
    """Whether a label means benign traffic; null does not."""
    return F.coalesce(folded(c).isin(*BENIGN), F.lit(False))


def binary_label(c: Column) -> Column:
    """Normal or Attack."""
    return F.when(is_benign(c), "Normal").otherwise("Attack")


def ordered(seed: int, *key: Column) -> Column:
    """A text to order rows by at random but alike on every run: md5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key)).cast("binary"))


def protocol_label(c: Column) -> Column:
    """TCP, UDP or ICMP, or the number as text."""
    return F.when(c == 6, "TCP").when(c == 17, "UDP").when(c == 1, "ICMP").otherwise(c.cast("string"))


def finite(c: Column) -> Column:
    """A number, or null for text, NaN and infinities."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
