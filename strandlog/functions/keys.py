"""Column helpers for the fixed-width key form that every comparison uses.

Two keys are the same if their padded forms are. The width counts characters, which equals bytes
because keys are ASCII. Null stays null; the empty key pads to ten zeros.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the width of a stored key.
KEY_WIDTH = 10


def pad_key(key: Column | str, width: int = KEY_WIDTH) -> Column:
    """Left-pads with '0' to ``width`` characters and cuts longer keys to the first ``width``."""
    c = F.col(key) if isinstance(key, str) else key
    return F.lpad(c.cast("string"), width, "0")


def unpad_key(key: Column | str) -> Column:
    """Strips every leading zero. For display only: '0' becomes the empty string."""
    c = F.col(key) if isinstance(key, str) else key
    return F.ltrim(c, F.lit("0"))


def clean_op(op: Column | str) -> Column:
    """Operation names in lower case without white space; null stays null."""
    c = F.col(op) if isinstance(op, str) else op
    return F.lower(F.regexp_replace(c, r"\s+", ""))
