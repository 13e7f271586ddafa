"""Hashes of canonical texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The modulus of the product checksum (a fixed value).
PRIME = 2147483629


def hex_number(text: Column, start: int, digits: int) -> Column:
    """Up to 15 hexadecimal digits as a number."""
    if not 0 < digits <= 15:
        raise ValueError("1 to 15 hexadecimal digits fit a long")
    return F.conv(F.substring(text, start, digits), 16, 10).cast("bigint")


def checksums(text: Column) -> dict[str, Column]:
    """Two 60-bit numbers of the text's md5 and their product modulo PRIME."""
    digest = F.md5(text)
    h1, h2 = hex_number(digest, 1, 15), hex_number(digest, 16, 15)
    return {"h1": h1, "h2": h2, "pr": ((h1 % PRIME) * (h2 % PRIME)) % PRIME}


def bucket(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of the text's md5."""
    return F.substring(F.md5(text), 1, digits)
