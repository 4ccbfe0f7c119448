"""Words of whole texts as two operators read them, and query sets cut into blocks of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+` over UTF-8, once A-Z are lower-cased: digits, a-z and all beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8, only A-Z lower-cased; null has none."""
    return WORD.findall(text.lower()) if text else []


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The rows (id, text) of a query set in blocks of about so many bytes of text, ordered by id and text.

    One block at a time is collected, so what is on the driver is bounded whatever the set's size; a block
    holds at least one whole text."""
    own = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for i in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
        yield sorted(((r.id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1] or ""))
