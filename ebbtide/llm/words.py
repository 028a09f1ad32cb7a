"""Words of texts, for the models that learn from them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

WORD = re.compile(r"[^\W\d_]+")


def rows(batch: pa.RecordBatch, size: int = 64) -> Iterator[tuple]:
    """The rows of a batch, a few at a time turned into Python values."""
    for i in range(0, batch.num_rows, size):
        part = batch.slice(i, size)
        yield from zip(*[part.column(j).to_pylist() for j in range(part.num_columns)], strict=True)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lowered."""
    return WORD.findall(text.lower()) if text else []
