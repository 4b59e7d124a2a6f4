"""Documents as packed token ids: the common first step of the operators on tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens

#: Rows and bytes of text that are encoded together; a longer text is encoded alone.
ROWS, BYTES = 4096, 6 << 20


def cut_rows(sizes: np.ndarray, rows: int = ROWS, most: int = BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have at most ``most`` bytes together, or are one row."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        before = ends[lo] - sizes[lo]
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield lo, hi
        lo = hi


def encoded(texts: pa.Array, e: "tokens.Encoder", end_id: int, most: int = BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """``lo, hi, ids`` for ranges of rows: the ids of each whole text (null: empty), then ``end_id``, packed. A range has up
    to ``most`` bytes of text, or is one row."""
    end = np.array([end_id], e.dtype).tobytes()
    at = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    for lo, hi in cut_rows(np.diff(at).astype(np.int64), most=most):
        yield lo, hi, e.encode_many(texts.slice(lo, hi - lo).to_pylist(), end)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    return [F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")]


def token_table(docs: DataFrame, end_id: int, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text", extra: str = "", describe=None, plain: bool = False) -> DataFrame:
    """``id_col, n_tokens, ids`` for each row: the ids of the whole text (null: empty), then ``end_id``, packed.

    ``describe(ids: numpy array) -> value`` fills one more column, declared by ``extra`` (a DDL field).
    ``plain``: the strings of added tokens are text like any other.
    Rows are independent; nothing is shuffled and one range of rows is in memory at a time beside its Arrow batch.
    """
    schema = f"{id_col} bigint, n_tokens bigint, ids binary" + (f", {extra}" if extra else "")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        e = tokens.encoder(vocab, plain)
        for batch in batches:
            for lo, hi, ids in encoded(batch.column(1), e, end_id):
                sizes = np.diff(np.frombuffer(ids.buffers()[1], np.int32)) // e.dtype.itemsize
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(sizes.astype(np.int64)), ids]
                if describe:
                    cols.append(pa.array([describe(np.frombuffer(b.as_buffer(), e.dtype)) for b in ids], fields[3].type))
                yield pa.RecordBatch.from_arrays(cols, schema=fields)

    return docs.select(*texts_of(docs, id_col, text_col)).mapInArrow(run, schema)
