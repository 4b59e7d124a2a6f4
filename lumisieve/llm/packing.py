"""Packing documents into training sequences along a space-filling curve (operator 4).

A document's vector is the mean of fixed pseudo-random vectors of its token ids (a hashed bag of tokens, projected to
``DIMS`` dimensions in one step). Its cell's place on the Hilbert curve is the sort key: Spark sorts the documents by
range of that key, and each sorted partition is one stream that is cut every ``SEQUENCE`` tokens, so that neighbours
on the curve share sequences. What is left at a partition's end is cut into powers of two, which need no padding.

Equal documents have equal keys; a hash of the document's id is the second key, so that a large group of copies is
spread over as many partitions as its size asks for. A task holds one Arrow batch and nothing of its stream.

Defined cases: a null or empty text has the end id only. A null id stays null in its pieces. Rows with equal ids are
documents of their own, equal texts too. A text of any length is encoded whole and cut into many pieces. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch, tokens
from .token_table import token_table

SEQUENCE, DIMS, BITS, SEED = 1024, 3, 10, 20240607
#: The means' spread: this many standard deviations of the mean of 16 tokens' vectors to either side.
RANGE = 3.0 / 4.0
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

_VECTORS: dict[int, np.ndarray] = {}


def token_vectors(n_ids: int) -> np.ndarray:
    if n_ids not in _VECTORS:
        _VECTORS[n_ids] = np.random.default_rng(SEED).standard_normal((n_ids, DIMS)).astype(np.float32)
    return _VECTORS[n_ids]


def hilbert_key(cell: list[int], bits: int = BITS) -> int:
    """The place of a cell on the Hilbert curve, by Skilling's transform ("Programming the Hilbert curve", 2004)."""
    x = list(cell)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    key = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | ((v >> b) & 1)
    return key


def curve_key(ids: np.ndarray, n_ids: int) -> int:
    mean = token_vectors(n_ids)[ids].mean(0) if len(ids) else np.zeros(DIMS)
    cell = np.clip((mean + RANGE) / (2 * RANGE) * (1 << BITS), 0, (1 << BITS) - 1).astype(int)
    return hilbert_key(cell.tolist())


def pack(docs: DataFrame, end_id: int = 0, vocab: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """The pieces (``PIECES``) of ``docs`` (doc_id, text); offsets are gapless in each sequence.

    A sequence is full, or its length is a power of two. ``sequence`` must be a power of two itself.
    """
    spark = docs.sparkSession
    e = tokens.encoder(vocab)
    n_ids, dtype = max(e.n_ids, end_id + 1), e.dtype.str
    keyed = scratch.written(token_table(docs, end_id, vocab, extra="curve bigint", describe=lambda ids: curve_key(ids, n_ids)), "op4-ids")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows that agree in text and id are parted by their place in the table.
    along = keyed.withColumn("spread", F.xxhash64("doc_id")).withColumn("place", F.monotonically_increasing_id())
    along = along.repartitionByRange(n, "curve", "spread", "place").sortWithinPartitions("curve", "spread", "place")
    return along.select("doc_id", "ids").mapInArrow(_cutter(dtype, sequence), PIECES)


def _cutter(dtype: str, sequence: int):
    def run(batches):
        from pyspark import TaskContext

        sequence_id = TaskContext.get().partitionId() << 33
        offset, held = 0, []  # the pieces of the sequence that is being filled: at most ``sequence`` of them

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names=[c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            ready = []
            for key, packed in zip(batch.column(0), batch.column(1)):
                key, ids, start = key.as_py(), np.frombuffer(packed.as_buffer(), dtype).astype("<u4"), 0
                while start < len(ids):
                    n = min(sequence - offset, len(ids) - start)
                    held.append((key, start, ids[start : start + n], len(ids), offset))
                    start, offset = start + n, offset + n
                    if offset == sequence:
                        ready += [(k, s, len(x), zlib.crc32(x), t, sequence_id, o) for k, s, x, t, o in held]
                        sequence_id, offset, held = sequence_id + 1, 0, []
            if ready:
                yield out(ready)
        rest = []
        for part, (k, s, x, t, o) in _in_powers(held, offset):
            rest.append((k, s, len(x), zlib.crc32(x), t, sequence_id + part, o))
        if rest:
            yield out(rest)

    return run


def _in_powers(held: list, total: int):
    """The pieces of an unfilled sequence, cut again into sequences whose lengths are powers of two, longest first."""
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    part, room = 0, sizes[0] if sizes else 0
    for k, s, ids, t, _ in held:
        at = 0
        while at < len(ids):
            n = min(room, len(ids) - at)
            yield part, (k, s + at, ids[at : at + n], t, sizes[part] - room)
            at, room = at + n, room - n
            if not room and part + 1 < len(sizes):
                part, room = part + 1, sizes[part + 1]


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
