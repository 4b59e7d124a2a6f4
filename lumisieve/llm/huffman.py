"""Token ids as canonical length-limited Huffman codes (operator 1).

``encode_table`` writes a folder with three Parquet tables: blocks in ascending document order, code lengths, and a
manifest of shards; ``read_documents`` gives the documents back from the folder alone, in any session.

* Spark sorts the texts by ranges of document ids; each range is a shard, whose task encodes the texts, forms blocks of
  ids and counts them. So texts move once, and ids never.
* Code lengths come from the counts of every id in the corpus (partial sums of the tasks, one row per id of the
  vocabulary in the end, which is all that reaches the driver). Package-merge bounds them at ``MAX_BITS``, so that a
  decoder needs one table of ``2 ** MAX_BITS`` entries. Codes are canonical: the lengths alone give them.
* A block holds up to ``BLOCK_IDS`` ids of one shard's stream, whatever documents they belong to, and can be decoded
  alone: it carries its documents' ordinals and lengths and, for every ``CHECKPOINT_IDS`` ids, the bit at which they
  start. The decoder works on all checkpoints of several blocks at once, one table look-up for a step of each.
* The manifest has each shard's first place, so that a document's place in the whole stream is that plus its place
  in the shard.

Blocks are rows of a Parquet table, so Spark's own commit protocol makes the output whole when tasks are run again.

Defined cases: a null or empty text has the end id only. Null document ids come first. Rows with equal ids are
documents of their own, in the order in which they are read, and a range may end between them. A text of any length is
encoded whole, and its ids may be in many blocks. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crc, scratch, tokens
from .token_table import encoded, texts_of

MAX_BITS, BLOCK_IDS, CHECKPOINT_IDS = 16, 1 << 16, 128
PARTS = "shard int, block bigint, first_id bigint, n_ids bigint, doc_ids array<bigint>, ordinals array<bigint>, lengths array<bigint>, after array<bigint>"
RAW = f"{PARTS}, ids binary, used array<int>, counts array<bigint>"
BLOCKS = f"{PARTS}, checkpoints array<bigint>, bits binary"
#: Blocks that a decoder takes together.
TOGETHER = 16


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for ids with these counts (0: no code), by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids cannot have codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    # Each level's list is the leaves merged with pairs of the level below; only how many leaves stand in its first
    # 2j items is needed, so levels keep a mask of which items are leaves.
    masks, level = [], leaves
    masks.append(np.ones(len(leaves), bool))
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        place = np.argsort(both, kind="stable")
        level = both[place]
        masks.append(place < len(leaves))
    take, out = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for mask in reversed(masks):
        n_leaves = int(mask[:take].sum())
        out[:n_leaves] += 1
        take = 2 * (take - n_leaves)
    lengths[order] = out
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each the one before plus one."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    size = lengths[order].astype(np.int64)
    longest = int(size.max()) if len(size) else 0
    # In units of the longest code, a code's place is the sum of the room that those before it take.
    room = np.left_shift(1, longest - size)
    codes[order] = ((np.cumsum(room) - room) >> (longest - size)).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every window of as many bits as the longest code: the id that it starts with, and its length."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    bits = int(lengths.max()) if len(used) else 1
    room = np.left_shift(1, bits - lengths[order].astype(np.int64))
    ids, sizes = np.repeat(order, room), np.repeat(lengths[order], room)
    gap = (1 << bits) - len(ids)
    return np.pad(ids, (0, gap)).astype(np.uint32), np.pad(sizes, (0, gap), constant_values=1).astype(np.int64), bits


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit string of ``ids`` and the bit at which every CHECKPOINT_IDS-th starts."""
    size = lengths[ids].astype(np.int64)
    if len(size) and size.min() == 0:
        raise ValueError("an id without a code")
    end = np.cumsum(size)
    start = end - size
    total = int(end[-1]) if len(end) else 0
    # A code of at most 16 bits lies within 32 bits from the byte at which it starts.
    byte, word = start >> 3, codes[ids].astype(np.uint64) << (32 - size - (start & 7)).astype(np.uint64)
    out = np.zeros((total + 7) // 8 + 4, np.uint8)
    first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]]) if len(byte) else np.zeros(0, np.int64)
    merged = np.bitwise_or.reduceat(word, first) if len(first) else word
    at = byte[first]
    for k in range(4):  # codes that start in one byte are merged, so each k writes every byte at most once
        out[at + k] |= ((merged >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.uint8)
    return out[: (total + 7) // 8].tobytes(), start[::CHECKPOINT_IDS]


def decode_blocks(blocks: list[tuple[bytes, np.ndarray, int]], table: tuple[np.ndarray, np.ndarray, int]) -> list[np.ndarray]:
    """The ids of blocks (bits, checkpoints, number of ids); all checkpoints advance together, an id a step."""
    ids, sizes, width = table
    if width > 25:
        raise ValueError("codes of more than 25 bits are not read")
    raw = np.frombuffer(b"".join(bytes(bits) + b"\0\0\0\0" for bits, _, _ in blocks), np.uint8).astype(np.uint32)
    # 32 bits from any byte on hold every window of up to 25 bits that starts in it.
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    first = 8 * np.cumsum([0, *(len(bits) + 4 for bits, _, _ in blocks)])
    at = np.concatenate([marks + start for (_, marks, _), start in zip(blocks, first)])
    out = np.zeros((CHECKPOINT_IDS, len(at)), np.uint32)
    last, shift, mask = len(window) - 1, 32 - width, (1 << width) - 1
    for k in range(CHECKPOINT_IDS):
        got = (window[np.minimum(at >> 3, last)] >> (shift - (at & 7))) & mask
        out[k] = ids[got]
        at += sizes[got]
    found, lo = [], 0
    for _, marks, n in blocks:
        found.append(np.ascontiguousarray(out[:, lo : lo + len(marks)].T).reshape(-1)[:n].astype("<u4", copy=False))
        lo += len(marks)
    return found


def decode_bits(bits: bytes, checkpoints: np.ndarray, n_ids: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    return decode_blocks([(bits, np.asarray(checkpoints, np.int64), n_ids)], table)[0]


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _row(values: list, fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, fields)], schema=fields)


def raw_blocks(docs: DataFrame, end_id: int, vocab: str | None, shards: int, n_ids: int) -> DataFrame:
    """``RAW``: blocks of plain ids, a shard's blocks from one task, and a row with each task's counts."""
    fields = _arrow_schema(RAW)

    def run(batches):
        from pyspark import TaskContext

        e = tokens.encoder(vocab)
        shard, block, ordinal, place = TaskContext.get().partitionId(), 0, 0, 0
        counts, parts, room = np.zeros(n_ids, np.int64), [], BLOCK_IDS
        held: list[np.ndarray] = []

        def flush():
            nonlocal block, place, parts, held, room
            keys, ordinals, sizes, after = (list(x) for x in zip(*parts))
            row = [shard, block, place, BLOCK_IDS - room, keys, ordinals, sizes, after, b"".join(held), None, None]
            block, place, parts, held, room = block + 1, place + BLOCK_IDS - room, [], [], BLOCK_IDS
            return _row(row, fields)

        for batch in batches:
            for lo, hi, packed in encoded(batch.column(1), e, end_id):
                ids, ends = np.frombuffer(packed.buffers()[2], e.dtype), np.frombuffer(packed.buffers()[1], np.int32) // e.dtype.itemsize
                counts += np.bincount(ids, minlength=n_ids)
                for key, at, end in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    while at < end:
                        n = min(room, end - at)
                        held.append(ids[at : at + n])
                        parts.append((key, ordinal, n, end - at - n))
                        at, room = at + n, room - n
                        if not room:
                            yield flush()
                    ordinal += 1
        if parts:
            yield flush()
        used = np.flatnonzero(counts)
        if len(used):
            yield _row([shard, None, None, None, None, None, None, None, None, used.astype(np.int32), counts[used]], fields)

    # Of rows with one id the place among the rows read is the second key, so that no id is bound to one shard.
    placed = docs.select(*texts_of(docs), F.monotonically_increasing_id().alias("__ls_at"))
    ordered = placed.repartitionByRange(shards, "doc_id", "__ls_at").sortWithinPartitions("doc_id", "__ls_at")
    return ordered.select("doc_id", "text").mapInArrow(run, RAW)


def _encoder_of(shared):
    fields = _arrow_schema(BLOCKS)

    def run(batches):
        lengths, codes, dtype = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                bits, marks = encode_bits(np.frombuffer(batch.column(8)[k].as_buffer(), dtype), codes, lengths)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(8)), pa.array([marks], fields[8].type), pa.array([bits], pa.binary())], schema=fields)

    return run


def encode_table(docs: DataFrame, end_id: int, vocab: str | None = None, shards: int | None = None, path: str | None = None) -> str:
    """Write ``docs`` (doc_id, text) as a folder of blocks, code lengths and manifest; its path."""
    spark, path = docs.sparkSession, path or scratch.new_path(docs.sparkSession, "op1-files")
    e = tokens.encoder(vocab)
    n_ids = max(e.n_ids, end_id + 1)
    raw = scratch.written(raw_blocks(docs, end_id, vocab, shards or int(spark.conf.get("spark.sql.shuffle.partitions")), n_ids), "op1-raw")
    counts = np.zeros(n_ids, np.int64)
    pairs = raw.where("used is not null").select(F.explode(F.arrays_zip("used", "counts")).alias("c"))
    for row in pairs.groupBy("c.used").agg(F.sum("c.counts").alias("n")).collect():  # at most one row for each id of the vocabulary
        counts[row["used"]] = row["n"]
    lengths = code_lengths(counts, max(MAX_BITS, int(np.ceil(np.log2(max(2, np.count_nonzero(counts)))))))
    shared = spark.sparkContext.broadcast((lengths, canonical_codes(lengths), e.dtype.str))
    raw.where("ids is not null").select(*[f.split()[0] for f in RAW.split(", ")[:9]]).mapInArrow(_encoder_of(shared), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    used = np.flatnonzero(lengths).tolist()
    spark.createDataFrame([(k, int(lengths[k])) for k in used], "token_id int, n_bits int").coalesce(1).write.parquet(f"{path}/lengths")
    sums = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row per shard
    first, manifest = 0, []
    for row in sums:
        manifest.append((row["shard"], first))
        first += row["n"]
    spark.createDataFrame(manifest, "shard int, shard_start bigint").coalesce(1).write.parquet(f"{path}/manifest")
    scratch.dropped(raw)
    return path


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the folder that ``encode_table`` wrote.

    A block gives for each of its documents the part's length and what its CRC adds to the whole document's; sums and
    xors bring the parts of a long document together, however many blocks it takes.
    """
    known = spark.read.parquet(f"{path}/lengths").collect()  # at most one row for each id of the vocabulary
    lengths = np.zeros(max((r["token_id"] for r in known), default=0) + 1, np.uint8)
    for r in known:
        lengths[r["token_id"]] = r["n_bits"]
    shared = spark.sparkContext.broadcast(lengths)
    names = ["shard", "ordinal", "doc_id", "place", "n", "mark"]

    def run(batches):
        table = decode_table(shared.value)
        values = lambda column, k: column[k].values
        for batch in batches:
            shard, first_id, n_ids, doc_ids, ordinals, sizes, after, marks, bits = (batch.column(c) for c in range(9))
            for lo in range(0, batch.num_rows, TOGETHER):
                some = range(lo, min(batch.num_rows, lo + TOGETHER))
                decoded = decode_blocks([(bits[k].as_buffer(), values(marks, k).to_numpy(), n_ids[k].as_py()) for k in some], table)
                for k, ids in zip(some, decoded):
                    n = values(sizes, k).to_numpy()
                    ends = np.cumsum(n)
                    crcs = [zlib.crc32(ids[e - m : e]) for e, m in zip(ends.tolist(), n.tolist())]
                    crcs = [crc.moved(c, 4 * a) if a else c for c, a in zip(crcs, values(after, k).to_pylist())]
                    yield pa.RecordBatch.from_arrays([pa.array([shard[k].as_py()] * len(n), pa.int32()), values(ordinals, k), values(doc_ids, k), pa.array(first_id[k].as_py() + ends - n), values(sizes, k), pa.array(crcs, pa.int64())], names=names)

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("shard", "first_id", "n_ids", "doc_ids", "ordinals", "lengths", "after", "checkpoints", "bits")
    parts = blocks.mapInArrow(run, "shard int, ordinal bigint, doc_id bigint, place bigint, n bigint, mark bigint")
    docs = parts.groupBy("shard", "ordinal").agg(F.min("doc_id").alias("doc_id"), F.min("place").alias("place"), F.sum("n").alias("n_tokens"), F.bit_xor("mark").alias("ids_crc32"))
    return docs.join(spark.read.parquet(f"{path}/manifest"), "shard").select("doc_id", (F.col("shard_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_documents(spark, encode_table(docs, end_id=2))
