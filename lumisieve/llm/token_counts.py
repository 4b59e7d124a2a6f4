"""Token counts of documents in flat token files, by their separators (operator 9).

A flat file is packed ids and nothing else; only the end-of-document id says where documents end. Files are read as
blocks of a bounded size. One vectorised comparison finds a block's separators; what a document has in earlier blocks
comes from a prefix scan in two levels: sums and last separators within segments of ``SEGMENT`` blocks, then over the
segments. So one file of any size is dealt over tasks, and no task sees more than one segment's summaries at once.

``flat_files`` reads files of up to ``WHOLE`` bytes whole. A longer one is listed by its length alone and read as
ranges of fixed-length records, by Hadoop's file systems: no task holds more than a block of it. Records must fill a
file exactly, so a record is the largest number of ids, up to a block, that divides the file's; where that is small (a
prime number of ids: one) more records are read for a block, which costs time only.

The registered query makes flat files of its documents first. Each task encodes what it reads into pieces of up to ``PIECE``
bytes (a longer document is a piece of its own). Spark's text writer puts each piece's bytes, as they are, in a file of
its own, with the separator's bytes as the end of its one line: so the files hold ids and nothing else, go through any
Hadoop file system, and are committed as any table is. Beside each file of ids the same task writes one with the
documents' own ids, for naming results only. The files of ids are then read and scanned like anybody's.

Defined cases: an empty document between two separators counts 0; ids after a file's last separator are a document
without an end (``ended`` is false). A null or empty text has its separator only. An empty table gives no rows.
Rows with equal ids are documents of their own. A text that holds the string of the end-of-document token is encoded as
plain text, so its ids never have the separator and its count is that of the plain encoding. A null id stays null in
its row. A text of any length is one document. Other columns are not read.
"""

from __future__ import annotations

import re
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch, tokens
from .token_table import encoded, texts_of

END_ID, BLOCK_IDS, SEGMENT = 50256, 1 << 16, 1024
#: Bytes of a file that is read whole, about as many in a range of a longer one, and in a file that is made here.
WHOLE, RANGE, PIECE = 1 << 24, 1 << 26, 1 << 22
#: Stems that a worker keeps: a task that scans has two workers, and any of them may have encoded before. Bytes of text that
#: are encoded together, and rows that are sent to a worker at a time: what a task holds besides its stems and its piece.
STEMS, TEXT, SENT = 100_000, 3 << 19, 1024


def cut(batches, size: int):
    """Files (path, content) as blocks of up to ``size`` bytes. Like all that only reads, it first lets go of encoders of tasks before it."""
    tokens.release()
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            view = memoryview(content.as_buffer())
            for k in range(0, len(view), size):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k // size], pa.int64()), pa.array([view[k : k + size].tobytes()], pa.binary())], names=["file", "block", "ids"])


def flat_files(spark: SparkSession, path: str, item_bytes: int = 2, where: str | None = None) -> DataFrame:
    """``file, block, ids`` of the flat files at ``path``, in blocks of up to BLOCK_IDS ids; ``where`` may choose folders by
    their partition columns."""

    size = BLOCK_IDS * item_bytes

    def run(batches):
        return cut(batches, size)

    files, schema = spark.read.format("binaryFile").load(path), "file string, block bigint, ids binary"
    files = files.where(where) if where else files
    small = files.where(F.col("length") <= WHOLE).select("path", "content").mapInArrow(run, schema)
    long = files.where(F.col("length") > WHOLE).select("path", "length").collect()  # a row for each long file, without content
    if not long:
        return small
    ranges = spark.sparkContext.union([_ranges(spark, r["path"], r["length"], item_bytes) for r in long])
    return small.union(spark.createDataFrame(ranges, schema))


def _ranges(spark: SparkSession, path: str, length: int, item_bytes: int) -> RDD:
    """A long file's rows (file, block, ids); ranges start at multiples of a block."""
    if length % item_bytes:
        raise ValueError(f"{path}: {length} bytes are not a whole number of ids")
    unit = next(k for k in range(BLOCK_IDS, 0, -1) if length // item_bytes % k == 0)
    record, per = unit * item_bytes, BLOCK_IDS // unit
    split = str(record * per * max(1, RANGE // (record * per)))
    name = re.sub(r"([\\{}\[\]*?])", r"\\\1", path)  # no pattern
    conf = {
        "mapreduce.input.fileinputformat.inputdir": re.sub(r"([\\,])", r"\\\1", name),  # no list
        "mapreduce.input.fileinputformat.split.minsize": split,
        "mapreduce.input.fileinputformat.split.maxsize": split,
        "org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(record),
    }
    records = spark.sparkContext.newAPIHadoopRDD("org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)

    def run(part):
        for block, own in groupby(part, lambda r: r[0] // per):
            yield path, block, bytearray(b"".join(r[1] for r in own))

    return records.mapPartitions(run)


@contextmanager
def sent_at_once(spark: SparkSession, rows: int):
    """At most ``rows`` rows are sent to a Python worker at a time by the jobs that run meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


NAMED = np.dtype([("doc_id", "<i8"), ("valid", "u1")])


def flattened(docs: DataFrame, vocab: str | None = None, piece_bytes: int = PIECE) -> tuple[DataFrame, DataFrame, str]:
    """``docs`` as flat files, read back in blocks (``file, block, ids``); which document is the n-th of a file (``file,
    ordinal, doc_id``), for naming results only; the ids' numpy type. Nothing is shuffled, and a task holds a piece
    besides what it encodes at a time."""
    spark, e = docs.sparkSession, tokens.encoder(vocab, plain=True)
    dtype, item, end = e.dtype.str, e.dtype.itemsize, np.array([END_ID], e.dtype).tobytes()

    def run(batches):
        from pyspark import TaskContext

        e, task = tokens.encoder(vocab, plain=True, stored=STEMS), TaskContext.get().partitionId()
        piece, held, names, size = 0, [], [], 0

        def out():
            # The line's end, which the writer puts, is the last separator.
            rows = [b"".join(held)[: -len(end)], np.concatenate(names).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([f"{kind}-{task:06d}-{piece:06d}" for kind in ("ids", "names")]), pa.array(rows, pa.binary())], names=["file", "ids"])

        for batch in batches:
            for lo, hi, ids in encoded(batch.column(1), e, END_ID, TEXT):
                keys, data = batch.column(0).slice(lo, hi - lo), ids.buffers()[2].to_pybytes()
                if held and size + len(data) > piece_bytes:
                    yield out()
                    piece, held, names, size = piece + 1, [], [], 0
                own = np.zeros(len(keys), NAMED)
                own["doc_id"], own["valid"] = keys.fill_null(0).to_numpy(), keys.is_valid().to_numpy(zero_copy_only=False)
                held.append(data)
                names.append(own)
                size += len(data)
        if held:
            yield out()

    def unpacked(batches):
        tokens.release()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                view = memoryview(content.as_buffer())
                own = np.frombuffer(view[: len(view) - len(end)], NAMED)
                for lo in range(0, len(own), BLOCK_IDS):
                    part = own[lo : lo + BLOCK_IDS]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(np.arange(lo, lo + len(part))), pa.array(part["doc_id"], mask=part["valid"] == 0)], names=["file", "ordinal", "doc_id"])

    path = scratch.new_path(spark, "op9-flat")
    lines = docs.select(*texts_of(docs)).mapInArrow(run, "file string, ids binary").select("file", F.col("ids").cast("string"))
    with sent_at_once(spark, SENT):
        lines.write.partitionBy("file").option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).text(path)
    written, schema = spark.read.format("binaryFile").load(path), "file string, ordinal bigint, doc_id bigint"
    if "file" not in written.columns:  # no documents, no folders
        return spark.createDataFrame([], "file string, block bigint, ids binary"), spark.createDataFrame([], schema), dtype
    piece = lambda c, kind: F.regexp_extract(c, f"/file={kind}-([0-9-]+)/[^/]*$", 1)
    blocks = flat_files(spark, path, item, "file like 'ids-%'").withColumn("file", piece("file", "ids"))
    names = written.where("file like 'names-%'").select(piece("path", "names").alias("file"), "content").mapInArrow(unpacked, schema)
    return blocks, names, dtype


def counted(blocks: DataFrame, dtype: str = "<u2", end_id: int = END_ID) -> DataFrame:
    """``file, ordinal, start, n_tokens, ended`` of every document in the flat files' blocks; separators don't count."""

    def run(batches):
        tokens.release()
        for batch in batches:
            found, n = [], []
            for b in batch.column(2):
                ids = np.frombuffer(b.as_buffer(), dtype)
                found.append(np.flatnonzero(ids == end_id))
                n.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["file", "block", "n", "ends"])

    scanned = blocks.select("file", "block", "ids").mapInArrow(run, "file string, block bigint, n bigint, ends array<bigint>")
    scanned = scratch.written(scanned.withColumn("segment", F.floor(F.col("block") / SEGMENT)).withColumn("n_ends", F.size("ends").cast("long")).withColumn("last_end", F.array_max("ends")), "op9-scanned")
    # Within segments: ids and separators before each block, and where the last separator stands.
    before = Window.partitionBy("file", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = scanned.withColumn("ids_in", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("ends_in", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    inner = inner.withColumn("own_last", F.col("ids_in") + F.col("last_end"))
    inner = inner.withColumn("last_in", F.max("own_last").over(before))
    # Over segments, each one row.
    sums = inner.groupBy("file", "segment").agg(F.sum("n").alias("seg_n"), F.sum("n_ends").alias("seg_ends"), F.max("own_last").alias("seg_last"), F.max("block").alias("seg_block"))
    over = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("seg_at", F.coalesce(F.sum("seg_n").over(over), F.lit(0))).withColumn("seg_ord", F.coalesce(F.sum("seg_ends").over(over), F.lit(0)))
    sums = sums.withColumn("seg_before", F.max(F.col("seg_at") + F.col("seg_last")).over(over)).withColumn("file_block", F.max("seg_block").over(Window.partitionBy("file")))
    placed = inner.join(sums.drop("seg_n", "seg_ends", "seg_last", "seg_block"), ["file", "segment"])
    placed = placed.withColumn("at", F.col("seg_at") + F.col("ids_in")).withColumn("since", F.coalesce(F.col("seg_at") + F.col("last_in"), "seg_before", F.lit(-1)) + 1)
    placed = placed.withColumn("ord", F.col("seg_ord") + F.col("ends_in"))
    docs = placed.select("file", "at", "since", "ord", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("since")).otherwise(F.col("at") + F.get("ends", F.col("i") - 1) + 1)
    whole = docs.select("file", (F.col("ord") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("at") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    tail = placed.where("block = file_block").withColumn("start", F.coalesce(F.col("at") + F.col("last_end") + 1, F.col("since")))
    tail = tail.select("file", (F.col("ord") + F.col("n_ends")).alias("ordinal"), "start", (F.col("at") + F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return whole.union(tail)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, names, dtype = flattened(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return counted(blocks, dtype).join(names, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens", "ended")
