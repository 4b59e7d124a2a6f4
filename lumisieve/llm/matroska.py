"""Payloads in Matroska, and Matroska as a table of packets (operator 5).

``muxed`` stores bytes as 8-bit PCM samples (mono, 8000 a second) in laced SimpleBlocks within clusters, with cues.
``packets`` parses any Matroska bytes into rows (track, timestamp, byte range of each packet); ``features`` reads the
payload back through that table. Elements have variable-length ids and sizes; clusters may have unknown sizes; all
three kinds of lacing, SimpleBlocks and BlockGroups are read. A laced frame's time is its block's and the durations of
those before it: an equal share of the BlockGroup's duration if it has one, else the track's default duration; without
either it is the block's. Nothing is shuffled; a row's bytes are in memory once.

Defined cases: a null or empty payload is 64 zero bytes. Bytes that are no Matroska, or end early, raise in
``parsed``; in ``packets`` they give one row with ``error`` set, and a null gives none. Equal payloads have equal
files: nothing but the payload goes into them. Rows with null or equal ids are rows of their own. A payload of any
length is many clusters of one file. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

PAD, RATE, FRAME, LACE, CLUSTER_BLOCKS = 64, 8000, 512, 8, 32
#: Element ids (fixed values of the format).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, AUDIO, CUE_POINT, CUE_POSITIONS, BLOCK_GROUP = 0xAE, 0xE1, 0xBB, 0xB7, 0xA0
TRACK_NUMBER, TRACK_TYPE, CODEC, DEFAULT_DURATION, BLOCK_DURATION = 0xD7, 0x83, 0x86, 0x23E383, 0x9B
TIMESTAMP, SIMPLE_BLOCK, BLOCK, TIMESTAMP_SCALE, CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xE7, 0xA3, 0xA1, 0x2AD7B1, 0xB3, 0xF7, 0xF1
PARENTS = {SEGMENT, CLUSTER, CUES, CUE_POINT, CUE_POSITIONS, BLOCK_GROUP, INFO, TRACKS, TRACK_ENTRY}
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 2, 4, 6


def number(value: int, length: int = 0) -> bytes:
    """A variable-length integer: a leading one whose place gives the length, then the value."""
    while not length or value >= (1 << (7 * length)) - 1:
        length += 1
    return (value | 1 << (7 * length)).to_bytes(length, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + number(len(body)) + body


def unsigned(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def padded(data: bytes) -> bytes:
    return data + bytes(max(PAD, -(-len(data) // PAD) * PAD) - len(data))


def _head() -> tuple[bytes, bytes]:
    header = element(EBML, unsigned(0x4286, 1) + unsigned(0x42F7, 1) + unsigned(0x42F2, 4) + unsigned(0x42F3, 8) + element(0x4282, b"matroska") + unsigned(0x4287, 4) + unsigned(0x4285, 2))
    audio = element(AUDIO, element(0xB5, struct.pack(">d", RATE)) + unsigned(0x9F, 1) + unsigned(0x6264, 8))
    track = element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(0x73C5, 1) + unsigned(TRACK_TYPE, 2) + unsigned(0x9C, 1) + unsigned(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(CODEC, b"A_PCM/INT/LIT") + audio)
    return header, element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(0x4D80, b"lumisieve") + element(0x5741, b"lumisieve")) + element(TRACKS, track)


HEADER, INTRODUCTION = _head()


def _laced(frames: list[bytes], relative: int) -> bytes:
    """A SimpleBlock of track 1: fixed lacing if the frames' lengths are equal, else EBML lacing; none for one frame."""
    sizes = [len(f) for f in frames]
    kind = NO_LACING if len(frames) == 1 else FIXED if len(set(sizes)) == 1 else EBML_LACING
    body = number(1) + struct.pack(">hB", relative, 0x80 | kind)
    if kind:
        body += bytes([len(frames) - 1])
    if kind == EBML_LACING:
        body += number(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            length = 1
            while not -(1 << (7 * length - 1)) < b - a < (1 << (7 * length - 1)):
                length += 1
            body += number(b - a + (1 << (7 * length - 1)) - 1, length)
    return element(SIMPLE_BLOCK, body + b"".join(frames))


def muxed(payload: bytes) -> bytes:
    """The payload (a multiple of 64 bytes) as one audio track with a cue for each cluster."""
    per_block = FRAME * LACE
    clusters, cues, at = [], [], len(INTRODUCTION)
    for lo in range(0, len(payload), per_block * CLUSTER_BLOCKS):
        begin, blocks = lo * 1000 // RATE, []
        for b in range(lo, min(lo + per_block * CLUSTER_BLOCKS, len(payload)), per_block):
            part = payload[b : b + per_block]
            blocks.append(_laced([part[i : i + FRAME] for i in range(0, len(part), FRAME)], b * 1000 // RATE - begin))
        clusters.append(element(CLUSTER, unsigned(TIMESTAMP, begin) + b"".join(blocks)))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, begin) + element(CUE_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at))))
        at += len(clusters[-1])
    return HEADER + element(SEGMENT, INTRODUCTION + b"".join(clusters) + element(CUES, b"".join(cues)))


def _id(data, at: int) -> tuple[int, int]:
    length = 9 - data[at].bit_length()
    if length > 4 or at + length > len(data):
        raise ValueError("no element id")
    return int.from_bytes(data[at : at + length], "big"), at + length


def _number(data, at: int) -> tuple[int | None, int]:
    """A variable-length integer; None if all its bits are set (an unknown size)."""
    if at >= len(data):
        raise ValueError("it ends early")
    length = 9 - data[at].bit_length()
    if length > 8 or at + length > len(data):
        raise ValueError("no size")
    value = int.from_bytes(data[at : at + length], "big") & ((1 << 7 * length) - 1)
    return (None if value == (1 << 7 * length) - 1 else value), at + length


def _frames(data, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and the frames' byte ranges of a block."""
    track, at = _number(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags & 6
    if kind == NO_LACING:
        return track, relative, flags, [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == EBML_LACING:
        for i in range(n - 1):
            before = at
            value, at = _number(data, at)
            bits = 7 * (at - before)
            value = (1 << bits) - 1 if value is None else value
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << (bits - 1)) - 1))
    else:
        if (end - at) % n:
            raise ValueError("fixed lacing that does not divide its block")
        sizes = [(end - at) // n] * (n - 1)
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    if at > end or any(s < 0 for s in sizes):
        raise ValueError("lacing beyond its block")
    return track, relative, flags, [*out, (at, end - at)]


def parsed(data: bytes) -> dict:
    """``packets``: (cluster, track, timestamp in ms, offset, length, keyframe); ``cues``: (time, track, position);
    ``clusters``: positions within the segment; ``tracks``: of each number its type, codec and default duration in ns."""
    packets, cues, clusters, tracks = [], [], [], {}
    entry, laced = {}, []
    scale, segment, now, cue, seen = 1_000_000, 0, 0, {}, False
    stack, at = [(None, len(data))], 0
    while at < len(data):
        while at >= stack[-1][1]:
            stack.pop()
        begin = at
        kind, at = _id(data, at)
        size, at = _number(data, at)
        if stack[-1][0] == CLUSTER and kind in TOP_LEVEL:  # a cluster of unknown size ends here
            stack.pop()
        end = stack[-1][1] if size is None else at + size
        if end > stack[-1][1] or size is None and kind not in (SEGMENT, CLUSTER):
            raise ValueError("an element beyond its parent")
        seen |= kind == EBML
        if kind in PARENTS:
            if kind == SEGMENT:
                segment = at
            elif kind == CLUSTER:
                clusters.append(begin - segment)
            elif kind == CUE_POINT:
                cue = {}
            elif kind == TRACK_ENTRY:
                entry = {}
            elif kind == BLOCK_GROUP:
                laced = []
            stack.append((kind, end))
            continue
        if kind == TIMESTAMP_SCALE:
            scale = int.from_bytes(data[at:end], "big")
        elif kind == TIMESTAMP:
            now = int.from_bytes(data[at:end], "big")
        elif kind in (SIMPLE_BLOCK, BLOCK):
            track, relative, flags, frames = _frames(data, at, end)
            begins, step = (now + relative) * scale, tracks.get(track, {}).get("duration", 0)
            laced = range(len(packets), len(packets) + len(frames))
            for k, (o, n) in enumerate(frames):
                packets.append((len(clusters) - 1, track, (begins + k * step) // 1_000_000, o, n, bool(flags & 0x80)))
        elif kind == BLOCK_DURATION and laced:
            step = int.from_bytes(data[at:end], "big") * scale // len(laced)
            for k, i in enumerate(laced):
                packets[i] = (*packets[i][:2], (begins + k * step) // 1_000_000, *packets[i][3:])
        elif kind == TRACK_NUMBER:
            tracks[int.from_bytes(data[at:end], "big")] = entry
        elif kind == TRACK_TYPE:
            entry["type"] = int.from_bytes(data[at:end], "big")
        elif kind == CODEC:
            entry["codec"] = bytes(data[at:end]).rstrip(b"\0").decode("ascii", "replace")
        elif kind == DEFAULT_DURATION:
            entry["duration"] = int.from_bytes(data[at:end], "big")
        elif kind == CUE_TIME:
            cue["time"] = int.from_bytes(data[at:end], "big")
        elif kind == CUE_TRACK:
            cue["track"] = int.from_bytes(data[at:end], "big")
        elif kind == CUE_CLUSTER:
            cues.append((cue.get("time"), cue.get("track"), int.from_bytes(data[at:end], "big")))
        at = end
    if not seen:
        raise ValueError("no EBML header")
    return {"packets": packets, "cues": cues, "clusters": clusters, "tracks": tracks}


PACKETS = "id bigint, packet int, cluster int, track int, timestamp_ms bigint, offset bigint, length bigint, keyframe boolean, track_type int, codec string, error string"


def packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The packet table of a column of Matroska files; a file that can't be parsed is one row with ``error``."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not m.is_valid:
                    continue
                try:
                    found = parsed(m.as_py())
                    of = {k: (t.get("type"), t.get("codec")) for k, t in found["tracks"].items()}
                    rows += [(key, i, *p, *of.get(p[1], (None, None)), None) for i, p in enumerate(found["packets"])]
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((key, *[None] * 9, str(e)))
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in PACKETS.split(", ")])

    return media.select(F.col(id_col).cast("long"), F.col(media_col)).mapInArrow(run, PACKETS)


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text (null: empty) in UTF-8, padded and muxed, as a written table."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                texts = [t.as_py() or b"" for t in batch.column(1).slice(lo, 256)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 256), pa.array([len(t) for t in texts], pa.int64()), pa.array([muxed(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return scratch.written(texts.mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary"), "op5-media")


def feature(found: dict, samples: np.ndarray) -> str:
    """Counts from the packet table and whole-number statistics of the samples."""
    places = set(found["clusters"])
    cued = sum(p in places for _, _, p in found["cues"])
    deltas = np.abs(np.diff(samples.astype(np.int64)))
    return f"packets={len(found['packets'])};clusters={len(places)};cued={cued};ms={len(samples) * 1000 // RATE};sum={int(samples.sum(dtype=np.int64))};peak={int(samples.max())};turns={int(deltas.sum())};distinct={len(np.unique(samples))}"


READ = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def features(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back packet by packet."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for m in batch.column(2).slice(lo, 256):
                    data = m.as_py()
                    found = parsed(data)
                    payload = b"".join([data[o : o + n] for _, _, _, o, n, _ in found["packets"]])
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), feature(found, np.frombuffer(payload, np.uint8))))
                cols = list(zip(*rows))
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 256), batch.column(1).slice(lo, 256), *(pa.array(list(c), t) for c, t in zip(cols, types))], names=[c.split()[0] for c in READ.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, READ)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
