"""N-gram Jaccard join by parity sketches (operator 6).

A document is the set of hashes of its distinct 5-word shingles. Its sketch is a row of blocks: every shingle falls in
one block and is XORed into that block's content, so blocks (and the bits within) that differ between two documents
number at most the symmetric difference of their sets. At Jaccard >= 3/4 that difference is at most a third of either
set's size.

* Size bands double: a document is in the band of its size and, if a partner may be smaller than that band, in the one
  below. All documents of a band have the same number of blocks.
* Pigeonhole: of more than d non-empty blocks, d differences leave one alone, so two documents with at most d
  differences agree in one of the first d + 1 non-empty blocks of either. These (band, block, content) are the join keys. A
  document with too few non-empty blocks also gives its empty ones. In bands from ``EXACT`` shingles on, a sketch takes
  the shingles of one of ``2 ** r`` hash classes; the difference within it is bounded by its mean plus seven standard
  deviations and 8 (a miss is less likely than one in ten thousand million). So keys per document are bounded.
* Keys with one distinct set are dropped; documents with equal sets are one class throughout (by a 64-bit hash; where a
  second one shows that unequal sets share the first, both together are taken).
* Links within a key's group are not listed pair by pair. First every member is compared with one hub, the member
  whose keys are shared most. Only where that leaves several components in a group, members of different components
  are compared: directly in groups of fewer than ``CROWD`` members.
* Larger groups hold what many documents quote. Their members get keys anew: of the shingles that a sketch takes, counted
  over all these members, the rarest most + 1. Two linked documents leave at most ``most`` of either's shingles unshared,
  so the rarest that they share is a key of both, and what many quote is a key only of documents with little else.
  Shingles that one component alone has come first in this order and link nothing new, so they only take up places: they
  are left out where they are counted, and most documents have no new keys.
* To compare is to hold the Hamming distance of 1024-bit parity sketches against the bound, as the joins' own
  condition, and then to intersect the whole sets. The bound is the pair's own: sets of ``m`` and ``n`` shingles with a
  Jaccard index of 3/4 differ in ``(m + n) / 7`` at most, and of these a sketch of one hash class in ``2 ** r`` sees the
  share and seven standard deviations and 8 at most.
* Members of different components that share many keys meet once, at the least key that both have. Each row holds its
  class's ``FIRST`` least keys; where two such lists have one in common, the least of these is the least of all that the
  two classes share. Where they have none, the two meet at each key that they share.

``exact`` makes a sketch take all shingles in large bands too: no link can be missed, for keys in proportion to sizes.

Defined cases: documents without words, or with a null or empty text, have no set, link with nothing and keep their
own id as component. With fewer than five words the whole sequence is the one shingle. Nodes are sets, not ids: rows
that repeat an id with different sets are in the components of their own sets, and one row's links say nothing of
another's. Components that have the same smallest id have the same ``component_id``; ``grouped`` tells them apart. Null
ids name no component: a set that only rows without an id have links with nothing. An empty table gives no rows.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .components import components

WORDS, EXACT, TAKEN_MOST, SINGLE, SIGMAS, SKETCH_WORDS, CROWD, COMMON_FROM, FIRST, FEW, NAMED = 5, 512, 256, 64, 7.0, 16, 6, 4, 8, 300_000, 1_000_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64 bits of each value that depend on all of its bits (the splitmix64 finaliser)."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_LETTERS = mixed(np.arange(256, dtype=np.uint64), 5)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number, kept for the longest word so far."""
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.r_[np.uint64(1), np.full(2 * n - 1, _M1)], dtype=np.uint64)
    return _POWERS[0]


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word: its letters' values times powers, summed and mixed. ASCII letters are lower-cased, and ASCII
    white space parts words."""
    b = np.frombuffer(text.lower(), np.uint8)
    at = np.flatnonzero(~_SPACE[b])
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    sizes = np.diff(first, append=len(at))
    with np.errstate(over="ignore"):
        values = _LETTERS[b[at]] * powers(int(sizes.max()))[np.arange(len(at)) - np.repeat(first, sizes)]
        return mixed(np.add.reduceat(values, first) + sizes.astype(np.uint64) * _M2, 11)


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a text in UTF-8."""
    h = word_hashes(text) if text else np.zeros(0, np.uint64)
    n = min(len(h), WORDS)
    if n == 0:
        return h
    with np.errstate(over="ignore"):
        s = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            s = s * _M1 + h[j : len(h) - n + 1 + j]
        s = mixed(s)
        s.sort()
        return s[np.diff(s, prepend=~s[:1]) != 0]


def band_of(n: int) -> int:
    return n.bit_length() - 1


def halvings(band: int, exact: bool = False) -> int:
    """A band's sketches take one hash class in two to this power."""
    top = 1 << (band + 1)
    return 0 if exact or top <= EXACT else top.bit_length() - TAKEN_MOST.bit_length()


def in_band(s: np.ndarray, band: int, exact: bool = False) -> tuple[np.ndarray, int, int]:
    """The shingles that a band's sketch takes, the number of its blocks, and the most differences to bear with."""
    top, r = 1 << (band + 1), halvings(band, exact)
    most = min(len(s), top - 1) // 3
    if r:
        mean = most / (1 << r)
        most = int(np.ceil(mean + SIGMAS * np.sqrt(mean) + 8))
        # Of 435 blocks 111 are not empty on average for 128 shingles, of 97 needed; 193 for 256, of 158 needed.
        return s[(s & np.uint64((1 << r) - 1)) == 0], int(TAKEN_MOST * 1.7), most
    return s, 0 if top <= SINGLE else int(np.ceil(top * 0.4)) + 8, most


def _marked(keys: np.ndarray, band: int) -> np.ndarray:
    return (keys & ~np.uint64(31)) | np.uint64(band & 31)


def sketch(s: np.ndarray, band: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """A band's join keys (their last five bits name the band), its parity sketch in 64-bit words, the most differences.

    A shingle's block comes from the upper half of its hash, so blocks lie in the order of the sorted shingles.
    """
    taken, blocks, most = in_band(s, band, exact)
    with np.errstate(over="ignore"):
        place = ((taken >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32) if blocks else taken
        first = np.flatnonzero(np.diff(place, prepend=~place[:1]))
        held, folded = place[first], np.bitwise_xor.reduceat(taken, first) if len(first) else taken
        if len(held) > most:
            held, folded = held[: most + 1], folded[: most + 1]
        else:
            empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), held)
            held, folded = np.r_[held, empty], np.r_[folded, np.zeros(len(empty), np.uint64)]
        keys = _marked(mixed(held * _M1 + folded, 1000 + band), band)
    bits = np.bincount(((taken >> np.uint64(16)) & np.uint64(SKETCH_WORDS * 64 - 1)).astype(np.int64), minlength=SKETCH_WORDS * 64).astype(np.uint8) & 1
    return keys.view(np.int64), np.packbits(bits).view(np.int64), most


def class_of(s: np.ndarray, salt: int = 7) -> int:
    """64 bits that stand for a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), salt) - (1 << 63)


SIGNED = "doc_id bigint, text_hash bigint, n int, class bigint, check bigint, own boolean, band int, most int, keys array<bigint>, bits array<bigint>"


def _texts(batch, k: int, lo: int, n: int):
    return ((t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.column(k).slice(lo, n))


def _lists(rows) -> pa.Array:
    """Arrays of whole numbers as one column of lists."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int64), *(np.asarray(r, np.int64) for r in rows)]))


def _signer(exact):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = []
                for doc, mark, text in zip(batch.column(0).slice(lo, 500).to_pylist(), batch.column(2).slice(lo, 500).to_pylist(), _texts(batch, 1, lo, 500)):
                    s = shingles(text)
                    n = len(s)
                    if not n:
                        rows.append((doc, mark, 0, None, None, True, None, None, [], None))
                        continue
                    kind, check, band = class_of(s), class_of(s, 9), band_of(n)
                    for b in (band, band - 1) if 3 * n < 4 << band and band else (band,):
                        keys, bits, most = sketch(s, b, exact)
                        rows.append((doc, mark, n, kind, check, b == band, b, most, keys, bits))
                cols = list(zip(*rows))
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(cols, types)), _lists(cols[8]), pa.array(list(cols[9]), pa.list_(pa.int64()))], names=[f.split()[0] for f in SIGNED.split(", ")])

    return run


def _own(batch, lo: int, n: int):
    """``place, class, shingles`` of rows (class, check, text); rows whose text is of another class (of a repeated id)
    are left out."""
    names = zip(batch.column(0).slice(lo, n).to_pylist(), batch.column(1).slice(lo, n).to_pylist())
    for k, ((kind, check), text) in enumerate(zip(names, _texts(batch, 2, lo, n))):
        s = shingles(text)
        if class_of(s, 9) == check:
            yield lo + k, kind, s


def _sets(batches):
    """class -> its packed shingles."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            rows = [(kind, s.tobytes()) for _, kind, s in _own(batch, lo, 200)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["class", "shingles"])


TAKEN = "class bigint, slack int, taken array<bigint>, part bigint"


def _taker(exact):
    """(class, check, text, bands, part) -> for each band the shingles that its sketch takes, and slack: how many of them are
    keys, one more than a link may leave unshared, less how many they are."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                rows = []
                for k, kind, s in _own(batch, lo, 200):
                    for band in batch.column(3)[k].as_py():
                        taken, _, most = in_band(s, band, exact)
                        keys = np.unique(_marked(mixed(taken, 3), band).view(np.int64))
                        rows.append((kind, min(most, len(s) // 4) + 1 - len(keys), keys, batch.column(4)[k].as_py()))
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.int64()), pa.array(list(cols[1]), pa.int32()), _lists(cols[2]), pa.array(list(cols[3]), pa.int64())], names=["class", "slack", "taken", "part"])

    return run


def _verified(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if 4 * min(len(p), len(q)) < 3 * max(len(p), len(q)):
                keep.append(False)
                continue
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            both = int((q[at] == p).sum())
            keep.append(100 * both >= 75 * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_verified, "a bigint, b bigint")


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


_WORDS = [f"w{k}" for k in range(SKETCH_WORDS)]


def _close(l: str, r: str, exact: bool):
    """Whether two rows with sizes and sketches may be linked: a condition of a join, so other pairs are never rows."""
    c = lambda side, name: F.col(f"{side}.{name}")
    apart = reduce(lambda x, y: x + y, [F.bit_count(c(l, w).bitwiseXOR(c(r, w))) for w in _WORDS])
    differ = (c(l, "n") + c(r, "n")) / 7
    sampled = [b for b in range(32) if halvings(b, exact)]
    if sampled:
        share = differ / F.pow(F.lit(2.0), c(l, "band") - (sampled[0] - halvings(sampled[0])))
        differ = F.when(c(l, "band") < sampled[0], differ).otherwise(share + SIGMAS * F.sqrt(share) + 8)
    return (4 * F.least(c(l, "n"), c(r, "n")) >= 3 * F.greatest(c(l, "n"), c(r, "n"))) & (apart <= F.least(c(l, "most"), c(r, "most"), differ))


def met_once(rows: DataFrame, exact: bool) -> DataFrame:
    """``a, b``: classes of ``rows`` (key, class, component, first, sizes and sketches) of different components that share
    a key and may be linked, at the least key that they share; at each one where ``first`` doesn't tell the least."""
    l, r = rows.alias("l"), rows.alias("r")
    shared = F.array_min(F.array_intersect("l.first", "r.first"))
    once = F.coalesce(shared, F.col("l.key")) == F.col("l.key")
    # A key names its band. With it on both sides they name the same columns, and are one exchange.
    near = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.band") == F.col("r.band")) & (F.col("l.component") != F.col("r.component")) & (F.col("l.class") < F.col("r.class")) & _close("l", "r", exact) & once)
    return near.select(*_ordered("l.class", "r.class"))


def text_hash(text="text"):
    """Tells a repeated id's texts apart."""
    return F.xxhash64(F.col(text).cast("string").cast("binary"))


def near_copies(docs: DataFrame, exact: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of ``docs`` (doc_id, text), a row for each of its rows."""
    return grouped(docs, exact).select("doc_id", "n_shingles", "component_id")


def signed_classes(texts: DataFrame, exact: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches of ``texts`` (doc_id, text), who has which set (doc_id, text_hash, n, class), and the classes with
    their first document and their second hash."""
    return told_apart(scratch.written(texts.withColumn("text_hash", text_hash()).mapInArrow(_signer(exact), SIGNED), "op6-sketches"))


def told_apart(signed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``signed_classes`` of rows ``SIGNED``: where unequal sets share a class, the second hash makes two of it."""
    own = signed.where("own").select("doc_id", "text_hash", "n", "class", "check")
    once = lambda rows: rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("first"), F.min("check").alias("check"), F.max("check").alias("other"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.written(once(own), "op6-classes")
    clash = classes.where("check <> other").select("class")
    if clash.count():  # a few in 10 ** 10 sets, if any
        apart = lambda rows: rows.join(clash.withColumn("clash", F.lit(True)), "class", "left").withColumn("class", F.when(F.col("clash"), F.xxhash64("class", "check")).otherwise(F.col("class"))).drop("clash")
        signed = scratch.written(apart(signed).select(*signed.columns), "op6-sketches")
        own = signed.where("own").select("doc_id", "text_hash", "n", "class", "check")
        classes = scratch.written(once(own), "op6-classes")
    return signed, scratch.written(own.drop("check"), "op6-members"), classes.select("class", "first", "check", "copies")


def keys_of(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """``class, key`` of each set. Only the lists of sets that several rows have are dealt out to take one of each; if even
    to name these sets is too much to send, all lists are."""
    lists = signed.where("n > 0").select("class", "band", "keys")
    once = lambda rows: rows.groupBy("class", "band").agg(F.first("keys").alias("keys"))
    several = classes.where("copies > 1").select("class")
    if several.count() > NAMED:
        lists = once(lists)
    else:
        several = F.broadcast(several)
        lists = lists.join(several, "class", "left_anti").unionByName(once(lists.join(several, "class", "left_semi")))
    return lists.select("class", F.explode("keys").alias("key"))


@contextmanager
def _released(spark: SparkSession):
    """Meanwhile what a job has shuffled goes when its table is written, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def grouped(docs: DataFrame, exact: bool = False) -> DataFrame:
    """``near_copies`` with each row's ``text_hash``, and ``component``, the least class of its set's component (null:
    no words)."""
    with _released(docs.sparkSession):
        return _grouped(docs, exact)


def _grouped(docs: DataFrame, exact: bool) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    signed, members, classes = signed_classes(texts, exact)
    band = F.col("key").bitwiseAND(31).cast("int").alias("band")

    # Keys that at least two different sets have, and who has them. The rows are dealt by key once, for the count and
    # for the join: both sides name the same columns, so Spark plans one exchange and uses it twice.
    keyed = keys_of(signed, classes).repartition("key")
    shared = keyed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("key")
    held = scratch.written(keyed.join(shared.hint("shuffle_hash"), "key").distinct(), "op6-held")
    sketches = signed.where("n > 0").join(held.select("class").distinct(), "class", "left_semi").dropDuplicates(["class", "band"])
    sketches = scratch.written(sketches.select("class", "band", "n", "most", *[F.element_at("bits", k + 1).alias(w) for k, w in enumerate(_WORDS)]), "op6-held-sketches")

    # Every member against its group's hub.
    counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    score = held.join(counts, "key").groupBy("class").agg(F.sum("c").alias("score"))
    hubs = held.join(score, "class").groupBy("key").agg(F.max(F.struct("score", "class")).alias("top")).select("key", F.col("top.class").alias("hub"))
    pairs = held.join(hubs, "key").where("class <> hub").select(*_ordered("class", "hub"), band).distinct()
    one, two = sketches.alias("l"), sketches.alias("r")
    pairs = pairs.join(one, (F.col("a") == F.col("l.class")) & (pairs["band"] == F.col("l.band"))).join(two, (F.col("b") == F.col("r.class")) & (F.col("l.band") == F.col("r.band")) & _close("l", "r", exact))
    pairs = scratch.written(pairs.select("a", "b").distinct(), "op6-hub-pairs")
    sets = _sets_of(pairs, classes, texts)
    links = scratch.written(verified(pairs, sets), "op6-hub-links")
    scratch.dropped(signed, sets)
    parts = scratch.written(components(links), "op6-parts")

    # Groups that still hold several components: members of different ones. Dealt by key once for all that follows.
    part_of = parts.select(F.col("node").alias("class"), "component")
    placed = held.join(part_of, "class", "left").select("class", "key", F.coalesce("component", "class").alias("component")).repartition("key")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("class").alias("c")).where("lo <> hi").select("key", "c")
    placed = scratch.written(placed.join(open_keys.hint("shuffle_hash"), "key"), "op6-placed")
    small = placed.where(F.col("c") < CROWD).withColumn("band", band)
    crowd = placed.where(F.col("c") >= CROWD).groupBy("class").agg(F.collect_set(band).alias("bands"), F.max(F.expr("nullif(component, class)")).alias("part"))
    crowd = scratch.written(crowd, "op6-crowd")
    of = F.coalesce("part", "class")
    anew = scratch.written(rarest_keys(crowd, classes, texts, exact, across=True).select("key", "class", of.alias("component"), "band"), "op6-new-keys")
    again = anew.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    anew = scratch.written(anew.join(again, "key"), "op6-anew")
    rows = small.select("key", "class", "component", "band").union(anew).groupBy("class", "band")
    rows = rows.agg(F.min("component").alias("component"), F.array_sort(F.collect_set("key")).alias("keys")).join(sketches, ["class", "band"])
    rows = rows.withColumn("first", F.slice("keys", 1, FIRST)).withColumn("key", F.explode("keys")).drop("keys")
    rows = scratch.written(rows, "op6-open")
    rest = met_once(rows, exact).distinct().join(pairs, ["a", "b"], "left_anti")
    rest = scratch.written(rest, "op6-pairs")
    scratch.dropped(held, sketches, placed, crowd, rows)
    sets = _sets_of(rest, classes, texts)
    more = scratch.written(verified(rest, sets), "op6-links")
    scratch.dropped(sets)
    ends = components(links.union(more)).select(F.col("node").alias("class"), "component")

    # The smallest document of each component, back to the documents.
    whole = classes.join(ends, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = scratch.written(whole.join(least, "component").select("class", "component", "component_id"), "op6-components")
    out = members.join(of_class, "class", "left")
    return out.select("doc_id", "text_hash", "component", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def rarest_keys(crowd: DataFrame, classes: DataFrame, texts: DataFrame, exact: bool, across: bool = False) -> DataFrame:
    """``class, part, band, key``: the rarest shingles of the classes in ``crowd`` (class, bands and, if they are in another
    class's component, part), one more than a link may leave unshared. Shingles count over all of ``crowd``, and once more
    for a repeated row; those that count less than COMMON_FROM are equally rare. ``across``: shingles that one component
    alone has come before all others and, as they link nothing new, are left out."""
    crowd = crowd if "part" in crowd.columns else crowd.withColumn("part", F.lit(None).cast("bigint"))
    taken = _text_of(crowd, classes, texts, "bands", "part").mapInArrow(_taker(exact), TAKEN)
    alike, of = Window.partitionBy("key"), F.coalesce("part", "class")
    keyed = taken.select("class", "part", "slack", F.explode("taken").alias("key"))
    keyed = keyed.withColumns({"c": F.count(F.lit(1)).over(alike), "lo": F.min(of).over(alike), "hi": F.max(of).over(alike)})
    keyed = keyed.where("lo <> hi") if across else keyed
    ranked = F.struct(F.when(F.col("c") >= COMMON_FROM, F.col("c")).otherwise(0).alias("c"), "key")
    # What is left out takes up places, so as many fewer are left: slack and the number of those that are not.
    rows = keyed.select("class", "part", "slack", F.col("key").bitwiseAND(31).cast("int").alias("band"), ranked.alias("ranked"))
    rows = rows.groupBy("class", "part", "band", "slack").agg(F.array_sort(F.collect_set("ranked")).alias("keys"))
    rows = rows.withColumn("places", F.col("slack") + F.size("keys")).where("places > 0")
    return rows.select("class", "part", "band", F.explode(F.slice("keys", F.lit(1), F.col("places"))["key"]).alias("key"))


def _sent(rows: DataFrame) -> DataFrame:
    """Rows of a few numbers: sent to every task where they are counted to be at most FEW, else joined."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _text_of(named: DataFrame, classes: DataFrame, texts: DataFrame, *more: str) -> DataFrame:
    """``class, check, text`` and ``more`` columns of ``named``, from each class's first document. Rows of a repeated id
    have other texts, which the second hash tells apart."""
    of = scratch.written(named.join(classes, "class").select("class", "check", F.col("first").alias("doc_id"), *more), "op6-named")
    return texts.join(_sent(of), "doc_id").select("class", "check", "text", *more)


def _sets_of(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The sets of the classes in ``pairs``."""
    named = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    return scratch.written(_text_of(named, classes, texts).mapInArrow(_sets, "class bigint, shingles binary"), "op6-sets")


#: By brute force, over documents with an id.
ORACLE = """
with recursive words as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
places as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) as k from words),
sets as materialized (select distinct doc_id, array_to_string(w[k:k + 4], ' ') as s from places),
sizes as materialized (select doc_id, count(*) as n from sets group by doc_id),
links as materialized (
  select x.doc_id as a, y.doc_id as b from sets x join sets y on x.s = y.s and x.doc_id <> y.doc_id
  join sizes p on p.doc_id = x.doc_id join sizes q on q.doc_id = y.doc_id
  where 4 * least(p.n, q.n) >= 3 * greatest(p.n, q.n)
  group by x.doc_id, y.doc_id, p.n, q.n having 100 * count(*) >= 75 * (p.n + q.n - count(*))),
reached(a, b) as (select distinct a, a from links union select r.a, l.b from reached r join links l on l.a = r.b),
least_of as (select a, min(b) as c from reached group by a)
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(l.c, d.doc_id) as component_id
from documents d left join sizes s on s.doc_id = d.doc_id left join least_of l on l.a = d.doc_id
"""


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
