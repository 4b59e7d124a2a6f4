"""Queries that run the library's operators on whole tables, and the same in SQL.

The tables hold no images. An embedding's 64 numbers make a plane of 8 x 8 pixels; a text's bytes, three by three,
make pixels; whole columns of ``lineitem`` make red, green and blue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashes as H
from ..functions import image_hash
from ..functions import pixels as P
from .. import scratch
from ..operators import asof, sketches
from ..operators import similarity as S
from ..sources import images
from ..streaming import streams

WITHIN, GOLDEN_PER_LABEL, TOP_LINES = 6, 1, 3
#: Events of a batch of the stream whose state would be all of them.
SLICE_ROWS = 250_000
RETAINED = "spark.sql.streaming.minBatchesToRetain"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plane() -> Column:
    """64 numbers from -1 to 1 as bytes."""
    return F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 1.0) * 127.5))).cast("int"))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", plane().alias("px"))


def average_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes(spark, sf_dir).select("vec_id", "label", H.to_hex(H.average_bits(F.col("px")), 64).alias("hex"))


def q_average(spark, sf_dir):
    return average_hashes(spark, sf_dir).select("vec_id", "hex")


def q_difference(spark, sf_dir):
    px = F.col("px")
    return planes(spark, sf_dir).select("vec_id", H.to_hex(H.difference_bits(px, 8, 8), 56).alias("across"), H.to_hex(H.difference_bits(px, 8, 8, vertical=True), 56).alias("down"))


def q_median(spark, sf_dir):
    px = F.transform("px", lambda v: v.cast("double"))
    return planes(spark, sf_dir).select("vec_id", H.median_of(px).alias("median"), H.to_hex(H.above(px, H.median_of(px), H.SNAP), 64).alias("hex"))


def q_pixels(spark, sf_dir):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 256).cast("int").alias("r"), (F.col("l_partkey") % 256).cast("int").alias("g"), (F.col("l_suppkey") * 7 % 256).cast("int").alias("b"))
    h = P.hue(r, g, b)
    rows = rows.select(P.luma(r, g, b).alias("l"), h.alias("h"), P.saturation(r, g, b).alias("s"), P.value(r, g, b).alias("v"), P.colour_class(r, g, b).alias("colour_class"), P.hue_bin(h).alias("hue_bin"))
    sums = [F.sum(c).cast("long").alias(f"sum_{c}") for c in ("l", "h", "s", "v")]
    return rows.groupBy("colour_class", "hue_bin").agg(F.count(F.lit(1)).alias("n"), *sums)


def q_composite(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 256).cast("int").alias("c"), (F.col("l_partkey") % 256).cast("int").alias("a"))
    return rows.select(P.over_black(F.col("c"), F.col("a")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))


def q_colour_hash(spark, sf_dir, bits: int = 3):
    """A histogram of each document's bytes as pixels. Texts are dealt by document to as many tasks as a shuffle has; a
    document's pixels are read, judged and counted where its text is."""
    every_doc = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("x"))
    docs = every_doc.where(F.octet_length("x") >= 3).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    # Bytes have places, so a pixel of a long text is read as fast as that of a short one.
    places = docs.select("doc_id", "x", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("x") / 3).cast("int") - 1)).alias("k"))
    p = F.conv(F.hex(F.substring("x", F.col("k") * 3 + 1, F.lit(3))), 16, 10).cast("int")
    pixels = places.select("doc_id", F.coalesce(p, F.lit(0)).alias("p"))
    pixels = pixels.select("doc_id", *[F.shiftright("p", k).bitwiseAND(255).alias(c) for k, c in ((16, "r"), (8, "g"), (0, "b"))])
    rows = P.with_colour_bin(pixels, "bin", "r", "g", "b").groupBy("doc_id", "bin").agg(F.count(F.lit(1)).alias("m"))
    names = [n for n in P.BINS if n not in ("black", "gray", "none")]
    h = rows.groupBy("doc_id").agg(F.sum("m").alias("total"), *[F.coalesce(F.sum(F.when(F.col("bin") == k, F.col("m"))), F.lit(0)).alias(n) for k, n in enumerate(P.BINS[:-1])])
    values = H.colour_values(F.col("black"), F.col("gray"), [F.col(n) for n in names[:6]], [F.col(n) for n in names[6:]], F.col("total"), bits)
    h = h.select("doc_id", F.array(*values).alias("v"))
    every = F.flatten(F.transform("v", lambda v: P.bin_bits(v, bits)))
    found = h.select("doc_id", F.array_join(F.transform("v", lambda v: v.cast("string")), ",").alias("bins"), H.to_hex(every, 14 * bits).alias("hex"))
    # A text of less than one pixel has a row without a hash.
    return found.union(every_doc.where(F.octet_length("x") < 3).select("doc_id", F.lit(None).cast("string"), F.lit(None).cast("string")))


def with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, hex`` of every vector, and once more, by an id 1,000,000 higher, with one bit flipped in each of 0 to 7
    digits: near copies, for the searches."""
    rows = average_hashes(spark, sf_dir).select(F.col("vec_id").alias("id"), "hex")
    at, n = (F.col("id") % 9).cast("int"), (F.col("id") % 8).cast("int")
    flipped = F.translate(F.substring("hex", at + 1, n), "0123456789abcdef", "1032547698badcfe")
    copy = F.concat(F.substring("hex", F.lit(1), at), flipped, F.substring("hex", at + n + 1, F.lit(16)))
    return rows.union(rows.select(F.col("id") + 1_000_000, copy))


def q_near_values(spark, sf_dir):
    rows = with_copies(spark, sf_dir)
    return S.near_values(rows, rows, 16, WITHIN, ordered=True)


def q_near_wide(spark, sf_dir):
    """The same at twice the radius."""
    rows = with_copies(spark, sf_dir)
    return S.near_values(rows, rows, 16, 2 * WITHIN, ordered=True)


def q_near_groups(spark, sf_dir):
    return S.near_groups(with_copies(spark, sf_dir), 16, WITHIN)


def _golden(rows: DataFrame) -> DataFrame:
    """The first vector of each label."""
    return rows.groupBy("label").agg(F.min_by("hex", "vec_id").alias("hex"), F.min("vec_id").alias("ordinal"))


def q_best_match(spark, sf_dir):
    rows = average_hashes(spark, sf_dir)
    return S.best_match(rows.select(F.col("vec_id").alias("id"), "hex"), _golden(rows), 16)


def q_tolerance(spark, sf_dir):
    rows = average_hashes(spark, sf_dir)
    golden = _golden(rows).select("label", F.col("hex").alias("golden"))
    d = H.hamming(F.col("hex"), F.col("golden"))
    return rows.join(golden, "label").select("vec_id", d.alias("distance"), (d <= 20).alias("near"))


def q_known(spark, sf_dir):
    rows = average_hashes(spark, sf_dir)
    golden = _golden(rows)
    counts = lambda t, name: t.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", F.lit(name).alias("kind"), "n")
    return counts(S.known(rows, golden), "known").union(counts(S.known(rows, golden, missing=True), "new"))


def _quarters(rows: DataFrame) -> DataFrame:
    """A plane's four quarters, each hashed by its own mean: hashes of 16 bits."""
    parts = [F.array(*[F.get("px", F.lit((y + dy) * 8 + x + dx)) for dy in range(4) for dx in range(4)]) for y in (0, 4) for x in (0, 4)]
    return rows.select("vec_id", "label", F.array(*[H.to_hex(H.average_bits(p), 16) for p in parts]).alias("own"))


def q_multi_hash(spark, sf_dir):
    rows = _quarters(planes(spark, sf_dir))
    golden = rows.groupBy("label").agg(F.min_by("own", "vec_id").alias("other"))
    both = rows.join(golden, "label")
    d = H.multi_difference(F.col("own"), F.col("other"))
    return both.select("vec_id", d["matches"].alias("matches"), d["distance"].alias("distance"), H.multi_distance(F.col("own"), F.col("other")).alias("score"), H.multi_matches(F.col("own"), F.col("other"), 2).alias("two_regions"), F.array_join("own", ",").alias("hex"))


def q_multi_best(spark, sf_dir):
    """For each vector's four hashes the nearest of the labels' first ones, by the multi-hash distance."""
    rows = _quarters(planes(spark, sf_dir))
    golden = rows.groupBy("label").agg(F.min_by("own", "vec_id").alias("own"), F.min("vec_id").alias("ordinal"))
    return S.best_multi_match(rows.select(F.col("vec_id").alias("id"), "own"), golden.select("ordinal", "own"))


def q_hash_checks(spark, sf_dir):
    """Size, validity and old texts of hashes."""
    rows = average_hashes(spark, sf_dir)
    bits = H.from_hex(F.col("hex"))
    broken = F.when(F.col("vec_id") % 3 == 0, F.transform(bits, lambda b: b * 2)).when(F.col("vec_id") % 3 == 1, F.slice(bits, 1, 0)).otherwise(bits)
    return rows.select("vec_id", H.bit_size(F.col("hex")).alias("bits"), H.valid_bits(bits).alias("valid"), H.valid_bits(broken).alias("broken_valid"), H.to_hex(H.old_hex(F.col("hex")), 64).alias("old"))


def q_hex_parts(spark, sf_dir):
    """Texts of many lengths, lower and upper case, as hashes: what each parser makes of them."""
    text = F.substring(F.md5(F.concat(F.lit("h"), F.col("o_orderkey").cast("string"))), F.lit(1), (F.col("o_orderkey") % 33).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, F.upper(text)).otherwise(text).alias("t"))
    ones = lambda a: F.coalesce(F.aggregate(a, F.lit(0), lambda s, v: s + v), F.lit(-1))
    multi = F.concat_ws(",", "t", F.lit("00ff"))
    return rows.select("o_orderkey", F.coalesce(H.side_of(F.col("t")), F.lit(-1)).alias("side"), ones(H.from_hex(F.col("t"))).alias("ones"), ones(H.from_flat_hex(F.col("t"), 3)).alias("flat_ones"), F.coalesce(F.size(H.from_multi_hex(multi)), F.lit(-1)).alias("parts"))


def q_bin_bits(spark, sf_dir):
    v = (F.col("l_orderkey") % 16).cast("int")
    return table(spark, sf_dir, "lineitem").select(v.alias("v"), H.to_hex(P.bin_bits(v, 4), 4).alias("digit")).groupBy("v", "digit").agg(F.count(F.lit(1)).alias("n"))


def q_frame_changes(spark, sf_dir):
    """Each label's vectors as frames of a film: distance to the frame before."""
    rows = S.before(average_hashes(spark, sf_dir), "label", "vec_id", "hex")
    return rows.select("vec_id", F.coalesce(H.hamming(F.col("hex"), F.col("before")), F.lit(-1)).alias("change"))


def q_report(spark, sf_dir):
    """Counts of hashes by label and by the first digit's upper half, with subtotals."""
    rows = average_hashes(spark, sf_dir).withColumn("bright_corner", F.substring("hex", 1, 1) >= "8")
    out = rows.cube("label", "bright_corner").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("hex").alias("n_hashes"))
    return out.select(F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce(F.col("bright_corner").cast("string"), F.lit("all")).alias("bright_corner"), "n", "n_hashes")


def q_common_digits(spark, sf_dir):
    """Hash prefixes that even and odd vectors share (intersection), and those of even ones only (difference)."""
    rows = average_hashes(spark, sf_dir).select((F.col("vec_id") % 2).alias("odd"), F.substring("hex", 1, 2).alias("prefix"))
    even, odd = (rows.where(F.col("odd") == k).select("prefix") for k in (0, 1))
    return even.intersect(odd).select("prefix", F.lit("both").alias("kind")).union(even.distinct().exceptAll(odd.distinct()).select("prefix", F.lit("even").alias("kind")))


def q_largest_lines(spark, sf_dir):
    """The longest lines of each document, of equally long ones the first."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("ordinal", "line"))
    rows = lines.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.length("line").cast("long").alias("size"))
    return S.largest(rows, ["doc_id"], "size", "ordinal", TOP_LINES).select("doc_id", "ordinal", "size", F.col("rank").cast("long").alias("rank"))


def _headed(spark, sf_dir) -> DataFrame:
    """First bytes of files in every format, with the sizes that parts have."""
    n = F.col("p_partkey")
    big = lambda v, k: F.lpad(F.hex(v), 2 * k, "0")
    little = lambda v, k: F.concat(*[F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(255)), 2, "0") for i in range(k)])
    w, h = F.col("p_size").cast("long") + 1, (n % 3000 + 1).cast("long")
    heads = [
        F.concat(F.lit("424D" + "00" * 16), little(w, 4), little(h, 4)),
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4)),
        F.concat(F.lit("474946383961"), little(w, 2), little(h, 2)),
        # An application segment of a length of its own, a table, and a frame.
        F.concat(F.lit("FFD8FFE0"), big(n % 50 + 2, 2), F.repeat(F.lit("FF"), (n % 50).cast("int")), F.lit("FFFFDB0004C0C0"), F.when(n % 3 == 0, "FFC2").otherwise("FFC0"), F.lit("001108"), big(h, 2), big(w, 2), F.lit("03")),
        F.concat(F.lit("5249464600000000574542505650385800000000" + "00" * 4), little(w - 1, 3), little(h - 1, 3)),
        # A directory of three entries, the width of two bytes and the height of four.
        F.concat(F.lit("49492A0008000000" + "0300"), F.lit("FE00" + "0400" + "01000000" + "00000000"), F.lit("0001" + "0300" + "01000000"), little(w, 2), F.lit("0000" + "0101" + "0400" + "01000000"), little(h, 4)),
        F.concat(F.lit("00000018667479706865696300000000" + "0000001469737065" + "00000000"), big(w, 4), big(h, 4)),
        F.lit("25504446"),
    ]
    kind = (n % len(heads)).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", F.unhex(F.get(F.array(*heads), kind)).alias("content"))


def q_formats(spark, sf_dir):
    size = F.col("size")
    rows = images.checked(_headed(spark, sf_dir), max_pixels=100_000).withColumn("size", images.size_of(F.col("content")))
    return rows.select("p_partkey", "format", F.coalesce(size["width"], F.lit(-1)).alias("width"), F.coalesce(size["height"], F.lit(-1)).alias("height"), F.coalesce(F.col("error.kind"), F.lit("none")).alias("error_kind"))


def _bitmaps(spark, sf_dir) -> DataFrame:
    """Every embedding as a gray bitmap file of 8 x 8."""
    head = "424D" + "F6000000" + "00000000" + "36000000" + "28000000" + "08000000" + "F8FFFFFF" + "0100" + "1800" + "00000000" * 6
    body = F.array_join(F.transform("px", lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), 3)), "")
    return planes(spark, sf_dir).select("vec_id", F.unhex(F.concat(F.lit(head), body)).alias("content"))


def _encoded(spark, sf_dir) -> DataFrame:
    """Every embedding as a file of 8 x 8, in turn in one of ten encodings, of which four are faulty."""
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    every = lambda of: F.array_join(F.transform("px", of), "")
    bitmap = lambda start, depth, method, rows="F8FFFFFF": F.lit("424D" + "00000000" * 2 + start + "28000000" + "08000000" + rows + "0100" + depth + method + "00000000" * 5)
    grays = F.lit("".join(f"{i:02X}" * 3 + "00" for i in range(256)))
    # Rows of runs of one place each, from the last row up.
    line = lambda y: F.concat(F.array_join(F.transform(F.slice("px", (7 - y) * 8 + 1, 8), lambda v: F.concat(F.lit("01"), byte(v))), ""), F.lit("0000"))
    runs = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), line), "")
    entry = lambda tag, kind, value: tag + kind + "01000000" + value
    directory = "0800" + entry("0001", "0300", "08000000") + entry("0101", "0300", "08000000") + entry("0201", "0300", "08000000") + entry("0301", "0300", "01000000") + entry("0601", "0300", "01000000") + entry("1101", "0400", "6E000000") + entry("1501", "0300", "01000000") + entry("1701", "0400", "40000000")
    plain = F.concat(bitmap("36000000", "1800", "00000000"), every(lambda v: F.repeat(byte(v), 3)))
    files = [
        ("bmp24", plain),
        ("bmp32", F.concat(bitmap("36000000", "2000", "00000000"), every(lambda v: F.concat(F.repeat(byte(v), 3), F.lit("00"))))),
        ("palette", F.concat(bitmap("36040000", "0800", "00000000"), grays, every(byte))),
        ("bitfields", F.concat(bitmap("42000000", "2000", "03000000"), F.lit("FF00000000FF00000000FF00"), every(lambda v: F.concat(F.repeat(byte(v), 3), F.lit("00"))))),
        ("runs", F.concat(bitmap("36040000", "0800", "01000000", "08000000"), grays, runs, F.lit("0001"))),
        ("tiff", F.concat(F.lit("49492A0008000000" + directory + "00000000"), every(byte))),
        ("cut", F.substring(plain, 1, 300)),
        ("depth", F.concat(bitmap("36000000", "0700", "00000000"), every(byte))),
        ("os2", F.concat(F.lit("424D" + "00000000" * 2 + "1A000000" + "0C000000" + "0800080001001800"), every(lambda v: F.repeat(byte(v), 3)))),
        ("planes", F.concat(F.lit("424D" + "00000000" * 2 + "36000000" + "28000000" + "08000000" + "08000000" + "0200" + "1800" + "00000000" * 6), every(lambda v: F.repeat(byte(v), 3)))),
    ]
    at = (F.col("vec_id") % len(files)).cast("int")
    return planes(spark, sf_dir).select("vec_id", F.get(F.array(*[F.lit(n) for n, _ in files]), at).alias("encoding"), F.unhex(F.get(F.array(*[c for _, c in files]), at)).alias("content"))


def q_decoded_formats(spark, sf_dir):
    """Files of many encodings through check and decoders: the average hash, or why there is none."""
    found = images.decoded(images.checked(_encoded(spark, sf_dir)))
    fault = F.coalesce("error.kind", images.raster_fault(F.col("raster")), F.lit("none"))
    return found.select("vec_id", "encoding", "format", fault.alias("fault"), image_hash.hash_of(F.col("raster"), "average", 8).alias("hex"))


def q_image_hashes(spark, sf_dir):
    """Bitmaps through format check, decoder and every hash."""
    raster = images.decoded(images.checked(_bitmaps(spark, sf_dir)))
    sizes = {"colour": 3}
    return raster.select("vec_id", *[image_hash.hash_of(F.col("raster"), a, sizes.get(a, 8)).alias(a) for a in image_hash.ALGORITHMS])


def q_decoded_average(spark, sf_dir):
    """The average hash once more, by way of encoded files."""
    raster = images.decoded(images.checked(_bitmaps(spark, sf_dir)))
    return raster.select("vec_id", image_hash.hash_of(F.col("raster"), "average", 8).alias("hex"))


def q_crop_resistant(spark, sf_dir):
    """Segments of the same bitmaps, a row for each."""
    raster = images.decoded(images.checked(_bitmaps(spark, sf_dir)))
    return raster.select("vec_id", F.posexplode(image_hash.crop_resistant(F.col("raster"))).alias("segment", "hex"))


def _streamed(spark, sf_dir, plan, mode: str, slice_rows: int | None = None) -> DataFrame:
    """What a stream over the events gives, by one run over what is there; by ``slice_rows`` at a time in the order of time,
    if that is given."""
    events = table(spark, sf_dir, "events")
    if slice_rows:
        rows = streams.in_order(events.select("ts", "user_id", "event_type", "event_id"), "ts", slice_rows)
    else:
        rows = spark.readStream.schema(events.schema).option("pathGlobFilter", "*").parquet(f"{sf_dir}/events.parquet*")
    hexed = rows.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.substring(F.md5("event_type"), 1, 16).alias("hex"), F.col("event_id").alias("id"), "event_type")
    from ..scratch import new_path

    out, marks = new_path(spark, "stream"), new_path(spark, "stream-marks")
    # Each batch replaces the result in complete mode; a batch that is run again in append mode replaces its own part.
    to = (lambda batch, k: batch.write.mode("overwrite").parquet(out)) if mode == "complete" else (lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch={k}"))
    writer = plan(hexed).writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", marks).foreachBatch(to)
    # A run of many batches needs the states of the last few ones only; a query takes settings as they are at its start.
    kept = spark.conf.get(RETAINED)
    spark.conf.set(RETAINED, "4")
    try:
        query = writer.start()
    finally:
        spark.conf.set(RETAINED, kept)
    query.awaitTermination()
    return spark.read.parquet(out)


def q_stream_windows(spark, sf_dir):
    """Events as a stream: counts in ten-minute windows."""
    out = _streamed(spark, sf_dir, lambda rows: streams.counted(rows, "ts", "1 hour", "10 minutes"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "n_hashes")


def q_stream_sliding(spark, sf_dir):
    """The same in windows of an hour that begin every quarter."""
    out = _streamed(spark, sf_dir, lambda rows: streams.counted(rows, "ts", "1 hour", "1 hour", "15 minutes"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


def q_stream_first_seen(spark, sf_dir):
    """Kinds of events of users that were seen at all: each once, as long as the stream is no older than its watermark."""
    plan = lambda rows: streams.first_seen(rows.withColumn("hex", F.concat("hex", F.col("user_id").cast("string"))), "ts", "3650 days")
    return _streamed(spark, sf_dir, plan, "append").select("hex")


def q_stream_sessions(spark, sf_dir):
    """Users' sessions: events with less than 90 minutes between."""
    out = _streamed(spark, sf_dir, lambda rows: streams.sessions(rows, "ts", "user_id", "1 hour", "90 minutes"), "complete")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


def _user_hex() -> Column:
    """A hash of the user in which one of the digits, by the event, has a bit flipped: a user's are at most two bits apart."""
    base, at = F.md5(F.col("user_id").cast("string")), (F.col("id") % 16).cast("int")
    flipped = F.translate(F.substring(base, at + 1, F.lit(1)), "0123456789abcdef", "1032547698badcfe")
    return F.concat(F.substring(base, F.lit(1), at), flipped, F.substring(base, at + 2, 15 - at))


def q_stream_near_copies(spark, sf_dir):
    """Events whose hash is near that of an event of the day before."""
    plan = lambda rows: streams.near_copies(rows.withColumn("hex", _user_hex()), "ts", 16, 2, "1 day", "2 days")
    return _streamed(spark, sf_dir, plan, "append", SLICE_ROWS).select("id", "earlier_id", "distance")


def q_stream_known(spark, sf_dir):
    """Events near one of the known hashes: those of the first users."""
    known = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("ordinal")).where("user_id % 7 = 0").select("ordinal", F.substring(F.md5(F.col("user_id").cast("string")), 1, 16).alias("hex"))
    return _streamed(spark, sf_dir, lambda rows: streams.near_known(rows.withColumn("hex", _user_hex()), known, 16, 1), "append").select("id", "ordinal", "distance")


def q_stream_followed(spark, sf_dir):
    """Purchases within six hours of a user's view: two streams with a watermark each."""
    of = lambda rows, kind: rows.where(F.col("event_type") == kind).select("id", "user_id", "ts")
    plan = lambda rows: streams.followed(of(rows, "view"), of(rows, "purchase"), "user_id", "ts", "6 hours", ("1 day", "2 days"))
    return _streamed(spark, sf_dir, plan, "append").select("user_id", "id", "after_id")


def q_asof(spark, sf_dir):
    """Each view with the user's latest purchase until then, and the distance of their hashes."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.substring(F.md5("props"), 1, 16).alias("hex"))
    views = rows.where("event_type = 'view'").select("event_id", "user_id", "ts", "hex")
    bought = rows.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("reference"), F.col("hex").alias("reference_hex"))
    out = asof.latest(views, bought, ["user_id"], "ts")
    return out.select("event_id", F.coalesce("reference", F.lit(-1)).alias("reference"), F.coalesce(H.hamming(F.col("hex"), F.col("reference_hex")), F.lit(-1)).alias("distance"))


def q_sketches(spark, sf_dir):
    """Distinct hashes by label and corner with subtotals, from stored sketches of parts: whether each estimate is within
    its bound of the exact count."""
    rows = average_hashes(spark, sf_dir).withColumn("bright_corner", F.substring("hex", 1, 1) >= "8").withColumn("part", F.col("vec_id") % 8)
    stored = scratch.written(sketches.sketched(rows, ["label", "bright_corner", "part"], "hex"), "sketches")
    found = sketches.merged(stored, ["label", "bright_corner"])
    exact = rows.cube("label", "bright_corner").agg(F.countDistinct("hex").alias("n_hashes"))
    both = exact.join(found, exact["label"].eqNullSafe(found["label"]) & exact["bright_corner"].eqNullSafe(found["bright_corner"]))
    named = [F.coalesce(exact["label"], F.lit(-1)).alias("label"), F.coalesce(exact["bright_corner"].cast("string"), F.lit("all")).alias("bright_corner")]
    return both.select(*named, "n_hashes", sketches.within(F.col("n_distinct"), F.col("n_hashes")).alias("within_bound"))


QUERIES = {
    "average_hash": q_average,
    "difference_hash": q_difference,
    "median_hash": q_median,
    "pixel_classes": q_pixels,
    "alpha_composite": q_composite,
    "colour_hash": q_colour_hash,
    "near_hash_pairs": q_near_values,
    "near_hash_pairs_wide": q_near_wide,
    "near_hash_groups": q_near_groups,
    "best_match": q_best_match,
    "tolerance_filter": q_tolerance,
    "known_hashes": q_known,
    "multi_hash": q_multi_hash,
    "hex_parsers": q_hex_parts,
    "bin_bits": q_bin_bits,
    "frame_changes": q_frame_changes,
    "hash_report": q_report,
    "hash_set_ops": q_common_digits,
    "largest_lines": q_largest_lines,
    "image_formats": q_formats,
    "decoded_average_hash": q_decoded_average,
    "decoded_formats": q_decoded_formats,
    "image_hashes": q_image_hashes,
    "crop_resistant_hash": q_crop_resistant,
    "stream_windows": q_stream_windows,
    "stream_sliding": q_stream_sliding,
    "stream_first_seen": q_stream_first_seen,
    "stream_sessions": q_stream_sessions,
    "stream_near_copies": q_stream_near_copies,
    "stream_known": q_stream_known,
    "stream_followed": q_stream_followed,
    "asof_frames": q_asof,
    "hash_sketches": q_sketches,
    "best_multi_match": q_multi_best,
    "hash_checks": q_hash_checks,
}
