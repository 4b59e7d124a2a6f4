"""Near copies among embeddings by PCA-ordered tiles (operator 3).

* Equal vectors of a label are one class from the start; copies are counted, never paired.
* Vectors are scaled to length 1 and turned so that the leading coordinates carry most of the variance. The basis is
  fitted on at most ``BASIS_ROWS`` vectors (by a hash of their ids); any basis gives the same links, a good one sooner.
* Linked vectors are at most ``sqrt(2 - 2 t)`` apart. Spark sorts the classes by label, by slabs of that width of the first
  coordinate and within a slab by the second one, and cuts them into tiles of ``TILE``, which travel as they are stored.
  Two tiles meet only if the boxes of their ``BOX`` leading coordinates come within that distance, which is found from
  the boxes alone, by cells of slabs of two coordinates, before any vector travels. A label's vectors are few tiles, so
  that a vector travels once for many it is compared with.
* Within a task a tile is halved at the median of the widest of its ``BOX`` leading coordinates until parts have at most
  ``LEAF`` vectors. Two parts are compared only if their boxes of leading coordinates come within that distance.
* In a pair of parts the dot products of the leading coordinates are taken first. What the others can add is at most
  the product of their norms; a pair that cannot reach the threshold with that is left, and the rest goes on with more
  coordinates. Products within 1e-9 of the threshold are decided by the plain cosine in double precision.
* A pair of tiles returns sums of links per vector and the edges of a spanning forest, not its pairs.

Defined cases: a vector that is null, empty, zero or has null or non-finite components, or whose label or id is null,
links with nothing and is its own component. Vectors of different lengths never link. Labels may be of any type that
Spark can sort; they are only compared. Rows with equal ids and vectors are copies of each other; rows that repeat an id
with other vectors have the links of their own vectors. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .components import components

THRESHOLD, TILE, LEAF, BOX, BASIS_ROWS, STAGES = 0.93, 8192, 256, 4, 8192, (8, 16, 32)
FOUND = "node bigint, other bigint, links bigint"


def basis(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal columns, those with the largest second moment first."""
    return np.linalg.eigh(vectors.T @ vectors)[1][:, ::-1]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def linked(x: np.ndarray, y: np.ndarray, raw_x: np.ndarray, raw_y: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """The places (i, j) at which the cosine of turned unit vectors ``x[i], y[j]`` reaches the threshold."""
    dims, least = x.shape[1], threshold - 1e-9
    cuts = [c for c in STAGES if c < dims] + [dims]
    sx = [np.sqrt((x[:, c:] ** 2).sum(1)) for c in cuts]
    sy = [np.sqrt((y[:, c:] ** 2).sum(1)) for c in cuts]
    dot = x[:, : cuts[0]] @ y[:, : cuts[0]].T
    i, j = np.nonzero(dot + np.outer(sx[0], sy[0]) >= least)
    stage = 0
    while stage + 1 < len(cuts) and len(i) > dot.size // 16:  # too many are left to take them one by one
        dot += x[:, cuts[stage] : cuts[stage + 1]] @ y[:, cuts[stage] : cuts[stage + 1]].T
        stage += 1
        i, j = np.nonzero(dot + np.outer(sx[stage], sy[stage]) >= least)
    sums = dot[i, j]
    for stage in range(stage + 1, len(cuts)):
        a, b = cuts[stage - 1], cuts[stage]
        sums = sums + np.einsum("ij,ij->i", x[i, a:b], y[j, a:b])
        keep = sums + sx[stage][i] * sy[stage][j] >= least
        i, j, sums = i[keep], j[keep], sums[keep]
    sure = sums >= threshold + 1e-9
    near = np.flatnonzero(~sure)
    for k in near:
        p, q = raw_x[i[k]], raw_y[j[k]]
        sure[k] = float(p @ q) / (float(np.sqrt(p @ p)) * float(np.sqrt(q @ q))) >= threshold
    return i[sure], j[sure]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that links reach from it."""
    least = np.arange(n)
    while len(i):
        before = least.copy()
        np.minimum.at(least, i, least[j])
        np.minimum.at(least, j, least[i])
        least = least[least]
        if (least == before).all():
            break
    return least


def leaves(x: np.ndarray) -> list[np.ndarray]:
    """Places of ``x`` in parts of at most LEAF that are near each other by their leading coordinates."""
    out, open_ = [], [np.arange(len(x))]
    while open_:
        own = open_.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        lead = x[own, :BOX]
        widest = int(np.argmax(lead.max(0) - lead.min(0)))
        order = np.argpartition(lead[:, widest], len(own) // 2)
        open_ += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return [o for o in out if len(o)]


def boxes_within(a: tuple[np.ndarray, np.ndarray], lows: np.ndarray, highs: np.ndarray, reach: float) -> np.ndarray:
    """Which boxes come within ``reach`` of the box ``a``."""
    gap = np.maximum(0, np.maximum(lows - a[1], a[0] - highs))
    return np.flatnonzero((gap**2).sum(1) <= reach**2)


def tiles_linked(x: np.ndarray, y: np.ndarray, raw_x: np.ndarray, raw_y: np.ndarray, copies_x: np.ndarray, copies_y: np.ndarray, same: bool, threshold: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of links of the vectors of ``x``, and of ``y`` behind them, and the ends (i, j) of edges that connect what
    links connect. ``same``: ``y`` is ``x``, and only ``x`` is counted."""
    n, m = len(x), 0 if same else len(y)
    sums, ends = np.zeros(n + m), [np.zeros((2, 0), np.int64)]
    parts, others = leaves(x), leaves(y)
    lows, highs = (np.array([f(y[o, :BOX], 0) for o in others]) for f in (np.min, np.max))
    for k, p in enumerate(parts):
        for q in boxes_within((x[p, :BOX].min(0), x[p, :BOX].max(0)), lows, highs, reach):
            if same and q < k:
                continue
            o = others[q]
            i, j = linked(x[p], y[o], raw_x[p], raw_y[o], threshold)
            if same and q == k:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            sums[p] += np.bincount(i, copies_y[o][j], len(p))
            sums[(0 if same else n) + o] += np.bincount(j, copies_x[p][i], len(o))
            both = np.r_[p, (0 if same else n) + o]
            least = forest(len(both), i, (0 if same and q == k else len(p)) + j)
            moved = np.flatnonzero(least != np.arange(len(both)))
            ends.append(np.stack([both[moved], both[least[moved]]]))
    return sums, *np.concatenate(ends, 1)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & some, F.lit(False))
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"  # stored and sent as it is
    stored = np.dtype("<f4" if single else "<f8").str
    vector = F.col("embedding") if single else F.col("embedding").cast("array<double>").alias("embedding")
    kind = vectors.schema["label"].dataType
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vector).withColumn("ok", ok)
    rows = rows.select("vec_id", F.when(F.col("ok"), F.col("label")).alias("label"), F.when(F.col("ok"), F.col("embedding")).alias("embedding"))
    valid = rows.where("label is not null and embedding is not null")
    # A class is named by its place in the written table: ids may repeat.
    classes = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.written(classes.withColumn("node", F.monotonically_increasing_id()), "op3-classes")

    sample = classes.orderBy(F.xxhash64("embedding"), "node").select("embedding").limit(BASIS_ROWS).toPandas()["embedding"]
    by_dims: dict[int, list] = {}
    for v in sample:
        by_dims.setdefault(len(v), []).append(np.asarray(v, np.float64))
    turned = spark.sparkContext.broadcast({d: basis(unit(np.array(v))) for d, v in by_dims.items()})
    turn = lambda x: x @ turned.value[x.shape[1]] if x.shape[1] in turned.value else x
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9

    def first(batches):
        for batch in batches:
            lists = batch.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            dims = np.diff(ends).astype(np.int32)
            lead, packed = np.zeros((batch.num_rows, BOX)), np.empty(batch.num_rows, object)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                raw = flat[ends[own][:, None] + np.arange(d)]
                lead[own, : min(BOX, d)] = turn(unit(raw.astype(np.float64)))[:, :BOX]
                width = d * np.dtype(stored).itemsize
                packed[own] = np.frombuffer(raw.astype(stored).tobytes(), f"V{width}").tolist()
            leads = pa.ListArray.from_arrays(np.arange(0, BOX * batch.num_rows + 1, BOX, np.int32), lead.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims), leads, batch.column(2), batch.column(3), pa.array(packed, pa.binary())], names=["label", "dims", "lead", "node", "copies", "vector"])

    named = f"label {kind.simpleString()}, dims int"
    placed = classes.select("label", "embedding", "node", "copies").mapInArrow(first, f"{named}, lead array<double>, node bigint, copies bigint, vector binary")
    placed = scratch.written(placed, "op3-placed")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slab = lambda c: F.floor(c / reach).cast("int")
    order = ["label", "dims", "slab", "next", "node"]
    ordered = placed.withColumn("slab", slab(F.get("lead", F.lit(0)))).withColumn("next", F.get("lead", F.lit(1))).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def tiled(batches):
        from pyspark import TaskContext

        tile, held, size = TaskContext.get().partitionId() << 33, [], 0

        def out():
            nonlocal tile, held, size
            whole = pa.Table.from_batches(held).combine_chunks()
            lead = whole.column("lead").combine_chunks().flatten().to_numpy().reshape(-1, BOX)
            numbers = lambda c: whole.column(c).to_numpy().astype(np.int64).tobytes()
            row = [pa.array([tile]), whole.column("label").slice(0, 1).combine_chunks(), whole.column("dims").slice(0, 1).combine_chunks()]
            row += [pa.array([f(0).tolist()], pa.list_(pa.float64())) for f in (lead.min, lead.max)]
            row += [pa.array([v], pa.binary()) for v in (numbers("node"), numbers("copies"), b"".join(v.as_buffer().to_pybytes() for v in whole.column("vector")))]
            tile, held, size = tile + 1, [], 0
            return pa.RecordBatch.from_arrays(row, names=["tile", "label", "dims", "lo", "hi", "nodes", "copies", "vectors"])

        for batch in batches:
            label, dims = batch.column(0), batch.column(1)
            # Where another label or another length begins.
            new = [0, batch.num_rows]
            if batch.num_rows > 1:
                new += (1 + np.flatnonzero(pc.or_(pc.not_equal(label.slice(1), label.slice(0, len(label) - 1)), pc.not_equal(dims.slice(1), dims.slice(0, len(dims) - 1))).to_numpy(zero_copy_only=False))).tolist()
            new = sorted(set(new))
            for lo, hi in zip(new, new[1:]):
                if held and (held[-1].column(0)[-1] != label[lo] or held[-1].column(1)[-1] != dims[lo]):
                    yield out()
                while lo < hi:
                    part = batch.slice(lo, min(hi - lo, TILE - size))
                    held.append(part)
                    lo, size = lo + part.num_rows, size + part.num_rows
                    if size == TILE:
                        yield out()
        if held:
            yield out()

    columns = ["label", "dims", "lead", "node", "copies", "vector"]
    tiles = ordered.select(*columns).mapInArrow(tiled, f"tile bigint, {named}, lo array<double>, hi array<double>, nodes binary, copies binary, vectors binary")
    tiles = scratch.written(tiles, "op3-tiles", "none")
    met = _near_tiles(tiles, reach)
    whole = lambda k: tiles.select(F.col("tile").alias(k), "dims", *(F.col(c).alias(f"{k}_{c}") for c in ("nodes", "copies", "vectors")))
    met = met.join(whole("p"), "p").join(whole("q").drop("dims"), "q").repartition(n, "p", "q").select("p", "q", "dims", "p_nodes", "p_copies", "p_vectors", "q_nodes", "q_copies", "q_vectors")

    def compared(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                p, q, dims, *packed = (batch.column(c)[k] for c in range(9))
                dims = dims.as_py()
                nodes, copies, raw = ([np.frombuffer(packed[s + o].as_buffer(), t) for s in (0, 3)] for o, t in ((0, np.int64), (1, np.int64), (2, stored)))
                raw = [v.astype(np.float64).reshape(-1, dims) for v in raw]
                x, y = (turn(unit(v)) for v in raw)
                same = p.as_py() == q.as_py()
                links, i, j = tiles_linked(x, y, *raw, *copies, same, threshold, reach)
                all_nodes, least = nodes[0] if same else np.r_[nodes[0], nodes[1]], forest(len(links), i, j)
                use = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(all_nodes[use]), pa.array(all_nodes[least[use]]), pa.array(links[use].astype(np.int64))], names=["node", "other", "links"])

    found = scratch.written(met.mapInArrow(compared, FOUND), "op3-found")
    scratch.dropped(placed, tiles)
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    ends = classes.join(sums, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ends.groupBy("component").agg(F.min("first").alias("component_id"))
    ends = ends.join(least, "component").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(ends, ["label", "embedding"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _near_tiles(tiles: DataFrame, reach: float) -> DataFrame:
    """``p, q`` of tiles of one label and length whose boxes (lo, hi) come within ``reach``, from the boxes alone. Boxes meet in
    cells of slabs of the first two coordinates, each pair in the first cell that they share."""
    slab = lambda c, k: F.floor(F.get(c, F.lit(k)) / reach).cast("int")
    boxes = tiles.select("tile", "label", "dims", "lo", "hi", *[slab(c, k).alias(f"{c}{k}") for c in ("lo", "hi") for k in (0, 1)])
    cells = lambda t, more: t.withColumn("c0", F.explode(F.sequence(F.col("lo0") - more, F.col("hi0") + more))).withColumn("c1", F.explode(F.sequence(F.col("lo1") - more, F.col("hi1") + more)))
    of = lambda t, name: t.select("label", "dims", "c0", "c1", F.col("tile").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("lo", "hi", "lo0", "lo1")])
    both = of(cells(boxes, 1), "p").join(of(cells(boxes, 0), "q"), ["label", "dims", "c0", "c1"])
    once = (F.col("c0") == F.greatest(F.col("p_lo0") - 1, "q_lo0")) & (F.col("c1") == F.greatest(F.col("p_lo1") - 1, "q_lo1"))
    gap = lambda k: F.greatest(F.lit(0.0), F.get("q_lo", F.lit(k)) - F.get("p_hi", F.lit(k)), F.get("p_lo", F.lit(k)) - F.get("q_hi", F.lit(k)))
    near = sum((gap(k) * gap(k) for k in range(BOX)), F.lit(0.0)) <= reach * reach
    return both.where((F.col("p") <= F.col("q")) & once & near).select("p", "q")


#: By brute force.
ORACLE = """
with recursive v as materialized (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
n as materialized (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as r from v),
links as materialized (
  select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where a.r > 0 and b.r > 0 and list_inner_product(a.e, b.e) / (a.r * b.r) >= 0.93),
reached(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reached r join links l on l.a = r.b),
parts as (select a, min(b) as c from reached group by a),
counts as (select a, count(*) as k from links group by a)
select e.vec_id, coalesce(k, 0) as n_links, c as component_id, e.vec_id = c as kept
from embeddings e join parts p on p.a = e.vec_id left join counts k on k.a = e.vec_id
"""


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
