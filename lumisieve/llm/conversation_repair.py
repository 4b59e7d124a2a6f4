"""Repairing the structure of conversations at the least cost (operator 11).

A repaired conversation is empty, or one system turn at most and then pairs of a user's and an assistant's turn:
``(s?(ua)+)?`` in initials. It is made by edits of the turns in their order: K keeps one (cost 0), R gives it the role
user or assistant (1), D deletes it (2), I inserts an empty turn of user or assistant anywhere (5). Blank and repeated
turns must go; a turn that is cut short costs 5 more unless it goes.

Edits are the edges of a lattice of (turns read, state of the grammar), which is never built: Dijkstra's search keeps a
heap ordered by (cost, audit), where the audit is the edits' initials, and stops at the first accepting end that it
pops. No audit is a proper prefix of another one of the same cost and place (what it lacks would be inserts, which
cost), so the order goes through edges and of equally cheap repairs the one with the least audit is found. The audit tells the
repair: turns that stay alternate, and an odd number of them begins with the system's.

A conversation of at most ``PART`` rows is one search. A longer one is cut every ``PART`` rows, so that no task holds
a whole one: for each part the search finds the cheapest way from each state to each other, inserts standing before the
turn that follows them. Such a table is 16 costs and the order of the 16 audits, which is all that is needed to
multiply tables: of equal costs the earlier part's audit decides, then the later one's. Tables are multiplied in groups of
``FAN`` until one group is left, the states at the cuts are read back from the top, and each part is searched once more
between its two states. So cuts change nothing in what is found.

Turns of one conversation are in the order of turn (nulls first), role and text. Defined cases: a null role or text is
one space; a role that is not system, user or assistant can't be kept, only renamed or deleted (the grammar goes by
initials: any s, u or a will do; an empty role has none); rows without a conversation are one conversation;
equal rows of one turn are repeats of the first. A conversation whose rows all go is empty. An empty table gives no
rows. Other columns are not read. SHA-256 goes from the first byte to the last, so the digest of a long conversation is
made by one task, which sees its repaired parts one after another and holds one; the repaired turns themselves
(``repaired``) are many rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

PART, FAN = 512, 512
RENAME, DELETE, CUT_SHORT, INSERT = 1, 2, 5, 5
#: States: nothing yet, after the system's turn, after a user's, after an assistant's.
STATES, START, AFTER_USER, AFTER_ASSISTANT = 4, 0, 2, 3
ACCEPTED = (START, AFTER_ASSISTANT)
#: Where a turn of each role leads from each state.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: Where the one role that is not the system's leads.
NEXT = {0: 2, 1: 2, 3: 2, 2: 3}
WHITE = " \t\n\x0b\x0c\r"


def faults(turns: list[tuple[str, str]], again: list[bool] | None = None) -> list[str]:
    """Each turn's first fault: ``blank``, ``duplicate``, ``truncated`` or none; ``again`` tells which were seen before."""
    out, seen = [], set()
    for k, (role, text) in enumerate(turns):
        bare = text.strip(WHITE)
        repeated = again[k] if again else (role, text) in seen
        seen.add((role, text))
        out.append("blank" if not bare else "duplicate" if repeated else "" if bare[-1] in ".!?" else "truncated")
    return out


def searched(turns: list[tuple[str, str]], start: int, wanted: tuple[int, ...], last: bool) -> Iterator[tuple[int, str, int]]:
    """``cost, audit, state`` of the ends in ``wanted``, the cheapest first, from ``start`` over turns (initial, fault).
    Only the last part may end with inserts."""
    n, done = len(turns), set()
    heap = [(0, "", 0, start)]
    while heap:
        cost, audit, at, state = heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == n and state in wanted:
            yield cost, audit, state
        if at < n:
            initial, fault = turns[at]
            heappush(heap, (cost + DELETE, audit + "D", at + 1, state))
            if fault not in ("blank", "duplicate"):
                more = CUT_SHORT if fault else 0
                if (state, initial) in KEPT:
                    heappush(heap, (cost + more, audit + "K", at + 1, KEPT[state, initial]))
                heappush(heap, (cost + more + RENAME, audit + "R", at + 1, NEXT[state]))
        if at < n or last:
            heappush(heap, (cost + INSERT, audit + "I", at, NEXT[state]))


def edited(turns: list[tuple[str, str]], audit: str, first: int = START) -> list[tuple[str, str]]:
    """The repaired turns (role, text) that an audit makes, from the state ``first``."""
    out, at, state = [], 0, first
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        role, text = ("", "") if edit == "I" else turns[at]
        at += edit != "I"
        if edit == "K":
            state = KEPT[state, role[:1]]
        else:
            state = NEXT[state]
            role = "user" if state == AFTER_USER else "assistant"
        out.append((role, text))
    return out


def ranked(keys: list) -> list[int]:
    """Each key's place among the distinct ones; none for ``None``."""
    place = {k: i for i, k in enumerate(sorted({k for k in keys if k is not None}))}
    return [place.get(k, -1) for k in keys]


def table_of(turns: list[tuple[str, str]], last: bool) -> tuple[list[int], list[int]]:
    """Costs (-1: no way) and the order of audits from each state to each state."""
    costs, audits = [-1] * STATES**2, [None] * STATES**2
    for i in range(STATES):
        for cost, audit, k in searched(turns, i, tuple(range(STATES)), last):
            costs[i * STATES + k], audits[i * STATES + k] = cost, audit
    return costs, ranked(audits)


def times(one: tuple[list[int], list[int]], two: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    """The table of two parts, one after the other."""
    best = []
    for i in range(STATES):
        for k in range(STATES):
            ways = [(i * STATES + j, j * STATES + k) for j in range(STATES)]
            best.append(min(((one[0][a] + two[0][b], (one[1][a], two[1][b])) for a, b in ways if one[0][a] >= 0 and two[0][b] >= 0), default=(-1, None)))
    return [b[0] for b in best], ranked([b[1] for b in best])


def cuts(tables: list[tuple[list[int], list[int]]], first: int, wanted: tuple[int, ...]) -> list[int]:
    """The states before each of the tables' parts and after the last one, on the cheapest way from ``first``."""
    ahead, ways = [(0, 0) if k in wanted else None for k in range(STATES)], []
    for costs, ranks in reversed(tables):
        found = []
        for i in range(STATES):
            of = ((costs[i * STATES + k] + ahead[k][0], (ranks[i * STATES + k], ahead[k][1]), k) for k in range(STATES) if ahead[k] and costs[i * STATES + k] >= 0)
            found.append(min(of, default=None))
        order = ranked([f and f[1] for f in found])
        ahead = [f and (f[0], order[i]) for i, f in enumerate(found)]
        ways.append([f and f[2] for f in found])
    path = [first]
    for way in reversed(ways):
        path.append(way[path[-1]])
    return path


def _joined(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``few``; null keys are equal."""
    named = few.withColumnsRenamed({k: f"__ls_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__ls_{k}")) for k in keys])
    return rows.join(named, on, "left").drop(*[f"__ls_{k}" for k in keys])


def _in_parts(rows: DataFrame) -> DataFrame:
    """``rows`` with ``part`` (the place in the conversation, over PART) and ``again`` (role and text were seen before).

    Rows are sorted in ranges, a conversation's rows in earlier ranges come from a prefix sum over ranges, and a text's
    first place is a minimum, so that a conversation is never one task's.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text", "__ls_row"]
    ordered = rows.withColumn("__ls_row", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Within a range, the id grows by one a row.
    ordered = scratch.written(ordered.drop("__ls_row").withColumn("at", F.monotonically_increasing_id()), "op11-ordered")
    ordered = ordered.withColumn("range", F.shiftright("at", 33))
    runs = ordered.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = scratch.written(runs.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0))).drop("c"), "op11-runs")
    placed = _joined(ordered, runs, ["conv_id", "range"]).withColumn("place", F.col("before") + F.col("at") - F.col("first"))
    placed = placed.withColumn("mark", F.unhex(F.md5(F.concat_ws("\x00", "role", "text").cast("binary")))).select(*rows.columns, "place", "mark")
    once = placed.groupBy("conv_id", "mark").agg(F.min("place").alias("first_place"))
    both = _joined(placed, once, ["conv_id", "mark"])
    return both.select(*rows.columns, F.floor(F.col("place") / PART).alias("part"), (F.col("place") > F.col("first_place")).alias("again"))


def collected(turns: DataFrame) -> DataFrame:
    """``conv_id, part, parts, rows``: a conversation's rows (turn, role, text, again) in parts of at most PART."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    one = {"parts": F.lit(1).cast("long"), "part": F.lit(0).cast("long"), "again": F.lit(None).cast("boolean")}
    # Long conversations, at most one for each PART rows of the table.
    counts = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > PART)
    full = scratch.written(counts.select("conv_id", F.ceil(F.col("c") / PART).alias("parts")), "op11-full")
    if full.isEmpty():
        rows = rows.withColumns(one)
    else:
        marked = _joined(rows, full, ["conv_id"])
        rows = marked.where("parts is null").withColumns(one).unionByName(_in_parts(marked.where("parts is not null")))
    # At the place of one text, the first of equal rows is the one that was not seen before.
    row = F.struct(F.col("turn").isNotNull().alias("dated"), "turn", "role", "text", "again")
    return rows.groupBy("conv_id", "part", "parts").agg(F.sort_array(F.collect_list(row)).alias("rows"))


def _read(rows: list[dict]) -> tuple[list[tuple[str, str]], list[str], list[tuple[str, str]]]:
    """Turns (role, text), their faults, and (initial, fault) of each."""
    turns = [(r["role"], r["text"]) for r in rows]
    found = faults(turns, [r["again"] for r in rows] if rows[0]["again"] is not None else None)
    return turns, found, [(role[:1], fault) for (role, _), fault in zip(turns, found)]


def _at_cuts(long: DataFrame) -> DataFrame:
    """``conv_id, part, first, after``: the states at the ends of the parts of long conversations."""
    kind = long.schema["conv_id"].dataType.simpleString()
    scored, numbers = f"conv_id {kind}, part bigint, costs array<bigint>, ranks array<bigint>", pa.list_(pa.int64())

    def tables(batch, found):
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], numbers), pa.array([f[1] for f in found], numbers)], names=["conv_id", "part", "costs", "ranks"])

    def score(batches):
        for batch in batches:
            last = [p == n - 1 for p, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield tables(batch, [table_of(_read(own.as_py())[2], end) for own, end in zip(batch.column(3), last)])

    def product(batches):
        for batch in batches:
            yield tables(batch, [reduce(times, [(t["costs"], t["ranks"]) for t in own.as_py()]) for own in batch.column(2)])

    def read_back(batches):
        for batch in batches:
            where, out = [], []
            for k, (own, first, after) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
                path = cuts([(t["costs"], t["ranks"]) for t in own], first, ACCEPTED if after is None else (after,))
                out += [(t["part"], path[i], path[i + 1]) for i, t in enumerate(own)]
                where += [k] * len(own)
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), *cols], names=["conv_id", "part", "first", "after"])

    def grouped(level: DataFrame) -> DataFrame:
        groups = level.groupBy("conv_id", F.floor(F.col("part") / FAN).alias("group"))
        return groups.agg(F.sort_array(F.collect_list(F.struct("part", "costs", "ranks"))).alias("own"))

    levels = [scratch.written(long.select("conv_id", "part", "parts", "rows").mapInArrow(score, scored), "op11-tables")]
    while not levels[-1].where(F.col("part") >= FAN).isEmpty():
        levels.append(scratch.written(grouped(levels[-1]).mapInArrow(product, scored), "op11-products"))
    found = None
    for level in reversed(levels):
        groups = grouped(level)
        known = groups.withColumns({"first": F.lit(START), "after": F.lit(None).cast("int")}) if found is None else _joined(groups, found.withColumnRenamed("part", "group"), ["conv_id", "group"])
        found = scratch.written(known.mapInArrow(read_back, f"conv_id {kind}, part bigint, first int, after int"), "op11-cuts")
    return found


#: What is known of a part besides its repaired turns; ``n_turns`` are distinct turn numbers.
COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost", "n_turns")
ENDS = ("first_turn", "last_turn", "first_role", "last_role")


def repaired(turns: DataFrame) -> DataFrame:
    """``conv_id, part, parts, turns (role, text), audit``, a part's counts of faults and costs (COUNTS), and what its
    neighbours need of it (ENDS: turn numbers and roles' initials before the repair).

    ``turns`` (conv_id, turn, role, text) is read more than once, so it should be a table or a plain read of one. A
    conversation's parts, put together, are its repair.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, part bigint, parts bigint, turns array<struct<role:string,text:string>>, audit string, {', '.join(f'{c} bigint' for c in COUNTS)}, first_turn bigint, last_turn bigint, first_role string, last_role string"
    turn_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                own, out = batch.slice(lo, 256), []
                for k, (part, parts, first, after) in enumerate(zip(*(own.column(c).to_pylist() for c in (1, 2, 4, 5)))):
                    rows = own.column(3)[k].as_py()
                    said, found, short = _read(rows)
                    first = START if first is None else first
                    cost, audit, _ = next(searched(short, first, ACCEPTED if after is None else (after,), part == parts - 1))
                    initials, numbers = [s[0] for s in short], [r["turn"] for r in rows if r["turn"] is not None]
                    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
                    counts = [found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, len(set(numbers))]
                    ends = [numbers[0] if numbers else None, numbers[-1] if numbers else None, initials[0], initials[-1]]
                    out.append(([{"role": r, "text": t} for r, t in edited(said, audit, first)], audit, *counts, *ends))
                types = [turn_type, pa.string(), *[pa.int64()] * (len(COUNTS) + 2), pa.string(), pa.string()]
                cols = [pa.array([o[i] for o in out], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in (0, 1, 2)), *cols], names=["conv_id", "part", "parts", "turns", "audit", *COUNTS, *ENDS])

    parts = collected(turns)
    none = {"first": F.lit(None).cast("int"), "after": F.lit(None).cast("int")}
    columns = ["conv_id", "part", "parts", "rows", "first", "after"]
    short = parts.where("parts = 1").withColumns(none).select(*columns)
    long = scratch.written(parts.where("parts > 1"), "op11-long")
    if long.isEmpty():
        return short.mapInArrow(run, schema)
    return short.unionByName(_joined(long, _at_cuts(long), ["conv_id", "part"]).select(*columns)).mapInArrow(run, schema)


def _written(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def _long_digests(parts: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of conversations of several parts, which come in order and are held one at a time."""
    kind = parts.schema["conv_id"].dataType.simpleString()

    def run(batches):
        conv, state, began, some = None, None, False, False
        for batch in batches:
            ids, done = batch.column(0), []
            for k, text in enumerate(batch.column(2)):
                if state is None or ids[k] != conv and (ids[k].is_valid or conv.is_valid):
                    if state is not None:
                        done.append((conv.as_py(), state.hexdigest()))
                    conv, state, began = ids[k], hashlib.sha256(), False
                if text.is_valid:
                    state.update((b"\n" if began else b"") + text.as_buffer().to_pybytes())
                    began = True
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], ids.type), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"])
            some = ids.type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv.as_py()], some), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

    text = F.when(F.size("turns") > 0, _written(F.col("turns"))).alias("text")
    return parts.select("conv_id", "part", text).repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "part", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def summed(parts: DataFrame) -> DataFrame:
    """A row for each conversation in ``repaired`` parts (a table): gaps, faults, cost, audit, and the digest of the
    repaired turns."""
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = lambda lo, hi, n: F.coalesce(hi - lo + 1 - n, F.lit(0)).cast("long").alias("gaps")
    short = parts.where("parts = 1").select("conv_id", gaps(F.col("first_turn"), F.col("last_turn"), F.col("n_turns")), *counts, "audit", F.sha2(_written(F.col("turns")).cast("binary"), 256).alias("repaired_sha256"))
    long = parts.where("parts > 1")
    if long.isEmpty():
        return short
    # What two neighbours make together: a pair of roles, and a turn number that both have.
    before = long.select("conv_id", (F.col("part") + 1).alias("part"), F.col("last_turn").alias("turn_before"), F.col("last_role").alias("role_before"))
    both = _joined(long, before, ["conv_id", "part"])
    pair = (F.col("part") > 0) & ~F.concat("role_before", "first_role").isin("su", "ua", "au")
    shared = F.coalesce(F.col("turn_before") == F.col("first_turn"), F.lit(False))
    both = both.withColumn("illegal", F.col("illegal") + pair.cast("long")).withColumn("n_turns", F.col("n_turns") - shared.cast("long"))
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda p: p["audit"]), "")
    sums = both.groupBy("conv_id").agg(gaps(F.min("first_turn"), F.max("last_turn"), F.sum("n_turns")), *[F.sum(c).alias(c) for c in counts], audit.alias("audit"))
    return short.unionByName(_joined(sums, _long_digests(long), ["conv_id"]))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with the faults that the operator repairs, by a checksum of conversation and
    turn: of twenty rows one is lost, one emptied, one without its ends of sentences, one repeated, one the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), kind.alias("kind")).where("kind > 0")
    once = rows.select("conv_id", "turn", "role", "text")
    return once.union(rows.where("kind = 3").select(*once.columns))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = summed(scratch.written(repaired(damaged(turns)), "op11-repaired"))
    out = _joined(turns.select("conv_id").distinct(), found, ["conv_id"])
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """The lattice turn by turn for all conversations: of each state the least (cost, audit) as one text, ``~`` for none."""

    def more(x: str, cost: str, edit: str) -> str:
        return f"(CASE WHEN {x} = '~' THEN '~' ELSE lpad(CAST(CAST(substr({x}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || '{edit}' END)"

    def inserted(source: str) -> str:
        two = f"SELECT *, least(s2, {more('s0', '5', 'I')}, {more('s1', '5', 'I')}, {more('s3', '5', 'I')}) AS i2 FROM {source}"
        return f"(SELECT *, least(s3, {more('i2', '5', 'I')}) AS i3 FROM ({two}))"

    stays = lambda x, cost, edit: f"(CASE WHEN gone THEN '~' ELSE {more(x, f'({cost} + extra)', edit)} END)"
    by = lambda role, x: f"(CASE WHEN r = '{role}' THEN {stays(x, '0', 'K')} ELSE {stays(x, '1', 'R')} END)"
    states = [
        more("s0", "2", "D"),
        f"least({more('s1', '2', 'D')}, CASE WHEN r = 's' THEN {stays('s0', '0', 'K')} ELSE '~' END)",
        f"least({more('i2', '2', 'D')}, {by('u', 's0')}, {by('u', 's1')}, {by('u', 'i3')})",
        f"least({more('i3', '2', 'D')}, {by('a', 'i2')})",
    ]
    crc = """xor(4294967295::UBIGINT, list_reduce(range(0, 8 * length(key)), lambda c, i: CASE WHEN (xor(c, (ascii(key[i // 8 + 1])::UBIGINT >> (i % 8)::UBIGINT)) & 1) = 1
      THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, 4294967295::UBIGINT))"""
    bare = r"rtrim({0}, e' \t\n\x0b\x0c\r')"
    return rf"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS MATERIALIZED (SELECT *, {crc} % 20 AS kind FROM keyed),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) t(copy) WHERE kind > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM hurt),
told AS (SELECT *, substr(role, 1, 1) AS r, {bare.format('text')} AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS nth, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS r_before FROM placed),
judged AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM told),
steps AS MATERIALIZED (SELECT conv_id, k, r, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM judged),
lattice(conv_id, k, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, '000000000', '~', '~', '~' FROM (SELECT DISTINCT conv_id FROM steps)
  UNION ALL
  SELECT conv_id, k, {', '.join(states)} FROM (SELECT i.conv_id, s.k, i.s0, i.s1, i.i2, i.i3, s.r, s.gone, s.extra FROM {inserted('lattice')} i JOIN steps s ON s.conv_id IS NOT DISTINCT FROM i.conv_id AND s.k = i.k + 1)),
ends AS (SELECT conv_id, least(s0, i3) AS best FROM {inserted('lattice')} WHERE (conv_id, k) IN (SELECT conv_id, max(k) FROM steps GROUP BY conv_id)),
letters AS (SELECT conv_id, p, substr(best, 9 + p, 1) AS e FROM ends, range(1, 10000) t(p) WHERE p <= length(best) - 9),
counted AS (SELECT *, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER w AS k, sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER w AS o, sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id) AS n
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING)),
lines AS (SELECT c.conv_id, c.p, CASE WHEN c.e = 'K' THEN j.role WHEN (c.o - c.n % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN c.e = 'I' THEN '' ELSE j.text END AS line
  FROM counted c LEFT JOIN judged j ON j.conv_id = c.conv_id AND j.k = c.k WHERE c.e <> 'D'),
texts AS (SELECT conv_id, string_agg(line, e'\n' ORDER BY p) AS t FROM lines GROUP BY conv_id),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(CASE WHEN fault = 'blank' THEN 1 ELSE 0 END) AS blank, sum(CASE WHEN fault = 'duplicate' THEN 1 ELSE 0 END) AS duplicate,
  sum(CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END) AS truncated, sum(CASE WHEN k > 1 AND r_before || r NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal FROM judged GROUP BY conv_id)
SELECT i.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(s.duplicate, 0)::BIGINT AS duplicate, coalesce(s.truncated, 0)::BIGINT AS truncated,
  coalesce(s.illegal, 0)::BIGINT AS illegal, coalesce(CAST(substr(e.best, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(e.best, 10), '') AS audit, sha256(coalesce(t.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN sums s ON s.conv_id = i.conv_id LEFT JOIN ends e ON e.conv_id = i.conv_id LEFT JOIN texts t ON t.conv_id = i.conv_id"""


ORACLE = _sql()
