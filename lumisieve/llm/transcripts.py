"""Raw chat transcripts to canonical turns by a hidden Markov model (operator 7).

A transcript is a text in which turns follow one another under speaker markers of any style ("User:", "### Human:",
"[assistant]", "Q:", "<|system|>"), some of them missing. Each line is one observation: the kind of marker at its
start, whether a blank line stands before it, whether it asks, its length. The hidden states are role x (first line of
a turn, later line). ``fit`` counts starts, transitions and emissions over labelled transcripts as Spark sums, of
which one row per state pair or state and symbol reaches the driver; ``parsed`` finds the best states by Viterbi and
renders turns as ``<|role|>``, the lines without their marker, ``<|end|>``.

``rendered_from`` makes transcripts out of a table of turns, one for each conversation of at most ``PART`` rows. A
longer one is cut every ``PART`` rows, in the order of turn, role and text, so that no row of the table grows with the
keys; equal rows count as turns of their own. The cuts change nothing in what is found: for each part a table of
max-plus products tells the best score from any state of its first line to any state of the next part's first line,
these tables are multiplied in groups of ``FAN`` until one group is left, and the best states at the cuts are read back
from the top. So a part is decoded as if the whole conversation stood before and after it, and the parts' ``rendered``,
put together, are the conversation's canonical turns; a turn may go on over a cut.

Defined cases: a null or empty transcript has no turns; null texts are empty turns; a turn whose role is null or
unknown is shown without a marker and teaches nothing; a null turn number comes first; rows without a conversation are
one conversation. Without any labelled line all states are alike, and markers alone decide. Line feeds around a turn
are dropped within each part. The one move over each cut is not counted by ``fit``. Of paths whose scores differ by no
more than rounding, any may be found. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

ROLES, PART, FAN, DROPPED = ("system", "user", "assistant"), 512, 512, 12
#: What speakers are called.
NAMES = {
    "system": 0, "sys": 0, "context": 0,
    "user": 1, "human": 1, "customer": 1, "question": 1, "q": 1, "prompt": 1, "instruction": 1,
    "assistant": 2, "ai": 2, "bot": 2, "agent": 2, "answer": 2, "a": 2, "response": 2,
}
_MARKER = re.compile(r"\s{0,3}(?:#{1,4}\s*|\*\*|\[|<\|)?([A-Za-z]{1,12})(?::\*\*|\*\*:|\]:?|\|>|:)[ \t]*")
STYLES = (("{}: ", ("System", "User", "Assistant")), ("### {}: ", ("System", "Human", "AI")), ("[{}] ", ("system", "user", "assistant")), ("{}: ", ("Context", "Q", "A")), ("<|{}|>", ROLES))
N_STATES, NO_MARKER, OTHER_MARKER = 2 * len(ROLES), len(ROLES), len(ROLES) + 1
N_SYMBOLS = (len(ROLES) + 2) * 2 * 2 * 4
#: Stands for the state of the line after the last one.
END = N_STATES


def symbols(lines: list[str]) -> np.ndarray:
    """Each line's observation as one number."""
    out, blank = np.zeros(len(lines), np.int64), True
    for k, line in enumerate(lines):
        found = _MARKER.match(line)
        marker = NO_MARKER if not found else NAMES.get(found.group(1).lower(), OTHER_MARKER)
        bare = line.strip()
        size = 0 if not bare else 1 if len(bare) < 60 else 2 if len(bare) < 200 else 3
        out[k] = ((marker * 2 + blank) * 2 + bare.endswith("?")) * 4 + size
        blank = not bare
    return out


class Model:
    """Log probabilities of starts, transitions and emissions, from counts with add-``a`` smoothing."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray, a: float = 0.1):
        # A later line needs a first line of its own role before it.
        self.allowed = np.ones((N_STATES, N_STATES), bool)
        for s in range(1, N_STATES, 2):
            self.allowed[:, s] = [p // 2 == s // 2 for p in range(N_STATES)]
        first = np.arange(N_STATES) % 2 == 0
        with np.errstate(divide="ignore"):
            self.start = np.log(np.where(first, start + a, 0) / (start + a)[first].sum())
            m = np.where(self.allowed, moves + a, 0)
            self.moves = np.log(m / m.sum(1, keepdims=True))
            # Markers name a role: that much is known before any count.
            known = np.full((N_STATES, N_SYMBOLS), a)
            for s in range(0, N_STATES, 2):
                known[s, (s // 2) * 16 : (s // 2) * 16 + 16] += 1
            e = emits + known
            self.emits = np.log(e / e.sum(1, keepdims=True))

        # Any state may be the last one.
        self.leave = np.hstack([self.moves, np.zeros((N_STATES, 1))])

    def states(self, seen: np.ndarray, first: int | None = None, after: int = END) -> np.ndarray:
        """The most likely states of a transcript's lines, or of a part's, given its first line's state and that of the
        line after it."""
        if not len(seen):
            return np.zeros(0, np.int64)
        start = self.start if first is None else np.where(np.arange(N_STATES) == first, 0, -np.inf)
        best, back = start + self.emits[:, seen[0]], np.zeros((len(seen), N_STATES), np.int64)
        for k in range(1, len(seen)):
            ways = best[:, None] + self.moves
            back[k] = ways.argmax(0)
            best = ways.max(0) + self.emits[:, seen[k]]
        path = np.zeros(len(seen), np.int64)
        path[-1] = (best + self.leave[:, after]).argmax()
        for k in range(len(seen) - 1, 0, -1):
            path[k - 1] = back[k, path[k]]
        return path

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """The best score from each state of a part's first line to each state (or ``END``) of the line after it."""
        best = np.where(np.eye(N_STATES, dtype=bool), self.emits[:, seen[0]], -np.inf)
        for s in seen[1:]:
            best = times(best, self.moves) + self.emits[:, s]
        return times(best, self.leave)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (x[:, :, None] + y[None]).max(1)


def cuts(tables: list[np.ndarray], first: np.ndarray, after: int) -> list[int]:
    """The best states at the first lines of consecutive parts, given scores of the first one and the state after all."""
    best, back = first, []
    for t in tables[:-1]:
        ways = best[:, None] + t[:, :END]
        back.append(ways.argmax(0))
        best = ways.max(0)
    path = [int((best + tables[-1][:, after]).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def turns_of(text: str | None, model: Model, first: int | None = None, after: int = END) -> list[tuple[str | None, str]]:
    """(role, content) of each turn, line feeds around which are no content; of a part, what belongs to an earlier
    part's turn comes first, without a role."""
    lines = text.split("\n") if text or first is not None else []
    out: list[tuple[str | None, list[str]]] = []
    for line, state in zip(lines, model.states(symbols(lines), first, after)):
        if state % 2 == 0:
            found = _MARKER.match(line)
            line = line[found.end() :] if found and found.group(1).lower() in NAMES else line
            out.append((ROLES[state // 2], [line]))
        elif out:
            out[-1][1].append(line)
        else:
            out.append((None, [line]))
    return [(role, "\n".join(own).strip("\n")) for role, own in out]


def canonical(turns: list[tuple[str | None, str]], goes_on: bool = False) -> str:
    """Turns as text; the last one has no end yet if it ``goes_on``, and one without a role has begun before."""
    out = "".join(("" if role is None else f"<|{role}|>\n") + f"{content}\n<|end|>\n" for role, content in turns)
    return out.removesuffix("<|end|>\n") + "\n" if goes_on else out


RENDERED = "conv_id bigint, part bigint, parts bigint, text string, states array<int>"


def _joined(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``few``, by Spark's choice of join; null keys are equal."""
    named = few.withColumnsRenamed({k: f"__ls_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__ls_{k}")) for k in keys])
    return rows.join(named, on, "left").drop(*[f"__ls_{k}" for k in keys])


def _in_parts(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, parts) with ``part``: the place in the conversation, over PART. Rows are
    sorted in ranges, and a conversation's rows in earlier ranges come from a prefix sum; equal rows may be in several
    ranges."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text", "__ls_row"]
    ordered = rows.withColumn("__ls_row", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Within a range, the id grows by one a row.
    ordered = scratch.written(ordered.drop("__ls_row").withColumn("at", F.monotonically_increasing_id()), "op7-ordered")
    ordered = ordered.withColumn("range", F.shiftright("at", 33))
    runs = ordered.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = scratch.written(runs.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0))).drop("c"), "op7-runs")
    place = F.col("before") + F.col("at") - F.col("first")
    return _joined(ordered, runs, ["conv_id", "range"]).withColumn("part", F.floor(place / PART)).select(*rows.columns, "part")


def rendered_from(turns: DataFrame) -> DataFrame:
    """``conv_id, part, parts, text, states``: raw transcripts of a table (conv_id, turn, role, text), in a style that the
    conversation's id gives and with every ``DROPPED``-th marker or so left out, and each line's true state (-1: none)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), "role", "text")
    one = {"parts": F.lit(1).cast("long"), "part": F.lit(0).cast("long")}
    # Long conversations, at most one for each PART rows of the table.
    counts = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > PART)
    full = scratch.written(counts.select("conv_id", F.ceil(F.col("c") / PART).alias("parts")), "op7-full")
    if full.isEmpty():
        rows = rows.withColumns(one)
    else:
        marked = _joined(rows, full, ["conv_id"])
        rows = marked.where("parts is null").withColumns(one).unionByName(_in_parts(marked.where("parts is not null")))
    parts = rows.groupBy("conv_id", "part", "parts").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches):
        for batch in batches:
            out = []
            for conv, part, n_parts, own in zip(*(batch.column(k).to_pylist() for k in range(4))):
                style, names = STYLES[zlib.crc32(str(conv).encode()) % len(STYLES)]
                lines, states = [], []
                for k, t in enumerate(own):
                    role = ROLES.index(t["role"]) if t["role"] in ROLES else None
                    hidden = role is None or (k or part) and zlib.crc32(f"{conv}/{t['turn']}".encode()) % DROPPED == 0
                    body = (t["text"] or "").split("\n")
                    own_states = [-1] * len(body) if role is None else [2 * role, *[2 * role + 1] * (len(body) - 1)]
                    lines += [("" if hidden else style.format(names[role])) + body[0], *body[1:], ""]
                    states += [*own_states, -1 if role is None else 2 * role + 1]
                # The empty line after a turn stands between parts, too.
                keep = len(lines) - (part == n_parts - 1)
                out.append((conv, part, n_parts, "\n".join(lines[:keep]), states[:keep]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["conv_id", "part", "parts", "text", "states"])

    return parts.mapInArrow(run, RENDERED)


def fit(labelled: DataFrame) -> Model:
    """A model from transcripts (part, text, states)."""

    def run(batches):
        start, moves, emits = np.zeros(N_STATES, np.int64), np.zeros((N_STATES, N_STATES), np.int64), np.zeros((N_STATES, N_SYMBOLS), np.int64)
        for batch in batches:
            for part, text, states in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not text or not states:
                    continue
                seen, s = symbols(text.split("\n")), np.array(states)
                if s[0] >= 0 and part == 0:
                    start[s[0]] += 1
                sure = (s[:-1] >= 0) & (s[1:] >= 0)
                np.add.at(moves, (s[:-1][sure], s[1:][sure]), 1)
                np.add.at(emits, (s[s >= 0], seen[s >= 0]), 1)
        flat = np.concatenate([start, moves.ravel(), emits.ravel()])
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], names=["place", "n"])

    sums = labelled.select("part", "text", "states").mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(N_STATES + N_STATES**2 + N_STATES * N_SYMBOLS)
    for row in sums:
        flat[row["place"]] = row["n"]
    a, b = N_STATES, N_STATES + N_STATES**2
    return Model(flat[:a], flat[a:b].reshape(N_STATES, N_STATES), flat[b:].reshape(N_STATES, N_SYMBOLS))


PARSED = "conv_id bigint, part bigint, n_lines bigint, n_turns bigint, roles string, rendered string"


def _at_cuts(long: DataFrame, shared) -> DataFrame:
    """``conv_id, part, first, after``: the best states of the parts' first lines and of the lines after them."""

    def score(batches):
        for batch in batches:
            tables = [shared.value.scores(symbols(text.split("\n"))).ravel() for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tables, pa.list_(pa.float64()))], names=["conv_id", "part", "scores"])

    def product(batches):
        for batch in batches:
            tables = []
            for own in batch.column(2).to_pylist():
                all_of = [np.array(t["scores"]).reshape(N_STATES, -1) for t in own]
                tables.append(reduce(lambda x, y: times(x[:, :END], y), all_of).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tables, pa.list_(pa.float64()))], names=["conv_id", "part", "scores"])

    def read_back(batches):
        for batch in batches:
            out = []
            for conv, own, first, after in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                begin = shared.value.start if first is None else np.where(np.arange(N_STATES) == first, 0, -np.inf)
                after = END if after is None else after
                path = [*cuts([np.array(t["scores"]).reshape(N_STATES, -1) for t in own], begin, after), after]
                out += [(conv, t["part"], path[k], path[k + 1]) for k, t in enumerate(own)]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["conv_id", "part", "first", "after"])

    def grouped(level: DataFrame) -> DataFrame:
        groups = level.groupBy("conv_id", F.floor(F.col("part") / FAN).alias("group"))
        return groups.agg(F.sort_array(F.collect_list(F.struct("part", "scores"))).alias("own"))

    scored = "conv_id bigint, part bigint, scores array<double>"
    levels = [scratch.written(long.select("conv_id", "part", "text").mapInArrow(score, scored), "op7-scores")]
    while not levels[-1].where(F.col("part") >= FAN).isEmpty():
        levels.append(scratch.written(grouped(levels[-1]).mapInArrow(product, scored), "op7-products"))
    none = F.lit(None).cast("int")
    found = None
    for level in reversed(levels):
        groups = grouped(level)
        known = groups.withColumns({"first": none, "after": none}) if found is None else _joined(groups, found.withColumnRenamed("part", "group"), ["conv_id", "group"])
        found = scratch.written(known.mapInArrow(read_back, "conv_id bigint, part bigint, first int, after int"), "op7-cuts")
    return found


def parsed(transcripts: DataFrame, model: Model) -> DataFrame:
    """Transcripts (conv_id, part, parts, text) as canonical turns; ``roles`` has the first letter of each turn that
    begins in the part. Transcripts are read twice, so they should be a table."""
    shared = transcripts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            out = []
            for conv, part, text, first, after in zip(*(batch.column(k).to_pylist() for k in range(5))):
                after = END if after is None else after
                turns = turns_of(text, shared.value, first, after)
                roles = "".join(r[0] for r, _ in turns if r)
                out.append((conv, part, text.count("\n") + 1 if text else 0, len(roles), roles, canonical(turns, after != END and after % 2 == 1)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[c.split()[0] for c in PARSED.split(", ")])

    columns = ["conv_id", "part", "text", "first", "after"]
    none = F.lit(None).cast("int")
    short = transcripts.where("parts = 1").withColumns({"first": none, "after": none}).select(*columns)
    long = transcripts.where("parts > 1")
    if long.isEmpty():
        return short.mapInArrow(run, PARSED)
    cut = _joined(long, _at_cuts(long, shared), ["conv_id", "part"]).select(*columns)
    return short.unionByName(cut).mapInArrow(run, PARSED)


def op7_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    raw = scratch.written(rendered_from(turns), "op7-raw")
    taught = raw.where(F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 != 2, F.lit(False)))
    return parsed(raw, fit(taught))
