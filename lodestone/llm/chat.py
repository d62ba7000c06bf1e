"""Chat formatting: minimum-cost role repair over a legal-turn automaton, then rendering.

Legal: an optional system turn first, then user and assistant in turn, ending with the assistant. For each turn the
repair may keep its role, relabel it, merge it into the output turn before, or insert an empty turn before it; an empty
assistant turn may close the conversation. The cheapest repair is found by dynamic programming over the role of the
last output turn; among equal costs the earlier entry of STATES wins, from the last turn backwards.

A conversation may be of any length: the turns are range-partitioned by (conversation, turn), every stretch of a
conversation in a partition is reduced to a small matrix of costs from state to state, the few conversations that cross
partitions are settled on those matrices, and each stretch is then repaired by itself between its settled states.

Ids and turns are passed on as Arrow columns, exactly, whatever their type. A worker holds one stretch at a time, at most
what a partition has of one conversation.

Roles are compared trimmed and in lower case; ALIASES are taken as the roles they name; a null or unknown role may
become any role at the price of `guess`. Null text: the empty text. Null conv_id: one conversation of its own. Null turn: before all
others. Repeated turns: ordered by role and text, each is a turn. Very long texts: passed on whole. An empty table: no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable

STATES = ("none", "system", "user", "assistant")
#: Roles by other names, and prices.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MERGE, INSERT, RELABEL, GUESS = 1.0, 2.0, 3.0, 1.0
NEXT = {("none", "system"), ("none", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"
FAR = 1e18
#: Turns of the conversations whose repairs a worker remembers, and rows that it hands on together.
SHORT, ROWS = 24, 5_000


def role_of(role) -> str:
    name = role.strip().lower() if isinstance(role, str) else ""
    name = ALIASES.get(name, name)
    return name if name in STATES[1:] else "unknown"


def moves(role: str) -> list[list[tuple[float, str, str]]]:
    """[from][to]: (cost, action, inserted role) of a turn of that role; to is its role in the output."""
    out = [[(FAR, "", "")] * 4 for _ in STATES]
    for (i, a), (j, b) in product(enumerate(STATES), enumerate(STATES)):
        if b == "none":
            continue
        own, label = (0.0, "keep") if role == b else (GUESS, "guess") if role == "unknown" else (RELABEL, "relabel")
        ways = []
        if (a, b) in NEXT:
            ways.append((own, label, ""))
        if a == b:
            ways.append((own + MERGE, "merge" if label == "keep" else f"{label}+merge", ""))
        ways += [(own + INSERT, f"{label}+insert", x) for x in STATES[2:] if (a, x) in NEXT and (x, b) in NEXT]
        if ways:
            out[i][j] = min(ways, key=lambda w: w[0])
    return out


MOVES = {role: moves(role) for role in (*STATES[1:], "unknown")}
COSTS = {role: [[w[0] for w in line] for line in m] for role, m in MOVES.items()}
#: From each state to the end of the conversation.
END = [0.0, INSERT * 2, INSERT, 0.0]


def through(roles: list[str]) -> list[list[float]]:
    """Least cost from state to state over a stretch of turns."""
    best = [[0.0 if i == j else FAR for j in range(4)] for i in range(4)]
    for role in roles:
        c = COSTS[role]
        best = [[min(row[k] + c[k][j] for k in range(4)) for j in range(4)] for row in best]
    return best


def repair(roles: list[str] | tuple[str, ...], start: int = 0, end: int | None = None) -> list[int]:
    """The state after each turn on the cheapest way; end None: at the end of the conversation."""
    best, back = [0.0 if i == start else FAR for i in range(4)], []
    for role in roles:
        c = COSTS[role]
        step = [min(range(4), key=lambda k: best[k] + c[k][j]) for j in range(4)]  # noqa: B023
        best = [best[k] + c[k][j] for j, k in enumerate(step)]
        back.append(step)
    at = min(range(4), key=lambda j: best[j] + END[j]) if end is None else end
    states = []
    for step in reversed(back):
        states.append(at)
        at = step[at]
    return states[::-1]


@lru_cache(maxsize=20_000)
def _remembered(roles: tuple[str, ...], start: int, end: int | None) -> list[int]:
    return repair(roles, start, end)


def _settle(met: pa.Table) -> pa.Table:
    """Start and end states of the stretches of one conversation, from their matrices: one row for each partition it is in."""
    met = met.sort_by("part")
    best, back = [0.0, FAR, FAR, FAR], []
    for m in met["costs"].to_pylist():
        step = [min(range(4), key=lambda k: best[k] + m[4 * k + j]) for j in range(4)]  # noqa: B023
        best = [best[k] + m[4 * k + j] for j, k in enumerate(step)]
        back.append(step)
    at = min(range(4), key=lambda j: best[j] + END[j])
    ends, starts = [], []
    for step in reversed(back):
        ends.append(at)
        at = step[at]
        starts.append(at)
    states = [pa.array(x[::-1], pa.int32()) for x in (starts, ends)]
    return pa.table([met["conv"], met["part"], *states, pa.array([k == len(back) - 1 for k in range(len(back))])], ["conv", "part", "enter", "leave", "final"])


def _starts(conv: pa.Array) -> list[int]:
    """Where in a column a value follows another one; nulls are equal to each other."""
    a, b = conv.slice(1), conv.slice(0, max(0, len(conv) - 1))
    differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return (np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1).tolist()


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Each run of one conversation in a sorted partition, however the batches cut it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv")
        edge = [0, *_starts(conv), batch.num_rows]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if held and (a or held[-1].column("conv")[-1].as_py() != conv[0].as_py()):
                yield held
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def _roles(run: list[pa.RecordBatch]) -> list[str]:
    return [role_of(r) for part in run for r in part.column("role").to_pylist()]


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, turn_col, place, role_in, role_out, action, inserted, cost, piece), a row for each turn.

    The pieces of a conversation, joined in the order of place, are its rendering.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = ["conv", "turn", "role", "text"]
    # Sorted and numbered once, in the shared folder: later steps must all see the same stretches.
    ranged = durable(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))
    conv, turn = (rows.schema[k].dataType.simpleString() for k in ("conv", "turn"))

    # A partition shares a conversation with others only at its ends.
    spread = (
        ranged.groupBy("part").agg(F.min(F.struct("conv", "turn")).getField("conv").alias("low"), F.max(F.struct("conv", "turn")).getField("conv").alias("high"))
        .select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("conv"))
    )
    across = spread.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("wide"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _stretches(batches):
            costs = [x for line in through(_roles(run)) for x in line]
            yield pa.RecordBatch.from_arrays([run[0].column("conv").slice(0, 1), run[0].column("part").slice(0, 1), pa.array([costs], pa.list_(pa.float64()))], ["conv", "part", "costs"])

    crossing = ranged.join(F.broadcast(across), F.col("conv").eqNullSafe(F.col("wide"))).select("conv", "part", "role")
    settled = crossing.mapInArrow(matrices, f"conv {conv}, part int, costs array<double>").groupBy("conv").applyInArrow(_settle, f"conv {conv}, part int, enter int, leave int, final boolean")
    # At most two stretches a partition are settled this way, so their number is bounded by that of the partitions.
    settled = durable(settled).select(F.col("conv").alias("c"), F.col("part").alias("p"), "enter", "leave", "final")
    joined = ranged.join(F.broadcast(settled), F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").select(*keys, "part", "enter", "leave", "final")
    names = ["place", "role_out", "action", "inserted", "cost", "piece"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed, made, kept = 0, [], []

        def flush() -> pa.RecordBatch:
            own = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            new = [pa.array(x, kind) for x, kind in zip(zip(*made, strict=True), kinds, strict=True)]
            made.clear()
            kept.clear()
            return pa.RecordBatch.from_arrays([own.column("conv"), own.column("turn"), new[0], own.column("role"), *new[1:]], ["conv", "turn", "place", "role_in", *names[1:]])

        for run in _stretches(batches):
            enter, leave, final, part = (run[0].column(k)[0].as_py() for k in ("enter", "leave", "final", "part"))
            roles = _roles(run)
            last, at = enter is None or final, enter or 0
            states = (_remembered if len(roles) <= SHORT else repair)(tuple(roles), at, leave)
            n = 0
            for piece_of in run:
                for text in piece_of.column("text").to_pylist():
                    to = states[n]
                    cost, action, extra = MOVES[roles[n]][at][to]
                    if "merge" in action:
                        piece = "\n\n" + text
                    else:
                        piece = (CLOSE if at else "") + (OPEN.format(extra) + CLOSE if extra else "") + OPEN.format(STATES[to]) + text
                    if last and n == len(roles) - 1:
                        ending = {1: ("user", "assistant"), 2: ("assistant",)}.get(to, ())
                        piece += CLOSE + "".join(OPEN.format(x) + CLOSE for x in ending)
                        cost += END[to]
                        action += "+close" if ending else ""
                    made.append(((part << 33) + passed, STATES[to], action, extra or None, cost, piece))
                    passed, at, n = passed + 1, to, n + 1
                kept.append(piece_of.select(["conv", "turn", "role"]))
                if len(made) >= ROWS:
                    yield flush()
        if made:
            yield flush()

    out = joined.mapInArrow(render, f"conv {conv}, turn {turn}, place long, role_in string, role_out string, action string, inserted string, cost double, piece string")
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), "place", "role_in", "role_out", "action", "inserted", "cost", "piece")


def rendered(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, cost, chat): whole renderings, for conversations that fit in a row."""
    return formatted.groupBy(conv_col).agg(
        F.sum("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "piece"))), lambda t: t["piece"]), "").alias("chat")
    )
