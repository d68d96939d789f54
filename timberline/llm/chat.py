"""Chat formatting with the cheapest repair of a conversation's roles.

A legal conversation has at most one system turn, first, then user and assistant turns by turns, and ends with an
assistant turn. Each given turn takes one of the three roles (another one than its own costs RELABEL, an unknown role
becomes any for UNKNOWN) and either starts a turn, continues the one before (MERGE) or comes after an empty turn that
is put in (INSERT each). The cheapest sequence is found by dynamic programming over the automaton's states.

Steps of the automaton are matrices of costs whose products (least sums) can be taken in any grouping. So a
conversation needs no task of its own: all turns are sorted by conversation and turn and cut into runs of CHUNK rows;
runs are multiplied apart, a scan over a conversation's runs finds the states at their borders, and each run then
finds its own path between these. Runs hold roles alone. Texts are joined to what was decided, a row a turn, so that no task holds
more than a row of them; turns come out with the piece of text that they add.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import grouped
from .tables import stash

RELABEL, UNKNOWN, MERGE, INSERT = 3, 1, 1, 2
CHUNK_BITS = 11
#: Turns whose runs one task scans for borders, on average, at most.
BORDER_TURNS = 1_000_000
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 30
CLOSE = "<|end|>\n"
#: How a state is followed by a role's turn, without a merge: the roles of empty turns put in between.
BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (SYSTEM, USER): (), (USER, ASSISTANT): (), (ASSISTANT, USER): (),
    (START, ASSISTANT): (USER,), (SYSTEM, ASSISTANT): (USER,), (USER, USER): (ASSISTANT,), (ASSISTANT, ASSISTANT): (USER,),
}
ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
END_COST = np.array([INSERT * len(ENDING[s]) for s in range(4)], np.int64)


def step_costs() -> np.ndarray:
    """costs[code, before, after] of a turn whose role is system, user, assistant (codes 0 to 2) or unknown (3)."""
    costs = np.full((4, 4, 4), NEVER, np.int64)
    for code in range(4):
        for before in range(4):
            for after in (SYSTEM, USER, ASSISTANT):
                label = UNKNOWN if code == 3 else 0 if code == after - 1 else RELABEL
                ways = [MERGE] if before == after else []
                if (before, after) in BETWEEN:
                    ways.append(INSERT * len(BETWEEN[before, after]))
                if ways:
                    costs[code, before, after] = label + min(ways)
    return costs


COSTS = step_costs()


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(2), NEVER)


def products(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The product of each run's matrices, runs laid end to end; runs are halved together."""
    matrix, run = COSTS[codes], np.repeat(np.arange(len(sizes)), sizes)
    while len(matrix) > len(sizes):
        first = np.searchsorted(run, np.arange(len(sizes)))
        place = np.arange(len(run)) - first[run]
        left = np.flatnonzero((place % 2 == 0))
        pair = left[(left + 1 < len(run)) & (run[np.minimum(left + 1, len(run) - 1)] == run[left])]
        matrix[pair] = multiply(matrix[pair], matrix[pair + 1])
        matrix, run = matrix[left], run[left]
    return matrix


def borders(matrices: np.ndarray) -> np.ndarray:
    """The states before each run of a conversation and after the last one, on a cheapest path."""
    ahead = [np.array([0, NEVER, NEVER, NEVER], np.int64)]
    for m in matrices:
        ahead.append(np.minimum((ahead[-1][:, None] + m).min(0), NEVER))
    states = [int((ahead[-1] + END_COST).argmin())]
    for v, m in zip(ahead[-2::-1], matrices[::-1], strict=True):
        states.append(int((v + m[:, states[-1]]).argmin()))
    return np.array(states[::-1])


def paths(codes: np.ndarray, sizes: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states before and after each turn, on the cheapest path of each run between its border states."""
    start = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    cost = np.full((len(sizes), 4), NEVER, np.int64)
    cost[np.arange(len(sizes)), entry] = 0
    back = np.zeros((len(codes), 4), np.int8)
    longest = int(sizes.max(initial=0))
    for t in range(longest):
        live = order[: int((sizes > t).sum())]
        total = cost[live][:, :, None] + COSTS[codes[start[live] + t]]
        back[start[live] + t] = total.argmin(1)
        cost[live] = np.minimum(total.min(1), NEVER)
    before, after, state = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64), leave.astype(np.int64).copy()
    for t in range(longest - 1, -1, -1):
        live = order[: int((sizes > t).sum())]
        after[start[live] + t] = state[live]
        state[live] = back[start[live] + t, state[live]]
        before[start[live] + t] = state[live]
    return before, after


def tag(state: int) -> str:
    return f"<|{ROLES[state - 1]}|>\n"


def opening(before: int, after: int) -> str:
    """What a turn between two states adds before its text: what it closes, what is put in, and its own tag."""
    if before == after:
        return "\n"
    put = BETWEEN.get((before, after), ())
    return (CLOSE if before else "") + "".join(tag(s) + CLOSE for s in put) + (tag(after) if after else "")


def closing(state: int) -> str:
    """What the last turn adds after its text."""
    return CLOSE + "".join(tag(s) + CLOSE for s in ENDING[state])


def rendered(before: Column, after: Column, text: Column, last: Column) -> tuple[Column, Column]:
    """A turn's action and the piece of text that it adds."""
    move = before * 4 + after + 1
    moves = [(b, a) for b in range(4) for a in range(4)]
    action = F.element_at(F.array(*(F.lit("merge" if b == a else "insert" if BETWEEN.get((b, a)) else "keep") for b, a in moves)), move)
    start = F.element_at(F.array(*(F.lit(opening(b, a)) for b, a in moves)), move)
    end = F.when(last, F.element_at(F.array(*(F.lit(closing(a)) for a in range(4))), after + 1)).otherwise(F.lit(""))
    return action, F.concat(start, F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |")), end)


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return column.flatten(), np.asarray(column.value_lengths())


def _multiply_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns, sizes = _lists(batch.column("turns"))
        matrix = products(turns.field("code").to_numpy(), sizes).reshape(-1)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                batch.column("chunk"),
                pa.array(sizes.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, len(matrix) + 1, 16, dtype=np.int32)), pa.array(matrix.astype(np.int32))),
            ],
            ["key", "chunk", "n", "matrix"],
        )


def _border_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in grouped(batches, ["key"]):
        n = group.column("n").to_numpy().astype(np.int64)
        matrix = group.column("matrix").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, 4, 4)
        states = borders(matrix)
        yield pa.RecordBatch.from_arrays(
            [
                group.column("key").combine_chunks(),
                group.column("chunk").combine_chunks(),
                pa.array(np.cumsum(n) - n),
                pa.array(states[:-1].astype(np.int32)),
                pa.array(states[1:].astype(np.int32)),
                pa.array(np.arange(len(n)) == len(n) - 1),
            ],
            ["key", "chunk", "offset", "entry", "leave", "last"],
        )


def _path_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns, sizes = _lists(batch.column("turns"))
        before, after = paths(
            turns.field("code").to_numpy(), sizes, batch.column("entry").to_numpy(), batch.column("leave").to_numpy()
        )
        run = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(run)) - (np.cumsum(sizes) - sizes)[run]
        yield pa.RecordBatch.from_arrays(
            [
                turns.field("at"),
                pa.array(batch.column("offset").to_numpy()[run] + inside),
                pa.array(before.astype(np.int32)),
                pa.array(after.astype(np.int32)),
                pa.array(batch.column("last").to_numpy(zero_copy_only=False)[run] & (inside == sizes[run] - 1)),
            ],
            ["at", "place", "before", "after", "last"],
        )


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, place (from 0), new_role, action and piece of every row of ``turns``.

    A conversation's text is its pieces, by place, end to end. Turns are ordered by turn (nulls last), then role and
    text; repeated rows are turns like others. Rows of null conv_id form one conversation. Roles are compared without
    spaces around them and capitals; null and unknown ones may become any role. Null texts are empty; ``<|`` in a text
    gets a space, so that no text can pose as a tag. action is keep, merge or insert, and a role other than the given
    one shows a relabel. Columns other than conv_id, turn, role and text are left out, those named like an output
    column too. Texts of any length are taken whole, one in memory at a time.
    An empty table gives no rows.
    """
    role = F.lower(F.trim("role"))
    code = F.when(role == "system", 0).when(role == "user", 1).when(role == "assistant", 2).otherwise(3)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.xxhash64("text"), F.col("row")]
    # the row number only lets a range border fall between rows that are the same
    rows = turns.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("row"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.col("conv_id"), "turn", "role", "text", code.alias("code"), F.monotonically_increasing_id().alias("at")
    )
    placed = stash(
        placed.select("*", F.shiftright("at", CHUNK_BITS).alias("chunk"), F.coalesce(F.concat(F.lit("id "), F.col("conv_id").cast("string")), F.lit("")).alias("key"))
    )
    coded = placed.groupBy("key", "chunk").agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("turns"))
    matrices = coded.mapInArrow(_multiply_batches, "key string, chunk bigint, n int, matrix array<int>")
    # one row for each run of a conversation: a hot conversation has one in 2**CHUNK_BITS of its turns here. The number
    # of parts is given, as adaptive execution would put so few bytes into one task, whatever work they make
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-placed.count() // BORDER_TURNS))
    found = (
        matrices.repartition(parts, "key")
        .sortWithinPartitions("key", "chunk")
        .mapInArrow(_border_batches, "key string, chunk bigint, offset bigint, entry int, leave int, last boolean")
    )
    decided = (
        coded.join(found, ["key", "chunk"])
        .select("turns", "offset", "entry", "leave", "last")
        .mapInArrow(_path_batches, "at bigint, place bigint, before int, after int, last boolean")
    )
    action, piece = rendered(F.col("before"), F.col("after"), F.col("text"), F.col("last"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("after"))
    return placed.select("at", "conv_id", "turn", "role", "text").join(decided, "at").select(
        "conv_id", "turn", "role", "place", role.alias("new_role"), action.alias("action"), piece.alias("piece")
    )
