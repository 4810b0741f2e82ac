"""Chat formatting with minimum-cost role repair.

Legal conversations are the paths of an automaton: an optional system turn, then user and assistant
in turn, ending with the assistant. A dynamic program over its states finds, for the turns as they
are, the cheapest repair: a turn is kept, merged into the turn before it, given another role, or has
empty turns put before it; empty turns may follow the last one. Then the repaired turns are rendered.

The program's step is a matrix of costs between states, so a conversation may be cut: turns are
sorted by range, and each range gives the matrix of its part of a conversation. From these the few
conversations that several ranges share get the costs of what follows each cut; with them each range
repairs its part as the whole conversation would be repaired, whatever the cuts.

Defined cases: a null or unknown role has to be relabelled; a null text is an empty one; turns of one
number are ordered by role and text; a null conv_id is a conversation of its own, a null turn comes
first; markers inside a text are broken up by a space; an empty table gives no rows. Of repairs with
equal cost the one that keeps, then merges, then relabels the earlier turn is taken. Conversations of
any length are cut as above; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, pairs, parts, staged, table, to_batch

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
#: Roles that may follow a state.
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: States in which a conversation may end.
ENDS = (ASSISTANT,)
MERGE, RELABEL, INSERT = 1, 2, 3
NEVER = 1 << 40


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """For each state and role the shortest line of empty turns after which the role may follow."""
    out = {}
    for state in range(4):
        lines = [()]
        while lines:
            nxt = []
            for line in lines:
                for role in FOLLOWS[line[-1] if line else state]:
                    if (state, role) not in out:
                        out[state, role] = line
                        nxt.append((*line, role))
            lines = nxt
    return out


PATHS = _paths()


def steps(role: int, state: int) -> list[tuple[int, int, str, int]]:
    """(cost, next state, action, empty turns before) of each way to take a turn; role 0: unknown."""
    out = []
    for to in (SYSTEM, USER, ASSISTANT):
        other = RELABEL * (to != role)
        if (state, to) in PATHS:
            n = len(PATHS[state, to])
            out.append((other + INSERT * n, to, "relabel" if other else "keep", n))
        if to == state:
            out.append((other + MERGE, to, "relabel_merge" if other else "merge", 0))
    order = {"keep": 0, "merge": 1, "relabel": 2, "relabel_merge": 3}
    return sorted(out, key=lambda s: (s[0], order[s[2]], s[1]))


STEPS = {(role, state): steps(role, state) for role in range(4) for state in range(4)}


def ending(state: int) -> tuple[int, tuple[int, ...]]:
    """Cost and line of the empty turns that bring a state to a legal end; a conversation without turns needs none."""
    if state in ENDS:
        return 0, ()
    best = min(((INSERT * (len(PATHS[state, e]) + 1), (*PATHS[state, e], e)) for e in ENDS if (state, e) in PATHS), default=(NEVER, ()))
    return best


def costs(roles: list[int], first: int) -> list[list[int]]:
    """costs[t][s]: of the cheapest way from state first through the first t turns to state s."""
    out = [[0 if s == first else NEVER for s in range(4)]]
    for role in roles:
        row = [NEVER] * 4
        for state, c in enumerate(out[-1]):
            if c < NEVER:
                for more, to, _, _ in STEPS[role, state]:
                    row[to] = min(row[to], c + more)
        out.append(row)
    return out


ENDING = tuple(ending(s)[0] for s in range(4))


def repair(roles: list[int], first: int = START, rest: tuple[int, ...] = ENDING) -> tuple[int, list[tuple[str, int, int, int]], int]:
    """Cost to the end of the conversation, (action, new role, empty turns before, state before) for each turn, and the last state.

    rest: for each state, the least cost of what follows these turns.
    """
    after = [[NEVER] * 4 for _ in range(len(roles) + 1)]
    after[-1] = list(rest)
    for t in range(len(roles) - 1, -1, -1):
        for state in range(4):
            after[t][state] = min((c + after[t + 1][to] for c, to, _, _ in STEPS[roles[t], state]), default=NEVER)
    out, state = [], first
    for t, role in enumerate(roles):
        c, to, action, n = next(s for s in STEPS[role, state] if s[0] + after[t + 1][s[1]] == after[t][state])
        out.append((action, to, n, state))
        state = to
    return after[0][first], out, state


def _clean(text: str | None) -> str:
    return (text or "").replace("<|", "< |")


def _open(role: int) -> str:
    return f"<|im_start|>{NAMES[role]}\n"


CLOSE = "<|im_end|>\n"


def rendered(text: str | None, action: str, role: int, n: int, state: int) -> str:
    """A turn's part of the conversation's text; the turn before it is closed here."""
    if action.endswith("merge"):
        return "\n\n" + _clean(text)
    empty = "".join(_open(r) + CLOSE for r in PATHS[state, role])
    return (CLOSE if state != START else "") + empty + _open(role) + _clean(text)


def _number(role: str | None) -> int:
    return NAMES.index(role) if role and role in NAMES else 0


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """(range, conversation) and its rows, in order."""
    now, held = None, []
    for b in batches:
        for row in pairs(b):
            if (key := row[:2]) != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(row)
    if held:
        yield now, held


def format_chats(turns: DataFrame) -> DataFrame:
    """Each turn with its repair: conv_id, place (in the conversation), turn, role, new_role, action, inserted, inserted_after, cost (of the conversation), rendered.

    The rendered parts in the order of place are the conversation.
    """
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.lower(F.trim(F.col("role").cast("string"))).alias("known"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    n = parts(turns, 4)
    key = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    rows = rows.repartitionByRange(n, *key).sortWithinPartitions(*key)
    rows = staged(rows.select(F.spark_partition_id().alias("range"), "conv_id", F.monotonically_increasing_id().alias("line"), "turn", "known", "role", "text"), "turns")
    dealt = lambda *columns: rows.select(*columns).repartition(n, "range").sortWithinPartitions("range", "line")

    # conversations that several ranges share: at most two for each range
    shared = rows.groupBy("conv_id").agg(F.min("range").alias("a"), F.max("range").alias("b")).where("a < b").select(F.col("conv_id").alias("id"))
    cut = dealt("range", "conv_id", "line", "known").join(F.broadcast(shared), F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")
    cut = cut.sortWithinPartitions("range", "line")
    schema = pa.schema([("range", pa.int32()), ("conv_id", pa.int64()), ("n", pa.int64()), ("costs", pa.list_(pa.int64()))])

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, conv), held in _parts_of(batches):
            roles = [_number(r[3]) for r in held]
            yield to_batch([(part, conv, len(held), [c for first in range(4) for c in costs(roles, first)[-1]])], schema)

    found: dict = {}
    for r in arrow_map(cut, matrix, "range int, conv_id long, n long, costs array<long>").collect():
        found.setdefault(r.conv_id, []).append((r.range, r.n, r.costs))
    #: of each part of a shared conversation: its first place, what follows it costs, and whether it is the last
    known: dict[tuple, tuple[int, tuple[int, ...], bool]] = {}
    for conv, line in found.items():
        line.sort()
        place, rest = sum(k for _, k, _ in line), ENDING
        for part, k, m in reversed(line):
            place -= k
            known[part, conv] = (place, rest, (part, k, m) == line[-1])
            rest = tuple(min(m[4 * s + to] + rest[to] for to in range(4)) for s in range(4))
    ends_in = pa.schema([("range", pa.int32()), ("conv_id", pa.int64()), ("states", pa.list_(pa.int64())), ("cost", pa.int64())])

    def last_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, conv), held in _parts_of(batches):
            made = [repair([_number(r[3]) for r in held], first, known[part, conv][1]) if first == START or known[part, conv][0] else (0, [], first) for first in range(4)]
            yield to_batch([(part, conv, [m[2] for m in made], made[START][0])], ends_in)

    # the state at each cut, from left to right
    states: dict[tuple, tuple[int, int]] = {}
    if known:
        now: dict = {}
        for r in sorted(arrow_map(cut, last_states, "range int, conv_id long, states array<long>, cost long").collect(), key=lambda r: r.range):
            first, cost = now.get(r.conv_id, (START, r.cost))
            states[r.range, r.conv_id] = (first, cost)
            now[r.conv_id] = (r.states[first], cost)
    out = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("inserted", pa.int32()), ("inserted_after", pa.int32()), ("cost", pa.int64()), ("rendered", pa.string())])

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for (part, conv), held in _parts_of(batches):
            begin, rest, ends = known.get((part, conv), (0, ENDING, True))
            first, whole = states.get((part, conv), (START, None))
            cost, turns_, last = repair([_number(r[4]) for r in held], first, rest)
            tail = ending(last)[1]
            for k, ((_, _, _, turn, _, role, text), (action, to, n_empty, state)) in enumerate(zip(held, turns_)):
                piece, end = rendered(text, action, to, n_empty, state), ends and k == len(held) - 1
                if end:
                    piece += CLOSE + "".join(_open(r) + CLOSE for r in tail)
                made.append((conv, begin + k, turn, role, NAMES[to], action, n_empty, len(tail) if end else 0, cost if whole is None else whole, piece))
            if len(made) > 2000:
                yield to_batch(made, out)
                made = []
        yield to_batch(made, out)

    ddl = "conv_id long, place long, turn long, role string, new_role string, action string, inserted int, inserted_after int, cost long, rendered string"
    return arrow_map(dealt("range", "conv_id", "line", "turn", "known", "role", "text"), mend, ddl)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, repaired and rendered."""
    return format_chats(table(spark, sf_dir, "conversations"))
