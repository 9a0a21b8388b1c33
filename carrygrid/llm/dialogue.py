"""Repair of damaged conversations by the cheapest edits, with a reproducible choice among equals.

A conversation is repaired by keeping, re-labelling or deleting its rows and by
inserting empty ones, so that its roles read ``(s?(ua)+)?``. Nodes are the places
between rows, each with what the roles so far allow next: nothing yet, after a system
row, after a user row, after an assistant row. Costs to the end are computed backwards
(cost DP); arcs on cheapest paths are optimal. Nodes are then ranked by the audits that
start there: by their first edit, and round by round by twice as many edits, each a pair of
ranks (prefix doubling). Ranks choose an arc at every node, and the doubled pointers
of the rounds give the nodes of the least audit from the start on.

Rows are sorted by ranges of (conversation, turn, role, text), so a conversation of any size is spread.
Tasks cut it into blocks of at most ``BLOCK_ROWS`` rows. A conversation that lies
within one block, as nearly all do, is repaired on the spot, many together. The
others send a matrix per block, the cost between all states at its ends; a few numbers
for thousands of rows, from which the costs beyond each block follow. Their blocks are then
visited in order, as the digest of the repaired text must be.

Nulls in role, text and ids count as one space (ids: in the damage rule), a null turn sorts first. Rows with
the same turn are ordered by role and text. A null conv_id is a conversation of its own.
Blank texts, repeated rows and very long texts are faults or text like any other. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from carrygrid.llm.importance import CRC_SQL, crc_sql
from carrygrid.llm.store import written

WHITE = " \t\n\x0b\x0c\r"
BLOCK_ROWS, BLOCK_CHARS = 4096, 4_000_000
BATCH_ROWS = 16_384
DELETE, INSERT, REROLE, OPEN_END = 4, 3, 3, 3
NEVER = 1 << 50
LABELS = np.frombuffer(b"DIKR", np.uint8)  # in ASCII order
NEW_ROLE = {2: "user", 3: "assistant"}
START = 0  # states: 0 nothing yet, then what came last: 1 system, 2 user, 3 assistant
AFTER = np.array([2, 2, 3, 2])  # state after the user or assistant row that may come next
ACCEPT = np.array([0, 2 * INSERT, INSERT, 0], np.int64)  # cost from each state to the end, rows left aside


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage rule; dropped ones stay with ``live`` false, so that no conversation is lost."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.encode(F.concat(named[0], F.lit(":"), named[1]), "UTF-8")) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("live"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


# ---- one block of rows -------------------------------------------------------------------


@dataclass
class Block:
    """Consecutive rows of a conversation, without dropped ones."""

    conv_id: int | None
    seq: int = 0
    turns: list = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    chars: int = 0
    seen: frozenset[bytes] = frozenset()  # prints of rows that earlier blocks hold

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)


def print_of(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


@dataclass
class Rows:
    """Rows of some blocks as arrays: state that the role leads to (0: none), fault (0 none, 1 blank, 2 duplicate, 3 truncated)."""

    bounds: np.ndarray
    state: np.ndarray
    fault: np.ndarray

    @classmethod
    def of(cls, blocks: list[Block]) -> Rows:
        state, fault = [], []
        for b in blocks:
            known: set[tuple[str, str]] = set()
            for role, text in zip(b.roles, b.texts):
                state.append("sua".find(role[0]) + 1 if role else 0)
                end = text.rstrip(WHITE)
                row = (role, text)
                if not end:
                    fault.append(1)
                elif row in known or (b.seen and print_of(role, text) in b.seen):
                    fault.append(2)
                else:
                    fault.append(0 if end[-1] in ".!?" else 3)
                known.add(row)
        bounds = np.concatenate(([0], np.cumsum([len(b.roles) for b in blocks]))).astype(np.int64)
        return cls(bounds, np.array(state, np.int64), np.array(fault, np.int64))

    @property
    def doomed(self) -> np.ndarray:
        return (self.fault == 1) | (self.fault == 2)


def inserted(cost: np.ndarray) -> np.ndarray:
    """Costs of the states of a place (rows x 4) when rows may be inserted there."""
    out = cost.copy()
    out[:, 2] = np.minimum(cost[:, 2], cost[:, 3] + INSERT)
    out[:, 3] = np.minimum(cost[:, 3], cost[:, 2] + INSERT)
    out[:, :2] = np.minimum(cost[:, :2], out[:, 2:3] + INSERT)
    return out


def costs(rows: Rows, right: np.ndarray) -> np.ndarray:
    """Cost from every place (rows plus one per block) and state to the end; ``right`` is that of the blocks' ends."""
    sizes = np.diff(rows.bounds)
    count = len(sizes)
    total = np.empty((len(rows.state) + count, 4), np.int64)
    last = rows.bounds[1:] + np.arange(count)
    total[last] = right
    order = np.argsort(-sizes, kind="stable")
    for step in range(1, int(sizes.max(initial=0)) + 1):
        active = order[: int((sizes >= step).sum())]
        row = rows.bounds[active + 1] - step
        after = total[last[active] - step + 1]
        extra = np.where(rows.doomed[row], NEVER, np.where(rows.fault[row] == 3, OPEN_END, 0))
        here = np.minimum(after + DELETE, after[:, AFTER] + REROLE + extra[:, None])
        keep = rows.state[row]
        fits = np.stack((keep > 0, keep == 2, keep == 3, keep == 2), axis=1)
        fits[:, 0] &= keep != 3
        kept = after[np.arange(len(active)), keep] + extra
        here = np.where(fits, np.minimum(here, kept[:, None]), here)
        total[last[active] - step] = inserted(here)
    return np.minimum(total, NEVER)


@dataclass
class Graph:
    """Optimal arcs: ``arcs[label, node]`` is the node that the edit leads to, -1 where it is not optimal."""

    arcs: np.ndarray
    block: np.ndarray  # of each place

    @classmethod
    def of(cls, rows: Rows, total: np.ndarray, closing: np.ndarray) -> Graph:
        """``closing`` tells the blocks that end their conversation, where rows may be inserted at the end too."""
        sizes = np.diff(rows.bounds)
        places = len(total)
        block = np.repeat(np.arange(len(sizes)), sizes + 1)
        place = np.arange(places)
        end = np.zeros(places, bool)
        end[rows.bounds[1:] + np.arange(len(sizes))] = True
        row = np.where(end, 0, place - block)
        has = ~end
        after = np.where(has, place + 1, place)
        state, fault = (x[row] if len(x) else np.zeros(places, np.int64) for x in (rows.state, rows.fault))
        extra = np.where((fault == 1) | (fault == 2), NEVER, np.where(fault == 3, OPEN_END, 0))
        arcs = np.full((4, places, 4), -1, np.int64)

        def offer(label: int, q: int, to: np.ndarray, cost: np.ndarray | int, possible: np.ndarray) -> None:
            goal = total[to // 4, to % 4]
            good = possible & (goal < NEVER) & (total[:, q] == goal + cost) & (total[:, q] < NEVER)
            arcs[label, good, q] = to[good]

        for q in range(4):
            offer(0, q, 4 * after + q, DELETE, has)
            offer(1, q, 4 * place + AFTER[q], INSERT, has | closing[block])
            fits = ((state == 1) & (q == 0)) | ((state == 2) & (q != 2)) | ((state == 3) & (q == 2))
            offer(2, q, 4 * after + state, extra, has & fits)
            offer(3, q, 4 * after + AFTER[q], REROLE + extra, has)
        return cls(arcs.reshape(4, -1), block)


def least_paths(graph: Graph, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the path, node, label) along the least audit from each entry node, in order.

    Ranks of nodes by their audits are refined from one edit to two, four and so on; ``pointers[k]`` leads
    2**k edits ahead. Nodes without an optimal arc are ends and lead to themselves.
    """
    nodes = graph.arcs.shape[1]
    some = graph.arcs >= 0
    end = ~some.any(axis=0)
    first = np.where(end, 0, some.argmax(axis=0))
    itself = np.arange(nodes)
    rank = np.where(end, 0, first + 1)
    pointer = np.where(end, itself, graph.arcs[first, itself])
    pointers = [pointer]
    while not end[pointer].all():
        _, rank = np.unique(rank * (nodes + 1) + rank[pointer], return_inverse=True)
        pointer = pointer[pointer]
        pointers.append(pointer)
    # The least arc of a node is that of the least edit, then of the target with the least rank.
    key = np.where(some, np.arange(4)[:, None] * (nodes + 1) + rank[graph.arcs], np.iinfo(np.int64).max)
    label = key.argmin(axis=0)
    path, place, node = np.arange(len(entry)), np.zeros(len(entry), np.int64), entry
    live = ~end[node]
    path, place, node = path[live], place[live], node[live]
    for k in reversed(range(len(pointers))):
        ahead = pointers[k][node]
        live = ~end[ahead]
        path = np.concatenate((path, path[live]))
        place = np.concatenate((place, place[live] + (1 << k)))
        node = np.concatenate((node, ahead[live]))
    order = np.lexsort((place, path))
    return path[order], node[order], label[node[order]]


@dataclass
class Piece:
    """What the repair of one block gives."""

    audit: str
    cost: int  # from its entry to the end of the conversation
    exit: int  # state behind it
    lines: list[str]


def repair(blocks: list[Block], rows: Rows, right: np.ndarray, closing: np.ndarray, entry: np.ndarray) -> list[Piece]:
    """The least audit of each block from its entry state on, given the costs beyond its end."""
    total = costs(rows, right)
    graph = Graph.of(rows, total, closing)
    start = 4 * (rows.bounds[:-1] + np.arange(len(blocks))) + entry
    path, node, label = least_paths(graph, start)
    to = graph.arcs[label, node]
    cut = np.searchsorted(path, np.arange(len(blocks) + 1))
    out = []
    for i, b in enumerate(blocks):
        some = slice(cut[i], cut[i + 1])
        lines = []
        for edit, x, y in zip(label[some].tolist(), node[some].tolist(), to[some].tolist()):
            at = x // 4 - i - int(rows.bounds[i])
            if edit == 1:
                lines.append(f"{NEW_ROLE[y % 4]}:")
            elif edit == 2:
                lines.append(f"{b.roles[at]}:{b.texts[at]}")
            elif edit == 3:
                lines.append(f"{NEW_ROLE[y % 4]}:{b.texts[at]}")
        behind = int(to[some][-1]) % 4 if cut[i + 1] > cut[i] else int(entry[i])
        out.append(Piece(LABELS[label[some]].tobytes().decode(), int(total.ravel()[start[i]]), behind, lines))
    return out


def matrix(rows: Rows) -> np.ndarray:
    """Costs (states at the left, states at the right) of one block."""
    ends = np.where(np.eye(4, dtype=bool), 0, NEVER).astype(np.int64)
    return np.stack([costs(rows, ends[q : q + 1])[0] for q in range(4)], axis=1)


# ---- whole conversations -------------------------------------------------------------------


class Tally:
    """Digest of a conversation, block by block in order."""

    def __init__(self) -> None:
        self.faults = np.zeros(4, np.int64)
        self.illegal = self.distinct = self.cost = 0
        self.last_state: int | None = None
        self.least = self.most = None
        self.audit: list[str] = []
        self.sha = hashlib.sha256()
        self.state, self.begun, self.first = START, False, True

    def add(self, b: Block, rows: Rows, i: int, piece: Piece) -> None:
        a, z = rows.bounds[i], rows.bounds[i + 1]
        self.faults += np.bincount(rows.fault[a:z], minlength=4)
        for s in rows.state[a:z].tolist():
            if self.last_state is not None and (self.last_state, s) not in ((1, 2), (2, 3), (3, 2)):
                self.illegal += 1
            self.last_state = s
        for t in b.turns:
            if t is not None and t != self.most:
                self.distinct += 1
                self.least, self.most = (t if self.least is None else self.least), t
        if self.first:
            self.cost, self.first = piece.cost, False
        self.audit.append(piece.audit)
        self.state = piece.exit
        for line in piece.lines:
            self.sha.update((f"\n{line}" if self.begun else line).encode("utf-8", "surrogatepass"))
            self.begun = True

    def row(self, conv_id: int | None) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.distinct
        _, blank, duplicate, truncated = self.faults.tolist()
        return conv_id, gaps, blank, duplicate, truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


RESULT = {
    "conv_id": pa.int64(), "gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(),
    "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string(),
}
RESULT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
OPEN = {
    "part": pa.int32(), "seq": pa.int32(), "turns": pa.list_(pa.int64()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()),
}
OPEN_DDL = "part int, seq int, turns array<long>, roles array<string>, texts array<string>"


def _columns(rows: list[tuple], kinds: dict[str, pa.DataType]) -> list[pa.Array]:
    return [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds.values())]


def _whole(blocks: list[Block]) -> list[tuple]:
    """Digests of conversations that are one block each."""
    rows = Rows.of(blocks)
    n = len(blocks)
    pieces = repair(blocks, rows, np.tile(ACCEPT, (n, 1)), np.ones(n, bool), np.zeros(n, np.int64))
    out = []
    for i, (b, piece) in enumerate(zip(blocks, pieces)):
        tally = Tally()
        tally.add(b, rows, i, piece)
        out.append(tally.row(b.conv_id))
    return out


def _cut(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows in; digests of whole conversations and blocks of those that may go on in other tasks out."""
    part = TaskContext.get().partitionId()
    names = [*RESULT, *OPEN]

    def closed(blocks: list[Block]) -> pa.RecordBatch:
        found = _columns(_whole(blocks), RESULT)
        return pa.RecordBatch.from_arrays([*found, *(pa.nulls(len(blocks), k) for k in OPEN.values())], names=names)

    def left_open(b: Block) -> pa.RecordBatch:
        own = _columns([(part, b.seq, b.turns, b.roles, b.texts)], OPEN)
        first, *rest = RESULT.items()
        return pa.RecordBatch.from_arrays([pa.array([b.conv_id], first[1]), *(pa.nulls(1, k) for _, k in rest), *own], names=names)

    ready: list[Block] = []
    waiting = chars = 0
    current: Block | None = None
    edge = True  # the first and the last conversation of a task may lie in others too
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:3]]
        for conv_id, turn, role, text, live in zip(*columns, batch.column(3), batch.column(4).to_pylist()):
            if current is None:
                current = Block(conv_id)
            elif current.conv_id != conv_id:
                if edge or current.seq:
                    yield left_open(current)
                else:
                    ready.append(current)
                    waiting += len(current.roles) + 1
                    chars += current.chars
                edge, current = False, Block(conv_id)
                if waiting >= BATCH_ROWS or chars >= BLOCK_CHARS:
                    yield closed(ready)
                    ready, waiting, chars = [], 0, 0
            elif len(current.roles) >= block_rows or current.chars >= BLOCK_CHARS:
                yield left_open(current)
                current = Block(conv_id, current.seq + 1)
            if live:
                current.add(turn, role, text.as_py())
    if ready:
        yield closed(ready)
    if current is not None:
        yield left_open(current)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[Block, dict]]:
    """The open blocks of a batch, with their other columns."""
    for x in batch.to_pylist():
        yield Block(x["conv_id"], x["seq"], x["turns"], x["roles"], x["texts"], 0, frozenset(x.get("seen") or ())), x


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b, x in _blocks(batch):
            found = sorted({print_of(r, t) for r, t in zip(b.roles, b.texts)})
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.conv_id] * n, pa.int64()), pa.array([x["part"]] * n, pa.int32()), pa.array([b.seq] * n, pa.int32()), pa.array(found, pa.binary())],
                names=["conv_id", "part", "seq", "print"],
            )


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(b.conv_id, x["part"], b.seq, matrix(Rows.of([b])).ravel().tolist()) for b, x in _blocks(batch)]
        yield pa.RecordBatch.from_arrays(
            _columns(rows, {"c": pa.int64(), "p": pa.int32(), "s": pa.int32(), "m": pa.list_(pa.int64())}), names=["conv_id", "part", "seq", "matrix"]
        )


def _beyond(blocks: pd.DataFrame) -> pd.DataFrame:
    """Costs beyond each block of one conversation, from the last block to the first."""
    blocks = blocks.sort_values(["part", "seq"], ascending=False)
    right, found = ACCEPT, []
    for values in blocks["matrix"]:
        found.append(right.tolist())
        right = np.minimum((np.asarray(values).reshape(4, 4) + right).min(axis=1), NEVER)
    closing = [True] + [False] * (len(found) - 1)
    return pd.DataFrame({"conv_id": blocks["conv_id"].astype("Int64"), "part": blocks["part"], "seq": blocks["seq"], "beyond": found, "closing": closing})


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by conversation and place in, digests out; one block is held at a time."""
    tally: Tally | None = None
    for batch in batches:
        for row in range(batch.num_rows):
            b, x = next(_blocks(batch.slice(row, 1)))
            tally = tally or Tally()
            rows = Rows.of([b])
            (piece,) = repair([b], rows, np.array([x["beyond"]], np.int64), np.array([x["closing"]]), np.array([tally.state]))
            tally.add(b, rows, 0, piece)
            if x["closing"]:
                yield pa.RecordBatch.from_arrays(_columns([tally.row(b.conv_id)], RESULT), names=list(RESULT))
                tally = None


def _beside(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join by columns of the same names, nulls being equal."""
    other = b.withColumnsRenamed({n: f"_{n}" for n in names})
    same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    return a.join(other, same, how).drop(*[f"_{n}" for n in names])


def _stitched(blocks: DataFrame) -> DataFrame:
    """Digests of the conversations that lie in several blocks."""
    place = ["conv_id", "part", "seq"]
    prints = blocks.mapInArrow(_prints, "conv_id long, part int, seq int, print binary")
    shared = prints.groupBy("conv_id", "print").agg(F.min(F.struct("part", "seq")).alias("held"), F.count("*").alias("n")).where("n > 1")
    again = _beside(prints, shared, ["conv_id", "print"]).where("struct(part, seq) > held")
    marked = _beside(blocks, again.groupBy(*place).agg(F.collect_list("print").alias("seen")), place, "left")
    matrices = marked.mapInArrow(_matrices, "conv_id long, part int, seq int, matrix array<long>")
    beyond = matrices.groupBy("conv_id").applyInPandas(_beyond, "conv_id long, part int, seq int, beyond array<long>, closing boolean")
    full = _beside(marked, beyond, place)
    return full.repartition("conv_id").sortWithinPartitions(*place).mapInArrow(_in_order, RESULT_DDL)


def repaired(spark: SparkSession, rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Digest of the repair of every conversation of ``rows`` (conv_id, turn, role, text, live)."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.select("conv_id", "turn", "role", "text", "live").repartitionByRange(*order[:3], F.substring("text", 1, 64)).sortWithinPartitions(*order)
    # Both parts of the result read this table, and a lost executor does not sort again.
    cut = written(spark, dealt.mapInArrow(lambda batches: _cut(batches, block_rows), f"{RESULT_DDL}, {OPEN_DDL}"), "conversations")
    return cut.where("part is null").select(*RESULT).unionByName(_stitched(cut.where("part is not null").select("conv_id", *OPEN)))


def report(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    return repaired(spark, damaged(conversations))


# ---- the same in SQL -----------------------------------------------------------------------


def _step(cost: str, label: str, line: str, state: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': '{label}' || {state}.a, 'r': {line} || {state}.r}}"


def _oracle() -> str:
    none = f"{{'c': {NEVER}::BIGINT, 'a': '', 'r': ''}}"
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    own = "chr(10) || role || ':' || text"

    def keep(when: dict[str, int]) -> str:
        cases = " ".join(f"WHEN NOT doomed AND initial = '{i}' THEN {_step('extra', 'K', own, f's{q}')}" for i, q in when.items())
        return f"CASE {cases} ELSE {none} END"

    def rerole(line: str, q: int) -> str:
        return f"CASE WHEN NOT doomed THEN {_step(f'extra + {REROLE}', 'R', f'{line} || text', f's{q}')} ELSE {none} END"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    rows = {
        0: (keep({"s": 1, "u": 2}), rerole(user, 2)), 1: (keep({"u": 2}), rerole(user, 2)),
        2: (keep({"a": 3}), rerole(assistant, 3)), 3: (keep({"u": 2}), rerole(user, 2)),
    }
    moved = ", ".join(f"{least(_step(str(DELETE), 'D', repr(''), f's{q}'), *options)} AS m{q}" for q, options in rows.items())
    white = r"\x20\x09-\x0D"
    return f"""
WITH RECURSIVE {CRC_SQL},
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
drawn AS (SELECT *, {crc_sql("name")} % 20 AS kind FROM named, steps),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copies(copy) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS k FROM placed),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^{white}]') AS blank,
    regexp_extract(text, '([^{white}])[{white}]*$', 1) NOT IN ('.', '!', '?') AS cut FROM numbered),
told AS (
  SELECT *, NOT blank AND k > 1 AS duplicate, blank OR k > 1 AS doomed, NOT blank AND k = 1 AND cut AS truncated,
    CASE WHEN NOT blank AND k = 1 AND cut THEN {OPEN_END} ELSE 0 END AS extra,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM judged),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM told GROUP BY conv_id),
paths AS (
  SELECT conv_id, n AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS s0, {{'c': {2 * INSERT}::BIGINT, 'a': 'II', 'r': {user} || {assistant}}} AS s1,
    {{'c': {INSERT}::BIGINT, 'a': 'I', 'r': {assistant}}} AS s2, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS s3 FROM counted
  UNION ALL
  SELECT conv_id, i, {least("m0", _step(str(INSERT), "I", user, "p2"))}, {least("m1", _step(str(INSERT), "I", user, "p2"))}, p2,
    {least("m3", _step(str(INSERT), "I", user, "m2"))}
  FROM (
    SELECT *, {least("m2", _step(str(INSERT), "I", assistant, "m3"))} AS p2
    FROM (SELECT p.conv_id, p.i - 1 AS i, {moved} FROM paths p JOIN told t ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.i = t.i))),
best AS (SELECT conv_id, s0.c AS cost, s0.a AS audit, sha256(substr(s0.r, 2)) AS repaired_sha256 FROM paths WHERE i = 0),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM every e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON e.conv_id IS NOT DISTINCT FROM b.conv_id
"""


ORACLE = _oracle()
