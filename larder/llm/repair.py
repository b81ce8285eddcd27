"""Repair of conversations at least cost, by an auction algorithm for shortest paths.

A conversation is legal if the initials of its roles read `(s?(ua)+)?`. Its repairs are paths through a lattice of
(rows read, state): Keep costs 0, Rerole 2, Delete 3, Insert 2, and an undeleted truncated row 1 more; blank and repeated
rows must be deleted. The auction holds a path and a price for each node, below the cost that is left from there. The
path's end is raised to its cheapest way on (and the path contracted) or extended along that way, until the goal is
reached. The prices are then exact along the path, and tight arcs (price = cost + next price) lead on cheapest paths;
a next node's price is brought to its exact value by the same auction before an arc counts as tight. The first tight
arc in the order D, I, K, R is followed, and since a letter leads to one node, this is the least of the cheapest audits.

Prices can rise as often as the square of the rows, so a lattice holds CHUNK rows. Longer conversations are cut: the
auction gives the cost of a chunk from each state to each state, these give the cost that is left at each border, and the
chunk's audit is traced with those costs as its goal.

Rows are read in the order of (turn with nulls first, role, text). Conversations of at most LONG rows are handled whole in
one task, their equal rows counted before the shuffle. Rows of longer ones are sorted over many tasks, repeated rows are
found by an aggregate, and one task reads a conversation's row symbols, later its texts, as a stream: what it holds is
the audit, a letter a row, and the digest over all texts is one chain.

Null roles and texts count as one space, a null conv_id is a conversation. Conversations without rows after damage have
zeros, an empty audit and the digest of the empty text. Equal rows are repeated rows; other columns are ignored; an empty
table has an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.components import _kept

CHUNK, LONG = 64, 4096
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
#: Role that is due in each state, and the state it leads to.
DUE = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
DONE = (0, NEVER, NEVER, 0)
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
BLANKS = " \t\n\x0b\x0c\r"
BLANK, REPEATED, TRUNCATED, SOUND = "b", "r", "t", "k"

Arcs = list[list[tuple[str, int, int]]]


def lattice(rows: str, ends: tuple[int, ...], last: bool) -> Arcs:
    """Arcs (letter, cost, node) of each node 4 * rows read + state, by letter; the goal is the last node.

    Rows are the initials s, u, a, x, as capitals where truncated, d where they must be deleted; ends are the costs from the last
    states to the goal. Rows can be put in behind the last one only where no other chunk follows.
    """
    goal = 4 * (len(rows) + 1)
    arcs: Arcs = []
    for k in range(len(rows) + 1):
        for state in range(4):
            role, to = DUE[state]
            out = []
            if k < len(rows):
                more = int(rows[k].isupper())
                initial = rows[k].lower()
                out.append(("D", 3, 4 * (k + 1) + state))
                out.append(("I", 2, 4 * k + to))
                if initial == role:
                    out.append(("K", more, 4 * (k + 1) + to))
                elif initial == "s" and state == START:
                    out.append(("K", more, 4 * (k + 1) + SYSTEM))
                if initial != "d":
                    out.append(("R", 2 + more, 4 * (k + 1) + to))
            else:
                if ends[state] < NEVER:
                    out.append(("", ends[state], goal))
                if last:
                    out.append(("I", 2, 4 * k + to))
            arcs.append(out)
    return arcs


def auction(arcs: Arcs, prices: list[int], origin: int) -> int:
    """Price of a node raised to its exact cost to the goal; prices must be lower bounds that no arc undercuts."""
    goal = len(arcs)
    path = [origin]
    while path[-1] != goal:
        at = path[-1]
        least, to = NEVER, -1
        for _, cost, node in arcs[at]:
            if cost + prices[node] < least:
                least, to = cost + prices[node], node
        if least > prices[at]:
            prices[at] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    return prices[origin]


@lru_cache(maxsize=1 << 15)
def traced(rows: str, ends: tuple[int, ...], last: bool, state: int) -> tuple[int, str, int]:
    """(cost, audit, last state) of the cheapest path from a state through a chunk, the audit the ASCII-least."""
    arcs = lattice(rows, ends, last)
    prices = [0] * (len(arcs) + 1)
    cost = auction(arcs, prices, state)
    audit, at = [], state
    while at < 4 * len(rows) or arcs[at][0][0] != "" or prices[at] != arcs[at][0][1]:
        for letter, step, node in arcs[at]:
            if prices[at] == step + prices[node] and prices[at] == step + auction(arcs, prices, node):
                audit.append(letter)
                at = node
                break
    return cost, "".join(audit), at % 4


def _leads(rows: str, state: int, end: int) -> bool:
    """Whether a chunk can be left in the state `end`: the first states are not come back to."""
    if end == START:
        return state == START
    return end in (USER, ASSISTANT) or state == SYSTEM or (state == START and "s" in rows.lower())


@lru_cache(maxsize=1 << 14)
def crossing(rows: str) -> tuple[tuple[int, ...], ...]:
    """Costs through a chunk, behind which others follow, from each state to each state."""
    columns = []
    for end in range(4):
        arcs = lattice(rows, tuple(0 if e == end else NEVER for e in range(4)), False)
        prices = [0] * (len(arcs) + 1)
        columns.append([auction(arcs, prices, state) if _leads(rows, state, end) else NEVER for state in range(4)])
    return tuple(zip(*columns, strict=True))


def repair(rows: str) -> tuple[int, str]:
    """(cost, audit) of a conversation given by the symbols of its rows."""
    if len(rows) <= CHUNK:
        return traced(rows, DONE, True, START)[:2]
    chunks = [rows[i : i + CHUNK] for i in range(0, len(rows), CHUNK)]
    ends = [DONE, tuple(traced(chunks[-1], DONE, True, state)[0] for state in range(4))]
    for chunk in chunks[-2:0:-1]:
        ends.append(tuple(min(a + b for a, b in zip(row, ends[-1], strict=True)) for row in crossing(chunk)))
    audit, state, total = [], START, None
    for k, chunk in enumerate(chunks):
        least = min(ends[-1 - k])
        cost, own, state = traced(chunk, tuple(c - least if c < NEVER else c for c in ends[-1 - k]), k == len(chunks) - 1, state)
        total = cost + least if total is None else total
        audit.append(own)
    return total, "".join(audit)


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """`role:text` of the repaired rows."""
    state = START
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        initial, to = DUE[state]
        if letter == "K" and role[:1] == "s" and state == START:
            state = SYSTEM
            yield f"{role}:{text}"
            continue
        state = to
        yield f"{role if letter == 'K' else NAMES[initial]}:{text}"


def digest(lines: Iterator[str]) -> str:
    total, first = hashlib.sha256(), True
    for line in lines:
        total.update((line if first else "\n" + line).encode())
        first = False
    return total.hexdigest()


def fault(text: str, repeated: bool) -> str:
    if VISIBLE.search(text) is None:
        return BLANK
    if repeated:
        return REPEATED
    return SOUND if text.rstrip(BLANKS)[-1] in ".!?" else TRUNCATED


def symbol(role: str, its_fault: str) -> str:
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return "d" if its_fault in (BLANK, REPEATED) else initial.upper() if its_fault == TRUNCATED else initial


class Figures:
    """Counts of a conversation's rows, read in order."""

    def __init__(self):
        self.turns, self.first, self.last, self.before = 0, None, None, None
        self.faults = {BLANK: 0, REPEATED: 0, TRUNCATED: 0, SOUND: 0}
        self.illegal, self.symbols = 0, []

    def add(self, turn: int | None, role: str, its_fault: str, n: int, later: str) -> None:
        """A row and n - 1 equal ones behind it, whose fault is `later`."""
        if turn is not None and turn != self.last:
            self.turns, self.first, self.last = self.turns + 1, turn if self.first is None else self.first, turn
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.before = initial
        self.illegal += n - 1  # no role may follow itself
        self.faults[its_fault] += 1
        self.faults[later] += n - 1
        self.symbols.append(symbol(role, its_fault) + "d" * (n - 1))

    def row(self) -> tuple[int, int, int, int, int, int, str]:
        cost, audit = repair("".join(self.symbols))
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, self.faults[BLANK], self.faults[REPEATED], self.faults[TRUNCATED], self.illegal, cost, audit


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
FIGURES = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
RESULT = f"{FIGURES}, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows after damage, n times each; n is 0 for a dropped row."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    case = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.withColumn("_case", case).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(F.col("_case") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(F.col("_case") == 0, 0).when(F.col("_case") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


KEYS = ["conv_id", "turn", "role", "text"]
ROWS = "conv_id long, turn long, role string, text string, n long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one row with their number; of dropped rows only the conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64())])
    for batch in batches:
        table = pa.Table.from_batches([batch]).select([*KEYS, "n"]).cast(schema)
        gone = pa.array(table.column("n").to_numpy() == 0)
        ids = table.filter(gone).column("conv_id").unique()
        yield pa.record_batch([ids, *(pa.nulls(len(ids), f.type) for f in list(schema)[1:4]), pa.array([0] * len(ids), pa.int64())], schema=schema)
        kept = table.filter(pc.invert(gone)).group_by(KEYS).aggregate([("n", "sum")])
        yield from kept.select([*KEYS, "n_sum"]).rename_columns(schema.names).cast(schema).combine_chunks().to_batches()


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of each conversation, in runs of at most a batch; an empty run ends a conversation."""
    current, begun = None, False
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        run = []
        for row in zip(*columns, strict=True):
            if begun and row[0] != current:
                if run:
                    yield run
                yield []
                run = []
            current, begun = row[0], True
            run.append(row)
        if run:
            yield run
    if begun:
        yield []


def _repaired_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations that are held in memory one by one."""
    rows: list[tuple] = []
    out: list[tuple] = []
    for run in _streams(batches):
        rows += run
        if run:
            continue
        figures, seen, texts = Figures(), set(), []
        for _, turn, role, text, n in rows:
            if n:
                its_fault = fault(text, (role, text) in seen)
                seen.add((role, text))
                figures.add(turn, role, its_fault, n, BLANK if its_fault == BLANK else REPEATED)
                texts += [(role, text)] * n
        own = figures.row()
        out.append((rows[0][0], *own, digest(repaired(own[-1], iter(texts)))))
        rows = []
        if len(out) == 4096:
            yield _batch(out)
            out = []
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    columns = zip(*rows, strict=True) if rows else [[]] * 9
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", *COLUMNS, "repaired_sha256"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their task and their place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        columns = [pa.array([part] * batch.num_rows, pa.int64()), pa.array(range(at, at + batch.num_rows), pa.int64())]
        yield pa.record_batch([*batch.columns, *columns], names=[*batch.schema.names, "part", "at"])
        at += batch.num_rows


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures and audit of conversations whose rows (conv_id, turn, role, fault, n) come as a stream without texts."""
    figures, key = Figures(), None
    for run in _streams(batches):
        for key, turn, role, its_fault, n in run:
            if n:
                figures.add(turn, role, its_fault, n, BLANK if its_fault == BLANK else REPEATED)
        if not run:
            own = (key, *figures.row())
            yield pa.record_batch([pa.array([v], pa.string() if i == 7 else pa.int64()) for i, v in enumerate(own)], names=["conv_id", *COLUMNS])
            figures = Figures()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of conversations that come as a stream: a row with the audit as text, then the rows (conv_id, role, text, n)."""

    def texts(rows: Iterator[tuple]) -> Iterator[tuple[str, str]]:
        for _, role, text, n in rows:
            for _ in range(n):
                yield role, text

    streams = _streams(batches)
    for run in streams:

        def rows(run: list[tuple] = run) -> Iterator[tuple]:
            yield from run[1:]
            for more in iter(lambda: next(streams), []):
                yield from more

        rest = rows()
        key, done = run[0][0], digest(repaired(run[0][2], texts(rest)))
        for _ in rest:  # rows that are dropped come with n = 0
            pass
        yield pa.record_batch([pa.array([key], pa.int64()), pa.array([done])], names=["_conv", "repaired_sha256"])


def _long(rows: DataFrame) -> DataFrame:
    """Results of conversations with many rows."""
    placed = rows.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(_placed, f"{ROWS}, part long, at long")
    placed = _kept(placed, "long-conversations")
    names = placed.select("*", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2"))
    first = names.where("n > 0").groupBy("conv_id", "h1", "h2").agg(F.min(F.struct("part", "at")).alias("first"))
    first = first.select(F.col("conv_id").alias("_c"), F.col("h1").alias("_1"), F.col("h2").alias("_2"), "first")
    visible = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    narrow = names.select("conv_id", "turn", F.left("role", F.lit(1)).alias("role"), visible.alias("end"), "n", "part", "at", "h1", "h2")
    marked = narrow.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")), "left")
    kind = F.when(F.col("end") == "", BLANK).when(F.struct("part", "at") > F.col("first"), REPEATED).when(F.col("end").isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    marked = marked.select("conv_id", "turn", "role", kind.alias("fault"), "n", "part", "at").repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
    figures = _kept(marked.drop("part", "at").mapInArrow(_figures, FIGURES), "long-figures")
    heads = figures.select("conv_id", F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("n"), F.lit(-1).cast("long").alias("part"), F.lit(0).cast("long").alias("at"))
    texts = heads.unionByName(placed.select("conv_id", "role", "text", "n", "part", "at")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
    digests = texts.drop("part", "at").mapInArrow(_digests, "_conv long, repaired_sha256 string")
    return figures.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of (conv_id, turn, role, text, n)."""
    rows = rows.select(*KEYS, "n").mapInArrow(_counted, ROWS)
    sizes = rows.groupBy(F.col("conv_id").alias("_conv")).agg(F.sum("n").alias("rows")).where(F.col("rows") > LONG)
    long_ids = _kept(sizes.select("_conv"), "long-ids")
    is_long = F.col("conv_id").eqNullSafe(F.col("_conv"))
    whole = rows.join(long_ids, is_long, "left_anti").repartition("conv_id").sortWithinPartitions(*KEYS).mapInArrow(_repaired_whole, RESULT)
    if long_ids.isEmpty():
        return whole
    return whole.unionByName(_long(rows.join(long_ids, is_long, "left_semi")))
