"""Conversations with damaged turns, repaired to the role grammar at least cost.

The roles of a conversation have to read ``(s?(ua)+)?`` by their initials. An LR automaton of that grammar runs over
the rows with a graph-structured stack: every row may be kept, given another role or deleted, and a user or an
assistant row may be inserted anywhere, each at its price. Stacks with equal tops are merged, and only the cheapest
(cost, audit) of them lives on, the audit being the initials of the edits (K, R, D, I).

A conversation of any length is cut into blocks of rows. A block is folded once for each top it may be entered with,
so blocks are independent; one small row for each block then goes through the conversation in order. No more than a
block of rows and one digest state is ever held in memory. Rows that are equal are counted, not repeated.
"""
from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import stored, tidy

#: Prices of the edits, and what a truncated row costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows and bytes of text in one block.
BLOCK_ROWS = 1024
BLOCK_BYTES = 4 << 20
SPACE = " \t\n\x0b\f\r"

# ---------------------------------------------------------------- the role grammar
#: S is a conversation, P its pairs; s, u and a are role initials.
GRAMMAR = (("S", ()), ("S", ("P",)), ("S", ("s", "P")), ("P", ("u", "a")), ("P", ("P", "u", "a")))
ROLES = {"s": "system", "u": "user", "a": "assistant"}


def automaton(grammar: tuple) -> tuple[list[dict], list[list[int]]]:
    """The LR(0) automaton: moves of each state by symbol, and the productions complete in it. State 0 is the start."""
    heads = {head for head, _ in grammar}

    def closed(items):
        items = set(items)
        new = list(items)
        while new:
            rule, dot = new.pop()
            body = grammar[rule][1]
            if dot < len(body) and body[dot] in heads:
                for i, (head, _) in enumerate(grammar):
                    if head == body[dot] and (i, 0) not in items:
                        items.add((i, 0))
                        new.append((i, 0))
        return frozenset(items)

    first = closed((i, 0) for i, (head, _) in enumerate(grammar) if head == grammar[0][0])
    states, moves = [first], []
    for state in states:
        to = {}
        for symbol in sorted({grammar[r][1][d] for r, d in state if d < len(grammar[r][1])}):
            target = closed((r, d + 1) for r, d in state if d < len(grammar[r][1]) and grammar[r][1][d] == symbol)
            if target not in states:
                states.append(target)
            to[symbol] = states.index(target)
        moves.append(to)
    return moves, [sorted(r for r, d in state if d == len(grammar[r][1])) for state in states]


MOVES, COMPLETE = automaton(GRAMMAR)


def shift(stack: tuple, symbol: str) -> tuple | None:
    """The stack (state, stack below) after a terminal and the reductions that nothing can delay; None if it does not fit."""
    to = MOVES[stack[0]].get(symbol)
    if to is None:
        return None
    stack = (to, stack)
    while not MOVES[stack[0]]:  # a state that only reduces
        head, body = GRAMMAR[COMPLETE[stack[0]][0]]
        for _ in body:
            stack = stack[1]
        stack = (MOVES[stack[0]][head], stack)
    return stack


def accepts(stack: tuple) -> bool:
    return any(GRAMMAR[r][0] == "S" for r in COMPLETE[stack[0]])


def _entries() -> dict[int, tuple]:
    """One stack for each top that can be reached; stacks of one top read the same rows from there on."""
    stacks = [(0, None)]  # reductions keep them short, so there are few
    for stack in stacks:
        for symbol in ROLES:
            to = shift(stack, symbol)
            if to is not None and to not in stacks:
                stacks.append(to)
    return {stack[0]: stack for stack in reversed(stacks)}


ENTRIES = _entries()


# ---------------------------------------------------------------- the graph-structured stack
def _merge(tops: dict, stack: tuple, cost: int, audit: str) -> bool:
    """Keep the cheapest (cost, audit) of each top.

    Equal tops have read the same rows, so of two audits of equal cost neither begins the other: a longer one would
    hold more insertions and cost more. Comparing them now decides like comparing them at the end.
    """
    now = tops.get(stack[0])
    if now is None or (cost, audit) < now[:2]:
        tops[stack[0]] = (cost, audit, stack)
        return True
    return False


def inserted(tops: dict) -> dict:
    """The tops with everything that insertions alone can reach."""
    tops = dict(tops)
    new = list(tops.values())
    while new:
        cost, audit, stack = new.pop()
        if tops[stack[0]][:2] != (cost, audit):
            continue
        for symbol in "ua":
            to = shift(stack, symbol)
            if to is not None and _merge(tops, to, cost + INSERT, audit + "I"):
                new.append(tops[to[0]])
    return tops


@lru_cache(maxsize=1 << 15)
def fold(entry: int, rows: str) -> dict:
    """{top: (cost, audit, stack)} after the rows, entered with a top; insertions after the last row are left out.

    A row is its role initial (x: any other), upper case where it is truncated, or d where it has to go.
    """
    tops = {entry: (0, "", ENTRIES[entry])}
    for row, run in groupby(rows):
        n = sum(1 for _ in run)
        for count in [n] if row == "d" else [1] * n:
            tops, before = {}, inserted(tops)
            own, keep = row.lower(), TRUNCATED * row.isupper()
            for cost, audit, stack in before.values():
                _merge(tops, stack, cost + DELETE * count, audit + "D" * count)
                if row == "d":
                    continue
                for symbol in "sua" if own == "s" else "ua":
                    to = shift(stack, symbol)
                    if to is not None:
                        _merge(tops, to, cost + keep + REROLE * (symbol != own), audit + ("K" if symbol == own else "R"))
    return tops


def closing(tops: dict) -> tuple[int, str, int]:
    """(cost, audit, top) of the cheapest way to a whole conversation; ``tops`` as (cost, audit, stack)."""
    return min((c, a, s[0]) for c, a, s in inserted(tops).values() if accepts(s))


def replay(entry: int, audit: str, roles: list, texts: list) -> tuple[list, int]:
    """The rows (role, text) that an audit makes of a block's rows, and the top behind them."""
    out, stack, at = [], ENTRIES[entry], 0
    for edit in audit:
        role = next(r for r in "ua" if r in MOVES[stack[0]])
        if edit == "I":
            out.append((ROLES[role], ""))
        else:
            if edit == "K":
                role = roles[at][:1]
            if edit != "D":
                out.append((roles[at] if edit == "K" else ROLES[role], texts[at]))
            at += 1
            if edit == "D":
                continue
        stack = shift(stack, role)
    return out, stack[0]


# ---------------------------------------------------------------- rows to blocks
def marked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, fault): rows that are equal as one, with the first fault of the first of them."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                           F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                           F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("sha", F.sha2("text", 256))
    firsts = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s")).agg(
        F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("least"))
    both = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s")))
    said = F.rtrim("text", F.lit(SPACE))
    return both.select(
        "conv_id", "turn", "role", "text", "copies",
        F.when(said == "", "blank").when(~F.col("turn").eqNullSafe(F.col("least.turn")), "duplicate")
        .when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("").alias("fault"))


_BLOCK = ("conv_id long, block long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, "
          "first string, last string, symbols string, entries array<int>, exits array<int>, costs array<long>, audits array<string>, "
          "roles array<string>, texts array<string>, repeats array<long>")
_NAMES = [part.split()[0] for part in _BLOCK.split(", ")]
_LEGAL = ("su", "ua", "au")


def _block(conv, block: int, rows: list, opens: bool) -> tuple:
    """One row of ``_BLOCK``; ``opens``: the block is known to begin its conversation."""
    known = [t for t, *_ in rows if t is not None]
    count = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    symbols, illegal, before = [], 0, None
    for _, role, _, copies, fault in rows:
        initial = role[:1]
        if fault:
            count[fault] += copies if fault != "truncated" else 1
        if fault in ("", "truncated"):
            count["duplicate"] += copies - 1
            own = initial if initial in ROLES else "x"
            symbols.append((own.upper() if fault else own) + "d" * (copies - 1))
        else:
            symbols.append("d" * copies)
        illegal += copies - 1 + (before is not None and before + initial not in _LEGAL)
        before = initial
    moves = [(e, t, c, a) for e in ([0] if opens else ENTRIES) for t, (c, a, _) in fold(e, "".join(symbols)).items()]
    return (conv, block, min(known, default=None), max(known, default=None), len(set(known)), count["blank"], count["duplicate"],
            count["truncated"], illegal, rows[0][1][:1], before, "".join(symbols), *map(list, zip(*moves, strict=True)),
            [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])


def _batch(rows: list, names: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in kinds.items()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def _pack(batches):
    """Sorted rows of a partition to blocks; the numbers of blocks grow with the order of all rows."""
    schema, base = _arrow(_BLOCK), TaskContext.get().partitionId() << 32
    made, held, size, conv, opens = 0, [], 0, None, False
    out, weight = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[0] != conv or len(held) >= BLOCK_ROWS or size >= BLOCK_BYTES):
                out.append(_block(conv, base + made, held, opens))
                weight += size
                made, opens, held, size = made + 1, row[0] != conv, [], 0
                if weight >= BLOCK_BYTES or len(out) >= BLOCK_ROWS:
                    yield _batch(out, _NAMES, schema)
                    out, weight = [], 0
            conv = row[0]
            held.append(row[1:])
            size += len(row[3])
    if held:
        out.append(_block(conv, base + made, held, opens))
    if out:
        yield _batch(out, _NAMES, schema)


def _blocks(messages: DataFrame) -> DataFrame:
    """The blocks of all conversations, in the shared folder. Rows are dealt by ranges, so one conversation may span many tasks."""
    order = ["conv_id", "turn", "role", "text"]
    rows = marked(messages).repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(rows.mapInArrow(tidy(_pack), _BLOCK))


# ---------------------------------------------------------------- blocks to conversations
_CHOICE = ("conv_id long, block long, entry int, audit string, tail string, gaps long, blank long, duplicate long, truncated long, "
           "illegal long, cost long")
_LIGHT = _NAMES[:_NAMES.index("symbols")] + ["entries", "exits", "costs", "audits"]
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


class _Choice:
    """The cheapest way through the blocks of one conversation.

    The audits read so far are compared by rank: those of different tops differ before either ends.
    """
    def __init__(self, conv):
        self.conv, self.tops, self.ways, self.blocks = conv, {0: (0, 0)}, [], []
        self.total = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = None
        self.turns, self.last = 0, None

    def add(self, b: dict):
        best = {}
        for entry, to, cost, audit in zip(b["entries"], b["exits"], b["costs"], b["audits"], strict=True):
            if entry in self.tops:
                way = (self.tops[entry][0] + cost, self.tops[entry][1], audit, entry)
                if to not in best or way < best[to]:
                    best[to] = way
        rank = {key: i for i, key in enumerate(sorted((r, a) for _, r, a, _ in best.values()))}
        self.tops = {to: (c, rank[r, a]) for to, (c, r, a, _) in best.items()}
        self.ways.append({to: (e, a) for to, (_, _, a, e) in best.items()})
        self.blocks.append(b["block"])
        for name in _COUNTS:
            self.total[name] += b[name]
        if self.last is not None:
            self.total["illegal"] += self.last + b["first"] not in _LEGAL
        self.last = b["last"]
        if b["low"] is not None:  # blocks are in order of turns
            self.turns += b["turns"] - (self.high == b["low"])
            self.low, self.high = b["low"] if self.low is None else self.low, b["high"]

    def rows(self):
        """A row of ``_CHOICE`` for each block; the last carries the counts and the insertions at the end."""
        # ranks stand for audits of equal cost; what insertions add is compared behind them
        ends = [(cost, rank, audit, to) for to, (c, rank) in self.tops.items()
                for cost, audit, stack in inserted({to: (c, "", ENTRIES[to])}).values() if accepts(stack)]
        cost, _, tail, top = min(ends)
        path = []
        for way in reversed(self.ways):
            entry, audit = way[top]
            path.append((entry, audit))
            top = entry
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        end = len(self.blocks) - 1
        for i, (block, (entry, audit)) in enumerate(zip(self.blocks, reversed(path), strict=True)):
            own = (tail, gaps, *(self.total[n] for n in _COUNTS), cost) if i == end else (None,) * 7
            yield (self.conv, block, entry, audit, *own)


def _choose(batches):
    schema = _arrow(_CHOICE)
    choice, out = None, []
    for batch in batches:
        for b in batch.to_pylist():
            if choice is None or b["conv_id"] != choice.conv:
                out += choice.rows() if choice else []
                choice = _Choice(b["conv_id"])
            choice.add(b)
            if len(out) >= BLOCK_ROWS:
                yield _batch(out, schema.names, schema)
                out = []
    out += choice.rows() if choice else []
    for i in range(0, len(out), BLOCK_ROWS):
        yield _batch(out[i:i + BLOCK_ROWS], schema.names, schema)


def _by_conversation(df: DataFrame) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "block")


def _repaired(row: dict) -> list:
    roles = [r for r, n in zip(row["roles"], row["repeats"], strict=True) for _ in range(n)]
    texts = [t for t, n in zip(row["texts"], row["repeats"], strict=True) for _ in range(n)]
    return replay(row["entry"], row["audit"] + (row["tail"] or ""), roles, texts)[0]


def _decided(messages: DataFrame) -> DataFrame:
    """Blocks with their rows and the edits chosen for them."""
    blocks = _blocks(messages)
    choices = _by_conversation(blocks.select(*_LIGHT)).mapInArrow(_choose, _CHOICE)
    return blocks.select("block", "roles", "texts", "repeats").join(choices, "block")


def repaired_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, block, at, role, text): the rows of the repaired conversations; (block, at) is their order.

    Conversations repaired to nothing have no row. Input as for ``repair``.
    """
    schema = "conv_id long, block long, at int, role string, text string"

    def run(batches):
        fields = _arrow(schema)
        for batch in batches:
            for row in batch.to_pylist():
                said = [(row["conv_id"], row["block"], i, role, text) for i, (role, text) in enumerate(_repaired(row))]
                if said:
                    yield _batch(said, fields.names, fields)

    return _decided(messages).mapInArrow(tidy(run), schema)


_OUT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "repaired_sha256 string")


def repair(messages: DataFrame) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text): its faults, the cheapest edits and what they make.

    gaps: turns missing between the least and the largest; blank, duplicate, truncated: rows by their first fault;
    illegal: neighbours whose role initials are none of su, ua, au; cost and audit: the cheapest edits, ties to the
    audit that is ASCII-least; repaired_sha256: digest of the repaired ``role:text`` rows, joined by new lines.
    Rows are taken by turn (nulls first), role and text; equal rows are duplicates of one another. A null role or text
    is one space, a null conv_id is a conversation of its own, an empty role fits nowhere. Other columns are ignored.
    The digest runs over a conversation's blocks one after another, as SHA-256 asks for, holding one of them at a time.
    """
    def pieces(batches):
        fields = _arrow(f"{_CHOICE}, piece string, lines long")
        for batch in batches:
            for row in batch.to_pylist():
                said = _repaired(row)
                row |= {"piece": "\n".join(f"{role}:{text}" for role, text in said), "lines": len(said)}
                yield _batch([tuple(row[n] for n in fields.names)], fields.names, fields)

    def digests(batches):
        fields = _arrow(_OUT)
        digest, lines, audit, out = hashlib.sha256(), 0, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["lines"]:
                    digest.update(b"\n" * (lines > 0) + row["piece"].encode())
                lines += row["lines"]
                audit.append(row["audit"])
                if row["cost"] is not None:
                    audit.append(row["tail"])
                    out.append((*(row[n] for n in fields.names[:-2]), "".join(audit), digest.hexdigest()))
                    digest, lines, audit = hashlib.sha256(), 0, []
                    if len(out) >= BLOCK_ROWS:
                        yield _batch(out, fields.names, fields)
                        out = []
        if out:
            yield _batch(out, fields.names, fields)

    made = _decided(messages).mapInArrow(tidy(pieces), f"{_CHOICE}, piece string, lines long")
    return _by_conversation(made).mapInArrow(tidy(digests), _OUT)
