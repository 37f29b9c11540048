"""Repair of the turn structure of conversations by the cheapest edits.

A conversation is repaired to one system turn at most, then user and assistant by turns,
or to nothing. The edits are a cheapest path through the states of that grammar, found by
Viterbi. Paths are kept as a tree of backpointers with reference counts: when all
surviving paths share an ancestor, what leads to it is decided, and is put out and
forgotten, so memory holds the undecided end of the paths alone. Of equally cheap paths
the one whose edits are least in ASCII order survives; two are compared by all that
follows the ancestor they share, as what came before is the same.

Conversations may be of any length. Their rows are dealt out by ranges of conversation and
turn, and a task solves stretches of them in blocks. Where a block may begin in the
middle of a conversation it is solved from each state, which gives at most sixteen
paths; the blocks of a conversation that was cut are then put together by the same
algorithm, with those paths as edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tabflow.llm.shared import arrow_schema, column, map_arrow, materialise

#: White space of ASCII, as a text is blank or ends.
BLANK = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of a truncated row that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows and characters at which a block ends.
BLOCK_ROWS, BLOCK_CHARS = 1024, 1 << 18

#: States: nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn of each initial; others are not allowed.
AFTER = {
    (START, "s"): SYSTEM,
    (START, "u"): USER,
    (SYSTEM, "u"): USER,
    (ASSISTANT, "u"): USER,
    (USER, "a"): ASSISTANT,
}
ENDS = (START, ASSISTANT)
#: The turns that may be put in, or given another role.
NEXT = {state: (initial, after) for (state, initial), after in AFTER.items() if initial != "s"}
ROLES = {"u": "user", "a": "assistant"}


class Node:
    """An edit, or several, at the end of a path; counts the paths and nodes that need it."""

    __slots__ = ("parent", "edits", "block", "depth", "needed")

    def __init__(self, parent: Node | None, edits: str, block: Block | None = None):
        self.parent, self.edits, self.block, self.needed = parent, edits, block, 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.needed += 1


def release(node: Node) -> None:
    """Give up a path's end, and what nothing else needs before it."""
    while node.needed == 0 and node.parent is not None:
        parent, node.parent = node.parent, None
        parent.needed -= 1
        node = parent


def before(a: Node, b: Node) -> bool:
    """Whether the edits to ``a`` come before those to ``b``. Compares all that follows
    the nearest ancestor of both."""
    left, right = [], []
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.edits)
            a = a.parent
        else:
            right.append(b.edits)
            b = b.parent
    return "".join(reversed(left)) < "".join(reversed(right))


class Paths:
    """The surviving path to each state, as its cost and its last node."""

    def __init__(self, state: int):
        self.root = Node(None, "")
        self.root.needed += 1
        self.best: dict[int, tuple[int, Node]] = {state: (0, self.root)}

    @staticmethod
    def offer(best: dict, state: int, cost: int, parent: Node, edits: str, block: Block | None = None) -> bool:
        """Take a path into ``best`` if it is cheaper, or as cheap and its edits less."""
        known = best.get(state)
        if known and known[0] < cost:
            return False
        node = Node(parent, edits, block)
        if known and known[0] == cost and not before(node, known[1]):
            release(node)
            return False
        node.needed += 1
        best[state] = (cost, node)
        if known:
            known[1].needed -= 1
            release(known[1])
        return True

    def replace(self, best: dict[int, tuple[int, Node]]) -> None:
        """Go on with ``best``, less what can't be cheapest any more: from ASSISTANT all
        can be done that can from SYSTEM, and from START but for a system turn, which
        may be deleted instead."""
        if ASSISTANT in best:
            for state, more in ((START, DELETE), (SYSTEM, 0)):
                if state in best and best[state][0] > best[ASSISTANT][0] + more:
                    _, node = best.pop(state)
                    node.needed -= 1
                    release(node)
        gone, self.best = self.best, best
        for _, node in gone.values():
            node.needed -= 1
            release(node)

    def insert(self) -> None:
        """Let turns be put in at this place, as long as that gives a better path."""
        best, again = dict(self.best), True
        for _, node in best.values():
            node.needed += 1
        while again:
            again = False
            for state in list(best):
                cost, node = best[state]
                again |= self.offer(best, NEXT[state][1], cost + INSERT, node, "I")
        self.replace(best)

    def row(self, initial: str, fault: str, copies: int) -> None:
        """A row and ``copies`` - 1 more of it, which are its duplicates."""
        self.insert()
        best: dict[int, tuple[int, Node]] = {}
        more, extra = "D" * (copies - 1), DELETE * (copies - 1)
        keep = extra + (TRUNCATED if fault == "truncated" else 0)
        for state, (cost, node) in self.best.items():
            self.offer(best, state, cost + DELETE + extra, node, "D" + more)
            if fault not in ("blank", "duplicate"):
                if (state, initial) in AFTER:
                    self.offer(best, AFTER[state, initial], cost + keep, node, "K" + more)
                self.offer(best, NEXT[state][1], cost + keep + REROLE, node, "R" + more)
        self.replace(best)

    def block(self, block: Block, found: list[tuple[int, int, int, str]]) -> None:
        """A block, by its paths: where they begin and end, their costs and edits."""
        best: dict[int, tuple[int, Node]] = {}
        for begin, end, cost, edits in found:
            if begin in self.best:
                so_far, node = self.best[begin]
                self.offer(best, end, so_far + cost, node, edits, block)
        self.replace(best)

    def rest(self, node: Node) -> list[Node]:
        """The undecided part of a path, in order."""
        chain = []
        while node is not self.root:
            chain.append(node)
            node = node.parent
        return chain[::-1]

    def decided(self) -> list[Node]:
        """What all survivors share and was not put out before, in order; it is forgotten."""
        out = []
        for node in self.rest(next(iter(self.best.values()))[1]):
            if self.root.needed > 1:
                break
            out.append(node)
            node.parent = None
            self.root = node
        return out

    def finish(self) -> tuple[int, list[Node]]:
        """The cheapest path to an allowed end, turns put in after the last row included:
        its cost, and what of it was not put out yet."""
        self.insert()
        found = [self.best[state] for state in ENDS if state in self.best]
        best = found[0]
        for cost, node in found[1:]:
            if cost < best[0] or (cost == best[0] and before(node, best[1])):
                best = (cost, node)
        return best[0], self.rest(best[1])


def edits_of(nodes: list[Node]) -> str:
    return "".join(node.edits for node in nodes)


def solve(rows: list[tuple[str, str, int]], state: int) -> tuple[str, Paths]:
    """The edits that all cheapest paths of some rows from a state begin with, and the paths."""
    paths, shared = Paths(state), []
    for initial, fault, copies in rows:
        paths.row(initial, fault, copies)
        shared.append(edits_of(paths.decided()))
    return "".join(shared), paths


def repaired(rows: list[tuple], audit: str, state: int) -> tuple[list[dict], int]:
    """The turns that the edits of a block make of its rows, and the state they end in."""
    out, at, left = [], 0, 0
    for edit in audit:
        role = text = None
        if edit == "I":
            initial, text = NEXT[state][0], ""
            role = ROLES[initial]
        else:
            while not left:
                left, at = rows[at][2], at + 1
            left -= 1
            if edit == "D":
                continue
            role, text = rows[at - 1][:2]
            initial = role[:1]
            if edit == "R":
                initial = NEXT[state][0]
                role = ROLES[initial]
        out.append({"role": role, "text": text})
        state = AFTER[state, initial]
    return out, state


TURNS = "array<struct<role: string, text: string>>"
#: What blocks count; the sums over a conversation's parts are its own.
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
PART = "part bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + f", cost bigint, audit string, turns {TURNS}"
#: Of a block that isn't solved yet: its rows, paths, and what meets the blocks beside it.
OPEN = (
    "lines array<struct<role: string, text: string, copies: bigint>>, "
    "paths array<struct<begin: int, end: int, cost: bigint, edits: string>>, "
    "first_turn bigint, last_turn bigint, first_role string, last_role string"
)
OPEN_NAMES = ["lines", "paths", "first_turn", "last_turn", "first_role", "last_role"]
LEGAL = ("su", "ua", "au")


class Block:
    """Rows of one conversation, as a task reads them, and what is counted of them."""

    def __init__(self, conversation, begins: bool):
        self.conversation, self.begins = conversation, begins
        self.rows: list[tuple[str, str, int]] = []
        self.steps: list[tuple[str, str, int]] = []
        self.size = 0
        self.first_turn = self.last_turn = self.first_role = self.last_role = None
        self.counts = dict.fromkeys(COUNTS, 0)

    def add(self, turn: int | None, role: str, text: str, copies: int, seen: bool) -> None:
        if not copies:
            return  # all of it was dropped
        counts, initial = self.counts, role[:1]
        end = text.rstrip(BLANK)[-1:]
        fault = "blank" if not end else "duplicate" if seen else "" if end in ".!?" else "truncated"
        if fault:
            counts[fault] += 1
        counts["blank" if fault == "blank" else "duplicate"] += copies - 1
        if self.last_role is not None:
            counts["illegal"] += self.last_role + initial not in LEGAL
        else:
            self.first_role = initial
        counts["illegal"] += copies - 1
        self.last_role = initial
        if turn is not None:
            if self.last_turn is not None:
                counts["gaps"] += max(0, turn - self.last_turn - 1)
            else:
                self.first_turn = turn
            self.last_turn = turn
        self.rows.append((role, text, copies))
        self.steps.append((initial, fault, copies))
        self.size += len(role) + len(text)

    def whole(self) -> dict:
        """The one part of a conversation that is no more than this block."""
        shared, paths = solve(self.steps, START)
        cost, nodes = paths.finish()
        audit = shared + edits_of(nodes)
        return {"cost": cost, "audit": audit, "turns": repaired(self.rows, audit, START)[0], **self.counts}

    def cut(self, part: int) -> dict:
        """What has to be known of a block to put it together with others."""
        found = []
        for begin in (START,) if self.begins else (START, SYSTEM, USER, ASSISTANT):
            shared, paths = solve(self.steps, begin)
            for end, (cost, node) in paths.best.items():
                edits = shared + edits_of(paths.rest(node))
                found.append({"begin": begin, "end": end, "cost": cost, "edits": edits})
        return {
            "part": part, "paths": found, **self.counts,
            "lines": [{"role": a, "text": b, "copies": c} for a, b, c in self.rows],
            "first_turn": self.first_turn, "last_turn": self.last_turn,
            "first_role": self.first_role, "last_role": self.last_role,
        }


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def in_batches(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows and their sizes as batches of bounded size."""
    out, size = [], 0
    for row, more in rows:
        out.append(row)
        size += more
        if size > 8 * BLOCK_CHARS or len(out) >= 5000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def read_blocks(kind: str):
    """Reads sorted rows; gives solved conversations, and blocks of those of which
    another task may have rows, or that are longer than a block."""
    schema = arrow_schema(f"id {kind}, {PART}, {OPEN}")

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        number, block, begins = TaskContext.get().partitionId() << 32, None, False
        for conversation, turn, role, text, copies, seen in read(batches):
            if block is None:
                block = Block(conversation, begins=False)
            elif conversation != block.conversation:
                yield {"id": block.conversation} | (block.whole() if block.begins else block.cut(number)), block.size
                block = Block(conversation, begins=True)
                number += 1
            elif len(block.rows) >= BLOCK_ROWS or block.size >= BLOCK_CHARS:
                yield {"id": block.conversation} | block.cut(number), block.size
                block = Block(conversation, begins=False)
                number += 1
            block.add(turn, role, text, copies, seen)
        if block is not None:
            yield {"id": block.conversation} | block.cut(number), block.size

    return lambda batches: in_batches(solved(batches), schema)


def join_blocks(kind: str):
    """Reads the blocks of cut conversations in order; gives the parts that they make."""
    schema = arrow_schema(f"id {kind}, {PART}")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        rows = (dict(zip(schema.names + OPEN_NAMES, row)) for row in read(batches))
        for conversation, blocks in groupby(rows, key=itemgetter("id")):
            paths, state, turn, role = Paths(START), START, None, None

            def part(block: dict, edits: str, cost: int = 0) -> tuple[dict, int]:
                nonlocal state
                lines = [(x["role"], x["text"], x["copies"]) for x in block["lines"]]
                turns, state = repaired(lines, edits, state)
                counts = {c: block[c] for c in ("part", *COUNTS)}
                size = sum(len(x["text"]) + len(x["role"]) for x in turns)
                return {"id": conversation, **counts, "cost": cost, "audit": edits, "turns": turns}, size

            for block in blocks:
                if block["first_role"] is not None:
                    if role is not None:
                        block["illegal"] += role + block["first_role"] not in LEGAL
                    role = block["last_role"]
                if block["first_turn"] is not None:
                    if turn is not None:
                        block["gaps"] += max(0, block["first_turn"] - turn - 1)
                    turn = block["last_turn"]
                for node in paths.decided():
                    yield part(node.block, node.edits)
                found = [(x["begin"], x["end"], x["cost"], x["edits"]) for x in block["paths"]]
                paths.block(block, found)
            cost, nodes = paths.finish()
            for k, node in enumerate(nodes):
                if node.block is not None:
                    # Turns put in at the end belong to the last block, as the whole cost does.
                    last = all(x.block is None for x in nodes[k + 1 :])
                    yield part(node.block, node.edits + edits_of(nodes[k + 1 :]) * last, cost * last)

    return lambda batches: in_batches(joined(batches), schema)


def repair(
    df: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    copies_col: str | None = None,
) -> DataFrame:
    """Repaired conversations, as parts of bounded size.

    Returns ``id``, ``part`` (null where a conversation is one part, else ascending in its
    order), ``turns`` (the repaired turns: role, text), ``audit`` (the initials of the
    edits: Keep, Rerole, Delete, Insert), ``cost``, and what was wrong with the input:
    ``gaps`` in the turn numbers, ``blank``, ``duplicate`` and ``truncated`` rows, and
    ``illegal`` neighbours. A conversation's audit and turns are those of its parts one
    after the other, its numbers their sums.

    Rows are taken by turn, nulls first, those of one turn by role, then text. A null role
    or text counts as one space, so a null text is blank; null ids are one conversation.
    A role counts by its first letter; one of any other letter, or of none, isn't kept.
    Equal rows are duplicates of the first of them. ``copies_col`` says how often a row
    counts; a conversation whose rows all count 0 times is empty, with one part of
    zeros and no turns. Other columns are not looked at; an empty table gives no rows.

    Equal rows are counted before rows are sorted by ranges, and the first turn of each
    role and text is found by a partial minimum and a join whose hot keys can be split;
    so neither a hot conversation nor a hot text goes to one task. What a cut
    conversation needs in one task are its blocks, one by one.
    """
    copies = column(copies_col).cast("bigint") if copies_col else F.lit(1).cast("bigint")
    rows = df.select(
        column(id_col).alias("id"),
        column(turn_col).cast("bigint").alias("turn"),
        F.coalesce(column(role_col), F.lit(" ")).alias("role"),
        F.coalesce(column(text_col), F.lit(" ")).alias("text"),
        copies.alias("copies"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.groupBy("id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = materialise(rows.withColumn("said", F.unhex(F.sha2(said, 256))))
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    first = rows.where("copies > 0").groupBy("id", "said").agg(F.min(place).alias("first"))
    first = first.withColumnsRenamed({"id": "of", "said": "words"})
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("said") == F.col("words"))
    seen = ~F.col("first.turn").eqNullSafe(F.col("turn"))
    placed = rows.join(first.hint("merge"), same, "left").select(
        "id", "turn", "role", "text", "copies", F.coalesce(seen, F.lit(False)).alias("seen")
    )
    order = ("id", "turn", "role", "text")
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    solved = materialise(map_arrow(placed, read_blocks(kind), f"id {kind}, {PART}, {OPEN}"))
    open_blocks = solved.where("paths IS NOT NULL").repartition("id").sortWithinPartitions("id", "part")
    joined = map_arrow(open_blocks, join_blocks(kind), f"id {kind}, {PART}")
    return solved.where("paths IS NULL").select(joined.columns).unionByName(joined)


def digests(parts: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``: ``id``, its numbers, its whole ``audit``, and
    ``repaired_sha256`` of its turns as ``role:text``, joined by line breaks. The turns
    of a cut conversation go through one task part by part, as the hash needs."""
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    hashed = F.sha2(F.concat_ws("\n", lines), 256)
    whole = parts.where("part IS NULL").select(
        "id", *COUNTS, "cost", "audit", hashed.alias("repaired_sha256")
    )
    kind = parts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, cost bigint, audit string, repaired_sha256 string"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((conversation, *row) for conversation, *row in read(batches))
        return in_batches(hashed_rows(rows), arrow)

    cut = parts.where("part IS NOT NULL").select("id", *COUNTS, "cost", "audit", "part", lines.alias("lines"))
    cut = cut.repartition("id").sortWithinPartitions("id", "part")
    return whole.unionByName(map_arrow(cut, run, schema))


def hashed_rows(rows: Iterator[tuple]) -> Iterator[tuple[dict, int]]:
    """The digest of each conversation from its parts in order."""
    for conversation, parts in groupby(rows, key=itemgetter(0)):
        sums, audit, sha, begun = [0] * (len(COUNTS) + 1), [], hashlib.sha256(), False
        for part in parts:
            sums = [a + b for a, b in zip(sums, part[1:])]
            audit.append(part[len(sums) + 1])
            for line in part[-1]:
                sha.update(("\n" if begun else "").encode() + line.encode())
                begun = True
        whole = dict(zip((*COUNTS, "cost"), sums))
        edits = "".join(audit)
        yield {"id": conversation, **whole, "audit": edits, "repaired_sha256": sha.hexdigest()}, len(edits)


def damage(
    df: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``df`` with faults to repair, chosen by a hash of conversation and turn: a twentieth
    each of the rows is dropped (``copies`` 0), emptied, loses its sentence ends, is
    repeated (``copies`` 2) and is given to the user. Nulls become a space in the hash,
    in roles and texts. Returns the four columns and ``copies``."""
    key = F.concat_ws(":", *(F.coalesce(column(c).cast("string"), F.lit(" ")) for c in (id_col, turn_col)))
    what = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = (F.coalesce(column(c), F.lit(" ")) for c in (role_col, text_col))
    return df.select(
        column(id_col).alias(id_col),
        column(turn_col).alias(turn_col),
        F.when(what == 4, "user").otherwise(role).alias(role_col),
        F.when(what == 1, "").when(what == 2, F.translate(text, ".!?", "")).otherwise(text).alias(text_col),
        F.when(what == 0, 0).when(what == 3, 2).otherwise(1).alias("copies"),
    )
