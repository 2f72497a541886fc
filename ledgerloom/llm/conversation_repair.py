"""Repair of damaged conversations by the cheapest edits, found by a Viterbi search with coalescing survivors.

Rows are kept, given another role, deleted, or preceded by inserted empty turns, until the initials of the roles read
``(s?(ua)+)?``. Four states tell what the output so far ends with: nothing, s, u, a. The search runs from the last row to the
first, so a state's survivor is its cheapest completion; survivors are paths in a tree of backpointers with counted references,
and once all of them share an ancestor, what follows it is decided and leaves the tree. In each state the letters of an edit
name its successor, so tied completions differ in their first letter, and the least letter is the least complete string.

A conversation of any length is searched in parallel. Rows are put in order by ranges of (conversation, turn), so a
conversation may span many tasks, and are packed into chunks. A chunk's edits act on costs as a 4 x 4 matrix under (min, +); one
pass over the matrices of a conversation, from its end, gives each chunk the costs of what follows it, with which its own
survivors are found for each of the four states that may enter it; a pass in order then picks one for each chunk. Conversations
that lie within one chunk, which are nearly all, are done where they are read and their texts move once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut

#: A chunk ends with this many rows or bytes of text.
ROWS, BYTES = 1024, 4 << 20
START, S, U, A = range(4)
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
#: The state that a user turn or an assistant turn leads to, by state; only one of the two may come next.
NEXT = (U, U, A, U)
ROLE = {U: "user", A: "assistant"}
#: Costs of what a conversation still needs at its end, by state, and the letters of that.
END, END_WORDS = (0, 10, 5, 0), ("", "II", "I", "")
#: Kinds of rows: the initial's code (s, u, a, other), plus 4 when truncated; GONE must be deleted.
GONE, BLANK = 8, 9
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_WHITE = " \t\n\x0b\x0c\r"


def kind_of(role: str, truncated: bool) -> int:
    return {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + 4 * truncated


def options(kind: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row, in the order of the letters."""
    out = [("D", DELETE, state)]
    if kind < GONE:
        initial, more = kind % 4, TRUNCATED * (kind >= 4)
        if initial == 0 and state == START:
            out.append(("K", more, S))
        if initial == NEXT[state] - 1:
            out.append(("K", more, NEXT[state]))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


@lru_cache(100_000)
def step(kind: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...], tuple[int, ...]]:
    """For each state before a row: the cost of the cheapest completion, the letters up to this row's edit, and the state after it.

    after: costs by state after the row, less their minimum, so few differ and each is computed once.
    """
    choices = [options(kind, q) for q in range(4)]
    cost = [min(c + after[n] for _, c, n in own) for own in choices]
    for _ in range(3):
        cost = [min(c, INSERT + cost[NEXT[q]]) for q, c in enumerate(cost)]
    words, states = [], []
    for q in range(4):
        word = ""
        while True:
            tied = [(letter, n) for letter, c, n in choices[q] if c + after[n] == cost[q]]
            if INSERT + cost[NEXT[q]] == cost[q]:
                tied.append(("I", -1))
            letter, n = min(tied)
            word += letter
            if letter != "I":
                break
            q = NEXT[q]
        words.append(word)
        states.append(n)
    return tuple(cost), tuple(words), tuple(states)


class _Node:
    __slots__ = ("word", "parent", "children", "exit")

    def __init__(self, word: str, parent: _Node | None, exit: int):
        self.word, self.parent, self.children, self.exit = word, parent, [], exit
        if parent is not None:
            parent.children.append(self)


class Survivors:
    """The cheapest completions from the four states, fed with rows from the last to the first."""

    def __init__(self, costs: tuple[int, ...] = END, words: tuple[str, ...] = END_WORDS):
        self.base, self.costs = 0, tuple(costs)
        self.root = _Node("", None, -1)
        self.heads = [_Node(w, self.root, q) for q, w in enumerate(words)]
        self.decided: list[str] = []
        self.held, self.most_held = 5, 5

    def feed(self, kind: int) -> None:
        least = min(self.costs)
        self.base += least
        self.costs, words, states = step(kind, tuple(c - least for c in self.costs))
        old = self.heads
        self.heads = [_Node(words[q], old[n], old[n].exit) for q, n in enumerate(states)]
        self.held += 4
        for node in old:  # a survivor that none goes on from is released, with what only it refers to
            while not node.children and node.parent is not None:
                node.parent.children.remove(node)
                node = node.parent
                self.held -= 1
        self.most_held = max(self.most_held, self.held)
        while len(self.root.children) == 1 and self.root.children[0].children:  # all share this ancestor: it is decided
            self.root = self.root.children[0]
            self.root.parent = None
            self.decided.append(self.root.word)
            self.held -= 1

    def cost(self, state: int) -> int:
        return self.base + self.costs[state]

    def edits(self, state: int) -> tuple[str, int]:
        """Letters of the completion from a state, and the state in which it leaves the last row fed first."""
        node, out = self.heads[state], []
        while node is not self.root and node is not None:
            out.append(node.word)
            node = node.parent
        return "".join(out) + "".join(reversed(self.decided)), self.heads[state].exit


def matrix(kinds: bytes) -> np.ndarray:
    """Costs of the rows' edits from each state to each, by products in pairs; inserts belong to the row that follows them."""
    if not kinds:
        out = np.full((4, 4), 1 << 40, np.int64)
        np.fill_diagonal(out, 0)
        return out
    at = np.frombuffer(kinds, np.uint8)
    every = np.stack([_kind_matrix(k) for k in range(BLANK + 1)])[at]
    while len(every) > 1:
        odd = every[-1:] if len(every) % 2 else every[:0]
        left, right = every[0 : len(every) - len(odd) : 2], every[1 : len(every) - len(odd) : 2]
        every = np.concatenate([(left[:, :, :, None] + right[:, None, :, :]).min(2), odd])
    return every[0]


def _kind_matrix(kind: int) -> np.ndarray:
    out = np.full((4, 4), 1 << 40, np.int64)
    for q in range(4):
        at, more = q, 0
        for _ in range(3):
            for _, c, n in options(kind, at):
                out[q, n] = min(out[q, n], more + c)
            at, more = NEXT[at], more + INSERT
    return out


def repaired(edits: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], int]:
    """Lines ``role:text`` that the edits make of the rows, and the state they end in."""
    out, i = [], 0
    for e in edits:
        if e == "D":
            i += 1
            continue
        if e == "I":
            state = NEXT[state]
            out.append(ROLE[state] + ":")
            continue
        if e == "R" or roles[i][0] != "s":
            state = NEXT[state]
        else:
            state = S
        out.append(f"{ROLE[state] if e == 'R' else roles[i]}:{texts[i]}")
        i += 1
    return out, state


class _Chunk:
    """Rows of one conversation that follow each other."""

    def __init__(self):
        self.kinds, self.roles, self.texts, self.bytes = bytearray(), [], [], 0
        self.marks: dict[bytes, int] = {}
        self.turns: list[int | None] = [None, None, 0]  # least, largest, how many
        self.illegal, self.last = 0, -1
        self.repeats: list[int] = []

    def add(self, turn: int | None, role: str, text: str, blank: bool, truncated: bool) -> None:
        kind = kind_of(role, truncated)
        self.illegal += bool(self.kinds) and (self.last, kind % 4) not in _LEGAL
        self.last = kind % 4
        if not blank:
            mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            if mark in self.marks:
                self.repeats.append(len(self.kinds))
            else:
                self.marks[mark] = len(self.kinds)
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        self.kinds.append(kind + 16 * blank)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text)


def _final(kinds: bytes, repeats: list[int]) -> tuple[bytes, list[int]]:
    """Kinds with what must be deleted, and how many rows are blank, duplicate and truncated."""
    own = np.frombuffer(bytes(kinds), np.uint8).copy()
    own[own >= 16] = BLANK
    own[np.array(repeats, np.int64)] = GONE
    return own.tobytes(), [int((own == BLANK).sum()), int((own == GONE).sum()), int(((own >= 4) & (own < GONE)).sum())]


def _sha(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: Of a chunk: the least and largest turn and how many, the role codes at both ends, and faults within.
_ENDS = "least long, largest long, turns long, head int, tail int, inner long"


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) after damage by crc32 of ``conv_id:turn`` modulo 20; null roles and texts are one space.

    A dropped row stays with no copies and no text, so that its conversation does.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20).cast("int").alias("hit"))
    text = F.when(F.col("hit") <= 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1).alias("copies"))


def repair(rows: DataFrame, chunk_rows: int = ROWS, chunk_bytes: int = BYTES) -> DataFrame:
    """Faults, cheapest edits and the repaired text's hash of each conversation in rows (conv_id, turn, role, text and maybe copies).

    Rows are taken by turn, nulls first, then by role and text. A null conv_id is a conversation; null roles and texts are one
    space; a role without an initial or with one besides s, u, a cannot be kept. A row of ``copies`` 0 only says that its
    conversation exists. Texts of any length are rows of their own chunk; other columns play no part.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text"), F.col("copies") if "copies" in rows.columns else F.lit(1).alias("copies"))
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    body = F.rtrim("text", F.lit(_WHITE))
    ranged = ranged.select("*", (body == "").alias("blank"), ((body != "") & ~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    schema = f"conv_id {kind}, part int, seq int, {RESULT}, kinds binary, repeats array<int>, marks array<binary>, places array<int>, {_ENDS}, roles array<string>, texts array<string>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out = TaskContext.get().partitionId(), 0, []
        types = None

        def whole(conv, c: _Chunk) -> None:
            kinds, faults = _final(c.kinds, c.repeats)
            search = Survivors()
            for k in reversed(kinds):
                search.feed(k)
            audit, _ = search.edits(START)
            gaps = 0 if c.turns[0] is None else c.turns[1] - c.turns[0] + 1 - c.turns[2]
            out.append({"conv_id": conv, "part": part, "seq": seq} | dict(zip(("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), (gaps, *faults, c.illegal, search.cost(START), audit, _sha(repaired(audit, START, c.roles, c.texts)[0])))))

        def piece(conv, c: _Chunk) -> None:
            codes = [k % 4 for k in c.kinds[:1] + c.kinds[-1:]] or [-1, -1]
            out.append({"conv_id": conv, "part": part, "seq": seq, "kinds": bytes(c.kinds), "repeats": c.repeats, "marks": list(c.marks), "places": list(c.marks.values()), "least": c.turns[0], "largest": c.turns[1], "turns": c.turns[2], "head": codes[0], "tail": codes[-1], "inner": c.illegal, "roles": c.roles, "texts": c.texts})

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(out, schema=types)
            out.clear()
            return made

        held = None  # [conversation, chunk, whether all its rows so far are in this chunk and its first row cannot be elsewhere]
        for batch in batches:
            if types is None:
                named = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary()), "array<string>": pa.list_(pa.string())}
                types = pa.schema([("conv_id", batch.schema.field("conv_id").type), *((n, named[t]) for n, t in (f.rsplit(" ", 1) for f in schema.split(", ")[1:]))])
            for conv, turn, role, text, copies, blank, truncated in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "blank", "truncated"))):
                if held is None or held[0] != conv:
                    if held is not None:
                        (whole if held[2] else piece)(held[0], held[1])
                        seq += 1
                    held = [conv, _Chunk(), held is not None]
                elif len(held[1].kinds) >= chunk_rows or held[1].bytes >= chunk_bytes:
                    piece(held[0], held[1])
                    seq += 1
                    held = [conv, _Chunk(), False]
                    if len(out) >= 16:
                        yield flush()
                for _ in range(copies):
                    held[1].add(turn, role, text, blank, truncated)
            if out:
                yield flush()
        if held is not None:
            piece(held[0], held[1])
            yield flush()

    packed = cut(ranged.mapInArrow(pack, schema))
    done = [f.split(" ")[0] for f in RESULT.split(", ")]
    chunks = packed.where("cost is null")

    # a row that an earlier chunk has seen is a duplicate: one row for each chunk and text meets here, however often it is repeated
    seen = chunks.select("conv_id", "part", "seq", F.explode(F.arrays_zip("marks", "places")).alias("m")).select("conv_id", "part", "seq", "m.marks", "m.places")
    first = seen.groupBy("conv_id", "marks").agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n")).where("n > 1")
    late = seen.alias("s").join(first.alias("f"), F.col("s.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("s.marks") == F.col("f.marks"))).where("struct(s.part, s.seq) <> f.first")
    late = late.groupBy("s.part", "s.seq").agg(F.collect_list("s.places").alias("late"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_final(k, (r or []) + (x or [])) for k, r, x in zip(batch["kinds"].to_pylist(), batch["repeats"].to_pylist(), batch["late"].to_pylist())]
            kept = {c: batch[c] for c in ("conv_id", "part", "seq", *(f.split(" ")[0] for f in _ENDS.split(", ")))}
            faults = {c: pa.array([f[i] for _, f in own], pa.int64()) for i, c in enumerate(("blank", "duplicate", "truncated"))}
            yield pa.record_batch(kept | faults | {"kinds": pa.array([k for k, _ in own], pa.binary()), "m": pa.array([matrix(k).ravel() for k, _ in own], pa.list_(pa.int64()))})

    ends = [f.split(" ")[0] for f in _ENDS.split(", ")]
    summed = cut(chunks.select("conv_id", "part", "seq", "kinds", "repeats", *ends).join(late, ["part", "seq"], "left").mapInArrow(sums, f"conv_id {kind}, part int, seq int, {_ENDS}, blank long, duplicate long, truncated long, kinds binary, m array<long>"))

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From a conversation's last chunk to its first: the costs after each, and sums so far, which are whole at the first."""
        conv, after, total, later = None, None, None, None
        for batch in batches:
            rows, out, sums_ = batch.to_pylist(), [], []
            for r in rows:
                if total is None or r["conv_id"] != conv:
                    conv, after, later = r["conv_id"], np.array(END, np.int64), None
                    total = {"largest": None, "least": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                out.append(after)
                for c in ("blank", "duplicate", "truncated"):
                    total[c] += r[c]
                total["illegal"] += r["inner"]
                if r["head"] >= 0:
                    total["illegal"] += later is not None and (r["tail"], later) not in _LEGAL
                    later = r["head"]
                if r["least"] is not None:
                    total["turns"] += r["turns"] - (r["largest"] == total["least"])
                    total["largest"] = r["largest"] if total["largest"] is None else total["largest"]
                    total["least"] = r["least"]
                after = (np.array(r["m"], np.int64).reshape(4, 4) + after[None, :]).min(1)
                gaps = 0 if total["least"] is None else total["largest"] - total["least"] + 1 - total["turns"]
                sums_.append((gaps, total["blank"], total["duplicate"], total["truncated"], total["illegal"], int(after[START])))
            named = {c: pa.array([x[i] for x in sums_], pa.int64()) for i, c in enumerate(done[:6])}
            yield pa.record_batch({c: batch[c] for c in ("conv_id", "part", "seq", "kinds")} | named | {"after": pa.array(out, pa.list_(pa.int64()))})

    lasting = ", ".join(RESULT.split(", ")[:6])
    ordered = summed.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
    priced = cut(ordered.mapInArrow(costs, f"conv_id {kind}, part int, seq int, kinds binary, {lasting}, after array<long>"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits, exits = [], []
            for kinds, after in zip(batch["kinds"].to_pylist(), batch["after"].to_pylist()):
                own = Survivors(tuple(after), ("",) * 4)
                for k in reversed(kinds):
                    own.feed(k)
                found = [own.edits(q) for q in range(4)]
                edits.append([e for e, _ in found])
                exits.append([x for _, x in found])
            yield pa.record_batch({c: batch[c] for c in ("conv_id", "part", "seq", *done[:6])} | {"edits": pa.array(edits, pa.list_(pa.string())), "exits": pa.array(exits, pa.list_(pa.int32()))})

    found = cut(priced.repartition("part", "seq").mapInArrow(search, f"conv_id {kind}, part int, seq int, {lasting}, edits array<string>, exits array<int>"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In a conversation's order, for each chunk its edits and then its texts."""
        conv, now, fields = None, None, None

        def close() -> dict:
            last = END_WORDS[now["state"]]
            lines, _ = repaired(last, now["state"], [], [])
            write(lines)
            return now["sums"] | {"conv_id": conv, "audit": "".join(now["audit"]) + last, "repaired_sha256": now["sha"].hexdigest()}

        def write(lines: list[str]) -> None:
            if lines:
                now["sha"].update(("\n" * now["open"] + "\n".join(lines)).encode())
                now["open"] = True

        for batch in batches:
            fields = fields or batch.schema.field("conv_id").type
            out = []
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != conv:
                    if now is not None:
                        out.append(close())
                    conv, now = r["conv_id"], {"state": START, "sums": {c: r[c] for c in done[:6]}, "audit": [], "sha": hashlib.sha256(), "open": False}
                if r["edits"] is not None:
                    now["audit"].append(r["edits"][now["state"]])
                    now["next"] = r["exits"][now["state"]]
                else:
                    lines, _ = repaired(now["audit"][-1], now["state"], r["roles"], r["texts"])
                    write(lines)
                    now["state"] = now["next"]
            yield pa.RecordBatch.from_pylist(out, schema=_schema(fields))
        if now is not None:
            yield pa.RecordBatch.from_pylist([close()], schema=_schema(fields))

    def _schema(conv: pa.DataType) -> pa.Schema:
        return pa.schema([("conv_id", conv), *((c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in done)])

    texts = chunks.select("conv_id", "part", "seq", "roles", "texts")
    both = found.unionByName(texts, allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", F.col("edits").isNull())
    large = ordered.mapInArrow(choose, f"conv_id {kind}, {RESULT}")
    return packed.where("cost is not null").select("conv_id", *done).unionByName(large)
