"""Repair of conversations by the cheapest edits that give a legal sequence of roles.

The edits of a conversation are paths through a lattice. A node is (rows passed, state); the states are: nothing said
yet, after a system turn, after a user turn, after an assistant turn. Keeping, re-roling and deleting pass a row, an
insertion changes the state only. Two Dijkstra searches run over it, one from the start and one from the legal ends.
They meet; both go on until no crossing as cheap as the best one can be missing, and of all crossings of that cost the
one with the ASCII-least audit (its edits' initials joined) wins.

Rows arrive as a sorted stream. A conversation of up to ``PART_ROWS`` rows is solved at once. A longer one is cut into
parts; each part is solved between every two states, and a second stream over those narrow results picks the way through
all parts. So memory holds one part, and of a whole conversation its audit and 16 bytes for each distinct row.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Stage, arrow_rows, reachable

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
PART_ROWS = 256
PART_CHARS = 1 << 22

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ENDS = (START, ASSISTANT)
_KEPT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_FITS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # where a turn of the role that fits leads
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_SPACE = " \t\n\x0b\x0c\r"


# ---- the lattice ---------------------------------------------------------------


def row_edges(kind: str, state: int):
    """Edits of a row: (cost, initial, state after it). ``kind`` is the initial of its role (``o`` for others), as a
    capital if the text is cut off, or ``x`` for a row that has to go."""
    yield DELETE, "D", state
    if kind != "x":
        more = TRUNCATED if kind.isupper() else 0
        if (to := _KEPT[state].get(kind.lower())) is not None:
            yield KEEP + more, "K", to
        yield REROLE + more, "R", _FITS[state]


class _Side:
    """One of the two searches: labels (cost, audit), settled nodes, and the heap. Nodes of equal cost leave the heap
    in the order of rows passed, so a label is final when its node does: free edges always pass a row."""

    def __init__(self, rows: str, seeds: list[tuple[int, int]], forward: bool):
        self.rows, self.forward = rows, forward
        self.label = {node: (0, "") for node in seeds}
        self.done: dict[tuple[int, int], tuple[int, str]] = {}
        self.heap: list[tuple[int, int, int]] = [(0, self._passed(i), q) for i, q in seeds]
        heapq.heapify(self.heap)

    def _passed(self, i: int) -> int:
        return i if self.forward else len(self.rows) - i

    def top(self) -> float:
        while self.heap and self._node(self.heap[0]) in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def _node(self, entry: tuple[int, int, int]) -> tuple[int, int]:
        return (entry[1] if self.forward else len(self.rows) - entry[1]), entry[2]

    def edges(self, i: int, q: int):
        """Edges out of a node, or into it for the reverse search: (cost, initial, other node)."""
        if self.forward:
            if i < len(self.rows):
                for cost, name, to in row_edges(self.rows[i], q):
                    yield cost, name, (i + 1, to)
            yield INSERT, "I", (i, _FITS[q])
            return
        for p in STATES:
            if i:
                for cost, name, to in row_edges(self.rows[i - 1], p):
                    if to == q:
                        yield cost, name, (i - 1, p)
            if _FITS[p] == q:
                yield INSERT, "I", (i, p)

    def settle(self, other: _Side, node: tuple[int, int] | None = None):
        """Makes the next node (or a given one) final; yields the crossings (cost, audit) to the other search."""
        if node is None:
            self.top()
            node = self._node(heapq.heappop(self.heap))
        cost, audit = self.done[node] = self.label[node]
        if node in other.done:
            yield self._joined(cost, audit, other.done[node])
        for more, name, to in self.edges(*node):
            label = (cost + more, audit + name if self.forward else name + audit)
            if to in other.done:
                yield self._joined(*label, other.done[to])
            if to not in self.done and (to not in self.label or label < self.label[to]):
                if to not in self.label or label[0] < self.label[to][0]:
                    heapq.heappush(self.heap, (label[0], self._passed(to[0]), to[1]))
                self.label[to] = label

    def _joined(self, cost: int, audit: str, rest: tuple[int, str]) -> tuple[int, str]:
        return cost + rest[0], audit + rest[1] if self.forward else rest[1] + audit


@functools.lru_cache(maxsize=1 << 14)
def cheapest(rows: str, begin: int = START, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Cost and audit of the cheapest way from a state before the rows to one of the states after them; None if there
    is none. Ties go to the ASCII-least audit: of audits of one cost and the same rows none begins another, so the
    least prefixes and suffixes of a crossing give the least whole."""
    ahead, behind = _Side(rows, [(0, begin)], True), _Side(rows, [(len(rows), q) for q in ends], False)
    found = [x for q in ends for x in behind.settle(ahead, (len(rows), q))] + list(ahead.settle(behind, (0, begin)))
    best = min(found, default=None)
    while True:
        a, b = ahead.top(), behind.top()
        if a == b == float("inf") or (best is not None and a + b > best[0]):
            return best
        side, other = (ahead, behind) if a <= b else (behind, ahead)
        for crossing in side.settle(other):
            best = crossing if best is None else min(best, crossing)


def between(rows: str) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a part of a conversation, for all states that rows can join."""
    ways = ((p, q, cheapest(rows, p, (q,))) for p in STATES for q in STATES)
    return [(p, q, *way) for p, q, way in ways if way is not None]


def applied(turns: list[tuple], audit: str, state: int) -> tuple[list[tuple], int]:
    """The turns (turn, role, text, edit) that an audit leaves, and the state after them; inserted ones have no turn."""
    out, at = [], iter(turns)
    for name in audit:
        turn, role, text = (None, None, "") if name == "I" else next(at)
        if name == "D":
            continue
        state = _KEPT[state][role[0]] if name == "K" else _FITS[state]
        out.append((turn, role if name == "K" else _ROLE[state], text, name))
    return out, state


# ---- streams of rows ------------------------------------------------------------


class _Seen:
    """The rows seen of a conversation, by 128-bit digests: a small set, and sorted arrays once there are many."""

    LIMIT = 1 << 16

    def __init__(self):
        self.recent: set[bytes] = set()
        self.runs: list[np.ndarray] = []

    def add(self, role: str, text: str) -> bool:
        """Whether a row is there already; it is afterwards."""
        raw = role.encode("utf-8", "surrogatepass")
        digest = hashlib.blake2b(len(raw).to_bytes(8, "little") + raw + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if digest in self.recent:
            return True
        for run in self.runs:
            at = int(np.searchsorted(run, np.array(digest, "S16")))
            if at < len(run) and run[at] == np.array(digest, "S16"):
                return True
        self.recent.add(digest)
        if len(self.recent) >= self.LIMIT:
            self.runs.append(np.sort(np.array(list(self.recent), "S16")))
            self.recent = set()
            if len(self.runs) > 8:
                self.runs = [np.sort(np.concatenate(self.runs))]
        return False


class _Reader:
    """Takes the rows of one conversation in order; ``part`` closes what has come since the last part."""

    def __init__(self, key):
        self.key, self.seen = key, _Seen()
        self.number, self.chars = 0, 0
        self.turns: list[tuple] = []
        self.kinds: list[str] = []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.last_initial: str | None = None
        self.first_turn = self.last_turn = None
        self.distinct = 0

    def row(self, turn, role: str | None, text: str | None) -> None:
        role, text = " " if role is None else role, " " if text is None else text
        initial = role[:1]
        if self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last_initial = initial
        if turn is not None:
            self.distinct += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        kind = initial if initial in ("s", "u", "a") else "o"
        known = self.seen.add(role, text)
        if not _WORD.search(text):
            self.counts["blank"] += 1
            kind = "x"
        elif known:
            self.counts["duplicate"] += 1
            kind = "x"
        elif text.rstrip(_SPACE)[-1] not in ".!?":
            self.counts["truncated"] += 1
            kind = kind.upper()
        self.turns.append((turn, role, text))
        self.kinds.append(kind)
        self.chars += len(role) + len(text)

    def full(self, rows: int) -> bool:
        return len(self.turns) >= rows or self.chars >= PART_CHARS

    def part(self, last: bool) -> dict:
        gaps = 0 if self.first_turn is None else min(self.last_turn - self.first_turn + 1 - self.distinct, (1 << 63) - 1)
        rows = "".join(self.kinds)
        out = {"key": self.key, "part": self.number, "last": last, "gaps": gaps, **self.counts, "cost": None, "audit": None, "ways": None}
        if last and not self.number:
            out["cost"], out["audit"] = cheapest(rows)
            out["turns"] = [dict(zip(_TURN, x)) for x in applied(self.turns, out["audit"], START)[0]]
        else:
            out["ways"] = [dict(zip(("before", "after", "cost", "audit"), x)) for x in between(rows)]
            out["turns"] = [dict(zip(_TURN, (*x, None))) for x in self.turns]
        self.number, self.chars, self.turns, self.kinds = self.number + 1, 0, [], []
        return out


_TURN = ("turn", "role", "text", "edit")
_TURNS = "array<struct<turn: long, role: string, text: string, edit: string>>"
_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"


def _parts(part_rows: int, schema: pa.Schema, flush: int = 64):
    """Parts of the conversations of a sorted partition (key, turn, role, text)."""

    def run(batches):
        reader, out, held = None, [], 0
        for batch in batches:
            for key, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if reader is None or key != reader.key:
                    if reader is not None:
                        out.append(reader.part(True))
                    reader = _Reader(key)
                elif reader.full(part_rows):
                    out.append(reader.part(False))
                reader.row(turn, role, text)
                held += len(text or "")
                if len(out) >= flush or (out and held >= PART_CHARS):
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
        if reader is not None:
            out.append(reader.part(True))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _chosen(schema: pa.Schema):
    """Per conversation, of a sorted partition (key, part, last, ways): the audit of each of its parts, the state
    before it, and the whole cost."""

    def best_way(ways: dict[int, tuple[int, str, tuple]]):
        cost, _, path = min(ways[q] for q in ENDS if q in ways)
        out = []
        while path:
            path, number, state, audit = path
            out.append((number, state, audit))
        return cost, out[::-1]

    def run(batches):
        ways: dict[int, tuple[int, str, tuple]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] == 0:
                    ways = {START: (0, "", ())}
                after: dict[int, tuple[int, str, tuple]] = {}
                for w in r["ways"]:
                    if w["before"] in ways:
                        cost, audit, path = ways[w["before"]]
                        way = (cost + w["cost"], audit + w["audit"], (path, r["part"], w["before"], w["audit"]))
                        if w["after"] not in after or way[:2] < after[w["after"]][:2]:
                            after[w["after"]] = way
                ways = after
                if r["last"]:
                    cost, path = best_way(ways)
                    for at in range(0, len(path), 256):
                        yield pa.RecordBatch.from_pylist(
                            [{"key": r["key"], "part": n, "state": q, "cost": cost, "audit": audit} for n, q, audit in path[at : at + 256]], schema)

    return run


def _mended(schema: pa.Schema):
    """The turns of each part after its audit."""

    def run(batches):
        for batch in batches:
            out = batch.to_pylist()
            for r in out:
                turns = applied([(t["turn"], t["role"], t["text"]) for t in r["turns"]], r["audit"], r.pop("state"))[0]
                r["turns"] = [dict(zip(_TURN, x)) for x in turns]
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """The repaired conversations: a row for each part of one, (key, part, last, gaps, blank, duplicate, truncated,
    illegal, cost, audit, turns). ``turns`` are the part's turns after repair (turn, role, text, edit: K, R or I; an
    inserted turn has none), ``audit`` its edits. The counts and the cost are those of the whole conversation; in a
    part that is not the last the counts go as far as that part. Almost all conversations have one part.

    Rows go by (turn, role, text), null turns first. A null role or text is one space. Rows of a null key are one
    conversation. Blank rows and repeats of a (role, text) are deleted; an empty role, and any that begins with none
    of s, u and a, can only be re-roled or deleted. A conversation of which nothing is left has no turns; an empty
    table has no conversations. Other columns are not looked at. ``gaps`` is at most 2**63 - 1.

    A conversation is read by one task, as its edits depend on all its rows in order; it is never one value.
    """
    spark = rows.sparkSession
    reachable(spark)
    stage = Stage(spark, "repair")
    kind = rows.schema[key].dataType.simpleString()
    one = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"))
    ordered = one.repartition("key").sortWithinPartitions("key", "turn", "role", "text")
    head = f"key {kind}, part int, last boolean, {_COUNTS}, cost long, audit string"
    ways = f"{head}, ways array<struct<before: int, after: int, cost: long, audit: string>>, turns {_TURNS}"
    shape = _arrow(spark.createDataFrame([], ways).schema)
    with arrow_rows(spark, 500):
        parts = stage.write(ordered.mapInArrow(_parts(part_rows, shape), ways), "parts")
    whole = parts.filter("last AND part = 0").drop("ways")
    cut = parts.filter("NOT (last AND part = 0)")
    path = f"key {kind}, part int, state int, cost long, audit string"
    narrow = cut.select("key", "part", "last", "ways").repartition("key").sortWithinPartitions("key", "part")
    chosen = narrow.mapInArrow(_chosen(_arrow(spark.createDataFrame([], path).schema)), path).select(F.col("key").alias("k"), F.col("part").alias("p"), "state", "cost", "audit")
    both = cut.drop("cost", "audit", "ways").join(chosen, F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")))
    names = [*whole.columns]
    with arrow_rows(spark, 16):
        mended = stage.write(both.select(*names, "state").mapInArrow(_mended(_arrow(whole.schema)), whole.schema), "mended")
    return whole.union(mended.select(*names)).withColumnRenamed("key", key)


def _digests(schema: pa.Schema):
    """Per conversation, of a sorted partition (key, part, last, turns): SHA-256 of its ``role:text`` lines."""

    def run(batches):
        digest, first = hashlib.sha256(), True
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["part"] == 0:
                    digest, first = hashlib.sha256(), True
                for t in r["turns"]:
                    digest.update(f"{'' if first else chr(10)}{t['role']}:{t['text']}".encode("utf-8", "surrogatepass"))
                    first = False
                if r["last"]:
                    out.append({"key": r["key"], "repaired_sha256": digest.hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def summary(repaired: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation: key, gaps, blank, duplicate, truncated, illegal, cost, audit of the whole, and the
    SHA-256 of the repaired ``role:text`` lines joined by line ends (of the empty string if nothing is left)."""
    spark = repaired.sparkSession
    rows = repaired.withColumnRenamed(key, "key")
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    whole = rows.filter("last AND part = 0").select("key", *columns, "audit", F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256"))
    cut = rows.filter("NOT (last AND part = 0)")
    totals = cut.groupBy("key").agg(
        *[F.max(F.when(F.col("last"), F.col(c))).alias(c) for c in columns],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    shape = f"key {rows.schema['key'].dataType.simpleString()}, repaired_sha256 string"
    with arrow_rows(spark, 16):
        digests = cut.select("key", "part", "last", "turns").repartition("key").sortWithinPartitions("key", "part").mapInArrow(
            _digests(_arrow(spark.createDataFrame([], shape).schema)), shape)
        digests = digests.select(F.col("key").alias("k"), "repaired_sha256")
        return whole.union(totals.join(digests, F.col("key").eqNullSafe(F.col("k"))).select(*whole.columns)).withColumnRenamed("key", key)


def damage(rows: DataFrame) -> DataFrame:
    """Test damage by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its end marks
    away, 3 repeats it, 4 makes it a user's; a null counts as one space."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate = F.crc32(named.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    copies = F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("fate")).select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")
