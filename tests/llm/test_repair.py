"""The repair of conversations against a plain dynamic programme, over short and long conversations."""

import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from fundlens.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?")


def plain(kinds: str, begin: int = 0, ends=(0, 3)):
    """Cost and audit by one pass over the rows, with any number of insertions between them."""

    def inserted(ways):
        for _ in range(4):
            for q, (cost, audit) in list(ways.items()):
                to, way = repair._FITS[q], (cost + 3, audit + "I")
                if to not in ways or way < ways[to]:
                    ways[to] = way
        return ways

    ways = inserted({begin: (0, "")})
    for kind in kinds:
        after = {}
        for q, (cost, audit) in ways.items():
            for more, name, to in repair.row_edges(kind, q):
                if to not in after or (cost + more, audit + name) < after[to]:
                    after[to] = (cost + more, audit + name)
        ways = inserted(after)
    return min((ways[q] for q in ends if q in ways), default=None)


def test_searches_meet_in_the_cheapest_least_audit():
    rng = random.Random(1)
    some = ["".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(4, 18))) for _ in range(1500)]
    for kinds in [*map("".join, (x for n in range(4) for x in itertools.product("suaoSUAOx", repeat=n))), *some]:
        assert repair.cheapest(kinds) == plain(kinds)
    for kinds in some[:150]:
        for p, q in itertools.product(repair.STATES, repeat=2):
            assert repair.cheapest(kinds, p, (q,)) == plain(kinds, p, (q,))


def expected(rows):
    """The summary of one conversation, from its rows (turn, role, text) with nulls."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    counts, kinds, seen = dict.fromkeys(("blank", "duplicate", "truncated"), 0), "", set()
    for _, role, text in rows:
        kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not re.search(r"[^\x20\x09-\x0D]", text):
            counts["blank"] += 1
            kind = "x"
        elif (role, text) in seen:
            counts["duplicate"] += 1
            kind = "x"
        elif re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?":
            counts["truncated"] += 1
            kind = kind.upper()
        seen.add((role, text))
        kinds += kind
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit = plain(kinds)
    left, _ = repair.applied(rows, audit, repair.START)
    assert LEGAL.fullmatch("".join(x[1][0] for x in left))
    digest = hashlib.sha256("\n".join(f"{x[1]}:{x[2]}" for x in left).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest


def summaries(rows, **more):
    found = repair.summary(repair.repair(rows, **more)).collect()
    return {r.conv_id: tuple(r)[1:] for r in found}


def test_repair_of_odd_rows(spark):
    talks = {
        1: [(0, "user", "Hi."), (1, "assistant", "Yes."), (1, "assistant", "Yes."), (3, "user", "cut off"), (4, "assistant", "  ")],
        2: [(None, None, None), (None, "user", "q?"), (5, "", "empty role."), (5, "Sys", "capital."), (6, "system", "late.")],
        3: [(0, "user", "")] * 3,
        4: [(-(2**63), "user", "é☺!"), (2**63 - 1, "assistant", "x" * 300_000 + ".")],
        5: [(2, "ua", "a\nb."), (2, "ua", "a\nb."), (2, None, "no role.")],
        None: [(0, "assistant", "Nobody's."), (None, "tool", "t ")],
    }
    rows = [(k, *r, "own", 7) for k, v in talks.items() for r in v]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, part int")
    want = {k: expected(v) for k, v in talks.items()}
    want[4] = (2**63 - 1, *want[4][1:])
    assert summaries(table) == want
    assert summaries(table, part_rows=1) == want  # every conversation in parts
    assert repair.summary(repair.repair(table.limit(0))).collect() == []


def test_long_conversations_go_in_parts(spark):
    rng = random.Random(3)
    words = ["Yes.", "No", "", "Why?", "So it goes."]
    talks = {k: [(rng.randint(0, n), rng.choice(["user", "assistant", "system", "tool"]), f"{rng.choice(words)}{rng.choice(['', '.', str(rng.randint(0, n))])}") for _ in range(n)] for k, n in enumerate((1, 7, 60, 400))}
    rows = spark.createDataFrame([(k, *r) for k, v in talks.items() for r in v], "conv_id int, turn long, role string, text string").repartition(7)
    want = {k: expected(v) for k, v in talks.items()}
    for part_rows in (3, 50, 1000):
        assert summaries(rows, part_rows=part_rows) == want
    turns = repair.repair(rows, part_rows=50).filter("conv_id = 3").select("part", F.posexplode("turns")).select("part", "pos", "col.*").orderBy("part", "pos").collect()
    assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == want[3][-1]
    assert {t.edit for t in turns} <= {"K", "R", "I"} and all((t.turn is None) == (t.edit == "I") for t in turns)


def test_seen_rows_in_sorted_runs(monkeypatch):
    monkeypatch.setattr(repair._Seen, "LIMIT", 3)
    seen = repair._Seen()
    rows = [(str(i % 2), f"text {i}") for i in range(200)]
    assert not any(seen.add(*r) for r in rows) and all(seen.add(*r) for r in rows) and not seen.add("1", "text 0")


def test_damage_follows_the_checksum(spark):
    import zlib

    rows = [(k, t, "assistant", "One. Two! Three?") for k in range(6) for t in range(8)] + [(None, 1, None, None), (3, None, "user", "x.")]
    found = {}
    for r in repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        found.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for k, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if k is None else k}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        one = ("user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
        assert found.get((k, t), []) == [one] * {0: 0, 3: 2}.get(fate, 1)
