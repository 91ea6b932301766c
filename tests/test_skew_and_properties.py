"""Operators against brute force on small, skewed, randomly built data."""

import datetime as dt
import hashlib
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fundlens.operators import classify as C, positions as P, reporting, underwriting as U, web as W
from fundlens.operators.running import neighbours, nest_pages, running_totals
from fundlens.operators.statements import canonicalize_extractions
from fundlens.plans.underwriting import Underwriting
from fundlens.sources.calendar import Calendar

from statement_fixture import extractions, ledger, statement

D0 = dt.date(2026, 1, 1)
day = lambda n: D0 + dt.timedelta(days=n)


def skewed_rows(seed, n=400):
    rng = random.Random(seed)
    # One key holds about half of the rows, with many rows on one day.
    return [
        ("hot" if rng.random() < 0.5 else f"k{rng.randrange(8)}", day(rng.choice([3, 3, 3, rng.randrange(40)])), i, rng.randrange(1, 9))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_running_totals_and_neighbours(spark, seed):
    data = skewed_rows(seed)
    df = spark.createDataFrame(data, "key string, day date, id bigint, v bigint")
    df = df.withColumn("tens", F.floor(F.col("id") / 10)).withColumn("month", F.month("day"))
    levels = [["day"], ["day", "tens"], ["month", "day", "tens"]][seed % 3]
    counted = running_totals(df, ["key"], levels, ["id"], {"number": F.lit(1), "total": F.col("v")})
    looked = neighbours(
        counted, ["key"], "number", {"before": ("v", -1), "second": ("v", 2)}, block=7
    )
    expected = {}
    by_key = {}
    for key, when, i, v in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        by_key.setdefault(key, []).append((i, v))
    for rows in by_key.values():
        total = 0
        for place, (i, v) in enumerate(rows):
            total += v
            before = rows[place - 1][1] if place else None
            second = rows[place + 2][1] if place + 2 < len(rows) else None
            expected[i] = (place + 1, total, before, second)
    found = {r.id: (r.number, r.total, r.before, r.second) for r in looked.collect()}
    assert found == expected


def test_pages_hold_everything_in_order(spark):
    df = spark.createDataFrame([("e", i % 17, f"d{i:03d}") for i in range(100)], "entry string, idx bigint, doc string")
    pages = nest_pages(df, "entry", ["idx", "doc"], ["doc"], "rows", page=30).orderBy("page").collect()
    assert [len(p["rows"]) for p in pages] == [30, 30, 30, 10]
    flat = [r.doc for p in pages for r in p["rows"]]
    assert flat == [f"d{i:03d}" for i in sorted(range(100), key=lambda i: (i % 17, i))]


def resolved_frame(spark, rows):
    return spark.createDataFrame(
        rows,
        "entry_id string, document_id string, document_index bigint, file_id string, account_key string, "
        "transaction_index bigint, transaction_id string, transaction_date date, amount decimal(18,2), "
        "canonical_counterparty string, explicit_reversal_indicator boolean",
    )


@pytest.mark.parametrize("seed", range(3))
def test_reversal_pairs_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        doc = rng.randrange(1, 4)
        rows.append((
            "e", f"d{doc}", doc, f"f{doc}", rng.choice(["a", "a", "b"]), i, f"t{rng.randrange(10**6)}_{i}",
            None if rng.random() < 0.05 else day(rng.randrange(30)),
            Decimal(rng.choice([50, -50, 50, -50, 75])) if rng.random() > 0.05 else None,
            rng.choice(["L", "L", None]), rng.random() < 0.45,
        ))
    resolved = resolved_frame(spark, rows)
    current = resolved.filter("document_id <> 'd3'").select("entry_id", "document_id", "document_index", "file_id").distinct()
    ordinals = Calendar(2025, 2026).ordinals(spark)
    found = {(r.reversal_transaction_id, r.original_transaction_id) for r in C.reversal_pairs(resolved, current, ordinals).collect()}

    ordinal = {r.calendar_date: r.business_day_ordinal for r in ordinals.collect()}
    usable = [r for r in rows if r[1] != "d3" and r[7] is not None and r[8] is not None and r[9] is not None]
    choices = {}
    for rev in (r for r in usable if r[10]):
        fits = [
            o for o in usable
            if not o[10] and o[4] == rev[4] and o[8] == -rev[8] and o[7] <= rev[7] and ordinal[rev[7]] - ordinal[o[7]] <= 5
        ]
        if fits:
            best = max(fits, key=lambda o: (o[7], o[2], o[5], o[6]))
            choices.setdefault(best[6], []).append((rev[7], rev[6]))
    expected = {(min(revs)[1], org) for org, revs in choices.items()}
    assert found == expected and len(found) > 3


def test_medians_are_exact(spark):
    rng = random.Random(5)
    groups = {f"p{g}": [Decimal(rng.randrange(1, 400)) / 100 for _ in range(rng.randrange(1, 30))] for g in range(20)}
    df = spark.createDataFrame(
        [("e", p, v, True) for p, values in groups.items() for v in values],
        "entry_id string, position_key string, payment_amount decimal(18,2), successful boolean",
    )
    found = {r.position_key: r.representative_payment_amount for r in P.representative_amounts(df).collect()}
    for p, values in groups.items():
        v = sorted(values)
        assert found[p] == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


def statement_rows(rng, n):
    rows = []
    for i in range(n):
        start = None if rng.random() < 0.1 else day(rng.randrange(60))
        end = None if start is None or rng.random() < 0.05 else start + dt.timedelta(days=rng.randrange(-6, 15))
        rows.append((
            f"e{rng.randrange(25)}", f"d{rng.randrange(40)}", rng.randrange(1, 3), rng.choice([None, " ", "A1", "a1", "B2"]),
            rng.choice(["Bank", "bank", None]), rng.choice(["Co", "Co", None]), start, end,
        ))
    return rows


STATEMENT_COLUMNS = (
    "entry_id string, document_id string, document_index bigint, account_number string, bank_name string, company string, "
    "statement_start_date date, statement_end_date date"
)
low = lambda t: (t or "").lower()
is_blank = lambda t: t is None or not t.strip()


@pytest.mark.parametrize("seed", range(4))
def test_overlaps_match_all_pairs(spark, seed):
    rows = statement_rows(random.Random(seed), 70)
    found = {r.entry_id for r in U.overlapping_entries(spark.createDataFrame(rows, STATEMENT_COLUMNS)).collect()}
    expected = set()
    for a in rows:
        for b in rows:
            if a[0] != b[0] or (a[2], a[1]) >= (b[2], b[1]) or None in (a[6], a[7], b[6], b[7]):
                continue
            compatible = is_blank(a[3]) or is_blank(b[3]) or (low(a[3]) == low(b[3]) and low(a[4]) == low(b[4]))
            if compatible and a[6] <= b[7] and b[6] <= a[7]:
                expected.add(a[0])
    assert found == expected


@pytest.mark.parametrize("seed", range(4))
def test_account_continuity_matches_plain_rules(spark, seed):
    rng = random.Random(seed)
    rows = statement_rows(rng, 60)
    for e in range(10):  # entries whose periods mostly join up
        at = 0
        for i in range(3):
            size = rng.choice([9, 9, 10])
            rows.append((f"j{e}", f"x{i}", i + 1, None, "Bank", "Co", day(at), day(at + size)))
            at += rng.choice([10, 10, 11]) if size == 9 else 11
    found = {r.entry_id: r.account_continuity_uncertain for r in U.account_continuity(spark.createDataFrame(rows, STATEMENT_COLUMNS)).collect()}
    for entry in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == entry]
        missing = [r for r in mine if is_blank(r[3])]
        invalid = any(not low(r[4]) or not low(r[5]) or None in (r[6], r[7]) or r[7] < r[6] for r in missing)
        chained = len(missing) == len(mine) and len({(low(r[4]), low(r[5])) for r in missing}) == 1 and not invalid
        if chained:
            ordered = sorted(missing, key=lambda r: (r[6], r[7]))
            chained = all((b[6] - a[7]).days == 1 for a, b in zip(ordered, ordered[1:]))
        assert found[entry] == (len(mine) > 1 and len(missing) > 0 and not chained), entry


def simulate_attribution(visits):
    """The browser's rules, visit by visit."""
    life, stored, out = dt.timedelta(days=30), {}, {}
    for visitor, visit, ts, params in sorted(visits, key=lambda v: (v[0], v[2], v[1])):
        record = stored.get(visitor)
        if record and record[0] + life <= ts:
            record = None
        if params:
            values = {**(record[1] if record else {}), **params}
            stored[visitor] = (ts, values)
            out[visit] = ("url", values)
        else:
            out[visit] = ("stored", record[1]) if record else ("none", {})
    return out


def test_attribution_matches_simulation(spark):
    rng = random.Random(9)
    visits, urls = [], []
    for i in range(500):
        visitor = 1 if rng.random() < 0.4 else rng.randrange(2, 40)
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 300))
        params = {n: f"v{rng.randrange(9)}" for n in ("app", "utm_id", "utm_term") if rng.random() < 0.25}
        visits.append((visitor, i, ts, params))
        urls.append((visitor, i, ts, "https://x.example/?" + "&".join(f"{k}={v}" for k, v in params.items()) + "&q=1"))
    df = spark.createDataFrame(urls, "visitor_id bigint, visit_id bigint, ts timestamp, url string")
    expected = simulate_attribution(visits)
    for r in W.resolve_attribution(df).collect():
        origin, values = expected[r.visit_id]
        assert r.origin == origin
        assert {n: r[n] for n in ("app", "utm_id", "utm_term") if r[n] is not None} == values


def test_canonical_rows_do_not_depend_on_input_order(spark):
    df = extractions(spark)
    columns = ["file_id", "entry_id", "payload_hash", "duplicate_count"]
    once = sorted(map(tuple, canonicalize_extractions(df).select(*columns).collect()))
    shuffled = canonicalize_extractions(df.orderBy(F.rand(3)).repartition(5)).select(*columns)
    assert once == sorted(map(tuple, shuffled.collect()))


def test_monthly_cadence_with_month_end(spark):
    months = ["2026-01-31", "2026-02-28", "2026-03-31", "2026-04-30", "2026-05-29"]
    lines = [(m, "Credibly payment", -500) for m in months]
    row = statement("m", "m_1", 1, "1", "B", "C", "2026-01-01", "2026-06-30", (9000, 6500, 0, 2500), lines)
    from fundlens.schemas import EXTRACTIONS
    data = spark.createDataFrame([row], EXTRACTIONS)
    book = spark.createDataFrame(
        [("m", "m_1", "bank_statement", 1, "file_m_1", dt.datetime(2026, 8, 2))],
        "entry_id string, document_id string, document_type string, document_index bigint, file_id string, updated_at timestamp",
    )
    run = Underwriting(data, book)
    found = run.positions.collect()
    assert [(p.frequency, p.status) for p in found] == [("MONTHLY", "CURRENT_WITH_MISSES")]
    # Jan 31 is a Saturday: nearest business day; Jun 30 has no payment.
    due = [(str(r.expected_date), r.matched) for r in run.schedule.orderBy("expected_date").collect()]
    assert due == [("2026-01-30", True), ("2026-02-27", True), ("2026-03-31", True), ("2026-04-30", True), ("2026-06-01", True), ("2026-06-30", False)]


def test_running_balance_ends_at_the_calculated_balance(spark):
    run = Underwriting(extractions(spark), ledger(spark))
    last = run.transactions.groupBy("file_id").agg(F.max_by("balance", "transaction_index").alias("balance"))
    joined = run.calculated.join(last, "file_id").filter("balance is not null")
    assert joined.count() > 3 and joined.filter("balance <> calculated_end_balance").count() == 0


def test_fingerprints_of_a_hot_entry(spark):
    rng = random.Random(8)
    names = ["document_id", "document_index", "statement_start_date", "statement_end_date", "withdrawals"]
    rows = []
    for i in range(2_600):
        start = rng.choice([None, "2024-01-01", "2024-01-15", "2025-03-01", "2026-07-01"])
        rows.append(("hot" if i % 13 else "small", f"d{rng.randrange(900)}", rng.choice([None, rng.randrange(3_000)]), start, rng.choice([None, "2026-08-01", "2026-09-01"]), f"{i % 40}.{i % 3}0"))
    rows += rows[:5]
    statements = spark.createDataFrame(rows, "entry_id string, document_id string, document_index int, statement_start_date string, statement_end_date string, withdrawals string")
    head = (1, "READY", 1, 1, True)
    summary = spark.createDataFrame(
        [(e, *head) for e in ("hot", "small", "none")],
        "entry_id string, analysis_version int, analysis_status string, expected_document_count int, extracted_document_count int, all_documents_processed boolean")
    found = reporting.summary_fingerprints(summary, statements.repartition(3), names)

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    assert found.count() == 3
    for row in found.collect():
        plain = lambda r: {**dict(zip(names, r[1:5])), "withdrawals": r[5].rstrip("0").rstrip(".")}
        own = [(r[3] or "", r[4] or "", r[2] is not None, r[2] or 0, r[1], json.dumps(plain(r), separators=(",", ":"))) for r in rows if r[0] == row.entry_id]
        keys = ["entry_id", "analysis_version", "analysis_status", "expected_document_count", "extracted_document_count", "all_documents_processed"]
        head_text = json.dumps(dict(zip(keys, (row.entry_id, *head))), separators=(",", ":"))
        assert row.summary_fingerprint == sha(head_text[:-1] + ',"statements":[' + ",".join(x[-1] for x in sorted(own)) + "]}")
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    # The same rows in one total order, numbered without a window.
    placed = reporting.rows_in_order(statements.withColumn("file_id", F.col("withdrawals")).repartition(5))
    key = lambda r: tuple((v is not None, v or 0 if isinstance(v, int) else v or "") for v in (r.entry_id, r.statement_start_date, r.statement_end_date, r.document_index, r.document_id, r.file_id))
    numbered = sorted(placed.collect(), key=lambda r: r.row)
    assert [r.row for r in numbered] == list(range(1, len(rows) + 1)) and [key(r) for r in numbered] == sorted(map(key, numbered))
    for entry in ("hot", "small"):
        assert [r.place for r in numbered if r.entry_id == entry] == list(range(1, 1 + sum(r[0] == entry for r in rows)))
    assert reporting.rows_in_order(statements.withColumn("file_id", F.lit("f")).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [0, 60, 1_000])
def test_running_totals_by_window_and_by_levels_agree(spark, hot):
    data = [(None if k == "k0" else k, None if i % 11 == 0 else d, i % 3, i, None if i % 7 == 0 else v) for k, d, i, v in skewed_rows(4)]
    df = spark.createDataFrame(data, "key string, day date, part bigint, id bigint, v bigint")
    found = running_totals(df, ["key"], ["day", "part"], ["id"], {"number": F.lit(1), "total": F.col("v"), "odd": F.col("v") % 2 == 1}, hot=hot)
    expected, order = {}, lambda r: (r[1] is not None, r[1], r[2], r[3])
    for key in {r[0] for r in data}:
        total = odd = 0
        place, known = None, False
        for n, r in enumerate(sorted((r for r in data if r[0] == key), key=order), 1):
            known = r[4] is not None or (known and place == r[1:3])
            place, total, odd = r[1:3], total + (r[4] or 0), odd + (r[4] or 0) % 2
            expected[r[3]] = (n, total if known else None, odd if known else None)
    assert {r.id: (r.number, r.total, r.odd) for r in found.collect()} == expected
    assert found.schema["total"].dataType.simpleString() == "bigint"


def test_rows_of_short_keys_move_once_for_their_running_total(spark):
    df = spark.createDataFrame(skewed_rows(5), "key string, day date, id bigint, v bigint").withColumn("tens", F.floor(F.col("id") / 10))
    found = running_totals(df, ["key"], ["day", "tens"], ["id"], {"number": F.lit(1), "total": F.coalesce("v", F.lit(0))})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
