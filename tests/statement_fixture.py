"""Literal statements for the end-to-end checks."""

import datetime as dt
from decimal import Decimal

from fundlens.schemas import EXTRACTIONS

D = dt.date
T0 = dt.datetime(2026, 8, 1, 0, 0, 0)


def money(value):
    return None if value is None else Decimal(str(value)).quantize(Decimal("0.01"))


def day(text):
    return None if text is None else D.fromisoformat(text)


def statement(entry, doc, index, account, bank, company, start, end, printed, lines, file_id=None, at=T0):
    start_balance, end_balance, credits, debits = printed
    return (
        entry, doc, index, file_id or "file_" + doc, at,
        (
            (account, bank, company, money(start_balance), money(end_balance), day(start), day(end),
             money(credits), money(debits)),
            [(day(when), text, money(amount)) for when, text, amount in lines],
        ),
    )


MAIN = ("1111", "Example Bank", "Fixture Co")
C, A, G = "Credibly payment", "1st Alliance payment", "CFG Merchant payment"

BASE = [
    statement("main", "main_1", 1, *MAIN, "2026-01-01", "2026-01-31", (1000, 39300, 38600, 300), [
        ("2026-01-02", "Customer revenue", 20000), ("2026-01-03", "Internal transfer", 1000),
        ("2026-01-04", "Business loan proceeds", 2000), ("2026-01-05", "Credibly funding", 15000),
        ("2026-01-06", "Working capital", 500), ("2026-01-08", C, -100), ("2026-01-15", C, -100),
        ("2026-01-16", "ACH return Credibly", 100), ("2026-01-22", C, -100)]),
    statement("main", "main_2", 2, *MAIN, "2026-02-01", "2026-02-28", (39300, 48775, 10000, 525), [
        ("2026-02-02", "Customer revenue", 10000), ("2026-02-02", A, -75), ("2026-02-05", C, -100),
        ("2026-02-09", A, -75), ("2026-02-12", C, -100), ("2026-02-16", A, -75), ("2026-02-19", C, -100)]),
    statement("main", "main_3", 3, *MAIN, "2026-03-01", "2026-03-31", (48775, 71825, 35050, 12000), [
        ("2026-03-01", "Customer revenue", 12000), ("2026-03-01", "Credibly funding renewal", 12000),
        ("2026-03-02", C, -120), ("2026-03-02", G, -50), ("2026-03-02", A, -90),
        ("2026-03-03", G, -50), ("2026-03-04", G, -50), ("2026-03-05", G, -50), ("2026-03-06", G, -50),
        ("2026-03-06", "ACH return CFG Merchant", 50), ("2026-03-09", C, -120), ("2026-03-09", A, -90),
        ("2026-03-10", "Credibly funding mistaken", 11000), ("2026-03-11", "ACH return Credibly", -11000),
        ("2026-03-16", C, -120), ("2026-03-16", A, -90), ("2026-03-23", C, -120)]),
    statement("holiday", "holiday_1", 1, "2222", "Holiday Bank", "Holiday Co", "2027-06-20", "2027-07-10",
              (50, 0, 200, 250), [
        ("2027-06-20", "Operating expense", -100), ("2027-06-21", "National Funding payment", -50),
        ("2027-06-28", "National Funding payment", -50), ("2027-07-06", "National Funding payment", -50),
        ("2027-07-06", "Customer revenue", 200)]),
    statement("missing", "missing_1", 1, None, "Missing Bank", "Missing Co", "2026-04-01", "2026-04-30",
              (None, None, None, None), [
        ("2026-03-31", "Outside deposit", 100), ("2026-04-02", "Missing amount", None), (None, "Missing date", 50)]),
    statement("overlap", "overlap_1", 1, "3333", "Overlap Bank", "Overlap Co", "2026-05-01", "2026-05-31", (100, 100, 0, 0), []),
    statement("overlap", "overlap_2", 2, "3333", "Overlap Bank", "Overlap Co", "2026-05-15", "2026-06-14", (100, 100, 0, 0), []),
    statement("identical", "identical_1", 1, "4444", "Duplicate Bank", "Duplicate Co", "2026-07-01", "2026-07-31",
              (100, 1100, 1100, 100), [
        ("2026-07-02", "Credibly funding", 1000), ("2026-07-03", C, -100), ("2026-07-06", "ACH return Credibly", 100)]),
    statement("payload", "payload_1", 1, "5555", "Conflict Bank", "Conflict Co", "2026-07-01", "2026-07-31", (100, 100, 0, 0), []),
    statement("binding_a", "binding_a_1", 1, "6666", "Binding Bank", "Binding Co", "2026-07-01", "2026-07-31", (100, 100, 0, 0), [],
              file_id="file_binding_shared"),
    statement("binding_b", "binding_b_1", 1, "6666", "Binding Bank", "Binding Co", "2026-07-01", "2026-07-31", (100, 100, 0, 0), [],
              file_id="file_binding_shared", at=T0 + dt.timedelta(seconds=1)),
]


def rows():
    later = T0 + dt.timedelta(seconds=2)
    identical = next(r for r in BASE if r[1] == "identical_1")
    changed = statement("payload", "payload_1", 1, "5555", "Conflict Bank", "Conflict Co", "2026-07-01", "2026-07-31",
                        (200, 200, 0, 0), [], at=later)
    return [*BASE, (*identical[:4], later, identical[5]), changed]


def extractions(spark):
    return spark.createDataFrame(rows(), EXTRACTIONS)


def ledger(spark):
    at = dt.datetime(2026, 8, 2)
    data = [(r[0], r[1], "bank_statement", r[2], r[3], at) for r in BASE]
    return spark.createDataFrame(
        data, "entry_id string, document_id string, document_type string, document_index bigint, file_id string, updated_at timestamp"
    )
