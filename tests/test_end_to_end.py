from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fundlens.operators.underwriting import private_fields
from fundlens.functions.sql import register_functions
from fundlens.plans import app_tables as A
from fundlens.plans.underwriting import Underwriting
from fundlens.plans.views import register_views

from statement_fixture import extractions, ledger


@pytest.fixture(scope="module")
def run(spark):
    return Underwriting(extractions(spark), ledger(spark))


def one(df, condition):
    found = df.filter(condition).collect()
    assert len(found) == 1, found
    return found[0]


def test_canonical(run):
    assert run.extractions.count() == 13
    assert run.canonical.count() == 10
    assert run.calculated.count() == 10
    same = one(run.canonical, "file_id = 'file_identical_1'")
    assert (same.duplicate_count, same.duplicate_payload_conflict, same.duplicate_binding_conflict) == (2, False, False)
    payload = one(run.canonical, "file_id = 'file_payload_1'")
    assert payload.duplicate_payload_conflict and not payload.duplicate_binding_conflict
    assert payload.statement.summary.start_balance == 200
    shared = one(run.canonical, "file_id = 'file_binding_shared'")
    assert shared.duplicate_binding_conflict and shared.entry_id == "binding_b"


def test_statement_deposits(run):
    assert run.statement_summary.filter("entry_id = 'main'").count() == 3
    first = one(run.statement_summary, "document_id = 'main_1'")
    assert (first.total_deposits, first.confirmed_non_revenue_deposits, first.true_deposits) == (38600, 18100, 20500)
    assert first.ambiguous_non_revenue_candidate_amount == 500
    assert len(first.large_mca_deposits) == 1
    third = one(run.statement_summary, "document_id = 'main_3'")
    assert [d.amount for d in third.large_mca_deposits] == [Decimal("12000.00")]
    assert third.overall_withholding_percentage == Decimal("7.92")


def test_reversals(run):
    first = run.classified.filter("document_id = 'main_1'")
    assert first.filter("is_confirmed_reversal").count() == 1
    assert first.filter("is_reversed_payment").count() == 1
    third = {r.transaction_id: r for r in run.classified.filter("document_id = 'main_3'").collect()}
    returned = next(r for r in third.values() if r.is_confirmed_reversal and r.amount == 50)
    original = third[returned.paired_reversal_transaction_id]
    assert str(original.transaction_date) == "2026-03-06" and original.amount == -50
    mistaken = next(r for r in third.values() if r.amount == 11000)
    assert mistaken.is_reversed_original
    assert third[mistaken.paired_reversal_transaction_id].amount == -11000


def test_positions(run):
    main = run.positions.filter("entry_id = 'main' and position_confidence = 'CONFIRMED'")
    assert {"BUSINESS_DAILY", "WEEKLY"} <= {r.frequency for r in main.collect()}
    for lender in ("Credibly", "1st Alliance"):
        assert main.filter(F.col("canonical_lender") == lender).select("position_key").distinct().count() >= 2
    missed = {r.status for r in main.filter("missed_payment_count > 0").collect()}
    assert {"CURRENT_WITH_MISSES", "INACTIVE"} <= missed
    holiday = one(run.positions, "entry_id = 'holiday' and canonical_lender = 'National Funding'")
    assert (holiday.frequency, holiday.status, holiday.missed_payment_count) == ("WEEKLY", "CURRENT_PAYING", 0)
    same = one(run.positions, "entry_id = 'identical' and canonical_lender = 'Credibly'")
    assert (same.successful_payment_count, same.total_paid) == (0, 0)
    assert (same.frequency, same.position_confidence) == ("UNCONFIRMED", "CONFIRMED")


def test_position_totals_add_up(run):
    per_document = run.positions.groupBy("position_key").agg(F.sum("total_paid").alias("a"))
    whole = run.graded_positions.select("position_key", F.col("total_paid").alias("b"))
    assert per_document.join(whole, "position_key").filter("a <> b").count() == 0


def test_balances_and_reasons(run):
    holiday = one(run.statement_summary, "entry_id = 'holiday'")
    assert holiday.negative_balance_days == 16 and holiday.average_daily_balance is not None
    missing = one(run.statement_summary, "entry_id = 'missing'")
    assert missing.total_deposits is None and missing.average_daily_balance is None
    assert {"MISSING_CALCULATION_INPUT", "TRANSACTION_OUTSIDE_PERIOD"} <= set(missing.quality_reasons)
    overlap = run.statement_summary.filter("entry_id = 'overlap'").collect()
    assert len(overlap) == 2 and all("OVERLAPPING_STATEMENTS" in r.quality_reasons for r in overlap)


def test_submissions(run):
    summary = {r.entry_id: r for r in run.submission_summary.collect()}
    main = summary["main"]
    assert main.analysis_status == "REVIEW_REQUIRED"
    assert (main.expected_document_count, main.extracted_document_count, main.statement_count) == (3, 3, 3)
    assert main.all_documents_processed and main.current_mca_position_count > 0
    pages = one(run.submission_statements, "entry_id = 'main'")
    assert [s.document_index for s in pages.statements] == [1, 2, 3]
    assert summary["identical"].analysis_status == "READY"
    assert summary["identical"].average_true_deposits is not None
    for entry in ("payload", "binding_a", "binding_b"):
        assert summary[entry].analysis_status == "REVIEW_REQUIRED"
        assert summary[entry].average_true_deposits is None


def test_reconciliation_rollup(run):
    main = one(run.reconciliation_summary, "entry_id = 'main'")
    assert (main.num_transactions, main.reconciliation_mismatch_count) == (33, 0)
    assert main.all_documents_processed


def test_outputs_hold_no_private_fields(run):
    for df in (run.classified, run.positions, run.statement_summary, run.submission_statements):
        assert private_fields(df) == []
    assert private_fields(run.canonical) != []


def test_views_answer_sql(spark, run):
    names = register_views(run)
    assert len(names) == 11
    public = [n for n in names if n not in ("bank_statement_extractions_canonical", "bank_statement_calculated")]
    assert all(private_fields(spark.table(n)) == [] for n in public)
    main = spark.sql(
        "SELECT s.entry_id, s.analysis_status, (SELECT count(*) FROM submission_underwriting_statements d WHERE d.entry_id = 'main') AS n, "
        "sum(p.total_paid) AS paid FROM submission_underwriting_summary s JOIN bank_statement_mca_positions p USING (entry_id) "
        "WHERE s.entry_id = 'main' GROUP BY s.entry_id, s.analysis_status"
    ).first()
    assert (main.analysis_status, main.n) == ("REVIEW_REQUIRED", 3) and main.paid > 0
    balance = spark.sql(
        "SELECT statement.summary.calculated_end_balance AS a, element_at(statement.transactions, -1).balance AS b "
        "FROM bank_statement_calculated WHERE document_id = 'main_3'"
    ).first()
    assert balance.a == balance.b == 71825
    documents = spark.sql("SELECT document_index FROM submission_bank_statement_documents WHERE entry_id = 'overlap'").collect()
    assert len(documents) == 2
    for name in ("submission_bank_statement_summary", "submission_underwriting_summary"):
        assert spark.sql(f"SELECT max(n) AS n FROM (SELECT count(*) AS n FROM {name} GROUP BY entry_id)").first().n == 1


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT normalize_description('  Credibly---Funding  ') AS a, normalize_description('Café Ｎo1') AS b, fold_text('ß') AS c").first()
    assert (row.a, row.b, row.c) == ("CREDIBLY FUNDING", "CAFÉ NO1", "ss")


def test_customers_are_worked_on_by_all_tasks(spark, tmp_path):
    customers = spark.range(40).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "CAST(id % 25 AS INT) AS c_nationkey", "CAST(id AS DOUBLE) AS c_acctbal", "'BUILDING' AS c_mktsegment")
    customers.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks > 1
    for rows in (A.customer_payloads(spark, str(tmp_path)), A.links(spark, str(tmp_path))):
        used = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(used) == tasks and sum(r["count"] for r in used) == 40
