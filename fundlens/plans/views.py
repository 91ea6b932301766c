"""The results as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import statements as S
from .underwriting import Underwriting

# The view names and the columns their users select.
CLASSIFIED = [
    "entry_id", "document_id", "document_index", "file_id", "account_key", "transaction_index",
    "transaction_id", "transaction_date", "amount", "balance", "direction", "description_fingerprint",
    "candidate_counterparty_fingerprint", "matched_rule_ids", "matched_priority", "classification",
    "confidence", "canonical_counterparty", "rule_conflict", "explicit_reversal_indicator",
    "paired_reversal_transaction_id", "is_confirmed_reversal", "is_reversed_original",
    "is_reversed_payment",
]
STATEMENT_DOCUMENT = [
    "document_id", "document_index", "file_id", "extraction_received", "extracted_at",
    "statement_start_date", "statement_end_date", "num_transactions", "num_credits", "num_debits",
    "calculated_total_credits", "calculated_total_debits", "calculated_end_balance",
    "credits_status", "debits_status", "ending_balance_status",
]


def view_frames(u: Underwriting) -> dict[str, DataFrame]:
    """Frames by view name. A submission has one row in its summaries; its statements and documents, in the order of
    ``document_index``, are rows of views of their own, whatever their number."""
    return {
        "bank_statement_extractions_canonical": u.canonical,
        "bank_statement_calculated": S.nest_calculated(u.calculated),
        "submission_bank_statement_summary": u.reconciliation_summary,
        "submission_bank_statement_documents": S.submission_statement_documents(u.current, u.calculated).select("entry_id", *STATEMENT_DOCUMENT),
        "bank_statement_transactions_classified": u.classified.select(*CLASSIFIED).withColumnRenamed("balance", "calculated_balance"),
        "bank_statement_mca_positions": u.positions,
        "bank_statement_underwriting_summary": u.statement_summary,
        "submission_underwriting_summary": u.submission_summary,
        "submission_underwriting_statements": u.submission_rows,
        "bank_transaction_rules": u.rules,
        "bank_business_calendar": u.calendar.days(u.spark),
    }


def register_views(u: Underwriting) -> list[str]:
    """Temporary views for ``spark.sql``; returns their names."""
    frames = view_frames(u)
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return list(frames)

