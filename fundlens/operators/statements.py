"""Extraction deduplication, balances and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import keys as K
from ..functions import text as T

IDENTITY = ["entry_id", "document_id", "document_index", "file_id"]
SUM = "decimal(28,2)"


def canonicalize_extractions(extractions: DataFrame) -> DataFrame:
    """Latest extraction per file with duplicate diagnostics.

    One aggregation: copies of a file collapse on the map side, so a file that
    holds a third of all rows still reaches the reducer as one row per task.
    """
    payload = K.json_digest(F.col("statement"))
    binding = K.json_digest(F.struct(*IDENTITY))
    hashed = extractions.filter(F.col("file_id").isNotNull()).select(
        *IDENTITY, "extracted_at", "statement",
        payload.alias("payload_hash"), binding.alias("binding_hash"),
    )
    # Ascending order throughout: time negated, payload digits mirrored.
    choice = F.struct(
        (-F.unix_micros("extracted_at")).alias("age"),
        F.translate("payload_hash", "0123456789abcdef", "fedcba9876543210").alias("mirror"),
        "binding_hash", "entry_id", "document_id", "document_index",
    )
    kept = F.struct("entry_id", "document_id", "document_index", "extracted_at", "statement", "payload_hash")
    grouped = hashed.groupBy("file_id").agg(
        F.min_by(kept, choice).alias("kept"),
        F.count("*").alias("duplicate_count"),
        (F.min("payload_hash") != F.max("payload_hash")).alias("duplicate_payload_conflict"),
        (F.min("binding_hash") != F.max("binding_hash")).alias("duplicate_binding_conflict"),
    )
    return grouped.select(
        "kept.entry_id", "kept.document_id", "kept.document_index", "file_id",
        "kept.extracted_at", "kept.statement", "kept.payload_hash",
        "duplicate_count", "duplicate_payload_conflict", "duplicate_binding_conflict",
    )


def with_identity(statements: DataFrame) -> DataFrame:
    """Adds folded bank, company and account texts and whether the account is
    blank, unless they are there already."""
    if "folded_account" in statements.columns:
        return statements

    def folded(name):
        return T.fold(F.coalesce(F.col(name), F.lit("")))

    return statements.select(
        "*", folded("bank_name").alias("folded_bank"), folded("company").alias("folded_company"),
        folded("account_number").alias("folded_account"), T.blank(F.col("account_number")).alias("account_blank"),
    )


FOLDED = ["folded_bank", "folded_company", "folded_account", "account_blank"]


def _total(transactions: Column, amount) -> Column:
    return F.aggregate(
        transactions,
        F.lit(0).cast(SUM),
        lambda total, t: (total + F.coalesce(amount(t["amount"]), F.lit(0))).cast(SUM),
    )


def _count(transactions: Column, condition) -> Column:
    return F.size(F.filter(transactions, condition)).cast("bigint")


def _status(calculated: Column, printed: Column) -> Column:
    return (
        F.when(printed.isNull(), "PRINTED_VALUE_MISSING")
        .when(calculated.isNull(), "CALCULATION_INCOMPLETE")
        .when(F.abs(calculated - printed) <= F.lit("0.01").cast("decimal(3,2)"), "MATCH")
        .otherwise("MISMATCH")
    )


def calculate_statements(canonical: DataFrame) -> DataFrame:
    """One row per statement: counts, calculated totals and reconciliation.

    Everything comes from the row's own transaction array, so nothing is
    exploded or shuffled here. ``transactions`` stays in reading order.
    """
    s = F.col("statement.summary")
    tx = F.col("transactions")
    read = canonical.select(
        *IDENTITY, "extracted_at", "duplicate_count", "duplicate_payload_conflict",
        "duplicate_binding_conflict",
        *[
            s[name].alias(name)
            for name in ("account_number", "bank_name", "company", "start_balance", "end_balance",
                         "statement_start_date", "statement_end_date", "total_credits", "total_debits")
        ],
        F.col("statement.transactions").alias("transactions"),
    )
    counted = with_identity(read).select(
        "*",
        F.size(tx).cast("bigint").alias("num_transactions"),
        _count(tx, lambda t: t["amount"] > 0).alias("num_credits"),
        _count(tx, lambda t: t["amount"] < 0).alias("num_debits"),
        _count(tx, lambda t: t["amount"].isNull()).alias("missing_amount_count"),
        _count(tx, lambda t: t["date"].isNull()).alias("missing_date_count"),
        _count(
            tx,
            lambda t: (t["date"] < F.col("statement_start_date")) | (t["date"] > F.col("statement_end_date")),
        ).alias("transaction_outside_period_count"),
        _total(tx, lambda a: F.when(a > 0, a)).alias("_credits"),
        _total(tx, lambda a: F.when(a < 0, -a)).alias("_debits"),
        _total(tx, lambda a: a).alias("_net"),
    )
    complete = F.col("missing_amount_count") == 0
    totals = counted.select(
        *[c for c in counted.columns if not c.startswith("_")],
        F.when(complete, F.col("_credits")).alias("calculated_total_credits"),
        F.when(complete, F.col("_debits")).alias("calculated_total_debits"),
        F.when(complete, (F.col("start_balance") + F.col("_net")).cast(SUM)).alias("calculated_end_balance"),
    )
    pairs = {
        "credits": ("calculated_total_credits", "total_credits"),
        "debits": ("calculated_total_debits", "total_debits"),
        "ending_balance": ("calculated_end_balance", "end_balance"),
    }
    return totals.select(
        "*",
        *[
            column
            for name, (calculated, printed) in pairs.items()
            for column in (
                (F.col(calculated) - F.col(printed)).cast(SUM).alias(f"{name}_difference"),
                _status(F.col(calculated), F.col(printed)).alias(f"{name}_status"),
            )
        ],
    )


def classified_account_key() -> Column:
    """Account key used for reversal pairing (the other one is in positions)."""
    return F.when(
        ~F.col("account_blank"),
        K.account_digest(F.col("entry_id"), F.col("folded_bank"), F.col("folded_account")),
    ).otherwise(K.document_digest(F.col("entry_id"), F.col("document_id")))


def with_running_balances(calculated: DataFrame) -> DataFrame:
    """Statements with their transactions in (date, reading order) and numbered,
    each with the balance after it. ``known_balance`` leaves out unknown amounts where ``balance``
    is then unknown.

    The input is partitioned by file already (it comes out of the grouping by
    file), so exploding, the running sum and the regrouping add no shuffle, and a
    file's rows all come from one input row.
    """
    ordered = F.array_sort(
        F.transform(
            "transactions",
            lambda t, i: F.struct(
                t["date"].isNull().alias("undated"), t["date"].alias("date"), i.alias("position"),
                t["description"].alias("description"), t["amount"].alias("amount"),
            ),
        )
    )
    header = [c for c in calculated.columns if c not in ("file_id", "transactions")]
    exploded = calculated.select(
        "file_id", F.struct(*header).alias("header"), F.posexplode_outer(ordered).alias("offset", "t")
    )
    running = Window.partitionBy("file_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    complete = (F.col("header.missing_amount_count") == 0) & (F.col("header.missing_date_count") == 0)
    known = (F.col("header.start_balance") + F.sum(F.coalesce("t.amount", F.lit(0))).over(running)).cast(SUM)
    lines = exploded.select(
        "file_id", "header",
        F.when(
            F.col("offset").isNotNull(),
            F.struct(
                (F.col("offset") + 1).cast("bigint").alias("transaction_index"), F.col("t.date").alias("date"),
                F.col("t.description").alias("description"), F.col("t.amount").alias("amount"),
                F.when(complete, known).alias("balance"), known.alias("known_balance"),
            ),
        ).alias("line"),
    )
    return (
        lines.groupBy("file_id")
        .agg(F.any_value("header").alias("header"), F.array_sort(F.collect_list("line")).alias("transactions"))
        .select("header.*", "file_id", "transactions")
    )


def statement_transactions(balanced: DataFrame) -> DataFrame:
    """One row per transaction; a plain explode of the balanced statements."""
    return balanced.select(
        *IDENTITY, classified_account_key().alias("account_key"), F.explode("transactions").alias("t")
    ).select(
        *IDENTITY, "account_key", "t.transaction_index", F.col("t.date").alias("transaction_date"),
        "t.description", "t.amount", "t.balance",
    )


def nest_calculated(balanced: DataFrame) -> DataFrame:
    """The nested statement record: summary, ordered transactions, reconciliation."""
    summary = F.struct(
        "account_number", "bank_name", "company", "start_balance", "end_balance",
        "statement_start_date", "statement_end_date", "total_credits", "total_debits",
        "calculated_total_credits", "calculated_total_debits", "calculated_end_balance",
        "num_credits", "num_debits", "num_transactions",
    )
    reconciliation = F.struct(
        *[f"{n}_{k}" for n in ("credits", "debits", "ending_balance") for k in ("difference", "status")]
    )
    bare = F.transform("transactions", lambda t: t.dropFields("transaction_index", "known_balance"))
    return balanced.select(
        *IDENTITY, "extracted_at",
        F.struct(summary.alias("summary"), bare.alias("transactions")).alias("statement"),
        reconciliation.alias("reconciliation"),
    )


def current_documents(ledger: DataFrame) -> DataFrame:
    """Latest ledger row of each bank statement, as one map-side aggregation."""
    newest = F.struct(
        "updated_at", (-F.col("document_index")).alias("first_index"), F.coalesce("file_id", F.lit("")).alias("file")
    )
    return (
        ledger.filter(F.col("document_type") == "bank_statement")
        .groupBy("entry_id", "document_id")
        .agg(F.max_by(F.struct("document_index", "file_id", "updated_at"), newest).alias("latest"))
        .select("entry_id", "document_id", "latest.document_index", "latest.file_id", "latest.updated_at")
    )


def submission_statement_documents(ledger_current: DataFrame, calculated: DataFrame) -> DataFrame:
    """Every expected document with its extraction, or without one."""
    received = calculated.drop("transactions").withColumn("extraction_received", F.lit(True))
    return ledger_current.join(received, IDENTITY, "left").withColumn(
        "extraction_received", F.coalesce("extraction_received", F.lit(False))
    )


def submission_statement_summary(documents: DataFrame) -> DataFrame:
    """Roll-up per entry; totals stay NULL until every document has arrived."""
    statuses = [F.col(f"{n}_status") for n in ("credits", "debits", "ending_balance")]

    def any_of(*values):
        found = F.lit(False)
        for status in statuses:
            found = found | status.isin(*values)
        return found

    all_in = F.count_if("extraction_received") == F.count("*")

    def when_complete(name, strict=False):
        condition = all_in & (F.count_if(F.col(name).isNull()) == 0) if strict else all_in
        return F.when(condition, F.sum(name)).alias(name)

    return documents.groupBy("entry_id").agg(
        F.count("*").alias("expected_document_count"),
        F.count_if("extraction_received").alias("extracted_document_count"),
        all_in.alias("all_documents_processed"),
        when_complete("num_transactions"),
        when_complete("num_credits"),
        when_complete("num_debits"),
        when_complete("calculated_total_credits", strict=True),
        when_complete("calculated_total_debits", strict=True),
        F.count_if(any_of("MISMATCH")).alias("reconciliation_mismatch_count"),
        F.count_if(any_of("PRINTED_VALUE_MISSING", "CALCULATION_INCOMPLETE")).alias(
            "incomplete_reconciliation_count"
        ),
    )
