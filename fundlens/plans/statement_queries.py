"""Registered queries over the statement chain, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import underwriting as U
from ..operators.running import running_totals
from ..sources.calendar import Calendar
from . import statement_tables as tables
from .present import shape, wrap
from .statement_oracle import chained
from .underwriting import Underwriting

_chains: dict[tuple[str, str], Underwriting] = {}


def chain(spark: SparkSession, sf_dir: str, fresh: bool = False) -> Underwriting:
    """The staged chain of one session and folder; later queries reuse its tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if fresh or key not in _chains:
        built = Underwriting(tables.extractions(spark, sf_dir), tables.ledger(spark, sf_dir))
        if fresh:
            return built
        _chains[key] = built
    return _chains[key]


QUERIES: dict[str, tuple] = {}


def register(name: str, spec: str, sql: str | None):
    def wrapper(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # all stored times are UTC
            return shape(build(spark, sf_dir), spec)

        QUERIES[name] = (run, wrap(sql, spec) if sql else None)
        return build

    return wrapper


def from_chain(name: str, spec: str, sql: str):
    """Register a query that only needs the chain."""
    def wrapper(build):
        register(name, spec, chained(sql))(lambda spark, sf_dir: build(chain(spark, sf_dir)))
        return build

    return wrapper


@from_chain(
    "canonical_extractions",
    "file_id:s entry_id:s document_id:s document_index:n start_balance:m duplicate_count:n payload_conflict:b binding_conflict:b",
    "SELECT * FROM canon",
)
def _(u):
    return u.canonical.select(
        "*", "statement.summary.start_balance",
        F.col("duplicate_payload_conflict").alias("payload_conflict"),
        F.col("duplicate_binding_conflict").alias("binding_conflict"),
    )


@from_chain(
    "calculated_statements",
    "file_id:s num_transactions:n num_credits:n num_debits:n missing_amounts:n missing_dates:n calc_credits:m calc_debits:m "
    "calc_end:m credits_difference:m debits_difference:m ending_balance_difference:m credits_status:s debits_status:s ending_balance_status:s",
    "SELECT * FROM calc",
)
def _(u):
    return u.calculated.withColumnsRenamed({
        "missing_amount_count": "missing_amounts", "missing_date_count": "missing_dates",
        "calculated_total_credits": "calc_credits", "calculated_total_debits": "calc_debits",
        "calculated_end_balance": "calc_end",
    })


@from_chain(
    "running_balances",
    "file_id:s idx:n txn_date:d description:s amount:m balance:m",
    """SELECT t.*, CASE WHEN missing_amounts = 0 AND missing_dates = 0 THEN start_balance
         + sum(t.amount) OVER (PARTITION BY file_id ORDER BY idx ROWS UNBOUNDED PRECEDING) END AS balance
       FROM tx t JOIN calc USING (file_id)""",
)
def _(u):
    return u.transactions.withColumnsRenamed({"transaction_index": "idx", "transaction_date": "txn_date"})


@from_chain(
    "out_of_period_transactions", "file_id:s outside:n", "SELECT file_id, outside FROM calc",
)
def _(u):
    return u.calculated.withColumnRenamed("transaction_outside_period_count", "outside")


@from_chain(
    "normalized_descriptions", "words:s transactions:n", "SELECT words, count(*) AS transactions FROM worded GROUP BY words",
)
def _(u):
    words = T.normalize_description(F.col("description")).alias("words")
    return u.transactions.groupBy(words).agg(F.count("*").alias("transactions"))


@from_chain(
    "rule_matches",
    "tid:s way:s rule_ids:s matched_priority:n",
    "SELECT tid, way, rule_ids, matched_priority FROM resolved",
)
def _(u):
    return u.resolved.select(
        F.col("transaction_id").alias("tid"), F.col("direction").alias("way"),
        F.array_join("matched_rule_ids", ",").alias("rule_ids"), "matched_priority",
    )


@from_chain(
    "resolved_transactions",
    "tid:s account_key:s classification:s confidence:s counterparty:s conflict:b is_marker:b fingerprint:s party:s",
    "SELECT * FROM resolved",
)
def _(u):
    return u.resolved.withColumnsRenamed({
        "transaction_id": "tid", "canonical_counterparty": "counterparty", "rule_conflict": "conflict",
        "explicit_reversal_indicator": "is_marker", "description_fingerprint": "fingerprint",
        "candidate_counterparty_fingerprint": "party",
    })


@from_chain("rule_usage", "rule_id:s classification:s transactions:n",
            """SELECT r.rule_id, r.classification, count(h.tid) AS transactions FROM rules r LEFT JOIN hit h USING (rule_id) GROUP BY ALL""")
def _(u):
    used = u.resolved.select(F.explode("matched_rule_ids").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))
    return u.rules.join(used, "rule_id", "left").withColumn("transactions", F.coalesce("n", F.lit(0)))


@from_chain("current_documents", "entry_id:s document_id:s document_index:n file_id:s", "SELECT * FROM cur")
def _(u):
    return u.current


@from_chain(
    "reversal_pairs", "rev_tid:s org_tid:s", "SELECT rev_tid, org_tid FROM pair",
)
def _(u):
    return u.pairs.withColumnsRenamed({"reversal_transaction_id": "rev_tid", "original_transaction_id": "org_tid"})


@from_chain(
    "classified_transactions",
    "tid:s file_id:s txn_date:d amount:m classification:s partner:s is_reversal:b is_original:b is_reversed_payment:b",
    "SELECT * FROM classified",
)
def _(u):
    return u.classified.withColumnsRenamed({
        "transaction_id": "tid", "transaction_date": "txn_date", "paired_reversal_transaction_id": "partner",
        "is_confirmed_reversal": "is_reversal", "is_reversed_original": "is_original",
    })


@from_chain("account_identity", "file_id:s account_key:s start_date:d end_date:d", "SELECT * FROM period")
def _(u):
    return u.periods.withColumnsRenamed({"statement_start_date": "start_date", "statement_end_date": "end_date"})


@from_chain(
    "payment_events", "tid:s account_key:s base:s kind:s paid:m good:b", "SELECT * FROM moved_money WHERE kind IS NOT NULL",
)
def _(u):
    return u.events.withColumnsRenamed({
        "transaction_id": "tid", "base_position_key": "base", "event_type": "kind", "payment_amount": "paid", "successful": "good",
    })


@from_chain(
    "funding_epochs", "tid:s epoch:n next_funding:d", "SELECT tid, epoch, next_funding FROM epoch WHERE kind = 'PAYMENT'",
)
def _(u):
    from ..operators.positions import epoch_payments
    return epoch_payments(u.epochs).withColumnsRenamed({
        "transaction_id": "tid", "funding_epoch": "epoch", "next_funding_date": "next_funding",
    })


@from_chain("amount_streams", "tid:s epoch:n stream:n pos:s", "SELECT tid, epoch, stream, pos FROM stream")
def _(u):
    return u.streams.withColumnsRenamed({
        "transaction_id": "tid", "funding_epoch": "epoch", "amount_stream": "stream", "position_key": "pos",
    })


@from_chain("median_payment", "pos:s median:m payments:n steady_payments:n",
            """SELECT pos, max(median) AS median, count(*) FILTER (WHERE good) AS payments, count(*) FILTER (WHERE steady) AS steady_payments
               FROM pay GROUP BY pos""")
def _(u):
    return u.payments.groupBy(F.col("position_key").alias("pos")).agg(
        F.max("representative_payment_amount").alias("median"), F.count_if("successful").alias("payments"),
        F.count_if("is_consistent").alias("steady_payments"),
    )


@from_chain(
    "positions",
    "pos:s lender:s n:n total_paid:m d0:d d1:d changes:n frequency:s span:n steady_days:n grade:s review:b until:d",
    "SELECT * EXCLUDE (lender), coalesce(lender, 'Unknown recurring debit') AS lender FROM posn",
)
def _(u):
    return u.graded_positions.withColumnsRenamed({
        "position_key": "pos", "canonical_lender": "lender", "successful_payment_count": "n", "first_payment_date": "d0",
        "last_payment_date": "d1", "unresolved_amount_change_count": "changes", "business_days_in_span": "span",
        "position_confidence": "grade", "position_review_required": "review", "latest_statement_end_date": "until",
    }).withColumn("steady_days", F.coalesce("business_payment_days", F.lit(0)))


@from_chain("expected_schedule", "pos:s due:d due_ord:n file_id:s met:b", "SELECT * FROM plan")
def _(u):
    return u.schedule.withColumnsRenamed({
        "position_key": "pos", "expected_date": "due", "expected_ordinal": "due_ord", "matched": "met",
    })


@from_chain("position_status", "pos:s frequency:s status:s", "SELECT * FROM status")
def _(u):
    return u.statuses.withColumnRenamed("position_key", "pos")


@from_chain(
    "mca_positions",
    "pos:s file_id:s document_id:s document_index:n lender:s grade:s review:b status:s median:m frequency:s n:n missed:n total_paid:m d0:d d1:d",
    "SELECT * FROM mca",
)
def _(u):
    return u.positions.withColumnsRenamed({
        "position_key": "pos", "canonical_lender": "lender", "position_confidence": "grade", "position_review_required": "review",
        "payment_amount": "median", "successful_payment_count": "n", "missed_payment_count": "missed",
        "first_payment_date": "d0", "last_payment_date": "d1",
    })


@from_chain(
    "transaction_metrics", "file_id:s deposits:m non_revenue:m unclear:m unclear_n:n unpaired:n conflicts:n", "SELECT * FROM metric",
)
def _(u):
    return U.transaction_metrics(u.classified).withColumnsRenamed({
        "known_total_deposits": "deposits", "known_confirmed_non_revenue_deposits": "non_revenue", "known_ambiguous_amount": "unclear",
        "ambiguous_non_revenue_candidate_count": "unclear_n", "unpaired_reversal_count": "unpaired", "rule_conflict_count": "conflicts",
    })


@from_chain("daily_closing_balances", "file_id:s day:d balance:m", "SELECT * FROM closing")
def _(u):
    return U.daily_closing_balances(u.calculated, u.calendar).withColumnsRenamed({"calendar_date": "day", "closing_balance": "balance"})


@from_chain("average_daily_balance", "file_id:s days:n average:x negative:n", "SELECT * FROM closed")
def _(u):
    return U.with_balance_metrics(u.calculated, u.calendar).withColumnsRenamed({
        "calendar_day_count": "days", "average_daily_balance": "average", "negative_balance_days": "negative",
    })


@from_chain(
    "statement_financials",
    "file_id:s total_deposits:m confirmed_non_revenue:m true_deposits:m ambiguous:m adb:x negative_days:n span:n days:n",
    "SELECT * FROM fin",
)
def _(u):
    balanced = U.with_balance_metrics(u.calculated, u.calendar)
    return U.statement_financials(balanced, U.transaction_metrics(u.classified)).withColumnsRenamed({
        "confirmed_non_revenue_deposits": "confirmed_non_revenue", "ambiguous_non_revenue_candidate_amount": "ambiguous",
        "average_daily_balance": "adb", "negative_balance_days": "negative_days", "statement_day_count": "span",
        "calendar_day_count": "days",
    })


@from_chain("large_deposits", "file_id:s lender:s txn_date:d amount:m", "SELECT * FROM large")
def _(u):
    return u.statement_summary.select("file_id", F.explode("large_mca_deposits").alias("d")).select(
        "file_id", F.col("d.canonical_lender").alias("lender"), F.col("d.deposit_date").alias("txn_date"), "d.amount"
    )


@from_chain(
    "lender_withholding", "file_id:s lender:s status:s total_paid:m share:m",
    """SELECT file_id, lender, status, m.total_paid,
         CASE WHEN true_deposits > 0 THEN round(m.total_paid * 100 / true_deposits, 2) END AS share
       FROM mca m JOIN fin USING (file_id) WHERE grade = 'CONFIRMED'""",
)
def _(u):
    return u.statement_summary.select("file_id", F.explode("mca_positions").alias("p")).select(
        "file_id", F.col("p.canonical_lender").alias("lender"), "p.status", "p.total_paid",
        F.col("p.lender_withholding_percentage").alias("share"),
    )


@from_chain("account_continuity", "entry_id:s uncertain:b", "SELECT * FROM continuity")
def _(u):
    return U.account_continuity(u.calculated).withColumnRenamed("account_continuity_uncertain", "uncertain")


@from_chain("overlapping_statements", "entry_id:s", "SELECT * FROM overlap")
def _(u):
    return U.overlapping_entries(u.calculated)


@from_chain(
    "quality_reasons", "file_id:s reasons:l quality_status:s",
    "SELECT file_id, reasons, CASE WHEN len(reasons) = 0 THEN 'READY' ELSE 'REVIEW_REQUIRED' END AS quality_status FROM graded",
)
def _(u):
    return u.statement_summary.withColumnRenamed("quality_reasons", "reasons")


@from_chain(
    "statement_underwriting_summary",
    "entry_id:s file_id:s start_date:d end_date:d total_deposits:m true_deposits:m adb:x negative_days:n confirmed_n:n mca_paid:m withheld:m "
    "reasons:l duplicate_count:n",
    "SELECT * FROM graded",
)
def _(u):
    return u.statement_summary.withColumnsRenamed({
        "statement_start_date": "start_date", "statement_end_date": "end_date", "average_daily_balance": "adb",
        "negative_balance_days": "negative_days", "total_mca_payments": "mca_paid",
        "overall_withholding_percentage": "withheld", "quality_reasons": "reasons",
    }).withColumn("confirmed_n", F.size("mca_positions"))


@from_chain(
    "submission_documents",
    "entry_id:s document_id:s document_index:n file_id:s received:b total_deposits:m quality_status:s reasons:l payload_conflict:b binding_conflict:b",
    "SELECT * FROM doc",
)
def _(u):
    return u.submission_documents.withColumnsRenamed({"extraction_received": "received", "quality_reasons": "reasons"})


@from_chain(
    "submission_underwriting_summary",
    "entry_id:s analysis_status:s expected:n arrived:n whole:b statement_count:n average_deposits:x average_true:x negative_days:n paying:n",
    """SELECT s.*, CASE WHEN NOT whole THEN 'PROCESSING' WHEN review THEN 'REVIEW_REQUIRED' ELSE 'READY' END AS analysis_status,
         CASE WHEN usable THEN arrived END AS statement_count, CASE WHEN usable THEN coalesce(p.paying, 0) END AS paying
       FROM sub s LEFT JOIN now_paying p USING (entry_id)""",
)
def _(u):
    return u.submission_summary.withColumnsRenamed({
        "expected_document_count": "expected", "extracted_document_count": "arrived", "all_documents_processed": "whole",
        "average_statement_deposits": "average_deposits", "average_true_deposits": "average_true",
        "total_negative_balance_days": "negative_days", "current_mca_position_count": "paying",
    })


@from_chain(
    "submission_statement_rows", "entry_id:s document_id:s document_index:n quality_status:s",
    "SELECT entry_id, document_id, document_index, quality_status FROM doc",
)
def _(u):
    return u.submission_rows


@from_chain(
    "submission_statement_pages", "entry_id:s page:n statements:n order_text:s statuses:s",
    """SELECT entry_id, 0 AS page, count(*) AS statements, string_agg(document_id, ',' ORDER BY document_index, document_id) AS order_text,
         string_agg(quality_status, ',' ORDER BY document_index, document_id) AS statuses
       FROM doc GROUP BY entry_id""",
)
def _(u):
    return u.submission_statements.select(
        "entry_id", "page", F.size("statements").alias("statements"),
        F.array_join("statements.document_id", ",").alias("order_text"),
        F.array_join("statements.quality_status", ",").alias("statuses"),
    )


@from_chain(
    "submission_statement_summary",
    "entry_id:s expected:n arrived:n whole:b num_transactions:n credits:m debits:m mismatches:n incomplete:n",
    """SELECT entry_id, count(*) AS expected, count(c.file_id) AS arrived, expected = arrived AS whole,
         CASE WHEN whole THEN sum(num_transactions) END AS num_transactions,
         CASE WHEN whole AND count(calc_credits) = count(*) THEN sum(calc_credits) END AS credits,
         CASE WHEN whole AND count(calc_debits) = count(*) THEN sum(calc_debits) END AS debits,
         count(*) FILTER (WHERE 'MISMATCH' IN (credits_status, debits_status, ending_balance_status)) AS mismatches,
         count(*) FILTER (WHERE 'PRINTED_VALUE_MISSING' IN (credits_status, debits_status, ending_balance_status)
           OR 'CALCULATION_INCOMPLETE' IN (credits_status, debits_status, ending_balance_status)) AS incomplete
       FROM cur s LEFT JOIN calc c USING (entry_id, document_id, document_index, file_id) GROUP BY entry_id""",
)
def _(u):
    return u.reconciliation_summary.withColumnsRenamed({
        "expected_document_count": "expected", "extracted_document_count": "arrived", "all_documents_processed": "whole",
        "calculated_total_credits": "credits", "calculated_total_debits": "debits",
        "reconciliation_mismatch_count": "mismatches", "incomplete_reconciliation_count": "incomplete",
    })


@register(
    "business_calendar_orders",
    "day:d business:b weekend:b holiday_name:s ord:n orders:n",
    chained("""SELECT c.day, business, weekend, holiday_name, ord, coalesce(n, 0) AS orders
      FROM cal c LEFT JOIN (SELECT CAST(o_orderdate + INTERVAL 24 YEAR AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) USING (day)"""),
)
def _(spark, sf_dir):
    calendar = Calendar()
    orders = tables.read(spark, sf_dir, "orders").select(
        F.add_months(F.to_date("o_orderdate"), 24 * 12).alias("calendar_date")
    )
    per_day = orders.groupBy("calendar_date").agg(F.count("*").alias("orders"))
    return (
        calendar.days(spark).join(calendar.ordinals(spark).drop("is_business_day"), "calendar_date")
        .join(per_day, "calendar_date", "left")
        .select(
            F.col("calendar_date").alias("day"), F.col("is_business_day").alias("business"),
            F.col("is_weekend").alias("weekend"), "holiday_name", F.col("business_day_ordinal").alias("ord"),
            F.coalesce("orders", F.lit(0)).alias("orders"),
        )
    )


@register(
    "running_order_totals",
    "o_custkey:n o_orderkey:n number:n spent:n",
    """SELECT o_custkey, o_orderkey,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS number,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS spent
       FROM orders""",
)
def _(spark, sf_dir):
    orders = tables.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return running_totals(orders, ["o_custkey"], ["o_orderdate"], ["o_orderkey"], {"number": F.lit(1), "spent": cents})
