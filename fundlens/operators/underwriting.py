"""Statement and submission summaries with explicit quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import keys as K
from ..sources.calendar import Calendar
from .statements import FOLDED, with_identity

LARGE_DEPOSIT = 10_000
LARGE_DEPOSIT_SHARE = "0.10"
NON_REVENUE = ["TRANSFER", "MCA_FUNDING", "OTHER_LOAN_PROCEEDS"]
CURRENT = ["CURRENT_PAYING", "CURRENT_WITH_MISSES"]
SUM = "decimal(28,2)"
FUNDING_LIST = f"array<struct<canonical_lender: string, deposit_date: date, amount: decimal(18,2)>>"
POSITION_LIST = (
    "array<struct<canonical_lender: string, status: string, payment_amount: decimal(20,3), "
    "frequency: string, successful_payment_count: bigint, missed_payment_count: bigint, "
    "total_paid: decimal(28,2), lender_withholding_percentage: decimal(38,2)>>"
)

# The review reasons in reporting order.
REASONS = [
    "DUPLICATE_PAYLOAD_CONFLICT",
    "BINDING_CONFLICT",
    "RECONCILIATION_MISMATCH",
    "MISSING_CALCULATION_INPUT",
    "AMBIGUOUS_NON_REVENUE",
    "MCA_CANDIDATE_UNCONFIRMED",
    "CALENDAR_COVERAGE_MISSING",
    "ACCOUNT_CONTINUITY_UNCERTAIN",
    "OVERLAPPING_STATEMENTS",
    "TRANSACTION_OUTSIDE_PERIOD",
]


def transaction_metrics(classified: DataFrame) -> DataFrame:
    """Deposit totals of each statement by how sure their nature is."""
    amount = F.col("amount")
    credit = amount > 0
    unpaired_marker = F.col("explicit_reversal_indicator") & ~F.col("is_confirmed_reversal")
    confirmed = F.col("confidence") == "CONFIRMED"
    non_revenue = credit & (
        (confirmed & F.col("classification").isin(NON_REVENUE) & ~unpaired_marker)
        | F.col("is_confirmed_reversal")
        | F.col("is_reversed_original")
    )
    ambiguous = credit & (
        (F.col("confidence") == "CANDIDATE")
        | F.col("rule_conflict")
        | (F.col("description_fingerprint") == K.EMPTY_TEXT_DIGEST)
        | unpaired_marker
    )
    funding = (
        credit & F.col("paired_reversal_transaction_id").isNull() & confirmed
        & (F.col("classification") == "MCA_FUNDING") & F.col("canonical_counterparty").isNotNull()
    )

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0)).cast(SUM)

    return classified.groupBy("entry_id", "document_id", "file_id").agg(
        total(credit).alias("known_total_deposits"),
        total(non_revenue).alias("known_confirmed_non_revenue_deposits"),
        total(ambiguous).alias("known_ambiguous_amount"),
        F.count_if(ambiguous).alias("ambiguous_non_revenue_candidate_count"),
        F.count_if(
            F.col("explicit_reversal_indicator") & F.col("paired_reversal_transaction_id").isNull()
        ).alias("unpaired_reversal_count"),
        F.count_if("rule_conflict").alias("rule_conflict_count"),
        F.array_sort(
            F.collect_list(
                F.when(
                    funding,
                    F.struct(
                        F.col("transaction_date").alias("deposit_date"),
                        F.col("canonical_counterparty").alias("canonical_lender"),
                        "amount", "transaction_id",
                    ),
                )
            )
        ).alias("funding_deposits"),
    )


def with_balance_spans(calculated: DataFrame, calendar: Calendar) -> DataFrame:
    """Adds ``_spans``: (first_day, last_day, balance) over a statement's period, one span for each change.

    Worked out inside the row in one pass over its ordered transactions: no calendar join, no shuffle
    and no work per day. NULL when the period is not valid.
    """
    low = calendar.clip_start(F.col("statement_start_date"))
    high = calendar.clip_end(F.col("statement_end_date"))
    valid = (F.col("statement_start_date") <= F.col("statement_end_date")) & (low <= high)
    last_of_day = F.filter(
        "transactions",
        lambda t, i: t["date"].isNotNull() & ~t["date"].eqNullSafe(F.get(F.col("transactions"), i + 1)["date"]),
    )
    opening = F.struct(low.alias("day"), F.col("start_balance").cast(SUM).alias("balance"))
    changes = F.transform(
        last_of_day, lambda t: F.struct(F.greatest(t["date"], low).alias("day"), t["known_balance"].alias("balance"))
    )
    points = calculated.withColumn("_points", F.when(valid, F.concat(F.array(opening), changes)))
    spans = F.transform(
        "_points",
        lambda p, i: F.struct(
            p["day"].alias("first_day"),
            F.least(F.date_sub(F.get(F.col("_points"), i + 1)["day"], 1), high).alias("last_day"),
            p["balance"].alias("balance"),
        ),
    )
    return points.withColumn("_spans", F.filter(spans, lambda s: s["first_day"] <= s["last_day"])).drop("_points")


def daily_closing_balances(calculated: DataFrame, calendar: Calendar) -> DataFrame:
    """Closing balance of every calendar day in each statement period."""
    owner = ["entry_id", "document_id", "file_id"]
    spans = with_balance_spans(calculated, calendar).select(*owner, F.explode("_spans").alias("s"))
    return spans.select(
        *owner, F.explode(F.sequence("s.first_day", "s.last_day")).alias("calendar_date"),
        F.col("s.balance").alias("closing_balance"),
    )


def with_balance_metrics(calculated: DataFrame, calendar: Calendar) -> DataFrame:
    """Statements with day count, average daily balance and negative days."""
    spans = F.col("_spans")

    def days(s):
        return F.datediff(s["last_day"], s["first_day"]) + 1

    total = F.aggregate(
        spans, F.lit(0).cast("decimal(34,2)"),
        lambda t, s: (t + s["balance"] * days(s).cast("decimal(8,0)")).cast("decimal(34,2)"),
    )
    count = F.aggregate(spans, F.lit(0), lambda n, s: n + days(s))
    negative = F.aggregate(F.filter(spans, lambda s: s["balance"] < 0), F.lit(0), lambda n, s: n + days(s))
    return with_balance_spans(calculated, calendar).select(
        *calculated.columns,
        F.coalesce(count, F.lit(0)).cast("bigint").alias("calendar_day_count"),
        # Of a sum this wide the quotient has twelve places, three more than are kept.
        (total.cast("decimal(28,2)") / count.cast("decimal(10,0)")).cast("decimal(38,9)").alias("average_daily_balance"),
        negative.cast("bigint").alias("negative_balance_days"),
    )


def statement_financials(balanced: DataFrame, metrics: DataFrame) -> DataFrame:
    """Totals and balances, NULL whenever their inputs are incomplete."""
    owner = ["entry_id", "document_id", "file_id"]
    amounts_known = F.col("missing_amount_count") == 0
    joined = balanced.drop("transactions").join(metrics, owner, "left")
    day_count = F.when(
        F.col("statement_end_date") >= F.col("statement_start_date"),
        (F.datediff("statement_end_date", "statement_start_date") + 1).cast("bigint"),
    )
    filled = joined.fillna(
        0,
        subset=[
            "known_total_deposits", "known_confirmed_non_revenue_deposits", "known_ambiguous_amount",
            "ambiguous_non_revenue_candidate_count", "unpaired_reversal_count", "rule_conflict_count",
        ],
    ).withColumn("statement_day_count", day_count)
    balances_known = (
        F.col("start_balance").isNotNull() & amounts_known
        & (F.col("missing_date_count") == 0)
        & (F.col("transaction_outside_period_count") == 0)
        & (F.col("calendar_day_count") == F.col("statement_day_count"))
    )
    true_deposits = (F.col("known_total_deposits") - F.col("known_confirmed_non_revenue_deposits")).cast(SUM)
    return (
        filled.withColumn("total_deposits", F.when(amounts_known, F.col("known_total_deposits")))
        .withColumn("confirmed_non_revenue_deposits", F.when(amounts_known, F.col("known_confirmed_non_revenue_deposits")))
        .withColumn("true_deposits", F.when(amounts_known, true_deposits))
        .withColumn("ambiguous_non_revenue_candidate_amount", F.when(amounts_known, F.col("known_ambiguous_amount")))
        .withColumn("average_daily_balance", F.when(balances_known, F.col("average_daily_balance")))
        .withColumn("negative_balance_days", F.when(balances_known, F.col("negative_balance_days")))
    )


def large_deposits(financials: DataFrame) -> DataFrame:
    """Confirmed fundings of at least 10,000 or a tenth of all deposits."""
    share = F.col("total_deposits") * F.lit(LARGE_DEPOSIT_SHARE).cast("decimal(3,2)")
    large = F.transform(
        F.filter("funding_deposits", lambda f: (f["amount"] >= LARGE_DEPOSIT) | (f["amount"] >= share)),
        lambda f: F.struct(f["canonical_lender"].alias("canonical_lender"), f["deposit_date"].alias("deposit_date"), f["amount"].alias("amount")),
    )
    return financials.withColumn(
        "large_mca_deposits", F.coalesce(large, F.array()).cast(FUNDING_LIST)
    )


def withholding(paid: Column, true_deposits: Column) -> Column:
    """Share of true deposits in percent; NULL unless deposits are positive."""
    share = F.round(
        (paid.cast("decimal(24,2)") * F.lit(100).cast("decimal(3,0)")).cast("decimal(28,2)")
        / F.when(true_deposits > 0, true_deposits.cast("decimal(28,2)")),
        2,
    )
    return share.cast("decimal(38,2)")


def statement_positions(positions: DataFrame) -> DataFrame:
    """Per statement: confirmed positions in order, amount paid, open questions."""
    confirmed = F.col("position_confidence") == "CONFIRMED"
    entry = F.struct(
        "canonical_lender", "status", "frequency", "position_key", "payment_amount",
        "successful_payment_count", "missed_payment_count", "total_paid",
    )
    return positions.groupBy("entry_id", "document_id", "file_id").agg(
        F.array_sort(F.collect_list(F.when(confirmed, entry))).alias("positions"),
        F.coalesce(F.sum(F.when(confirmed, F.col("total_paid"))), F.lit(0)).cast(SUM).alias("total_mca_payments"),
        F.count_if(~confirmed | F.col("position_review_required")).alias("mca_candidate_count"),
    )


def with_withholding(financials: DataFrame, positions: DataFrame) -> DataFrame:
    joined = financials.join(
        statement_positions(positions), ["entry_id", "document_id", "file_id"], "left"
    ).fillna(0, subset=["total_mca_payments", "mca_candidate_count"])
    listed = F.transform(
        "positions",
        lambda p: F.struct(
            *[
                p[n].alias(n)
                for n in ("canonical_lender", "status", "payment_amount", "frequency",
                          "successful_payment_count", "missed_payment_count", "total_paid")
            ],
            withholding(p["total_paid"], F.col("true_deposits")).alias("lender_withholding_percentage"),
        ),
    )
    return (
        joined.withColumn("mca_positions", F.coalesce(listed, F.array()).cast(POSITION_LIST))
        .withColumn("overall_withholding_percentage", withholding(F.col("total_mca_payments"), F.col("true_deposits")))
        .drop("positions")
    )


def account_continuity(statements: DataFrame) -> DataFrame:
    """Entries where statements without an account number cannot be chained.

    Columns used: entry_id, account_number, bank_name, company and the period.
    Works on distinct periods per entry; copies of one period are never
    consecutive, so a count above one settles the question.
    """
    valid = F.coalesce(F.col("statement_end_date") >= F.col("statement_start_date"), F.lit(False))
    rows = with_identity(statements).select(
        "entry_id", F.col("account_blank").alias("missing"), F.col("folded_bank").alias("bank"),
        F.col("folded_company").alias("company"), "statement_start_date", "statement_end_date", valid.alias("valid"),
    )
    identity = F.when(F.col("missing"), F.concat_ws("|", "bank", "company"))
    invalid = F.col("missing") & ((F.col("bank") == "") | (F.col("company") == "") | ~F.col("valid"))
    counts = rows.groupBy("entry_id").agg(
        F.count("*").alias("documents"),
        F.count_if("missing").alias("missing_accounts"),
        (F.min(identity) == F.max(identity)).alias("one_identity"),
        F.count_if(invalid).alias("invalid"),
    )
    in_order = Window.partitionBy("entry_id").orderBy("statement_start_date", "statement_end_date")
    spans = rows.filter(F.col("missing") & F.col("valid")).groupBy(
        "entry_id", "statement_start_date", "statement_end_date"
    ).agg(F.count("*").alias("copies"))
    gaps = spans.withColumn("prior", F.lag("statement_end_date").over(in_order)).groupBy("entry_id").agg(
        F.coalesce(
            F.bool_or((F.col("copies") > 1) | (F.datediff("statement_start_date", "prior") != 1)), F.lit(False)
        ).alias("broken")
    )
    chained = (
        (F.col("missing_accounts") == F.col("documents")) & F.col("one_identity")
        & (F.col("invalid") == 0) & ~F.coalesce("broken", F.lit(False))
    )
    uncertain = (F.col("documents") > 1) & (F.col("missing_accounts") > 0) & ~chained
    return counts.join(gaps, "entry_id", "left").select(
        "entry_id", F.coalesce(uncertain, F.lit(False)).alias("account_continuity_uncertain")
    )


DYADIC_LEVELS = 22  # 2**22 days reach from year 1 beyond year 9999


def _day_number(date: str) -> Column:
    return F.datediff(date, F.lit("0001-01-01").cast("date"))


def _aligned_blocks(low: Column, high: Column) -> Column:
    """The days from low to high as the fewest aligned blocks (level, place) of 2**level days each."""

    def at(level):
        first, end = F.shiftright(low + ((1 << level) - 1), level), F.shiftright(high + 1, level)
        own = F.struct(F.lit(level).alias("level"), first.alias("place"))
        last = F.struct(F.lit(level).alias("level"), (end - 1).alias("place"))
        return F.when((first < end) & (first % 2 == 1), own), F.when((first < end) & (end % 2 == 1), last)

    return F.array_compact(F.array(*[c for level in range(DYADIC_LEVELS) for c in at(level)]))


def _blocks_around(*days: Column) -> Column:
    """The aligned blocks of all sizes that hold any of the days."""
    return F.array_distinct(F.array(*[
        F.struct(F.lit(level).alias("level"), F.shiftright(day, level).alias("place")) for level in range(DYADIC_LEVELS) for day in days
    ]))


def overlapping_entries(statements: DataFrame) -> DataFrame:
    """Entries with two statements over a common day for compatible accounts.

    Accounts are compatible when either is blank or both agree with their bank. A period is cut into
    aligned blocks of days; two periods meet exactly when one fills a block that holds an end of the
    other, or fills it too. So a period of any length has some dozens of rows, and counting distinct
    documents per block aggregates on the map side and never forms pairs. Periods that end before
    they start touch a normal period only when it contains them; those few rows are joined by blocks.
    """
    rows = with_identity(statements).select(
        "entry_id", F.struct("document_index", "document_id").alias("document"),
        F.col("account_blank").alias("blank"), F.col("folded_account").alias("account"), F.col("folded_bank").alias("bank"),
        _day_number("statement_start_date").alias("low"), _day_number("statement_end_date").alias("high"),
    )
    normal = rows.filter(F.col("low") <= F.col("high"))
    filled = normal.withColumn("block", F.explode(_aligned_blocks(F.col("low"), F.col("high")))).withColumn("fills", F.lit(True))
    held = normal.withColumn("block", F.explode(_blocks_around(F.col("low"), F.col("high")))).withColumn("fills", F.lit(False))
    touched = filled.unionByName(held)

    def documents(*conditions):
        """Least and greatest document of the rows that meet all conditions."""
        chosen = F.col("document")
        for condition in conditions:
            chosen = F.when(condition, chosen)
        return F.min(chosen), F.max(chosen)

    def several(one, other=None):
        other = other or one
        return F.least(one[0], other[0]) != F.greatest(one[1], other[1])

    fills, blank = F.col("fills"), F.col("blank")
    anyone, blanks = documents(), documents(blank)
    filling, blank_filling = documents(fills), documents(fills, blank)
    with_blank = touched.groupBy("entry_id", "block").agg(
        (
            (blank_filling[0].isNotNull() & several(anyone))
            | (filling[0].isNotNull() & blanks[0].isNotNull() & several(filling, blanks))
        ).alias("hit")
    )
    same_account = touched.filter(~blank).groupBy("entry_id", "bank", "account", "block").agg(
        (filling[0].isNotNull() & several(anyone)).alias("hit")
    )

    backward = rows.filter(F.col("low") > F.col("high")).withColumn("block", F.explode(_blocks_around(F.col("high")))).alias("b")
    compatible = (
        F.col("b.blank") | F.col("n.blank")
        | ((F.col("b.account") == F.col("n.account")) & (F.col("b.bank") == F.col("n.bank")))
    )
    contained = backward.join(
        filled.alias("n"),
        (F.col("b.entry_id") == F.col("n.entry_id")) & (F.col("b.block") == F.col("n.block"))
        & (F.col("n.high") >= F.col("b.low")) & (F.col("b.document") != F.col("n.document")) & compatible,
        "left_semi",
    )
    hits = (
        with_blank.filter("hit").select("entry_id")
        .unionByName(same_account.filter("hit").select("entry_id"))
        .unionByName(contained.select("entry_id"))
    )
    return hits.distinct()


def _reasons(conditions: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(conditions[r], r) for r in REASONS]))


def quality_reasons(enriched: DataFrame, continuity: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Ordered review reasons of each statement; READY when there are none."""
    statuses = [F.col(f"{n}_status") for n in ("credits", "debits", "ending_balance")]

    def any_status(*values):
        found = F.lit(False)
        for status in statuses:
            found = found | status.isin(*values)
        return found

    flagged = enriched.join(continuity, "entry_id", "left").join(
        overlaps.withColumn("overlapping", F.lit(True)), "entry_id", "left"
    )
    conditions = {
        "DUPLICATE_PAYLOAD_CONFLICT": F.col("duplicate_payload_conflict"),
        "BINDING_CONFLICT": F.col("duplicate_binding_conflict"),
        "RECONCILIATION_MISMATCH": any_status("MISMATCH"),
        "MISSING_CALCULATION_INPUT": F.col("start_balance").isNull()
        | F.col("statement_day_count").isNull()
        | (F.col("missing_amount_count") > 0)
        | (F.col("missing_date_count") > 0)
        | any_status("CALCULATION_INCOMPLETE", "PRINTED_VALUE_MISSING"),
        "AMBIGUOUS_NON_REVENUE": (F.col("ambiguous_non_revenue_candidate_count") > 0)
        | (F.col("unpaired_reversal_count") > 0)
        | (F.col("rule_conflict_count") > 0),
        "MCA_CANDIDATE_UNCONFIRMED": F.col("mca_candidate_count") > 0,
        "CALENDAR_COVERAGE_MISSING": F.col("statement_day_count").isNull()
        | (F.col("calendar_day_count") != F.col("statement_day_count")),
        "ACCOUNT_CONTINUITY_UNCERTAIN": F.col("account_continuity_uncertain"),
        "OVERLAPPING_STATEMENTS": F.col("overlapping"),
        "TRANSACTION_OUTSIDE_PERIOD": F.col("transaction_outside_period_count") > 0,
    }
    return flagged.withColumn("quality_reasons", _reasons(conditions)).withColumn(
        "quality_status", F.when(F.size("quality_reasons") == 0, "READY").otherwise("REVIEW_REQUIRED")
    )


STATEMENT_SUMMARY = [
    "entry_id", "document_id", "document_index", "file_id", "extracted_at",
    "statement_start_date", "statement_end_date", "statement_day_count", "total_deposits",
    "confirmed_non_revenue_deposits", "true_deposits", "ambiguous_non_revenue_candidate_amount",
    "average_daily_balance", "negative_balance_days", "large_mca_deposits", "mca_positions",
    "total_mca_payments", "overall_withholding_percentage", "quality_status", "quality_reasons",
    "duplicate_count", "duplicate_payload_conflict", "duplicate_binding_conflict",
]


def statement_underwriting_summary(
    calculated: DataFrame, classified: DataFrame, positions: DataFrame, calendar: Calendar
) -> DataFrame:
    """One row per canonical statement, without account numbers or descriptions."""
    financials = statement_financials(with_balance_metrics(calculated, calendar), transaction_metrics(classified))
    enriched = with_withholding(large_deposits(financials), positions)
    graded = quality_reasons(enriched, account_continuity(calculated), overlapping_entries(calculated))
    return graded.select(*STATEMENT_SUMMARY)


def submission_documents(
    current: DataFrame, calculated: DataFrame, summary: DataFrame
) -> DataFrame:
    """Every expected document of a submission with its figures and final reasons.

    The extraction is looked up by file alone: a file bound to another entry or
    document counts as received but stays without figures and in conflict.
    """
    found = with_identity(calculated).select(
        "file_id", F.col("entry_id").alias("found_entry"), F.col("document_id").alias("found_document"),
        F.col("document_index").alias("found_index"), F.col("duplicate_payload_conflict").alias("payload_conflict"),
        F.col("duplicate_binding_conflict").alias("binding"), *FOLDED,
    )
    owner = ["entry_id", "document_id", "file_id"]
    received = F.col("found_entry").isNotNull()
    conflict = F.coalesce("binding", F.lit(False)) | (
        received
        & (
            (F.col("found_entry") != F.col("entry_id"))
            | (F.col("found_document") != F.col("document_id"))
            | (F.col("found_index") != F.col("document_index"))
        )
    )
    base = (
        current.select("entry_id", "document_id", "document_index", "file_id")
        .join(found, "file_id", "left")
        .join(summary.drop("document_index", "quality_status", "duplicate_payload_conflict", "duplicate_binding_conflict"), owner, "left")
        .withColumn("extraction_received", received)
        .withColumn("binding_conflict", conflict)
        .withColumn("payload_conflict", F.coalesce("payload_conflict", F.lit(False)))
    )
    # Account details count only where the file belongs to this document.
    own = (F.col("found_entry") == F.col("entry_id")) & (F.col("found_document") == F.col("document_id"))
    absent = {"account_blank": F.lit(True)}
    for name in FOLDED:
        base = base.withColumn(name, F.when(own, F.col(name)).otherwise(absent.get(name, F.lit(""))))
    arrived = base.filter("extraction_received")
    continuity = account_continuity(arrived)
    overlaps = overlapping_entries(arrived).withColumn("overlapping", F.lit(True))
    flagged = base.join(continuity, "entry_id", "left").join(overlaps, "entry_id", "left")

    conditions = {reason: F.array_contains("quality_reasons", reason) for reason in REASONS}
    conditions["DUPLICATE_PAYLOAD_CONFLICT"] = F.col("payload_conflict") | F.coalesce(conditions["DUPLICATE_PAYLOAD_CONFLICT"], F.lit(False))
    conditions["BINDING_CONFLICT"] = F.col("binding_conflict") | F.coalesce(conditions["BINDING_CONFLICT"], F.lit(False))
    conditions["ACCOUNT_CONTINUITY_UNCERTAIN"] = F.col("account_continuity_uncertain")
    conditions["OVERLAPPING_STATEMENTS"] = F.col("overlapping")
    status = (
        F.when(~F.col("extraction_received"), "PROCESSING")
        .when(F.size("quality_reasons") > 0, "REVIEW_REQUIRED")
        .otherwise("READY")
    )
    return (
        flagged.withColumn("quality_reasons", _reasons(conditions))
        .withColumn("quality_status", status)
        .withColumn("large_mca_deposits", F.coalesce("large_mca_deposits", F.array().cast(FUNDING_LIST)))
        .withColumn("mca_positions", F.coalesce("mca_positions", F.array().cast(POSITION_LIST)))
        .select(*SUBMISSION_DOCUMENT)
    )


SUBMISSION_DOCUMENT = [
    "entry_id", "document_id", "document_index", "file_id", "extraction_received",
    "statement_start_date", "statement_end_date", "statement_day_count", "total_deposits",
    "confirmed_non_revenue_deposits", "true_deposits", "ambiguous_non_revenue_candidate_amount",
    "average_daily_balance", "negative_balance_days", "large_mca_deposits", "mca_positions",
    "total_mca_payments", "overall_withholding_percentage", "quality_status", "quality_reasons",
    "payload_conflict", "binding_conflict",
]


def current_position_counts(positions: DataFrame) -> DataFrame:
    keys = positions.filter(
        (F.col("position_confidence") == "CONFIRMED") & F.col("status").isin(CURRENT)
    ).select("entry_id", "position_key").distinct()
    return keys.groupBy("entry_id").agg(F.count("*").alias("current_positions"))


def submission_underwriting_summary(documents: DataFrame, positions: DataFrame, version: int = 1) -> DataFrame:
    """Roll-up per submission, one row each; its statements are the rows of ``documents``."""
    processed = F.count_if("extraction_received") == F.count("*")
    clean = F.count_if(F.col("payload_conflict") | F.col("binding_conflict")) == 0

    def gated(name, value):
        return F.when(F.col("usable") & (F.col(f"missing_{name}") == 0), F.col(value))

    grouped = documents.groupBy("entry_id").agg(
        F.count("*").alias("expected_document_count"),
        F.count_if("extraction_received").alias("extracted_document_count"),
        processed.alias("all_documents_processed"),
        (processed & clean).alias("usable"),
        (F.count_if(F.col("quality_status") == "REVIEW_REQUIRED") > 0).alias("review_required"),
        F.count_if(F.col("total_deposits").isNull()).alias("missing_total"),
        F.count_if(F.col("true_deposits").isNull()).alias("missing_true"),
        F.count_if(F.col("negative_balance_days").isNull()).alias("missing_negative"),
        (F.sum("total_deposits") / F.count("total_deposits")).cast("decimal(38,9)").alias("average_total"),
        (F.sum("true_deposits") / F.count("true_deposits")).cast("decimal(38,9)").alias("average_true"),
        F.sum("negative_balance_days").alias("negative_days"),
    )
    return grouped.join(current_position_counts(positions), "entry_id", "left").select(
        "entry_id",
        F.lit(version).cast("bigint").alias("analysis_version"),
        F.when(~F.col("all_documents_processed"), "PROCESSING")
        .when(F.col("review_required"), "REVIEW_REQUIRED")
        .otherwise("READY")
        .alias("analysis_status"),
        "expected_document_count", "extracted_document_count", "all_documents_processed",
        F.when(F.col("usable"), F.col("extracted_document_count")).alias("statement_count"),
        gated("total", "average_total").alias("average_statement_deposits"),
        gated("true", "average_true").alias("average_true_deposits"),
        gated("negative", "negative_days").alias("total_negative_balance_days"),
        F.when(F.col("usable"), F.coalesce("current_positions", F.lit(0))).alias("current_mca_position_count"),
    )


# Field names that must not reach a public output.
PRIVATE_FIELDS = ["description", "account_number"]


def private_fields(df: DataFrame) -> list[str]:
    """Paths in the schema that end in a private field name; empty when safe."""
    found: list[str] = []

    def walk(kind, path):
        if isinstance(kind, ArrayType):
            walk(kind.elementType, path)
        elif isinstance(kind, StructType):
            for field in kind.fields:
                inner = f"{path}.{field.name}" if path else field.name
                if field.name in PRIVATE_FIELDS:
                    found.append(inner)
                walk(field.dataType, inner)

    walk(df.schema, "")
    return found
